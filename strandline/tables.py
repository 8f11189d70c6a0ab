"""Reading the named parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """The rows of a table that must stay small, such as a list of kinds.

    Reads at most ``most + 1`` rows, and refuses a larger table instead of collecting it.
    """
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows; it is meant to be a small list")
    return rows
