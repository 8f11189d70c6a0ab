"""Blocks and features written as the formats that consumers of the specs expect."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.plans.spec import Aggregate


def iso_text(c: Column) -> Column:
    """An instant as ISO text with offset, microseconds only where there are any."""
    micro = F.when(F.pmod(F.unix_micros(c), F.lit(1_000_000)) == 0, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return F.concat(micro, F.lit("+00:00"))


def _encoded(c: Column, kind: str) -> Column:
    """A value as its JSON shows it: instants as ISO text; of decimals, whole ones as numbers without a point, others as floats."""
    if kind == "timestamp":
        return iso_text(c)
    if kind == "decimal":
        whole = c == F.floor(c)
        return F.parse_json(F.when(whole, c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("double").cast("string")))
    return c


def block_key(agg: Aggregate) -> Column:
    """``identity/aggregate/dim1:dim2/time``; the time is that of the start, for sessions only."""
    dims = F.concat_ws(":", *(F.col(f"`{d.name}`").cast("string") for d in agg.dimensions)) if agg.dimensions else F.lit("")
    time = iso_text(F.col("_start_time")) if agg.kind == "activity" else F.lit("")
    return F.concat_ws("/", F.col("_identity"), F.lit(agg.name), dims, time)


def block_lines(blocks: DataFrame, agg: Aggregate) -> DataFrame:
    """One line per block, ``["key", {snapshot}]``, as ``value``. Fields without a value are null in it."""
    snapshot = F.struct(*(_encoded(F.col(f"`{f.name}`"), f.dataType.typeName()).alias(f.name) for f in blocks.schema))
    return blocks.select(F.concat(F.lit("["), F.to_json(F.struct(block_key(agg).alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(block_key(agg).alias("k")))) - 6), F.lit(", "), F.to_json(snapshot, {"ignoreNullFields": "false"}), F.lit("]")).alias("value"))


def write_blocks(blocks: dict[str, DataFrame], aggregates: dict[str, Aggregate], path: str) -> None:
    """All blocks as JSON lines under ``path``."""
    out = None
    for name, df in blocks.items():
        lines = block_lines(df, aggregates[name])
        out = lines if out is None else out.unionByName(lines)
    if out is not None:
        out.write.text(path)


def feature_columns(features: DataFrame) -> list[str]:
    """The names of a feature row, sorted: its fields, and for each aggregate ``<aggregate>._identity``, whose anchor the row is."""
    fields = [c for c in features.columns if not c.startswith("_")]
    return sorted({*fields, *(f"{c.partition('.')[0]}._identity" for c in fields if "." in c)})


def _feature(c: str) -> Column:
    return F.col(f"`{c}`") if not c.endswith("._identity") else F.col("_identity")


def feature_rows(features: DataFrame) -> DataFrame:
    """Feature rows as the CSV file has them: all columns of ``feature_columns``, instants as ISO text, collections as JSON."""
    types = {f.name: f.dataType.typeName() for f in features.schema}

    def shown(c: str) -> Column:
        v, kind = _feature(c), types.get(c, "string")
        if kind == "timestamp":
            return iso_text(v).alias(c)
        return (F.to_json(v) if kind in ("array", "map", "struct", "variant") else v).alias(c)

    return features.select(*(shown(c) for c in feature_columns(features)))


def write_features(features: DataFrame, path: str) -> None:
    """Feature rows as CSV with a header, columns by name."""
    feature_rows(features).write.option("header", True).csv(path)


def feature_lines(features: DataFrame, identities: DataFrame) -> DataFrame:
    """One line per identity, ``["identity", [rows ...]]``, as ``value``; identities without a row have an empty list."""
    types = {f.name: f.dataType.typeName() for f in features.schema}
    row = F.struct(*((iso_text(_feature(c)) if types.get(c) == "timestamp" else _feature(c)).alias(c) for c in feature_columns(features)))
    rows = features.groupBy("_identity").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_start_time").alias("s"), F.to_json(row, {"ignoreNullFields": "false"}).alias("j")))), lambda r: r["j"]).alias("rows"))
    every = identities.select("_identity").distinct().join(rows, "_identity", "left")
    name = F.to_json(F.struct(F.col("_identity").alias("k")))
    return every.select(F.concat(F.lit("["), name.substr(F.lit(6), F.length(name) - 6), F.lit(", ["), F.coalesce(F.array_join("rows", ", "), F.lit("")), F.lit("]]")).alias("value"))


def lines(df: DataFrame) -> Iterator[str]:
    """The lines one by one, a partition in memory at a time."""
    for r in df.toLocalIterator():
        yield r.value
