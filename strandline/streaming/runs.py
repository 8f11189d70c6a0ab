"""Structured Streaming: session windows with a watermark, and specs or late corrections carried from batch to batch.

The carried runs write a new version of what a micro-batch changes of their state, named by the batch's number, and read
the version before it. A batch that is run again after a failure writes the same version again, so nothing counts twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.instants import DAY_US, period_no
from strandline.operators import late
from strandline.plans.engine import Engine


def sessions(events: DataFrame, identity: Column, time: Column, gap_s: int, value: Column, watermark: str = "0 seconds") -> DataFrame:
    """Sessions of a stream: (identity, start, end, n, total). End is the last event's time; a gap of exactly ``gap_s`` does not split.

    Blank identities and rows without a time go. In append mode a session comes out once the watermark has passed it.
    """
    rows = events.select(identity.cast("string").alias("identity"), time.cast("timestamp").alias("at"), value.cast("double").alias("v"))
    rows = rows.filter("trim(identity) <> '' and at is not null").withWatermark("at", watermark)
    out = rows.groupBy(F.session_window("at", f"{gap_s} seconds"), "identity").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    return out.drop("session_window")


def profiles(events: DataFrame, identity: Column, value: Column) -> DataFrame:
    """Running per-identity counts and totals of a stream, for complete or update mode."""
    rows = events.select(identity.cast("string").alias("identity"), value.cast("double").alias("v")).filter("trim(identity) <> ''")
    return rows.groupBy("identity").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.max("v").alias("most"))


BUCKETS = 64


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _manifest(spark: SparkSession, folder: str, batch: int) -> dict[int, int]:
    """Bucket of identities -> the batch whose version of it is in force."""
    if batch < 0 or not _exists(spark, f"{folder}/buckets/v{batch}"):
        return {}
    return {r.bucket: r.version for r in spark.read.parquet(f"{folder}/buckets/v{batch}").collect()}  # a row per bucket


def _bucket(identity: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(identity), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, folder: str, name: str, held: dict[int, int]) -> DataFrame | None:
    paths = [p for b, v in held.items() if _exists(spark, p := f"{folder}/v{v}/{name}/_bucket={b}")]
    return spark.read.parquet(*paths) if paths else None


def carried_spec(engine: Engine, folder: str, seq: str | None = None, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a spec's blocks, carried on from the version of the batch before.

    Blocks lie in ``buckets`` buckets, always as many in one folder, by the hash of their identity. A batch reads and writes those buckets alone that hold
    an identity of its events; the others stay where they are, and a small table says which version of each bucket
    counts. Versions that no batch can be run again from are removed.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _manifest(spark, folder, number - 1)
        touched = {r.b for r in engine.keyed(batch, seq).df.select(_bucket(F.col("_id"), buckets).alias("b")).distinct().collect()}
        mine = {b: v for b, v in before.items() if b in touched}
        names = [a.name for a in engine.stream.aggregates]
        state = {n: df for n in names if (df := _read(spark, folder, n, mine)) is not None} if mine else None
        for name, df in engine.blocks(batch, seq, state, variables=True).items():
            df.withColumn("_bucket", _bucket(F.col("_identity"), buckets)).repartition("_bucket").write.partitionBy("_bucket").mode("overwrite").parquet(f"{folder}/v{number}/{name}")
        now = before | dict.fromkeys(touched, number)
        spark.createDataFrame(list(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/buckets/v{number}")
        for b, v in _manifest(spark, folder, number - 2).items():  # this batch can be run again from the one before alone
            if before.get(b) != v:
                for name in names:
                    _delete(spark, f"{folder}/v{v}/{name}/_bucket={b}")

    return step


def blocks_at(spark: SparkSession, engine: Engine, folder: str, batch: int) -> dict[str, DataFrame]:
    """The blocks after a batch, by aggregate; those without any block yet are left out."""
    held = _manifest(spark, folder, batch)
    return {a.name: df for a in engine.stream.aggregates if a.kind != "variable" and (df := _read(spark, folder, a.name, held)) is not None}


def carried_multisets(folder: str, columns: dict[str, Column], cutoff_s: int = 48 * 3600, period_us: int = DAY_US) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the value counts of every period, corrected by what a batch brings.

    ``columns`` are uid, tie, arrived_us, instant_us and value. Batches must come in order of arrival, so that a record
    seen before is the one that counts. Once the largest arrival is past a period's cut-off nothing can correct it any
    more: its counts go to a folder that is only added to, and the uids of its records are forgotten. So what a batch
    reads and writes is bounded by the open periods. A record delivered again after that counts as dropped once more.
    """

    def step(batch: DataFrame, number: int) -> None:
        here, before = f"{folder}/v{number}", f"{folder}/v{number - 1}" if number else None
        spark = batch.sparkSession
        rows = batch.select(*(c.alias(n) for n, c in columns.items()))
        clock = rows.agg(F.max("arrived_us")).first()[0]
        if before:
            clock = max((x for x in (clock, spark.read.parquet(f"{before}/clock").first()[0]) if x is not None), default=None)
            rows = rows.join(spark.read.parquet(f"{before}/seen").select("uid"), "uid", "left_anti")
        records = late.judged(rows, F.col("uid"), F.col("tie"), F.col("arrived_us"), F.col("instant_us"), F.col("value"), period_us, cutoff_s)
        counts = late.multisets(records)
        seen = rows.filter("uid is not null and instant_us is not null").select("uid", period_no(F.col("instant_us"), period_us).alias("period")).distinct()
        if before:
            old = spark.read.parquet(f"{before}/counts")
            counts = old.unionByName(counts).groupBy("period", "value").agg(*(F.sum(c).alias(c) for c in counts.columns if c.startswith("n_")))
            seen = seen.unionByName(spark.read.parquet(f"{before}/seen"))
        over = F.lit(clock).cast("long") > (F.col("period") + 1) * F.lit(period_us) + F.lit(cutoff_s * 1_000_000)
        closed = F.coalesce(over, F.lit(False))
        counts.withColumn("closed", closed).write.mode("overwrite").partitionBy("closed").parquet(f"{here}/all")
        whole = spark.read.schema(T.StructType([*counts.schema, T.StructField("closed", T.BooleanType())])).parquet(f"{here}/all")
        whole.filter("not closed").drop("closed").write.mode("overwrite").parquet(f"{here}/counts")
        whole.filter("closed").drop("closed").write.mode("overwrite").parquet(f"{folder}/closed/v{number}")
        seen.filter(~closed).write.mode("overwrite").parquet(f"{here}/seen")
        spark.createDataFrame([(clock,)], "clock long").coalesce(1).write.mode("overwrite").parquet(f"{here}/clock")
        _delete(spark, f"{here}/all")
        if number > 1:
            _delete(spark, f"{folder}/v{number - 2}")

    return step


def multisets_at(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    """The counts of all periods after a batch, open and closed."""
    parts = [f"{folder}/v{batch}/counts", *(f"{folder}/closed/v{n}" for n in range(batch + 1))]
    every = spark.read.parquet(*parts)
    return every.groupBy("period", "value").agg(*(F.sum(c).alias(c) for c in every.columns if c.startswith("n_")))
