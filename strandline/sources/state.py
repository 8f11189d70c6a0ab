"""Block tables on disk: the stores behind runs that carry on from one another."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Store:
    """The blocks of a spec in a folder, one parquet table per aggregate, replaced as a whole.

    Every save writes a new version beside the old one and then names it in a numbered file, so a run may replace the
    state that it reads, a reader sees one version or the other, and a run that fails leaves the old one in force.
    ``finalize`` removes versions that are no longer current. Several stores are several folders.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(n[8:]) for n in names if n.startswith("current-") and n[8:].isdigit())

    def version(self) -> str | None:
        """The name of the version in force: what the file ``current-<number>`` of the largest number says."""
        numbers = self._numbers()
        return self.spark.read.text(f"{self.folder}/current-{numbers[-1]}").first()[0] if numbers else None

    def names(self) -> list[str]:
        v = self.version()
        return sorted(x.getPath().getName().removesuffix(".parquet") for x in self._fs.listStatus(self._path(f"{self.folder}/{v}"))) if v else []

    def load(self) -> dict[str, DataFrame] | None:
        """The current blocks by aggregate; None before the first save."""
        v = self.version()
        return load(self.spark, f"{self.folder}/{v}", self.names()) if v else None

    def save(self, blocks: dict[str, DataFrame]) -> None:
        """Replaces all blocks. They may be computed from the ones that are replaced."""
        new, number = f"v-{uuid.uuid4().hex}", max(self._numbers(), default=0) + 1
        save(blocks, f"{self.folder}/{new}")
        draft = self._path(f"{self.folder}/draft-{new}")
        out = self._fs.create(draft, True)
        out.writeBytes(new)
        out.close()
        if not self._fs.rename(draft, self._path(f"{self.folder}/current-{number}")):
            raise RuntimeError(f"{self.folder}: another run saved version {number}")

    def finalize(self) -> int:
        """Removes what is not current, and says how many versions that were."""
        v, gone = self.version(), 0
        for n in self._numbers()[:-1]:
            self._fs.delete(self._path(f"{self.folder}/current-{n}"), False)
        for x in self._fs.listStatus(self._path(self.folder)):
            if x.isDirectory() and x.getPath().getName() != v:
                gone += bool(self._fs.delete(x.getPath(), True))
        return gone


class MemoryStore:
    """The blocks of a spec held by the session, as tables that SQL can name: ``<name>_<aggregate>``.

    They are computed when they are saved and kept in memory, on local disk where that is short; lost pieces are computed anew.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.held = spark, name, {}

    def load(self) -> dict[str, DataFrame] | None:
        """The current blocks by aggregate; None before the first save."""
        return dict(self.held) or None

    def save(self, blocks: dict[str, DataFrame]) -> None:
        """Replaces all blocks. They may be computed from the ones that are replaced."""
        new = {n: df.persist(StorageLevel.MEMORY_AND_DISK) for n, df in blocks.items()}
        for n, df in new.items():
            df.count()
            df.createOrReplaceTempView(f"{self.name}_{n}")
        old, self.held = self.held, new
        for n, df in old.items():
            if n not in new:
                self.spark.catalog.dropTempView(f"{self.name}_{n}")

    def finalize(self) -> None:
        """Gives everything up."""
        for n, df in self.held.items():
            df.unpersist()
            self.spark.catalog.dropTempView(f"{self.name}_{n}")
        self.held = {}


def get(blocks: DataFrame, identity: str, start: Column | None = None, **dimensions) -> DataFrame:
    """The block of one key: an identity with the values of its dimensions or, for a session, its start. The filters reach the scan."""
    found = get_all(blocks, identity)
    for name, value in dimensions.items():
        found = found.filter(F.col(f"`{name}`") == F.lit(value))
    return found if start is None else found.filter(F.col("_start_time") == start)


def write_items(blocks: DataFrame, key: Column, client, batch: int = 25) -> None:
    """Blocks put into a remote key-value table, for ``foreachBatch`` or a batch of its own.

    ``key`` is the block's key as ``sinks.block_key`` makes it. ``client`` is called once per partition, on the executor, and
    returns an object whose ``put_items`` takes up to ``batch`` items at a time: dicts with ``partition_key`` (the
    identity), ``range_key`` (the rest of the key) and the block's attributes, of which falsy ones are left out. Puts
    replace, so a task that runs twice does no harm.
    """
    shown = blocks.select(F.col("_identity").alias("partition_key"), F.substring(key, F.length("_identity") + 2, F.length(key)).alias("range_key"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in blocks.columns))).alias("item"))

    def send(rows: Iterable) -> None:
        import json

        held, target = [], client()
        for r in rows:
            held.append({"partition_key": r.partition_key, "range_key": r.range_key} | {k: v for k, v in json.loads(r.item).items() if v})
            if len(held) == batch:
                target.put_items(held)
                held = []
        if held:
            target.put_items(held)

    shown.foreachPartition(send)



def save(blocks: dict[str, DataFrame], folder: str) -> None:
    """One parquet table per aggregate. The folder must be new: a run never overwrites the state that it read."""
    for name, df in blocks.items():
        df.write.parquet(f"{folder}/{name}.parquet")


def load(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def get_all(blocks: DataFrame, identity: str) -> DataFrame:
    """All blocks of one entity; the filter reaches the scan."""
    return blocks.filter(F.col("_identity") == identity)


def put(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put over it by key: replaced where they meet, added where they do not."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def remove(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` without the keys of ``gone``."""
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def between(blocks: DataFrame, identity: str, start: Column, end: Column) -> DataFrame:
    """The entity's blocks that start strictly between two instants, in order."""
    return get_all(blocks, identity).filter((F.col("_start_time") > start) & (F.col("_start_time") < end)).orderBy("_start_time")


def nearest(blocks: DataFrame, n: int) -> DataFrame:
    """The first n blocks of each entity by start, or the last -n if n is negative; fewer if there are fewer."""
    order = F.asc("_start_time") if n > 0 else F.desc("_start_time")
    rank = F.row_number().over(Window.partitionBy("_identity").orderBy(order))
    return blocks.withColumn("_nth", rank).filter(F.col("_nth") <= abs(n)).drop("_nth")
