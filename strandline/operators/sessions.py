"""Activity sessions by one ordered scan.

Rows are sorted by (key, instant) over range partitions, so a key that owns a third of the table is cut
into many partitions by time instead of landing in one task. Each partition is then read once, front to
back, and holds nothing but the session that is open. A session that reaches a partition's edge comes out
as a fragment; there are at most two of those per partition, and they are joined in a last small step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.instants import iso_instant, micros, nonblank
from strandline.session import materialize

_FRAGMENT = "edge boolean, pid int, seq long, k string, s long, e long, n_items long, n_events long"


def _ordered_scan(gap_us: int):
    """A reader of (k, t, n_items, n_events) sorted by k, t, which emits sessions as they close."""
    names = ["edge", "pid", "seq", "k", "s", "e", "n_items", "n_events"]
    types = [pa.bool_(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def batch(pid: int, seq: int, edge: np.ndarray, k: pa.Array, *numbers: np.ndarray) -> pa.RecordBatch:
        n = len(edge)
        arrays = [pa.array(edge), pa.array(np.full(n, pid, np.int32)), pa.array(np.arange(seq, seq + n)), k, *(pa.array(x) for x in numbers)]
        return pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(arrays, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        seq, held = 0, None  # held: key, start, end, items, events of the open session
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0)
            t, items, events = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            new = np.ones(b.num_rows, bool)
            other_key = pc.not_equal(key.slice(1), key.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            new[1:] = other_key | (np.diff(t) > gap_us)
            if held is not None:
                new[0] = key[0].as_py() != held[0] or t[0] - held[2] > gap_us
            cut = np.flatnonzero(new)
            first = np.concatenate([[0], cut]) if not new[0] else cut
            last = np.append(first[1:], b.num_rows) - 1
            s, e = t[first].copy(), t[last].copy()
            ni, ne = np.add.reduceat(items, first), np.add.reduceat(events, first)
            k = key.take(pa.array(first))
            if held is not None:
                if new[0]:
                    k = pa.concat_arrays([pa.array([held[0]], pa.string()), k])
                    s, e, ni, ne = (np.concatenate([[h], x]) for h, x in zip(held[1:], (s, e, ni, ne)))
                else:
                    s[0] = held[1]
                    ni[0] += held[3]
                    ne[0] += held[4]
            held = (k[-1].as_py(), s[-1], e[-1], ni[-1], ne[-1])
            if len(s) > 1:
                edge = np.zeros(len(s) - 1, bool)
                edge[0] = seq == 0
                yield batch(pid, seq, edge, k.slice(0, len(s) - 1), s[:-1], e[:-1], ni[:-1], ne[:-1])
                seq += len(s) - 1
        if held is not None:
            yield batch(pid, seq, np.array([True]), pa.array([held[0]], pa.string()), *(np.array([x]) for x in held[1:]))

    return run


def sessionize(points: DataFrame, key: Column, instant_us: Column, events: Column | None = None, gap_s: int = 1800) -> DataFrame:
    """Sessions of ``points``: (key, start_us, end_us, n_items, n_events).

    A new session starts after more than ``gap_s`` seconds without a row of that key; a gap of exactly
    ``gap_s`` does not split. Rows whose key is blank or whose instant is null belong to no session.
    Rows at one instant of one key are summed before anything is moved. Null ``events`` count as 0.
    An empty input gives an empty result. Columns of ``points`` other than the given ones play no part.
    """
    if gap_s < 1:
        raise ValueError("gap_s must be at least 1")
    amount = F.coalesce(events.cast("long"), F.lit(0)) if events is not None else F.lit(0).cast("long")
    narrow = points.select(key.cast("string").alias("k"), instant_us.cast("long").alias("t"), amount.alias("v"))
    merged = narrow.filter(nonblank("k") & F.col("t").isNotNull()).groupBy("k", "t").agg(F.count(F.lit(1)).alias("n_items"), F.sum("v").alias("n_events"))
    ordered = merged.repartitionByRange("k", "t").sortWithinPartitions("k", "t")
    fragments = ordered.mapInArrow(_ordered_scan(gap_s * 1_000_000), _FRAGMENT)

    # Written, since the scan serves twice: whole sessions are done, edge fragments, at most two per partition, meet by key.
    scanned = materialize(fragments, "session-fragments")
    columns = [F.col("k").alias("key"), F.col("s").alias("start_us"), F.col("e").alias("end_us"), "n_items", "n_events"]
    by_start = Window.partitionBy("k").orderBy("s", "e")
    opens = F.when(F.col("s") - F.lag("e").over(by_start) <= gap_s * 1_000_000, 0).otherwise(1)
    numbered = scanned.filter("edge").withColumn("opens", opens).withColumn("part", F.sum("opens").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy("k", "part").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum("n_items").alias("n_items"), F.sum("n_events").alias("n_events"))
    return scanned.filter("not edge").select(*columns).unionByName(joined.select(*columns))


def put_items(items: DataFrame) -> DataFrame:
    """The store's current items out of its log of puts: (partition_key, instant_us, events).

    An item is (partition_key, group, dimensions, instant); a later put of the same item replaces the
    earlier one, however its time is spelled (latest ``written_at``, then largest ``item_id``; a put
    without ``written_at`` is the oldest). Items with a blank key or without any time are left out.
    """
    piece = F.substring_index("range_key", "/", -1)
    at = F.coalesce(iso_instant("_start_time"), F.when(F.col("_start_time").isNull(), iso_instant(piece)))
    name = F.substring(F.col("range_key"), F.lit(1), F.length("range_key") - F.length(piece))
    puts = items.select(F.col("partition_key").alias("k"), name.alias("name"), micros(at).alias("t"), F.col("events").cast("long").alias("v"), micros("written_at").alias("w"), F.col("item_id").cast("long").alias("i"))
    puts = puts.filter(nonblank("k") & F.col("t").isNotNull())
    latest = puts.groupBy("k", "name", "t").agg(F.max_by("v", F.struct("w", "i")).alias("events"))
    return latest.select(F.col("k").alias("partition_key"), F.col("t").alias("instant_us"), "events")
