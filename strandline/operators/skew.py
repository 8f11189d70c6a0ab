"""Per-key results over tables in which a few keys own most rows: fragment and replicate by estimated load.

The loads of keys are estimated from a sample of bounded size. Keys that weigh something, of which there can only
be a bounded number, are planned one by one on the driver; all others share hash buckets. Keys above one task's
share are split into shards in proportion to their load, shards and buckets are packed onto tasks, heaviest
first onto the least loaded. A matching side is copied to the shards of its own key and nowhere else. The sample
decides only where rows go: every row is moved and counted, and a bad estimate costs balance, never a row.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.instants import nonblank
from strandline.session import materialize

#: Sampled rows per planned item (a key or bucket of 1/fineness of a task's share); its load is then known to about 1/sqrt of this.
ROWS_PER_ITEM = 64
#: Plan rows (keys and buckets) that are broadcast; a larger plan is joined by shuffle.
MOST_BROADCAST = 1_000_000


@dataclass(frozen=True)
class LoadPlan:
    """``split``: key -> tasks of its shards; ``bucket_tasks``: bucket of the other keys -> task; ``total``: rows planned for, estimated from a sample."""

    n_tasks: int
    total: int
    split: dict[str, list[int]]
    bucket_tasks: list[int]
    task_loads: list[int]


def key_loads(df: DataFrame, key: Column, fraction: float = 1.0, seed: int = 11) -> DataFrame:
    """(k, load): the rows of each non-blank key, estimated from a sample of ``fraction`` of the rows; exact for 1."""
    rows = df.select(key.cast("string").alias("k"))
    if fraction < 1:
        rows = rows.sample(fraction, seed)
    return rows.filter(nonblank("k")).groupBy("k").agg(F.round(F.count(F.lit(1)) / F.lit(min(1.0, fraction))).cast("long").alias("load"))


def plan_for(df: DataFrame, key: Column, n_tasks: int, rows: int | None = None, fineness: int = 8) -> LoadPlan:
    """The plan for ``df``, from a sample of about ROWS_PER_ITEM rows for each of ``fineness * n_tasks`` items.

    ``rows`` is the table's number of rows where it is known; counting the rows of a parquet table reads its footers alone.
    """
    n = df.count() if rows is None else rows
    wanted = ROWS_PER_ITEM * fineness * n_tasks
    loads = materialize(key_loads(df, key, min(1.0, wanted / n) if n else 1.0), "key-loads")  # no more rows than the sample
    return plan_loads(loads, n_tasks, fineness)


def plan_loads(loads: DataFrame, n_tasks: int, fineness: int = 8) -> LoadPlan:
    """Shards and buckets packed onto ``n_tasks`` tasks.

    A key is planned singly from 1/``fineness`` of a task's share on, so at most ``fineness * n_tasks`` keys reach
    the driver, whatever the number of keys. The rest is known only by the load of as many hash buckets. Each bucket
    brings its own heaviest keys, so one job finds both.
    """
    buckets = fineness * n_tasks
    bucket = F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int")
    placed = loads.select(bucket.alias("b"), "k", "load")
    spread = {r.b: r.load for r in placed.groupBy("b").agg(F.sum("load").alias("load")).collect()}
    total = sum(spread.values())
    share = max(1, math.ceil(total / n_tasks))
    single = placed.filter(F.col("load") >= max(1, share / fineness)).collect() if total > buckets else []
    if len(single) > buckets:
        raise AssertionError("more heavy keys than the total allows")
    left = [spread.get(b, 0) for b in range(buckets)]
    for r in single:
        left[r.b] -= r.load
    items: list[tuple[int, object]] = [(load, b) for b, load in enumerate(left)]
    for r in single:
        shards = max(1, math.ceil(r.load / share))
        items += [(math.ceil(r.load / shards), (r.k, i)) for i in range(shards)]
    heap = [(0, t) for t in range(n_tasks)]
    split: dict[str, list[int]] = {r.k: [] for r in single}
    bucket_tasks, task_loads = [0] * buckets, [0] * n_tasks
    for load, what in sorted(items, key=lambda x: (-x[0], str(x[1]))):
        has, task = heapq.heappop(heap)
        heapq.heappush(heap, (has + load, task))
        task_loads[task] += load
        if isinstance(what, tuple):
            split[what[0]].append(task)
        else:
            bucket_tasks[what] = task
    return LoadPlan(n_tasks, total, split, bucket_tasks, task_loads)


def _fresh(df: DataFrame, name: str) -> str:
    """``name``, or something like it that no column of ``df`` is called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _with_tasks(df: DataFrame, key: str, plan: LoadPlan) -> tuple[DataFrame, str]:
    """``df`` and the name of a new column with the tasks of the row's key, looked up in the plan's two tables.

    Both have at most ``fineness * n_tasks`` rows and are broadcast up to MOST_BROADCAST of them.
    """
    spark = df.sparkSession
    planned, split, tasks, no, task = (_fresh(df, n) for n in ("_planned", "_split", "_tasks", "_bucket", "_bucket_task"))
    singles = spark.createDataFrame(list(plan.split.items()), f"`{planned}` string, `{split}` array<int>")
    buckets = spark.createDataFrame(list(enumerate(plan.bucket_tasks)), f"`{no}` int, `{task}` int")
    if len(plan.split) + len(plan.bucket_tasks) <= MOST_BROADCAST:
        singles, buckets = F.broadcast(singles), F.broadcast(buckets)
    bucket = F.pmod(F.xxhash64(key), F.lit(len(plan.bucket_tasks))).cast("int")
    joined = df.join(singles, F.col(key) == F.col(planned), "left").join(buckets, bucket == F.col(no), "left")
    return joined.withColumn(tasks, F.coalesce(F.col(split), F.array(F.col(task)))).drop(planned, split, no, task), tasks


def to_shards(df: DataFrame, key: str, plan: LoadPlan, task: str = "_task") -> DataFrame:
    """The large side: each row goes to one of its key's tasks, in turn. Adds ``task``."""
    held, tasks = _with_tasks(df, key, plan)
    turn = F.pmod(F.monotonically_increasing_id(), F.size(tasks).cast("long")).cast("int")
    return held.withColumn(task, F.get(tasks, turn)).drop(tasks)


def to_all_shards(df: DataFrame, key: str, plan: LoadPlan, task: str = "_task") -> DataFrame:
    """The matching side: each row goes to every task that holds a shard of its key, once. Adds ``task``."""
    held, tasks = _with_tasks(df, key, plan)
    return held.withColumn(task, F.explode(F.array_distinct(tasks))).drop(tasks)


def placed(df: DataFrame, key: str, plan: LoadPlan, task: str = "_task") -> DataFrame:
    """The rows of ``df`` moved to their planned tasks: the partition of a row is its ``task``, no hash in between."""
    return to_shards(df, key, plan, task).repartitionById(plan.n_tasks, F.col(task))


def balanced_join(large: DataFrame, small: DataFrame, key: str, plan: LoadPlan, how: str = "left") -> DataFrame:
    """``large`` joined with ``small`` on the string column ``key``, without a task that has far more rows than the others.

    Equal to the plain join, with the key once. Null and blank keys of ``large`` match nothing: kept for "left",
    dropped for "inner". ``small`` may repeat keys. Other columns of ``small`` that ``large`` has too get a ``_small`` suffix.
    Both sides are joined where they were placed, by merging, so the join moves nothing again.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be left or inner")
    taken = {c.lower() for c in large.columns}
    for c in small.columns:
        if c != key and c.lower() in taken:
            small = small.withColumnRenamed(c, _fresh(large, f"{c}_small"))
    task = _fresh(small, _fresh(large, "_task"))
    left = placed(large, key, plan, task)
    right = to_all_shards(small.filter(nonblank(key)), key, plan, task).repartitionById(plan.n_tasks, F.col(task))
    return left.join(right.hint("merge"), [task, key], how).drop(task)


def balanced_counts(df: DataFrame, key: Column, plan: LoadPlan) -> DataFrame:
    """(k, n_rows) per non-blank key: counted on the task where its rows were placed, then summed over the key's shards."""
    rows = placed(df.select(key.cast("string").alias("k")).filter(nonblank("k")), "k", plan)
    parts = rows.groupBy("_task", "k").agg(F.count(F.lit(1)).alias("n"))
    return parts.groupBy("k").agg(F.sum("n").alias("n_rows"))


def hot_keys(df: DataFrame, key: Column, n_tasks: int, share: float = 0.01) -> DataFrame:
    """(k, n_rows) of each non-blank key on at least ``share`` of all rows of ``df``; blank keys count in the total only.

    The counts are exact. An empty table has no hot key.
    """
    total = df.count()
    plan = plan_for(df, key, n_tasks, total)
    return balanced_counts(df, key, plan).filter((F.col("n_rows") >= F.lit(share * total * (1 - 1e-12))) & F.lit(total > 0))
