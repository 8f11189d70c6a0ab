import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandline.operators import skew


def hot_rows(n=5000, seed=1):
    r = random.Random(seed)
    return [("hot" if r.random() < 0.5 else "warm" if r.random() < 0.3 else f"k{r.randint(0, 300)}", i) for i in range(n)]


def test_plan_splits_hot_keys_in_proportion_and_balances_tasks(spark):
    df = spark.createDataFrame(hot_rows(), "k string, v int")
    plan = skew.plan_loads(skew.key_loads(df, F.col("k")), 8)
    assert plan.total == 5000 and sum(plan.task_loads) == pytest.approx(5000, abs=20)
    assert len(plan.split["hot"]) == 4 or len(plan.split["hot"]) == 5
    assert max(plan.task_loads) < 1.2 * 5000 / 8
    shares = Counter(r._task for r in skew.to_shards(df, "k", plan).collect())
    assert max(shares.values()) < 1.4 * 5000 / 8


@pytest.mark.parametrize("how", ["left", "inner"])
def test_balanced_join_equals_the_plain_one(spark, how):
    large = spark.createDataFrame([*hot_rows(), (None, 1), ("", 2), ("unmatched", 3)], "k string, v int").withColumn("_task", F.lit("mine")).withColumn("_tasks", F.lit(1))
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k5", 3), ("k6", 4), (None, 5), ("", 6), ("nobody", 7)], "k string, v int")
    plan = skew.plan_loads(skew.key_loads(large, F.col("k")), 5)
    got = skew.balanced_join(large, small, "k", plan, how)
    assert got.columns == ["k", "v", "_task", "_tasks", "v_small"]
    side = small.filter("trim(k) <> ''").withColumnRenamed("v", "w")
    want = large.join(side, "k", how)
    assert Counter(map(tuple, got.select("k", "v", "v_small").collect())) == Counter(map(tuple, want.select("k", "v", "w").collect()))


def test_counts_and_hot_keys(spark):
    rows = [*hot_rows(990), *[(None, 1)] * 5, *[("  ", 1)] * 5]
    df = spark.createDataFrame(rows, "k string, v int")
    want = Counter(k for k, _ in rows if k and k.strip())
    plan = skew.plan_loads(skew.key_loads(df, F.col("k")), 4)
    assert {r.k: r.n_rows for r in skew.balanced_counts(df, F.col("k"), plan).collect()} == want
    hot = {r.k: r.n_rows for r in skew.hot_keys(df, F.col("k"), 4, 0.01).collect()}
    assert hot == {k: n for k, n in want.items() if n * 100 >= len(rows)}


def test_estimated_loads_place_every_row_and_balance_the_tasks(spark):
    df = spark.createDataFrame(hot_rows(200_000), "k string, v int")
    plan = skew.plan_for(df, F.col("k"), 8)
    assert plan.total == pytest.approx(200_000, rel=0.1) and len(plan.split["hot"]) in (4, 5)
    rows = skew.placed(df, "k", plan)
    per_task = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p"), "_task").count().collect()]
    assert len(per_task) == 8 and sum(per_task) == 200_000 and max(per_task) < 1.5 * 200_000 / 8
    want = Counter(k for k, _ in hot_rows(200_000))
    assert {r.k: r.n_rows for r in skew.balanced_counts(df, F.col("k"), plan).collect()} == want


def test_nothing_is_moved_again_after_placing(spark):
    large, small = spark.createDataFrame(hot_rows(), "k string, v int"), spark.createDataFrame([("hot", 1), ("k5", 3)], "k string, w int")
    plan = skew.plan_for(large, F.col("k"), 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew.balanced_join(large, small, "k", plan)._jdf.queryExecution().executedPlan().toString()
        counted = skew.balanced_counts(large, F.col("k"), plan)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    exchanges = lambda text: [line.split("Exchange ")[1].split("(")[0] for line in text.splitlines() if "Exchange " in line and "Broadcast" not in line]
    assert exchanges(joined) == ["shufflepartitionidpassthrough"] * 2
    assert exchanges(counted) == ["hashpartitioning", "shufflepartitionidpassthrough"]


def test_a_large_plan_is_not_broadcast(spark, monkeypatch):
    df = spark.createDataFrame(hot_rows(), "k string, v int")
    plan = skew.plan_for(df, F.col("k"), 4)
    monkeypatch.setattr(skew, "MOST_BROADCAST", 3)
    assert "ResolvedHint (strategy=broadcast)" not in skew.to_shards(df, "k", plan)._jdf.queryExecution().analyzed().toString()
    assert skew.balanced_counts(df, F.col("k"), plan).count() == len({k for k, _ in hot_rows()})


def test_exactly_the_share_counts(spark):
    df = spark.createDataFrame([("a",)] * 1 + [(f"b{i}",) for i in range(99)], "k string")
    assert skew.hot_keys(df, F.col("k"), 3, 0.01).count() == 100


def test_empty(spark):
    df = spark.createDataFrame([], "k string, v int")
    assert skew.hot_keys(df, F.col("k"), 3).count() == 0
    plan = skew.plan_loads(skew.key_loads(df, F.col("k")), 3)
    assert skew.balanced_join(df, df.withColumnRenamed("v", "w"), "k", plan).count() == 0
