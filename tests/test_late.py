import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from strandline.operators import late

DAY, H = 86_400_000_000, 3_600_000_000
SCHEMA = "uid long, tie long, a long, t long, value double, period string, verdict string, u string"


def judged(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    return late.judged(df, F.col("uid"), F.col("tie"), F.col("a"), F.col("t"), F.col("value"))


def test_limits_of_the_verdicts(spark):
    rows = [(1, 1, DAY - 1, 0, 1.0), (2, 2, DAY, 0, 1.0), (3, 3, DAY + 48 * H, 0, 1.0), (4, 4, DAY + 48 * H + 1, 0, 1.0), (5, 5, None, 0, 1.0), (6, 6, 5, None, 1.0), (7, 7, -5, 3, 1.0)]
    assert {r.tie: r.verdict for r in judged(spark, rows).collect()} == {1: "on_time", 2: "corrected", 3: "corrected", 4: "dropped", 5: "dropped", 7: "on_time"}


def test_only_the_first_arrival_counts(spark):
    rows = [(1, 5, 9, 0, 1.0), (1, 6, 2, 0, 1.0), (1, 3, 2, 0, 1.0), (1, 1, None, 0, 1.0), (None, 7, 9, 0, 1.0), (None, 8, 9, 0, 1.0)]
    assert sorted(r.tie for r in judged(spark, rows).collect()) == [3, 7, 8]


@pytest.mark.parametrize("seed", range(3))
def test_aggregates_equal_those_of_the_sorted_values(spark, seed):
    r = random.Random(seed)
    pick = [lambda: r.randint(-3, 3) / 2, lambda: r.uniform(-1e6, 1e6), lambda: None, lambda: 10.0 ** r.randint(-300, 300)]
    rows = []
    for i in range(600):
        t = r.randint(0, 4) * DAY
        rows.append((i, i, t + r.choice([0, DAY, 4 * DAY]), t, r.choice(pick)()))
    got = {x.period: x for x in late.period_aggregates(late.multisets(judged(spark, rows))).collect()}
    assert set(got) == {t // DAY for *_, t, _ in rows}
    for period, x in got.items():
        mine = [(a - t, v) for _, _, a, t, v in rows if t // DAY == period]
        for phase, kept in (("close", [v for d, v in mine if d < DAY]), ("final", [v for d, v in mine if d <= 3 * DAY])):
            values = [v for v in kept if v is not None]
            assert x[f"n_{phase}"] == len(kept) and x[f"n_values_{phase}"] == len(values) and x[f"n_distinct_{phase}"] == len(set(values))
            if values:
                assert (x[f"least_{phase}"], x[f"most_{phase}"]) == (min(values), max(values))
                assert math.isclose(x[f"median_{phase}"], statistics.median(values), rel_tol=1e-12)
            else:
                assert x[f"median_{phase}"] is None


def test_nan_and_infinities_rank_last_and_first(spark):
    rows = [(i, i, 1, 0, v) for i, v in enumerate([float("nan"), float("inf"), float("-inf"), 1.0, -1.0])]
    x = late.period_aggregates(late.multisets(judged(spark, rows))).collect()[0]
    assert x.least_close == float("-inf") and math.isnan(x.most_close) and x.median_close == 1.0


def test_late_records_show_what_they_change(spark):
    rows = [(1, 1, 0, 0, 2.0), (2, 2, DAY, 0, 2.0), (3, 3, 9 * DAY, 0, 2.0), (4, 4, DAY, 0, None), (5, 5, 0, 0, 7.0)]
    records = judged(spark, rows)
    assert {r.tie: (r.verdict, r.delta) for r in late.change_log(records).collect()} == {2: ("corrected", 1), 3: ("dropped", 0), 4: ("corrected", 1)}
    got = {r.value: (r.n_at_close, r.n_final, r.n_dropped) for r in late.changed_entries(late.multisets(records)).collect()}
    assert got == {2.0: (1, 2, 1), None: (0, 1, 0)}


def test_close_values_are_spread_over_ranges(spark):
    """A day whose values all lie close together is cut like any other, so that no task has to sort it whole."""
    r = random.Random(3)
    values = [1000 + r.random() for _ in range(4000)]
    df = spark.createDataFrame([(i, i, 0, 0, v) for i, v in enumerate(values)], "uid long, tie long, a long, t long, value double")
    state = late.multisets(late.judged(df, F.col("uid"), F.col("tie"), F.col("a"), F.col("t"), F.col("value")))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        (x,) = late.period_aggregates(state).collect()
        parts = state.repartitionByRange("period", "value").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert x.median_final == statistics.median(values) and max(r["count"] for r in parts) < 1.5 * len(values) / len(parts) and len(parts) == 4


def test_empty(spark):
    state = late.multisets(judged(spark, []))
    assert late.period_aggregates(state).count() == 0 and late.change_log(judged(spark, [])).count() == 0 and late.changed_entries(state).count() == 0
