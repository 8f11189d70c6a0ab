import pytest
from pyspark.sql import functions as F

from strandline.operators import features

KINDS = [(1, "app_start"), (2, "app_end"), (3, "App-Start")]
SCHEMA = "who string, kind string, uid long, value double, us long, _kind_no int, cells string, n int"


def long_table(spark, rows):
    df = spark.createDataFrame([(*r, 9, "x", 1) for r in rows], SCHEMA)
    return features.kind_cells(df, {"who": F.col("who")}, F.col("kind"), F.col("uid"), F.col("value"), F.col("us"), KINDS)


def cells(spark, rows):
    return features.pivot_cells(long_table(spark, rows), ["who"], KINDS, 10_000_000)


def wide_table(spark, rows, as_of=10_000_000):
    return features.feature_table(long_table(spark, rows), "who", KINDS[:2], as_of)


def test_spellings_copies_blanks_and_nulls(spark):
    rows = [
        ("a", "app_start", 1, 2.0, 4_000_000), ("a", "APP.START ", 1, 2.0, 4_000_000), ("a", "appStart", 2, None, None), ("a", "app end", None, 1.0, None), ("a", "app end", None, 1.0, None),
        ("a", "other", 3, 1.0, 1), ("a", None, 4, 1.0, 1), ("a", "  ", 5, 1.0, 1), (None, "app_end", 6, 1.0, 1), (" ", "app_end", 7, 1.0, 1), ("A", "app_end", 8, 1.5, 9_000_000),
    ]
    got = {tuple(r) for r in features.filled_cells(cells(spark, rows), ["who"]).collect()}
    assert got == {("a", 1, 2, 6.0, 2.0), ("a", 2, 2, None, 2.0), ("A", 2, 1, 1.0, 1.5)}


def test_the_wide_table_has_every_kind(spark):
    (r,) = wide_table(spark, [("a", "app_end", 1, 2.0, 1_000_000)]).collect()
    assert r.asDict() == {"who": "a", "n_app_start": 0, "recency_s_app_start": None, "total_app_start": 0.0, "n_app_end": 1, "recency_s_app_end": 9.0, "total_app_end": 2.0}
    (r,) = wide_table(spark, [("a", "app_end", None, None, None)] * 3, None).collect()
    assert (r.n_app_end, r.recency_s_app_end, r.total_app_end) == (3, None, 0.0)


def test_the_pivot_moves_narrow_rows_once(spark):
    plan = wide_table(spark, [("a", "app_end", 1, 2.0, 1)])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(who") == 1 and "pivotfirst" in plan


def test_empty(spark):
    assert features.filled_cells(cells(spark, []), ["who"]).count() == 0
    assert wide_table(spark, []).count() == 0


def test_a_long_list_of_kinds_is_refused(spark, monkeypatch):
    monkeypatch.setattr(features, "MOST_KINDS", 2)
    with pytest.raises(ValueError):
        features.kind_list(spark.createDataFrame([(i, f"k{i}") for i in range(3)], "kind_no int, kind_name string"))
