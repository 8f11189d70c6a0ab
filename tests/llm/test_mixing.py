import math
import random

import pytest
from pyspark.sql import functions as F

from strandline.llm import mixing

SCHEMA = "doc_id long, source string, text string, weight double, key string, w int, tokens string, spot int"


def mixed(spark, rows, targets, seed=42, **more):
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    return mixing.mix(df, t, F.col("doc_id"), F.col("source"), F.col("text"), F.col("weight"), seed, **more)


def documents(n=2000, seed=1):
    r = random.Random(seed)
    return [(i, r.choice(["big", " BIG", "big", "big", "small", None]), "x" * r.randint(0, 100), r.choice([1.0, 2.0, None])) for i in range(n)]


def test_shares_come_out_and_the_cap_holds(spark):
    rows = documents()
    sizes = {s: sum(len(t) for _, x, t, _ in rows if (x or "").strip().lower() == s) for s in ("big", "small")}
    total = sum(len(t) for _, _, t, _ in rows)
    m = mixed(spark, rows, [("Big", 0.3, 2), ("small", 0.5, 2), ("absent", 0.2, 5)])
    report = {r.source: r for r in m.report.collect()}
    assert abs(report["big"].taken - 0.3 * total) <= 100 and not report["big"].exhausted
    assert report["small"].taken == 2 * sizes["small"] and report["small"].exhausted
    assert report["absent"].taken == 0 and report["absent"].exhausted
    taken = m.selection.collect()
    assert sum(r.tokens * r.times for r in taken) == sum(r.taken for r in report.values())
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9
    assert {r.times for r in taken if r.source == "small"} == {2} and {r.times for r in taken if r.source == "big"} == {1}


@pytest.mark.parametrize("heavy", [1000.0, 1.0, 0.001])
def test_ranges_are_even_whatever_the_weights(spark, heavy, monkeypatch):
    """Keys of very different scales: no range may hold much more than its part, or one task would sort a source."""
    written, plain = {}, mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda df, label: written.setdefault(label, plain(df, label)))
    rows = [(i, "a", "x" * (i % 50), heavy if i % 3 else 1.0) for i in range(12_000)] + [(i, "b", "y" * 9, None) for i in range(12_000, 13_000)]
    m = mixed(spark, rows, [("a", 0.4, 1), ("b", 0.02, 1)])
    held = [r["count"] for r in written["mix-ranges"].filter("source = 'a'").groupBy("spot").count().collect()]
    assert sum(held) == 12_000 and max(held) <= 0.04 * 12_000
    assert m.report.filter("source = 'a'").collect()[0].taken == pytest.approx(0.4 * sum(len(t) for _, _, t, _ in rows), abs=50)


def test_repeated_rows_are_spread_over_ranges(spark, monkeypatch):
    written, plain = {}, mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda df, label: written.setdefault(label, plain(df, label)))
    mixed(spark, [(7, "a", "x" * 10, 1.0)] * 4000, [("a", 0.5, 1)])
    assert max(r["count"] for r in written["mix-ranges"].groupBy("spot").count().collect()) < 4 * 4000 / mixing.RANGES


def test_the_fitting_total_meets_every_share(spark):
    rows = [(i, "big", "x" * 10, 1.0) for i in range(3000)] + [(i, "small", "y" * 10, 1.0) for i in range(3000, 3100)] + [(i, None, "z" * 90, 1.0) for i in range(3100, 3300)]
    m = mixed(spark, rows, [("big", 0.7, 1), ("small", 0.3, 4), ("absent", 0.0, 1)], total_tokens=mixing.FIT)
    report = {r.source: r for r in m.report.collect()}
    assert report["small"].taken == 4000 and report["small"].epochs == 4 and not report["small"].exhausted
    assert abs(report["big"].actual_share - 0.7) < 0.002 and abs(report["small"].actual_share - 0.3) < 0.002
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)
    check = mixing.selection_check(m.selection, df, m.report, F.col("doc_id"), F.col("source"), F.col("text"))
    assert {r.source: tuple(r)[1:] for r in check.collect()} == {s: (0, 0, 0, 0, 0, 0) for s in ("big", "small", "absent")}
    wrong = m.selection.withColumn("times", F.lit(9)).withColumn("id", F.when(F.col("source") == "small", F.col("id") - 2000).otherwise(F.col("id")))
    found = {r.source: r for r in mixing.selection_check(wrong, df, m.report, F.col("doc_id"), F.col("source"), F.col("text")).collect()}
    assert found["small"].n_foreign == 100 and found["big"].n_above_cap == found["big"].n_uneven > 0


def test_a_fitting_total_without_any_source_is_nothing(spark):
    m = mixed(spark, [(1, None, "x", 1.0)], [("a", 1.0, 1)], total_tokens=mixing.FIT)
    assert m.selection.count() == 0 and m.report.collect()[0].taken == 0


def test_whole_epochs_come_before_the_fraction(spark):
    rows = [(i, "a", "x" * 10, 1.0) for i in range(100)] + [(i, None, "x" * 10, 1.0) for i in range(100, 500)]
    m = mixed(spark, rows, [("a", 0.5, 9)])  # 2500 of 1000: two epochs and a half
    times = [r.times for r in m.selection.collect()]
    assert len(times) == 100 and sorted(set(times)) == [2, 3] and times.count(3) == 50


def test_the_fraction_is_what_a_plain_sort_by_key_selects(spark):
    rows = documents(800, 3)
    m = mixed(spark, rows, [("big", 0.21, 1)])
    df = spark.createDataFrame([r for r in rows if (r[1] or "").strip().lower() == "big"], "doc_id long, source string, text string, weight double")
    u = (F.pmod(F.xxhash64("doc_id", F.lower(F.trim("source")), F.lit(42)), F.lit(1 << 52).cast("long")) + 0.5) / float(1 << 52)
    keyed = df.select("doc_id", F.length("text").alias("n"), (-F.log(u) / F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(1e-6))).alias("key")).collect()
    budget, total, want = 0.21 * sum(len(t) for _, _, t, _ in rows), 0, set()
    for r in sorted(keyed, key=lambda r: (r.key, r.doc_id)):
        total += r.n
        if total - r.n / 2 <= budget:
            want.add(r.doc_id)
    got = {r.id for r in m.selection.collect()}
    assert {i for i in got ^ want if len(rows[i][2])} == set()


def test_heavier_records_are_taken_more_often(spark):
    rows = [(i, "a", "x" * 10, 4.0 if i % 2 else 1.0) for i in range(4000)]
    taken = [r.id for r in mixed(spark, rows, [("a", 0.25, 1)]).selection.collect()]
    assert sum(i % 2 for i in taken) / len(taken) > 0.7


def test_targets_that_are_alike_are_one_and_nulls_have_a_meaning(spark):
    rows = [(i, "a", "x" * 10, 1.0) for i in range(100)] + [(i, "b", "y" * 10, 1.0) for i in range(100, 200)]
    m = mixed(spark, rows, [("a", 0.1, 1), (" A", 0.15, 3), (None, 0.5, 1), ("b", None, None)])
    report = {r.source: r for r in m.report.collect()}
    assert set(report) == {"a", "b"} and report["a"].target_share == 0.25 and report["a"].max_repeats == 3 and report["a"].taken == 500
    assert report["b"].taken == 0 and not report["b"].exhausted


def test_empty_texts_and_tables(spark):
    m = mixed(spark, [], [("a", 1.0, 1)])
    assert m.selection.count() == 0 and m.report.collect()[0].share_of_all is None
    m = mixed(spark, [(1, "a", None, 1.0), (2, "a", "", 1.0), (1, "a", None, 1.0)], [("a", 1.0, 2)])
    assert m.report.collect()[0].taken == 0


def test_repeated_rows_stay_within_the_budget(spark):
    rows = [(7, "a", "x" * 10, 1.0)] * 300
    r = mixed(spark, rows, [("a", 0.5, 1)]).report.collect()[0]
    assert r.taken == 1500


def test_too_many_targets_are_refused(spark):
    with pytest.raises(ValueError):
        mixed(spark, [], [(f"s{i}", 0.0, 1) for i in range(mixing.MOST_SOURCES + 1)])


def test_prose_weight(spark):
    df = spark.createDataFrame([(["markdown", "code"],), ([],), (None,), ([None, "markdown"],)], "c array<string>")
    assert [r[0] for r in df.select(mixing.prose_weight(F.col("c"))).collect()] == [0.625, 0.25, 0.25, 0.625]
    assert math.isclose(sum([0.625, 0.25]), 0.875)


def test_a_total_of_ones_own(spark):
    rows = [(i, "a", "x" * 10, 1.0) for i in range(100)] + [(i, "b", "y" * 10, 1.0) for i in range(100, 200)]
    report = {r.source: r for r in mixed(spark, rows, [("a", 0.25, 1), ("b", 0.75, 1)], total_tokens=400).report.collect()}
    assert (report["a"].taken, report["b"].taken) == (100, 300) and report["b"].actual_share == 0.75
