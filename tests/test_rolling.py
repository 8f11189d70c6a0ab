import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandline.operators import rolling

DAY = 86_400_000_000
SCHEMA = "who string, us long, v double, uid long, kind string, tie long, day string, n string, total string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def totals(df):
    return rolling.rolling_totals(df, F.col("who"), F.col("us"), F.col("v"), F.col("uid"))


def test_equals_brute_force(spark):
    r = random.Random(3)
    rows = [(f"e{r.randint(0, 5)}", r.randint(0, 70) * DAY + r.randint(0, DAY - 1), r.randint(0, 9) / 2, i, "x", i) for i in range(120)]
    by = defaultdict(lambda: defaultdict(list))
    for who, us, v, *_ in rows:
        by[who][us // DAY].append(v)
    want = {}
    for who, days in by.items():
        for d in range(min(days), max(days) + 1):
            near = [[x for e in range(d - p + 1, d + 1) for x in days.get(e, ())] for p in (7, 30)]
            want[who, d] = (len(days.get(d, ())), len(near[0]), sum(near[0]), len(near[1]), sum(near[1]))
    got = {(x.entity, x.day): (x.n, x.n_7, x.total_7, x.n_30, x.total_30) for x in totals(frame(spark, rows)).collect()}
    assert got == want


def test_copies_blanks_nulls_and_days_before_the_epoch(spark):
    rows = [("a", -1, 2.0, 1, "x", 1), ("a", -1, 2.0, 1, "x", 2), ("a", 0, None, None, "x", 3), ("a", 0, None, None, "x", 3), (" ", 0, 1.0, 4, "x", 4), (None, 0, 1.0, 5, "x", 5), ("a", None, 1.0, 6, "x", 6)]
    got = {(x.entity, x.day): (x.n, x.total, x.n_7, x.avg_7) for x in totals(frame(spark, rows)).collect()}
    assert got == {("a", -1): (1, 2.0, 1, 2.0 / 7), ("a", 0): (2, 0.0, 3, pytest.approx(2.0 / 7))}


def test_empty(spark):
    assert totals(frame(spark, [])).count() == 0


def test_anchors_keep_the_first_of_a_day(spark):
    rows = [("a", 5, 1.0, 1, "Pet Start", 1), ("a", 3, 1.0, 2, "pet_start", 2), ("a", 3, 1.0, 3, "petstart", 3), ("a", DAY, 1.0, 4, "pet_start", 4), ("a", 7, 1.0, 5, "other", 5), ("a", 9, 1.0, 2, "pet_start", 9), (None, 1, 1.0, 6, "pet_start", 6), ("a", None, 1.0, 7, "pet_start", 7)]
    df = frame(spark, rows)
    specs = spark.createDataFrame([(1, "pet_start", 1), (2, "pet_start", None), (3, "PET.start", 2), (4, None, 1)], "anchor_no int, anchor_group string, anchor_max int")
    got = rolling.anchored(totals(df), df, F.col("who"), F.col("us"), F.col("kind"), F.col("uid"), F.col("tie"), specs)
    assert sorted((x.anchor_no, x.day, x.tie) for x in got.collect()) == [(1, 0, 2), (1, 1, 4), (2, 0, 1), (2, 0, 2), (2, 0, 3), (2, 1, 4), (3, 0, 2), (3, 0, 3), (3, 1, 4)]
    assert [x.n_7 for x in got.filter("anchor_no = 1").orderBy("day").collect()] == [4, 5]
