import random

import pytest
from pyspark.sql import functions as F

from strandline.operators.sessions import put_items, sessionize

SCHEMA = "k string, t long, v long, seq long, edge string, pid int"


def plain_sessions(points, gap_us):
    out, last = [], {}
    for k, t, v in sorted((p[:3] for p in points if p[0] is not None and p[0].strip(" ") and p[1] is not None), key=lambda p: (p[0], p[1])):
        s = last.get(k)
        if s is None or t - s[2] > gap_us:
            s = last[k] = [k, t, t, 0, 0]
            out.append(s)
        s[2], s[3], s[4] = t, s[3] + 1, s[4] + (v or 0)
    return sorted(map(tuple, out))


def run(spark, points, gap_s=1):
    df = spark.createDataFrame([(*p, 1, "x", 3) for p in points], SCHEMA)
    return sorted(map(tuple, sessionize(df, F.col("k"), F.col("t"), F.col("v"), gap_s).collect()))


def test_gap_of_exactly_the_threshold_does_not_split(spark):
    assert run(spark, [("a", 0, 1), ("a", 1_000_000, 2), ("a", 2_000_001, 4)]) == [("a", 0, 1_000_000, 2, 3), ("a", 2_000_001, 2_000_001, 1, 4)]


def test_blank_keys_missing_instants_and_null_values(spark):
    points = [(None, 5, 1), ("", 5, 1), ("  ", 5, 1), ("a", None, 1), ("a", 5, None), ("A", 5, 2), ("a", 5, 3)]
    assert run(spark, points) == [("A", 5, 5, 1, 2), ("a", 5, 5, 2, 3)]


def test_empty(spark):
    assert run(spark, []) == []


def test_a_gap_below_one_is_refused(spark):
    with pytest.raises(ValueError):
        run(spark, [], 0)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force_with_a_hot_key_over_many_partitions(spark, seed):
    r = random.Random(seed)
    points = [("hot" if r.random() < 0.6 else f"k{r.randint(0, 40)}", r.randint(0, 400) * 500_000, r.randint(0, 3)) for _ in range(4000)]
    points += [("long", i * 1_000_000, 1) for i in range(3000)]  # one session over several partitions
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    try:
        assert run(spark, points) == plain_sessions(points, 1_000_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_a_put_again_replaces_the_item_whatever_the_spelling(spark):
    rows = [
        (1, "u", "s//2018-03-01T00:00:00+00:00", None, 4, "2018-03-01 00:00:10"),
        (2, "u", "s//2018-03-01T01:00:00+01:00", "2018-03-01T01:00:00+01:00", 7, "2018-03-01 00:00:20"),
        (3, "u", "s//2018-03-01T00:00:00", None, 9, None),
        (4, "u", "state//", None, 9, "2018-03-01 00:00:20"),
        (5, " ", "s//2018-03-01T00:00:00", None, 9, "2018-03-01 00:00:20"),
        (6, "u", None, None, 9, "2018-03-01 00:00:20"),
        (7, "u", "d/a:b/", "2018-03-01T00:00:00Z", None, "2018-03-01 00:00:20"),
        (8, "u", "s//not a time", "neither", 1, "2018-03-01 00:00:20"),
    ]
    df = spark.createDataFrame(rows, "item_id long, partition_key string, range_key string, _start_time string, events long, w string").withColumn("written_at", F.col("w").cast("timestamp"))
    got = {(r.partition_key, r.instant_us, r.events) for r in put_items(df).collect()}
    at = 1519862400000000
    assert got == {("u", at, 7), ("u", at, None)}
