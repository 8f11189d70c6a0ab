"""Per-day aggregates by event time that late records correct until a cut-off.

The state of a period is a multiset: how often each value occurred, among the records that were there when the
period ended and among those that came late but in time. A late record only moves counts; the log of these changes
is what becomes of late records, and the state is the counts at the end plus the log. Medians, numbers of
distinct values and extremes are not kept but read off the counts, so a correction can never leave them stale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.instants import DAY_US, period_no
from strandline.session import materialize

ON_TIME, CORRECTED, DROPPED = "on_time", "corrected", "dropped"


def judged(events: DataFrame, uid: Column, tie: Column, arrived_us: Column, instant_us: Column, value: Column, period_us: int = DAY_US, cutoff_s: int = 48 * 3600) -> DataFrame:
    """The counted record of each uid with its period and verdict: (tie, period, value, verdict).

    Of the rows of one uid the one that arrived first counts, then the one with the smallest tie; a row that never
    arrived comes last. Rows without a uid are all counted. ``period`` numbers the periods since the epoch. A record
    is on time if it arrived before the period's end, corrects it up to ``cutoff_s`` after the end (inclusive), and
    is dropped later. A record without an instant has no period and goes; one without an arrival is dropped as too late.
    """
    rows = events.select(uid.alias("u"), tie.alias("tie"), arrived_us.alias("a"), instant_us.alias("t"), value.cast("double").alias("value"))
    own = F.when(F.col("u").isNull(), F.col("tie"))
    first = Window.partitionBy("u", own).orderBy(F.asc_nulls_last("a"), "tie")
    once = rows.withColumn("rank", F.row_number().over(first)).filter("rank = 1").filter(F.col("t").isNotNull())
    period = period_no(F.col("t"), period_us)
    late_us = F.col("a") - (period + 1) * F.lit(period_us)
    verdict = F.when(late_us < 0, ON_TIME).when(late_us <= cutoff_s * 1_000_000, CORRECTED).otherwise(DROPPED)
    return once.select("tie", period.alias("period"), "value", verdict.alias("verdict"))


def change_log(records: DataFrame) -> DataFrame:
    """What late records do to the state, one row each: (tie, period, value, verdict, delta).

    ``delta`` is 1 where the record raises its value's count in its period, and 0 where it came past the cut-off.
    """
    late = records.filter(F.col("verdict") != ON_TIME)
    return late.withColumn("delta", F.when(F.col("verdict") == CORRECTED, 1).otherwise(0).cast("long"))


def multisets(records: DataFrame) -> DataFrame:
    """The state: (period, value, n_on_time, n_corrected, n_dropped), one row per period and distinct value.

    Records on time make the counts at the period's end; the log of changes adds to them. A null value has its own
    row. Combined on the map side, so a period or a value with a third of all rows is no burden.
    """
    base = records.filter(F.col("verdict") == ON_TIME).select("period", "value", F.lit(ON_TIME).alias("verdict"), F.lit(1).cast("long").alias("delta"))
    entries = base.unionByName(change_log(records).drop("tie"))
    n = lambda v, c: F.sum(F.when(F.col("verdict") == v, c).otherwise(0)).alias(f"n_{v}")
    return entries.groupBy("period", "value").agg(n(ON_TIME, F.col("delta")), n(CORRECTED, F.col("delta")), n(DROPPED, F.lit(1) - F.col("delta")))


def changed_entries(state: DataFrame) -> DataFrame:
    """The entries of the state that late records changed or came too late for: (period, value, n_at_close, n_final, n_dropped)."""
    shown = state.select("period", "value", F.col(f"n_{ON_TIME}").alias("n_at_close"), (F.col(f"n_{ON_TIME}") + F.col(f"n_{CORRECTED}")).alias("n_final"), F.col(f"n_{DROPPED}").alias("n_dropped"))
    return shown.filter((F.col("n_final") > F.col("n_at_close")) | (F.col("n_dropped") > 0))


def period_aggregates(state: DataFrame) -> DataFrame:
    """One row per period: records, distinct values, extremes, total and exact median, at the period's end and at the cut-off.

    Columns n, n_values, n_distinct, least, most, total, median with suffix _close (only what was there at the end) and
    _final (with the corrections), and n_corrected, n_dropped. Nulls count in n alone; a period without values has
    null statistics. NaN ranks above all numbers. The median of an even number is the mean of the middle two.

    Ranks come from cumulative counts in two levels. The state is cut into ranges of (period, value), even in rows
    whatever the values are since no two rows are alike; the counts of ranges tell which one holds a middle, and only
    there are values counted up one by one. No task sorts a whole period.
    """
    counted = state.select("period", "value", F.col(f"n_{ON_TIME}").alias("c_close"), (F.col(f"n_{ON_TIME}") + F.col(f"n_{CORRECTED}")).alias("c_final"), F.col(f"n_{CORRECTED}").alias("n_corrected"), F.col(f"n_{DROPPED}").alias("n_dropped"))
    ranged = counted.repartitionByRange("period", "value").withColumn("b", F.spark_partition_id())
    ranged = materialize(ranged, "late-state")  # the numbers of ranges must not change between the two levels
    phases = ("close", "final")
    sums = [F.sum("n_corrected").alias("n_corrected"), F.sum("n_dropped").alias("n_dropped")]
    for x in phases:
        c, v = F.col(f"c_{x}"), F.when(F.col(f"c_{x}") > 0, F.col("value"))
        sums += [F.sum(c).alias(f"n_{x}"), F.sum(F.when(F.col("value").isNotNull(), c).otherwise(0)).alias(f"n_values_{x}"), F.count(v).alias(f"n_distinct_{x}"), F.min(v).alias(f"least_{x}"), F.max(v).alias(f"most_{x}"), F.sum(v * c).alias(f"total_{x}")]
    whole = ranged.groupBy("period").agg(*sums)

    valued = ranged.filter(F.col("value").isNotNull())
    in_order = Window.partitionBy("period").orderBy("b")
    ranges = valued.groupBy("period", "b").agg(*(F.sum(f"c_{x}").alias(f"c_{x}") for x in phases))
    middle = {}
    for x in phases:
        n = F.sum(f"c_{x}").over(Window.partitionBy("period"))
        before = F.sum(f"c_{x}").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(f"c_{x}")
        middle |= {f"lo_{x}": F.floor((n + 1) / 2) - before, f"hi_{x}": F.floor((n + 2) / 2) - before}
    ranked = ranges.withColumns(middle)
    inside = lambda x: F.col(f"lo_{x}").between(1, F.col(f"c_{x}")) | F.col(f"hi_{x}").between(1, F.col(f"c_{x}"))
    held = ranked.filter(inside("close") | inside("final")).select("period", "b", *middle)
    near = valued.select("period", "b", "value", "c_close", "c_final").join(held, ["period", "b"])
    by_value = Window.partitionBy("period", "b").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    picked = near.withColumns({f"to_{x}": F.sum(f"c_{x}").over(by_value) for x in phases})
    at = lambda x, r: F.max(F.when((F.col(f"{r}_{x}") <= F.col(f"to_{x}")) & (F.col(f"{r}_{x}") > F.col(f"to_{x}") - F.col(f"c_{x}")), F.col("value")))
    medians = picked.groupBy("period").agg(*(((at(x, "lo") + at(x, "hi")) / 2).alias(f"median_{x}") for x in phases))
    order = ["period", *(f"{k}_{x}" for x in phases for k in ("n", "n_values", "n_distinct", "least", "most", "total", "median")), "n_corrected", "n_dropped"]
    return whole.join(medians, "period", "left").select(*order)
