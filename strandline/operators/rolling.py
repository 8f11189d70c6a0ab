"""Counts, totals and averages over trailing periods for each entity and day, days without activity included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.instants import epoch_day, nonblank, plain_name
from strandline.operators.features import with_kind


def daily(events: DataFrame, entity: Column, instant_us: Column, value: Column, uid: Column) -> DataFrame:
    """(entity, day, n, total): one row per entity and UTC day with at least one record.

    Blank entities and rows without an instant go. A record delivered again (same uid, entity, day) counts once,
    with its largest value; rows without a uid are all counted. Null values count as records and add nothing.
    """
    rows = events.select(entity.cast("string").alias("entity"), epoch_day(instant_us).alias("day"), value.cast("double").alias("v"), uid.alias("u"))
    rows = rows.filter(nonblank("entity") & F.col("day").isNotNull())
    own = F.when(F.col("u").isNull(), F.monotonically_increasing_id())
    once = rows.withColumn("own", own).groupBy("u", "own", "entity", "day").agg(F.max("v").alias("v"))
    return once.groupBy("entity", "day").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"))


def densify(days: DataFrame) -> DataFrame:
    """Each entity crossed with the calendar from its first to its last active day; days without activity have n 0 and total 0.

    The calendar is generated row by row between one active day and the next, so no pair outside the span is ever made.
    """
    following = F.lead("day").over(Window.partitionBy("entity").orderBy("day"))
    gap = F.coalesce(following - F.col("day") - 1, F.lit(0))
    spans = days.withColumn("gap", gap).select("entity", "day", "n", "total", F.explode(F.sequence(F.lit(0), F.col("gap"))).alias("off"))
    real = F.col("off") == 0
    return spans.select("entity", (F.col("day") + F.col("off")).alias("day"), F.when(real, F.col("n")).otherwise(0).alias("n"), F.when(real, F.col("total")).otherwise(0.0).alias("total"))


def trailing(dense: DataFrame, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """``dense`` with n_<p>, total_<p> and avg_<p> for each period of p days: the day itself and the p - 1 before it.

    Averages are per day of the period, days before the entity's first one counting as empty.
    """
    out = dense
    for p in periods:
        w = Window.partitionBy("entity").orderBy("day").rowsBetween(1 - p, 0)
        out = out.withColumn(f"n_{p}", F.sum("n").over(w)).withColumn(f"total_{p}", F.sum("total").over(w))
    return out.withColumns({f"avg_{p}": F.col(f"total_{p}") / F.lit(float(p)) for p in periods})


def rolling_totals(events: DataFrame, entity: Column, instant_us: Column, value: Column, uid: Column, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Daily sums, densified, then window sums over a fixed number of preceding rows. See the three steps."""
    return trailing(densify(daily(events, entity, instant_us, value, uid)), periods)


def anchored(totals: DataFrame, events: DataFrame, entity: Column, instant_us: Column, group: Column, uid: Column, tie: Column, specs: DataFrame) -> DataFrame:
    """The rolling totals at the anchors of ``specs``: (anchor_no, entity, day, anchor_us, tie, and the totals' columns).

    An anchor is a record whose group is the spec's, letter case and separators aside. Per entity and day the
    first ``anchor_max`` by instant and then by ``tie`` are kept, all of them where it is null. Redelivered records are one.
    The specs are a small list; each is one kind of record.
    """
    from strandline.tables import bounded_rows

    rows = bounded_rows(specs.select("anchor_no", "anchor_group", "anchor_max").filter("anchor_no is not null and anchor_group is not null"), 10_000, "the list of anchors")
    number = {plain: i for i, plain in enumerate(sorted({plain_name(r.anchor_group) for r in rows}))}
    kinds = [(i, plain) for plain, i in number.items()]
    wanted = specs.sparkSession.createDataFrame([(r.anchor_no, number[plain_name(r.anchor_group)], r.anchor_max) for r in rows], "anchor_no int, _kind_no int, anchor_max int")
    found = with_kind(events.select(entity.cast("string").alias("entity"), instant_us.alias("anchor_us"), group.alias("_g"), uid.alias("_u"), tie.alias("tie")), F.col("_g"), kinds)
    found = found.filter(nonblank("entity") & F.col("anchor_us").isNotNull()).withColumn("day", epoch_day(F.col("anchor_us")))
    own = F.when(F.col("_u").isNull(), F.col("tie"))
    once = found.withColumn("_own", own).groupBy("_u", "_own", "entity", "day", "_kind_no").agg(F.min("anchor_us").alias("anchor_us"), F.min("tie").alias("tie"))
    placed = once.join(F.broadcast(wanted), "_kind_no")
    # A fixed bound on the rank lets each task drop what cannot be kept before anything is moved; uncapped specs need no rank.
    most = max((r.anchor_max for r in rows if r.anchor_max is not None), default=0)
    rank = F.row_number().over(Window.partitionBy("entity", "day", "anchor_no").orderBy("anchor_us", "tie"))
    capped = placed.filter(F.col("anchor_max").isNotNull()).withColumn("_rank", rank).filter(F.col("_rank") <= most).filter(F.col("_rank") <= F.col("anchor_max"))
    kept = placed.filter(F.col("anchor_max").isNull()).unionByName(capped.drop("_rank"))
    return kept.select("anchor_no", "entity", "day", "anchor_us", "tie").join(totals, ["entity", "day"])
