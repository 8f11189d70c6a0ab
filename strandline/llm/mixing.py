"""A selection in which each source has its target share of the total size.

Every record draws an exponential key, divided by its quality weight; taking the smallest keys first is weighted
sampling without replacement (Efraimidis and Spirakis). A source whose budget exceeds its size is taken whole as
often as the budget and the cap on repeats allow; only what is left over is filled by the smallest keys, up to
the record whose running total comes nearest to it.

Running totals are two-level: the records are cut into ranges of (source, key), even in rows however the keys lie,
the sizes of ranges decide most records by their range alone, and just the range in which a budget ends is summed
record by record. No task ever holds a whole source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.tokens import token_count
from strandline.session import materialize
from strandline.tables import bounded_rows

#: Ranges at least; more where the session shuffles into more partitions.
RANGES = 64
MOST_SOURCES = 100
#: A total for ``mix``: the largest at which every source reaches its share.
FIT = "fit"


@dataclass(frozen=True)
class Mixture:
    """``selection``: (id, source, tokens, times), each record taken once or more; ``report``: a row per source."""

    selection: DataFrame
    report: DataFrame


def plain_source(c: Column) -> Column:
    return F.lower(F.trim(c))


def prose_weight(cell_kinds: Column) -> Column:
    """A notebook's quality weight in [0.25, 1]: the more of its cells hold prose, the heavier; 0.25 without cells."""
    n = F.size(cell_kinds)
    prose = F.size(F.filter(cell_kinds, lambda k: k == "markdown"))
    return F.when(n > 0, 0.25 + 0.75 * prose / n).otherwise(0.25)


def fitting_total(sizes: dict[str, int], wanted: dict[str, tuple[float, int]]) -> float:
    """The largest total of which every source with documents can give its share, repeated as often as it may be.

    With a larger total the scarcest source falls behind its share; a smaller one would leave documents unused for
    nothing. Sources without documents have no say; with none left that asks for a share the total is 0.
    """
    most = [sizes[s] * cap / share for s, (share, cap) in wanted.items() if share > 0 and sizes.get(s)]
    return min(most, default=0.0)


def mix(docs: DataFrame, targets: DataFrame, doc_id: Column, source: Column, text: Column, weight: Column, seed: int = 42, tokenizer: str = "bytes", total_tokens: int | str | None = None) -> Mixture:
    """Records of ``docs`` in the shares of ``targets`` (source, target_share, max_repeats; at most MOST_SOURCES sources).

    A source's budget is its share of ``total_tokens``, by default the size of all documents, whatever their source; then
    sources that run out fall behind and the others come out above their shares. With FIT the total is the largest at
    which none runs out, so that the shares are met. Sources are compared trimmed
    and in lower case; targets that are then alike add up their shares and take the larger cap. A null share is 0, a
    null or negative cap 1, a null or non-positive weight the smallest there is. Documents of other or null sources
    count in the total only. Records are told apart by row; rows of one id and source draw the same key and are taken in
    any order. Sources without documents are reported with nothing taken. Documents of size 0 cost nothing and come along.
    """
    spark = docs.sparkSession
    wanted: dict[str, tuple[float, int]] = {}
    for r in bounded_rows(targets.select(plain_source(F.col("source")).alias("s"), "target_share", "max_repeats").filter("s is not null"), MOST_SOURCES, "the list of target shares"):
        share, cap = wanted.get(r.s, (0.0, 0))
        wanted[r.s] = (share + (r.target_share or 0.0), max(cap, r.max_repeats if r.max_repeats is not None and r.max_repeats >= 0 else 1))

    weighed = F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(1e-6))
    narrow = docs.select(doc_id.alias("id"), plain_source(source).alias("source"), token_count(text, tokenizer).alias("tokens"), weighed.alias("w"), F.monotonically_increasing_id().alias("row"))
    uniform = (F.pmod(F.xxhash64("id", "source", F.lit(seed)), F.lit(1 << 52).cast("long")) + F.lit(0.5)) / F.lit(float(1 << 52))
    keyed = materialize(narrow.withColumn("key", -F.log(uniform) / F.col("w")).drop("w"), "mix-keys")

    listed = F.col("source").isin(list(wanted))
    sizes = {r.s: r.tokens for r in keyed.groupBy(F.when(listed, F.col("source")).alias("s")).agg(F.sum("tokens").alias("tokens")).collect()}
    total = fitting_total(sizes, wanted) if total_tokens == FIT else sum(sizes.values()) if total_tokens is None else total_tokens
    plans = []
    for s, (share, cap) in wanted.items():
        size, budget = sizes.get(s, 0), share * total
        epochs = min(cap, int(budget / size + 1e-9)) if size else cap
        rest = 0.0 if epochs >= cap else max(0.0, budget - epochs * size)
        plans.append((s, share, cap, size, budget, epochs, rest))
    plan = spark.createDataFrame(plans, "source string, target_share double, max_repeats int, size long, budget double, epochs int, rest double")

    # The ranges are written, so that their numbers stay the same for all that follows.
    n_ranges = max(RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = materialize(keyed.filter(listed).repartitionByRange(n_ranges, "source", "key", "row").withColumn("spot", F.spark_partition_id()), "mix-ranges")
    ordered = Window.partitionBy("source").orderBy("spot").rowsBetween(Window.unboundedPreceding, 0)
    # At most MOST_SOURCES + n_ranges rows hold what lies before each range of keys.
    bounds = ranged.groupBy("source", "spot").agg(F.sum("tokens").alias("inside")).withColumn("before", F.sum("inside").over(ordered) - F.col("inside"))
    bounds = bounds.join(F.broadcast(plan.select("source", "epochs", "rest")), "source")
    placed = ranged.join(F.broadcast(bounds), ["source", "spot"])
    whole = F.col("before") + F.col("inside") <= F.col("rest")
    torn = ~whole & (F.col("before") < F.col("rest"))
    settled = placed.filter(~torn).withColumn("part", F.when(whole & (F.col("rest") > 0), 1).otherwise(0))
    by_key = Window.partitionBy("source", "spot").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("tokens").over(by_key)
    cut = placed.filter(torn).withColumn("upto", upto).withColumn("part", F.when(F.col("upto") - F.col("tokens") / 2 <= F.col("rest"), 1).otherwise(0)).drop("upto")
    taken = settled.unionByName(cut).withColumn("times", F.col("epochs") + F.col("part")).filter("times > 0")
    selection = taken.select("id", "source", "tokens", "times")

    reached = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("taken"), F.count(F.lit(1)).alias("n_docs"), F.max("times").alias("most_times"))
    of_all = F.sum("taken").over(Window.partitionBy())
    report = (
        plan.join(reached, "source", "left")
        .withColumn("taken", F.coalesce("taken", F.lit(0)))
        .select(
            "source", "target_share", "max_repeats", "size", "budget", "epochs", "taken", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_times", F.lit(0)).alias("most_times"),
            F.try_divide(F.col("taken").cast("double"), F.lit(float(total))).alias("share_of_all"), F.try_divide(F.col("taken").cast("double"), of_all).alias("actual_share"),
            ((F.col("taken") == F.col("size") * F.col("max_repeats")) & (F.col("taken") < F.col("budget") * (1 - 1e-12))).alias("exhausted"),
        )
    )
    return Mixture(selection, report)


def selection_check(selection: DataFrame, docs: DataFrame, report: DataFrame, doc_id: Column, source: Column, text: Column, tokenizer: str = "bytes") -> DataFrame:
    """Per source what must hold: (source, n_foreign, n_wrong_size, n_above_cap, n_uneven, off_budget, off_share).

    Records that no document of that source is, or whose size is not its text's; records taken more often than the cap,
    or not as often as the whole epochs and at most once more. ``off_budget`` is 1 if a source with documents enough
    misses its budget by more than its largest document; ``off_share`` if a selection in which no source is exhausted
    misses the target share by more than a hundredth. Ids must be unique.
    """
    own = docs.select(doc_id.alias("id"), plain_source(source).alias("of"), token_count(text, tokenizer).alias("size"))
    held = selection.join(own, "id", "left").join(F.broadcast(report.select("source", "epochs", "max_repeats")), "source")  # a row per source
    foreign = ~F.col("of").eqNullSafe(F.col("source"))
    per = held.groupBy("source").agg(
        F.count_if(foreign).alias("n_foreign"), F.count_if(~foreign & (F.col("size") != F.col("tokens"))).alias("n_wrong_size"), F.count_if(F.col("times") > F.col("max_repeats")).alias("n_above_cap"),
        F.count_if(~F.col("times").between(F.col("epochs"), F.col("epochs") + 1)).alias("n_uneven"),
    )
    largest = own.groupBy(F.col("of").alias("source")).agg(F.max("size").alias("largest"))
    none = F.lit(0).cast("long")
    ran_out = F.max(F.col("exhausted").cast("int")).over(Window.partitionBy()) == 1
    named = report.select("source", "size", "budget", "taken", "exhausted", "actual_share", "target_share", ran_out.alias("ran_out")).join(per, "source", "left").join(largest, "source", "left")
    off = (F.col("size") > 0) & ~F.col("exhausted") & (F.abs(F.col("taken") - F.col("budget")) > F.coalesce("largest", none))
    missed = ~F.col("ran_out") & (F.abs(F.col("actual_share") - F.col("target_share")) > 0.01)
    return named.select("source", *(F.coalesce(c, none).alias(c) for c in ("n_foreign", "n_wrong_size", "n_above_cap", "n_uneven")), off.cast("int").alias("off_budget"), F.coalesce(missed.cast("int"), F.lit(0)).alias("off_share"))
