"""One row per entity with a count, a recency and a total for each of hundreds of event types.

Events shrink to a compact long table (entity, type) first; only that table is pivoted, under the explicit list of
types, into rows per entity. What is moved for the pivot are the narrow rows of the long table, of which an entity has
no more than the list is long; wide rows exist only in the task that writes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.instants import nonblank, plain_kind, plain_name

MOST_KINDS = 10_000


def kind_list(kinds: DataFrame) -> list[tuple[int, str]]:
    """The explicit type list: (kind_no, kind_name) by number. Nulls are left out; more than MOST_KINDS rows are refused."""
    from strandline.tables import bounded_rows

    rows = bounded_rows(kinds.select("kind_no", "kind_name").filter("kind_no is not null and kind_name is not null"), MOST_KINDS, "the list of kinds")
    return sorted((r.kind_no, r.kind_name) for r in rows)


def with_kind(events: DataFrame, group: Column, kinds: list[tuple[int, str]]) -> DataFrame:
    """``events`` with ``_kind_no``, for rows whose group is a kind's name up to case, spaces, ``_``, ``-``, ``.``.

    Two names alike under that rule: the smaller number stands for both. Other rows, and rows without a group, go.
    """
    spark = events.sparkSession
    plain: dict[str, int] = {}
    for no, name in kinds:
        plain.setdefault(plain_name(name), no)
    names = spark.createDataFrame([(k, v) for k, v in plain.items()], "_plain string, _kind_no int")
    return events.withColumn("_plain", plain_kind(group)).join(F.broadcast(names), "_plain").drop("_plain")


def kind_cells(events: DataFrame, by: dict[str, Column], group: Column, uid: Column, value: Column, instant_us: Column, kinds: list[tuple[int, str]]) -> DataFrame:
    """The long table: one row per combination of ``by`` and kind with n, last_us and total.

    The first column of ``by`` is the entity; rows with a blank one go. A record delivered again (same uid,
    entity, kind) counts once, with its largest value and latest instant should copies differ; rows without
    a uid are all counted. Null values add nothing to the total, which is 0 if all are null; without any
    instant last_us is null. Copies are merged by uid first, which spreads a hot entity over all tasks.
    """
    entity = next(iter(by))
    named = with_kind(events.select(*(c.alias(f"_by_{n}") for n, c in by.items()), group.alias("_group"), uid.alias("_uid"), value.cast("double").alias("_value"), instant_us.alias("_us")), F.col("_group"), kinds)
    named = named.filter(nonblank(f"_by_{entity}"))
    keys = [f"_by_{n}" for n in by]
    own = F.when(F.col("_uid").isNull(), F.monotonically_increasing_id())
    once = named.withColumn("_own", own).groupBy("_uid", "_own", *keys, "_kind_no").agg(F.max("_value").alias("_value"), F.max("_us").alias("_us"))
    long = once.groupBy(*keys, "_kind_no").agg(F.count(F.lit(1)).alias("n"), F.max("_us").alias("last_us"), F.coalesce(F.sum("_value"), F.lit(0.0)).alias("total"))
    return long.select(*(F.col(f"_by_{n}").alias(n) for n in by), F.col("_kind_no").alias("kind_no"), "n", "last_us", "total")


def recency_s(last_us: Column, as_of_us: int | None) -> Column:
    """Seconds from the last instant to ``as_of_us``; null if either is missing."""
    return (F.lit(as_of_us).cast("long") - last_us) / F.lit(1e6)


def pivot_cells(long: DataFrame, by: list[str], kinds: list[tuple[int, str]], as_of_us: int | None = None) -> DataFrame:
    """One row per combination of ``by``; ``cells`` maps each kind of the explicit list that occurs to its cell.

    The sparse form of the table. A cell is (n, recency_s, total). Recency runs up to ``as_of_us``, null if that or the
    last instant is missing. Kinds outside the list are left out, so a row holds at most as many cells as the list is long.
    """
    listed = F.col("kind_no").isin([no for no, _ in kinds])
    cell = F.struct("n", recency_s(F.col("last_us"), as_of_us).alias("recency_s"), "total")
    return long.filter(listed).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("kind_no", cell.alias("cell")))).alias("cells"))


def feature_table(long: DataFrame, entity: str, kinds: list[tuple[int, str]], as_of_us: int | None = None) -> DataFrame:
    """One row per entity with the columns ``n_<kind>``, ``recency_s_<kind>``, ``total_<kind>`` for each kind of the explicit list.

    0, null and 0.0 where there is no event. The long table's rows are gathered by entity once, before they are grouped,
    so that grouping and pivoting move nothing more.
    """
    gathered = long.repartition(entity).groupBy(entity)
    wide = gathered.pivot("kind_no", [no for no, _ in kinds]).agg(F.first("n").alias("n"), F.first("last_us").alias("last_us"), F.first("total").alias("total"))
    at = "CAST(NULL AS BIGINT)" if as_of_us is None else f"{as_of_us}L"
    quoted = lambda name: f"`{name.replace('`', '``')}`"
    out = []  # as text, which is built much faster than as many columns
    for no, name in kinds:
        out += [f"coalesce(`{no}_n`, 0L) AS {quoted(f'n_{name}')}", f"({at} - `{no}_last_us`) / 1e6D AS {quoted(f'recency_s_{name}')}", f"coalesce(`{no}_total`, 0D) AS {quoted(f'total_{name}')}"]
    return wide.selectExpr(quoted(entity), *out)


def filled_cells(pivoted: DataFrame, by: list[str]) -> DataFrame:
    """The non-empty cells of the sparse table, as rows (``by``, kind_no, n, recency_s, total)."""
    rows = pivoted.select(*by, F.explode("cells").alias("kind_no", "_cell"))
    return rows.select(*by, "kind_no", "_cell.n", "_cell.recency_s", "_cell.total")
