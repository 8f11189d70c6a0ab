"""Blocks out of keyed events: grouped aggregation per rule, sessions from fragments, and merging with earlier blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.instants import epoch_day

_TYPES = {"int": "bigint", "float": "double", "bool": "boolean", "dt": "timestamp", "str": "string", "date": "date"}


def spark_type(field_type: str, shape) -> str:
    """The Spark type of a field of ``field_type`` whose inputs have the compiled shape ``shape``."""
    simple = {"integer": "bigint", "float": "double", "string": "string", "boolean": "boolean", "datetime": "timestamp"}
    if field_type in simple:
        return simple[field_type]
    if field_type == "map":
        return f"map<{_TYPES.get(shape.key, 'string')},{_TYPES.get(shape.elem, 'string')}>"
    return f"array<{_TYPES.get(shape.elem or 'str', 'string')}>"


def default_of(field_type: str, kind: str) -> Column:
    """What a field that no event updated shows, for a Spark type ``kind``."""
    plain = {"integer": F.lit(0), "float": F.lit(0.0), "string": F.lit(""), "boolean": F.lit(False), "datetime": F.lit(None), "list": F.array(), "set": F.array(), "map": F.create_map()}
    return plain[field_type].cast(kind)


def finished(col: Column, rule: str, field_type: str, shape) -> Column:
    """The aggregated value with the field's default: before any event numbers are 0, so maxima and minima start there."""
    d = default_of(field_type, spark_type(field_type, shape))
    if rule == "max":
        return F.greatest(F.coalesce(col, d), d)
    if rule == "min":
        return F.least(F.coalesce(col, d), d)
    return F.coalesce(col, d)


def _order(names: list[str]) -> Column:
    return F.struct(*names)


def _in_order(u: Column, order: Column) -> Column:
    rows = F.array_sort(F.collect_list(F.when(u.isNotNull(), F.struct(order.alias("o"), u.alias("v")))))
    return F.transform(rows, lambda r: r["v"])


def aggregate_of(rule: str, inputs: list, order: list[str]) -> Column | None:
    """The grouped aggregate of a rule over event columns; None for maps, which take a grouping of their own."""
    u, by = inputs[0].col, _order(order)
    if rule == "sum":
        return F.sum(u)
    if rule == "last":
        return F.max_by(u, F.when(u.isNotNull(), by))
    if rule == "first":  # of the events at the first instant the last one with a value; none if they have none
        return F.max_by(u, F.struct((-F.unix_micros(order[0])).alias("t"), u.isNotNull().alias("has"), *order[1:]))
    if rule == "since":
        return F.max(u)
    if rule == "max":
        return F.max(u)
    if rule == "min":
        return F.min(u)
    if rule == "any":
        return F.bool_or(u)
    if rule == "append":
        return _in_order(u, by)
    if rule == "extend":
        return F.flatten(_in_order(u, by))
    if rule == "add":
        return F.array_sort(F.collect_set(u))
    return None


def _shape(rule: str, inputs: list):
    """The shape of the field that a rule makes out of its inputs' shapes."""
    from strandline.plans.expr import V

    if rule in ("increment", "put"):
        return V(inputs[0].col, "map", inputs[1].kind, inputs[0].kind)
    if rule in ("append", "add"):
        return V(inputs[0].col, "list", inputs[0].kind)
    return inputs[0]


def _raw(df: DataFrame, keys: list[str], timed: bool, rules: list, order: list[str]) -> DataFrame:
    """Per key the aggregates before defaults are put in: st, et and f0, f1 ... in the order of ``rules``."""
    times = [F.min("_time").alias("st"), F.max("_time").alias("et")]
    flat = [a.alias(f"f{i}") for i, (_, rule, inputs) in enumerate(rules) if (a := aggregate_of(rule, inputs, order)) is not None]
    out = df.groupBy(*keys).agg(*times, *flat)
    for i, (_, rule, inputs) in enumerate(rules):
        if rule not in ("increment", "put"):
            continue
        k, v = inputs[0].col, inputs[1].col
        entries = df.filter(k.isNotNull()).groupBy(*keys, k.alias("_mk")).agg((F.sum(v) if rule == "increment" else F.max_by(v, F.when(v.isNotNull(), _order(order)))).alias("_mv"))
        if rule == "increment":
            entries = entries.filter("_mv is not null")
        maps = entries.groupBy(*(F.col(x).alias(f"_j{n}") for n, x in enumerate(keys))).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_mk", "_mv")))).alias(f"f{i}"))
        same = None
        for n, x in enumerate(keys):
            c = F.col(x).eqNullSafe(F.col(f"_j{n}"))
            same = c if same is None else same & c
        out = out.join(maps, same, "left").drop(*(f"_j{n}" for n in range(len(keys))))
    return out


def _shown(raw: DataFrame, timed: bool, rules: list, dims: dict[str, str], bare: bool) -> DataFrame:
    """The block's columns; ``bare`` leaves fields that no event updated null instead of showing the default."""
    cols = [F.col("_id").alias("_identity")]
    if timed:
        cols += [F.col("st").alias("_start_time"), F.col("et").alias("_end_time")]
    for i, (f, rule, inputs) in enumerate(rules):
        shape = _shape(rule, inputs)
        if rule == "since":
            cols.append(F.coalesce(inputs[1](F.col(f"f{i}"), F.col("st")), default_of(f.type, spark_type(f.type, shape))).alias(f.name))
            continue
        c = F.col(f"f{i}").cast(spark_type(f.type, shape)) if bare else finished(F.col(f"f{i}"), rule, f.type, shape)
        cols.append(c.alias(f.name))
    return raw.select(*cols, *(F.col(c).alias(n) for n, c in dims.items()))


def grouped(df: DataFrame, agg, keys: list[str], dims: dict[str, str], rules: list, bare: bool = False) -> DataFrame:
    """One row per key: ``_identity``, start and end for blocks and sessions, the fields, the dimensions."""
    timed = agg.kind in ("block", "activity")
    return _shown(_raw(df, keys, timed, rules, ["_time", "_seq"]), timed, rules, dims, bare)


def _merge(rule: str, c: Column, order: Column) -> Column:
    """Merges partial results of a rule, those of a later ``order`` being newer."""
    if rule in ("sum", "max", "min", "any"):
        return {"sum": F.sum, "max": F.max, "min": F.min, "any": F.bool_or}[rule](c)
    if rule == "last":
        return F.max_by(c, F.when(c.isNotNull(), order))
    if rule == "first":
        return F.min_by(c, order)
    if rule == "since":
        return F.max(c)
    if rule in ("increment", "put"):
        lists = F.transform(_in_order(F.map_entries(c), order), F.map_from_entries)  # entries can be sorted along, maps cannot
    else:
        lists = _in_order(c, order)
    if rule in ("append", "extend"):
        return F.flatten(lists)
    if rule == "add":
        return F.array_sort(F.array_distinct(F.flatten(lists)))
    join = (lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))) if rule == "increment" else (lambda _, a, b: F.coalesce(b, a))
    return F.reduce(F.slice(lists, 2, F.greatest(F.size(lists) - 1, F.lit(0))), F.get(lists, F.lit(0)), lambda a, b: F.map_zip_with(a, b, join))


def merged_intervals(parts: DataFrame, gap_s: int, keep: list[str]) -> DataFrame:
    """``parts`` (_id, st, et, ...) with ``_sid``: parts of one id share it if a chain of gaps of at most ``gap_s`` links them."""
    w = Window.partitionBy("_id").orderBy("st", "et")
    before = F.max("et").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.unix_micros("st") - F.unix_micros(before) > gap_s * 1_000_000), 1).otherwise(0)
    return parts.withColumn("_opens", opens).withColumn("_sid", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).select(*keep, "_sid")


def fragments(df: DataFrame, gap_s: int, rules: list) -> DataFrame:
    """Sessions as far as they lie within one UTC day: (_id, _day, _part, st, et, f0, f1 ...), the aggregates of ``rules`` over each.

    An id that owns much of the table is spread over its days.
    """
    day = df.withColumn("_day", epoch_day(F.unix_micros("_time")))
    w = Window.partitionBy("_id", "_day").orderBy("_time", "_seq")
    gap = F.unix_micros("_time") - F.unix_micros(F.lag("_time").over(w))
    opens = F.when(gap <= gap_s * 1_000_000, 0).otherwise(1)
    cut = day.withColumn("_opens", opens).withColumn("_part", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return _raw(cut, ["_id", "_day", "_part"], True, rules, ["_time", "_seq"])


def _merged_fields(rules: list, first: int) -> list[Column]:
    return [_merge(rule, F.col(f"f{first + i}"), F.struct("st")).alias(f"f{i}") for i, (_, rule, _) in enumerate(rules)]


def sessions_of(parts: DataFrame, agg, rules: list, bare: bool = False, first: int = 0) -> DataFrame:
    """Sessions out of fragments, joined across days; the fields of ``rules`` are f<first> and on. Only fragments are moved."""
    linked = merged_intervals(parts, agg.gap_s, ["_id", "st", "et", *(f"f{first + i}" for i in range(len(rules)))])
    whole = linked.groupBy("_id", "_sid").agg(F.min("st").alias("s"), F.max("et").alias("et"), *_merged_fields(rules, first))
    return _shown(whole.withColumnRenamed("s", "st"), True, rules, {}, bare)


def identities_of(parts: DataFrame, rules: list, first: int) -> DataFrame:
    """One row per id out of the fragments of its sessions."""
    return _shown(parts.groupBy("_id").agg(*_merged_fields(rules, first)), False, rules, {}, False)


def session_blocks(df: DataFrame, agg, rules: list, bare: bool = False) -> DataFrame:
    """Sessions in two steps: fragments within (id, UTC day), then fragments of one id joined across days."""
    return sessions_of(fragments(df, agg.gap_s, rules), agg, rules, bare)


def carried_on(old: DataFrame, new: DataFrame, agg, kinds: dict[str, str]) -> DataFrame:
    """Earlier blocks merged with new, bare ones of the same aggregate; blocks on either side alone stay as they are.

    Identity and keyed blocks meet by key, sessions wherever they overlap or lie no further apart than the gap, also
    when a late event links two of them. What the new block did not set stays as the old block had it.
    """
    timed = agg.kind in ("block", "activity")
    types = dict(new.dtypes)
    sides = []
    for n, side in enumerate((old, new)):
        cols = [F.col("_identity").alias("_id"), F.lit(n).alias("_batch"), *(F.col(d.name).alias(f"_k{i}") for i, d in enumerate(agg.dimensions))]
        if timed:
            cols += [F.col("_start_time").alias("st"), F.col("_end_time").alias("et")]
        cols += [F.col(f.name).cast(types[f.name]).alias(f"f{i}") for i, f in enumerate(agg.fields)]
        sides.append(side.select(*cols))
    both = sides[0].unionByName(sides[1])
    keys = ["_id", *(f"_k{i}" for i in range(len(agg.dimensions)))]
    if agg.kind == "activity":
        both = merged_intervals(both, agg.gap_s, both.columns)
        keys = ["_id", "_sid"]
    order = F.struct("_batch", "st") if timed else F.struct("_batch")
    times = [F.min("st").alias("_start_time"), F.max("et").alias("_end_time")] if timed else []
    merged = both.groupBy(*keys).agg(*times, *(_merge(kinds[f.name], F.col(f"f{i}"), order).alias(f"_v{i}") for i, f in enumerate(agg.fields)))
    shown = []
    for i, f in enumerate(agg.fields):
        d, v = default_of(f.type, types[f.name]), F.col(f"_v{i}")
        filled = F.coalesce(v, d)
        if kinds[f.name] in ("max", "min"):
            filled = (F.greatest if kinds[f.name] == "max" else F.least)(filled, d)
        shown.append(filled.alias(f.name))
    return merged.select(F.col("_id").alias("_identity"), *(["_start_time", "_end_time"] if timed else []), *shown, *(F.col(f"_k{i}").alias(d.name) for i, d in enumerate(agg.dimensions)))
