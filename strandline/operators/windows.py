"""Windows over the blocks before or after an anchor block: one feature row per accepted anchor.

Windows are frames over an entity's blocks ordered by start, never joins. ``sum``, ``len``, ``max``, ``min``, the
first and the last of a neighbour field run as window aggregates; any other use of it collects the frame's values.
All frames share one partitioning and order, so Spark shuffles and sorts the blocks once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.blocks import default_of, spark_type
from strandline.plans.expr import Compiler, UnknownName, V, coerce, column_value
from strandline.plans.spec import Aggregate, StreamSpec, WindowSpec

DAY_US, HOUR_US = 86_400_000_000, 3_600_000_000


def _frame(w: Aggregate):
    """The frame of a window: blocks strictly before or after the anchor's start, both ends open for days and hours."""
    n = w.window_value
    if not n:
        raise ValueError(f"{w.name}: a window of 0 holds nothing")
    if w.window_type == "count":
        rows = Window.partitionBy("_identity").orderBy("_at", "_key")
        return rows.rowsBetween(n, -1) if n < 0 else rows.rowsBetween(1, n)
    if w.window_type not in ("day", "hour"):
        raise ValueError(f"{w.name}: unknown window type {w.window_type}")
    span = n * (DAY_US if w.window_type == "day" else HOUR_US)
    by_time = Window.partitionBy("_identity").orderBy("_at")
    return by_time.rangeBetween(span + 1, -1) if n < 0 else by_time.rangeBetween(1, span - 1)


class _Frames:
    """Window columns of all windows, added together so that Spark computes those of one order in one pass."""

    def __init__(self):
        self.first: dict[str, Column] = {}
        self.second: dict[str, Column] = {}

    def add(self, c: Column, after: bool = False) -> str:
        name = f"_w{len(self.first) + len(self.second)}"
        (self.second if after else self.first)[name] = c
        return name

    def onto(self, df: DataFrame) -> DataFrame:
        for columns in (self.first, self.second):
            df = df.withColumns(columns) if columns else df
        return df


class _Neighbours:
    """Columns computed over one window's frame; shared among its fields."""

    def __init__(self, frames: _Frames, w: Aggregate, shapes: dict[str, V], ties: bool):
        self.frames, self.w, self.shapes, self.frame, self.ties, self.made = frames, w, shapes, _frame(w), ties, {}

    def column(self, what: str, field: str | None) -> str:
        key = (what, field)
        if key not in self.made:
            c = F.col("_at") if field is None else self.shapes[field].col
            over = {
                "sum": lambda: F.sum(c), "len": lambda: F.count(F.lit(1)), "max": lambda: F.max(c), "min": lambda: F.min(c), "first": lambda: F.first(c), "last": lambda: F.last(c),
                "list": lambda: F.collect_list(F.struct(F.col("_at").alias("at"), F.col("_key").alias("key"), c.alias("v"))),
            }[what]().over(self.frame)
            name = self.frames.add(over)
            if self.w.window_type == "count" and self.ties:
                # Blocks with one start must not see each other: all of them take the frame of the outermost one.
                peers = Window.partitionBy("_identity", "_at").orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
                name = self.frames.add((F.first if self.w.window_value < 0 else F.last)(name).over(peers), after=True)
            self.made[key] = name
        return self.made[key]

    def native(self, what: str, dotted: str) -> V | None:
        base, _, field = dotted.rpartition(".")
        if base != "source":
            return None
        if field not in self.shapes:
            raise UnknownName(f"{self.w.source}.{field}")
        shape = self.shapes[field]
        n = F.col(self.column("len", None))
        if what == "len":
            return V(n, "int")
        if what in ("sum", "max", "min"):
            if shape.kind not in ("int", "float") and what == "sum" or shape.kind in ("list", "map"):
                return None
            c = F.col(self.column(what, field))
            return V(F.coalesce(c, F.lit(0)) if what == "sum" else c, shape.kind, err=None if what == "sum" else n == 0)
        return V(F.col(self.column(what, field)), shape.kind, shape.elem, shape.key, err=n == 0)

    def collected(self, field: str) -> V:
        if field not in self.shapes:
            raise UnknownName(f"{self.w.source}.{field}")
        rows = F.array_sort(F.col(self.column("list", field)))
        return V(F.transform(rows, lambda r: r["v"]), "list", self.shapes[field].kind)

    def valid(self) -> Column:
        """Count windows must be full, day and hour windows must not be empty."""
        n = F.col(self.column("len", None))
        return n == abs(self.w.window_value) if self.w.window_type == "count" else n > 0


def _shapes(df: DataFrame) -> dict[str, V]:
    return {f.name: column_value(F.col(f"`{f.name}`"), f.dataType) for f in df.schema if not f.name.startswith("__")}


def features(stream: StreamSpec, spec: WindowSpec, blocks: dict[str, DataFrame], functions: dict[str, Callable] | None = None, python_functions: dict[str, Callable] | None = None) -> DataFrame:
    """Feature rows: ``_identity``, ``_start_time`` of the anchor, and a column ``<aggregate>.<field>`` per window field.

    A block is an anchor if the condition is true for it and for the final state of its entity's identity aggregates, and
    every window of it holds enough blocks. At most ``Max`` anchors are kept per entity and UTC day, the earliest first;
    blocks that start at once are ordered by their key.
    """
    sources = {w.source.partition(".")[2] for w in spec.aggregates if w.kind == "window"}
    if len(sources) > 1:
        raise ValueError("windows of one spec read one aggregate")
    timed = [a.name for a in stream.aggregates if a.kind in ("block", "activity")]
    if not sources and len(timed) != 1:
        raise ValueError("the stream spec must have exactly one aggregate with times")
    name = sources.pop() if sources else timed[0]
    agg = stream.aggregate(name)
    if agg is None or agg.kind not in ("block", "activity"):
        raise ValueError(f"{name} is no aggregate with times")
    base = blocks[name]
    key = F.concat_ws(":", *(F.col(f"`{d.name}`").cast("string") for d in agg.dimensions)) if agg.dimensions else F.lit("")
    df = base.withColumn("_at", F.unix_micros("_start_time")).withColumn("_key", key)
    shapes = _shapes(base)

    lookups: dict[str, dict[str, V]] = {}
    texts = [x for x in (spec.condition, spec.when, *(a.when for a in spec.aggregates), *(x for a in spec.aggregates for f in a.fields for x in (f.value, f.when))) if x]
    for other in stream.aggregates:
        if other.kind != "identity" or not any(f"{stream.name}.{other.name}" in x for x in texts):
            continue
        state = blocks[other.name]
        if other.dimensions:
            state = state.withColumn("_last", F.row_number().over(Window.partitionBy("_identity").orderBy(*(F.desc(f"`{d.name}`") for d in other.dimensions)))).filter("_last = 1").drop("_last")
        renamed = {c: f"_{other.name}__{c}" for c in state.columns if c != "_identity"}
        df = df.join(state.select("_identity", *(F.col(f"`{c}`").alias(n) for c, n in renamed.items())), "_identity", "left")
        joined = {f.name: f.dataType for f in state.schema}
        lookups[other.name] = {}
        for c, n in renamed.items():
            v = column_value(F.col(f"`{n}`"), joined[c])
            declared = other.field(c)
            if declared is not None and declared.type != "datetime" and declared in other.fields:
                v = replace(v, col=F.coalesce(v.col, default_of(declared.type, dict(state.dtypes)[c])))
            lookups[other.name][c] = v

    done: dict[tuple[str, str], V] = {}

    def attribute(base_name: str, field: str) -> V | None:
        if base_name == "anchor" or base_name == f"{stream.name}.{name}":
            if field in shapes:
                return shapes[field]
            raise UnknownName(f"{name}.{field}")
        if base_name.startswith(f"{stream.name}."):
            other = base_name.partition(".")[2]
            if field in lookups.get(other, {}):
                return lookups[other][field]
            raise UnknownName(f"{base_name}.{field}")
        if (base_name, field) in done:
            return done[base_name, field]
        own = next((a for a in spec.aggregates if a.name == base_name), None)
        if own is None:
            return None
        declared = own.field(field)
        if declared is None:
            raise UnknownName(f"{base_name}.{field}")
        kind = {"integer": "int", "float": "float", "string": "str", "boolean": "bool", "datetime": "dt"}.get(declared.type)
        if kind is None:
            raise UnknownName(f"{base_name}.{field} has no value yet")
        return V(default_of(declared.type, spark_type(declared.type, None)), kind)

    accepted = Compiler({}, attribute, functions, python_functions=python_functions).condition(spec.condition)
    ties = agg.kind == "block"
    keep, out, frames = [], [], _Frames()
    for a in spec.aggregates:
        near = _Neighbours(frames, a, shapes, ties) if a.kind == "window" else None
        if near is not None:
            keep.append(near.valid())

        def within(base_name: str, field: str, near=near) -> V | None:
            return near.collected(field) if base_name == "source" and near is not None else attribute(base_name, field)

        compiler = Compiler({}, within, functions, near.native if near is not None else None, python_functions)
        whole = compiler.condition(a.when)
        for f in a.fields:
            v = compiler.value(f.value, f.type)
            c = coerce(v, f.type)
            cond = compiler.condition(f.when)
            for gate in (whole, cond):
                if gate is not None:
                    c = F.when(gate, c)
            shape = V(c, {"integer": "int", "float": "float", "string": "str", "boolean": "bool", "datetime": "dt"}.get(f.type, v.kind), v.elem, v.key)
            shown = F.coalesce(c, default_of(f.type, spark_type(f.type, shape)))
            done[a.name, f.name] = V(shown, shape.kind, v.elem, v.key)
            out.append(shown.alias(f"{a.name}.{f.name}"))
    df = frames.onto(df)
    gate = Compiler({}, attribute, functions, python_functions=python_functions).condition(spec.when)
    for c in [accepted, *keep, *([gate] if gate is not None else [])]:
        df = df.filter(c)
    if spec.maximum is not None:
        order = Window.partitionBy("_identity", F.to_date("_start_time")).orderBy("_at", "_key")
        df = df.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= spec.maximum)
    return df.select("_identity", "_start_time", *out)
