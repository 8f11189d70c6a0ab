"""Specs compiled to Spark plans.

A field's rule is put in one of three tiers. A: the rule is a mergeable aggregate (a count, a sum, the last value, a
maximum, a set ...), so the field is one column of a grouped aggregation with partial sums. B: its value or condition
looks at other fields; those become running columns over the entity's ordered events, after which the rule is tier A
again. C: the rule feeds on its own last value in a way that is no aggregate; the aggregate's events are sorted by
key and time and folded one by one, holding one state at a time.
"""

from __future__ import annotations

import ast
import datetime as dt
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators import blocks as B
from strandline.plans import imports, interpret
from strandline.plans.expr import Compiler, UnknownName, Unsupported, V, coerce, column_value, holds_variant, none_value, to_str, truthy
from strandline.plans.spec import Aggregate, Field, StreamSpec, WindowSpec, stream_spec, window_spec
from strandline.session import materialize

_IMPORTED = {"parse", "parser", "datetime", "dateutil"}


def expressions(spec: StreamSpec | WindowSpec) -> list[str]:
    own = [spec.identity, spec.time] if isinstance(spec, StreamSpec) else [spec.condition]
    fields = [f for a in spec.aggregates for f in (*a.fields, *a.dimensions)]
    every = [*own, spec.when, *(a.when for a in spec.aggregates), *(x for f in fields for x in (f.value, f.when))]
    return [x for x in every if x]


def attributes_of(text: str, base: str) -> set[str]:
    """Names f of ``base.f`` and ``base['f']`` in an expression."""
    out = set()
    for n in ast.walk(ast.parse(text, mode="eval")):
        if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == base:
            out.add(n.attr)
        if isinstance(n, ast.Subscript) and isinstance(n.value, ast.Name) and n.value.id == base and isinstance(n.slice, ast.Constant) and isinstance(n.slice.value, str):
            out.add(n.slice.value)
    return out


@dataclass(frozen=True)
class Rule:
    """What one event contributes: ``kind`` of aggregate, and the expressions of its inputs."""

    kind: str
    inputs: tuple[ast.AST, ...]


def _names_field(n: ast.AST, agg: str, name: str) -> bool:
    if isinstance(n, ast.Attribute):
        return isinstance(n.value, ast.Name) and n.value.id == agg and n.attr == name
    return isinstance(n, ast.Subscript) and isinstance(n.value, ast.Name) and n.value.id == agg and isinstance(n.slice, ast.Constant) and n.slice.value == name


def _mentions(tree: ast.AST | None, agg: str, name: str) -> bool:
    return tree is not None and any(_names_field(n, agg, name) for n in ast.walk(tree))


def rule_of(agg: str, f: Field) -> tuple[Rule, ast.AST | None]:
    """The field's rule and its remaining condition. Raises Unsupported where only a fold will do."""
    value = ast.parse(f.value, mode="eval").body
    when = ast.parse(f.when, mode="eval").body if f.when else None
    own = lambda n: _names_field(n, agg, f.name)
    free = lambda *ns: not any(_mentions(n, agg, f.name) for n in ns)

    if isinstance(when, ast.Compare) and len(when.ops) == 1 and isinstance(when.ops[0], (ast.GtE, ast.Gt)) and own(when.comparators[0]):
        if ast.dump(when.left) == ast.dump(value) and free(value) and f.type in ("integer", "float"):
            return Rule("max", (value,)), None
    if _mentions(when, agg, f.name):
        raise Unsupported(f"{f.name} depends on itself")
    if isinstance(when, ast.Compare) and len(when.ops) == 1 and isinstance(when.ops[0], ast.Eq) and free(value):
        sides = (when.left, when.comparators[0])
        if any(isinstance(x, ast.Name) and x.id == "time" for x in sides):
            if any(_names_field(x, agg, "_start_time") for x in sides):
                return Rule("first", (value,)), None  # the last among the events of the block's first instant
            if any(_names_field(x, agg, "_end_time") for x in sides):
                return Rule("last", (value,)), None  # events come in order of time, so every one is at the end so far
    if free(value):
        names = {n.id for n in ast.walk(value) if isinstance(n, ast.Name)}
        if names - {"int", "float", "abs", "round"} == {"time", agg} and f.type in ("integer", "float") and attributes_of(ast.unparse(value), agg) == {"_start_time"}:
            return Rule("since", (value,)), when
        return Rule("last", (value,)), when
    if isinstance(value, ast.BinOp) and isinstance(value.op, ast.Add):
        for mine, other in ((value.left, value.right), (value.right, value.left)):
            if own(mine) and free(other):
                if f.type in ("integer", "float"):
                    return Rule("sum", (other,)), when
                if f.type == "list" and mine is value.left:
                    return Rule("extend", (other,)), when
    if isinstance(value, ast.BoolOp) and isinstance(value.op, ast.Or) and f.type == "boolean" and own(value.values[0]) and free(*value.values[1:]):
        rest = value.values[1] if len(value.values) == 2 else ast.BoolOp(ast.Or(), value.values[1:])
        return Rule("any", (rest,)), when
    if isinstance(value, ast.Call) and not value.keywords:
        if isinstance(value.func, ast.Name) and value.func.id in ("max", "min") and len(value.args) == 2 and f.type in ("integer", "float"):
            mine = [a for a in value.args if own(a)]
            other = [a for a in value.args if not own(a)]
            if len(mine) == len(other) == 1 and free(*other):
                return Rule(value.func.id, tuple(other)), when
        if isinstance(value.func, ast.Attribute) and own(value.func.value) and free(*value.args):
            rules = {("list", "append", 1): "append", ("list", "extend", 1): "extend", ("set", "add", 1): "add", ("map", "increment", 1): "increment", ("map", "increment", 2): "increment", ("map", "set", 2): "put"}
            kind = rules.get((f.type, value.func.attr, len(value.args)))
            if kind:
                return Rule(kind, tuple(value.args)), when
    raise Unsupported(f"{f.name} feeds on itself")


class _Events:
    """The keyed events, growing by the columns that rules need."""

    def __init__(self, df: DataFrame, spec: StreamSpec, attributes: dict[str, V], functions: dict, state: dict[str, DataFrame] | None = None, python_functions: dict | None = None):
        self.df, self.spec, self.attributes, self.functions, self.state, self.python_functions = df, spec, attributes, functions, state or {}, python_functions or {}
        self.made: dict[tuple, V] = {}
        self.busy: set[tuple] = set()
        self.rules: dict[tuple[str, str], tuple[str, list[V]]] = {}

    def add(self, stem: str, col: Column) -> str:
        name = f"{stem}_{len(self.df.columns)}"
        self.df = self.df.withColumn(name, col)
        return name

    def keys(self, agg: Aggregate) -> list[str]:
        """Columns of the events that make up a block's key."""
        out = ["_id"]
        for d in agg.dimensions:
            out.append(self._once(("dim", agg.name, d.name), lambda d=d: self._dimension(agg, d)))
        if agg.kind == "activity":
            out.append(self._once(("sid", agg.name), lambda: self._session(agg)))
        return out

    def seeds(self, agg: Aggregate) -> dict[str, str]:
        """Columns with the block's state of an earlier run, by field, as far as there is one; sessions have none to start from."""
        if agg.name not in self.state or agg.kind == "activity":
            return {}
        key = ("seed", agg.name)
        if key not in self.made:
            keys, old = self.keys(agg), self.state[agg.name]
            n = len(self.df.columns)
            meet = [F.col("_identity"), *(F.col(f"`{d.name}`") for d in agg.dimensions)]
            fields = [c for c in old.columns if c != "_identity" and c not in {d.name for d in agg.dimensions}]
            names = {c: f"_z{n}_{i}" for i, c in enumerate(fields)}
            side = old.select(*(c.alias(f"_m{n}_{i}") for i, c in enumerate(meet)), *(F.col(f"`{c}`").alias(x) for c, x in names.items()))
            same = F.lit(True)
            for i, k in enumerate(keys):
                same = same & (F.col(k) == F.col(f"_m{n}_{i}"))
            self.df = self.df.join(side, same, "left").drop(*(f"_m{n}_{i}" for i in range(len(meet))))
            self.made[key] = names
        return self.made[key]

    def _once(self, key: tuple, make: Callable[[], str]) -> str:
        if key not in self.made:
            self.made[key] = make()
        return self.made[key]

    def _dimension(self, agg: Aggregate, d: Field) -> str:
        c = coerce(self.compiler(agg, None).value(d.value, d.type), d.type)
        cond = self.compiler(agg, None).condition(d.when)
        return self.add("_d", c if cond is None else F.when(cond, c))

    def _session(self, agg: Aggregate) -> str:
        at = F.when(F.col(self.passes(agg)), F.unix_micros("_time"))
        at_name = self.add("_at", at)
        w = Window.partitionBy("_id").orderBy("_time", "_seq")
        before = F.max(at_name).over(w.rowsBetween(Window.unboundedPreceding, -1))
        opens = self.add("_opens", F.when(F.col(at_name).isNotNull() & (before.isNull() | (F.col(at_name) - before > agg.gap_s * 1_000_000)), 1).otherwise(0))
        return self.add("_sid", F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def passes(self, agg: Aggregate) -> str:
        """Whether an event takes part in an aggregate: its condition holds and its dimensions have values."""

        def make() -> str:
            c = F.lit(True)
            for d in agg.dimensions:
                c = c & F.col(self._once(("dim", agg.name, d.name), lambda d=d: self._dimension(agg, d))).isNotNull()
            cond = self.compiler(agg, None, condition=True).condition(agg.when)
            return self.add("_ok", c if cond is None else c & cond)

        return self._once(("ok", agg.name), make)

    def compiler(self, agg: Aggregate, place: int | None, condition: bool = False) -> Compiler:
        def attribute(base: str, name: str) -> V | None:
            if base == "source":
                return self.attributes.get(name, none_value())
            other = self.spec.aggregate(base)
            if other is None:
                if base.partition(".")[0] in ("source", *_IMPORTED):
                    return None
                raise UnknownName(base)
            if condition and other.name == agg.name:
                raise Unsupported(f"{agg.name}'s condition looks at its own state")
            return self.running(other, name, agg, place)

        names = {"time": V(F.col("_time"), "dt"), "identity": V(F.col("_id"), "str")}
        return Compiler(names, attribute, self.functions, python_functions=self.python_functions)

    def running(self, other: Aggregate, name: str, agg: Aggregate, place: int | None) -> V:
        """The state of ``other.name`` as ``agg``'s field at ``place`` sees it: updated by this event already, or not yet."""
        if name == "_identity":
            return V(F.col("_id"), "str")
        if name in ("_start_time", "_end_time"):
            if name == "_end_time" and other.name == agg.name:
                return V(F.col("_time"), "dt")
            w = Window.partitionBy(*self.keys(other)).orderBy("_time", "_seq").rowsBetween(Window.unboundedPreceding, 0)
            t = F.when(F.col(self.passes(other)), F.col("_time"))
            least = name == "_start_time"
            made = (F.min if least else F.max)(t).over(w)
            if (seed := self.seeds(other).get(name)) is not None:
                made = (F.least if least else F.greatest)(made, F.col(seed))
            return V(F.col(self._once((name, other.name), lambda: self.add("_t", made))), "dt")
        dim = next((d for d in other.dimensions if d.name == name), None)
        if dim is not None:
            self.keys(other)
            return V(F.col(self.made[("dim", other.name, name)]), {"integer": "int"}.get(dim.type, "str"))
        f = other.field(name)
        if f is None:
            raise UnknownName(f"{other.name}.{name}")
        order = [a.name for a in self.spec.aggregates]
        if other.name == agg.name:
            seen = place is not None and list(other.fields).index(f) < place
        else:
            seen = order.index(other.name) < order.index(agg.name)
        key = ("run", other.name, name, seen)
        if key in self.busy:
            raise Unsupported(f"{other.name}.{name} feeds on itself")
        if key not in self.made:
            self.busy.add(key)
            try:
                self.made[key] = self._run(other, f, seen)
            finally:
                self.busy.discard(key)
        return self.made[key]

    def _run(self, other: Aggregate, f: Field, seen: bool) -> V:
        kind, inputs = self.updates(other, f)
        if kind not in ("last", "sum", "max", "min", "any"):
            raise Unsupported(f"{f.name} is a collection that other rules look at")
        w = Window.partitionBy(*self.keys(other)).orderBy("_time", "_seq").rowsBetween(Window.unboundedPreceding, 0 if seen else -1)
        v = inputs[0]
        running = {"last": F.last(v.col, ignorenulls=True), "sum": F.sum(v.col), "max": F.max(v.col), "min": F.min(v.col), "any": F.max(v.col)}[kind].over(w)
        if (seed := self.seeds(other).get(f.name)) is not None:
            old = F.col(seed)
            joined = {"last": lambda: F.coalesce(running, old), "sum": lambda: F.coalesce(running + old, running, old), "max": lambda: F.greatest(running, old), "min": lambda: F.least(running, old), "any": lambda: F.coalesce(running | old, running, old)}
            running = joined[kind]()
        return V(F.col(self.add("_r", B.finished(running, kind, f.type, v))), v.kind, v.elem, v.key)

    def updates(self, agg: Aggregate, f: Field) -> tuple[str, list[V]]:
        """The field's kind of aggregate and, as columns of the events, what each event puts in; null where it does not."""
        key = (agg.name, f.name)
        if key not in self.rules:
            rule, when = rule_of(agg.name, f)
            timed = agg.kind in ("block", "activity")
            if rule.kind in ("first", "since") and (not timed or self.state.get(agg.name) is not None):
                when = ast.parse(f.when, mode="eval").body if f.when else None
                rule = Rule("last", rule.inputs)
            place = list(agg.fields).index(f)
            compiler = self.compiler(agg, place)
            cond = F.col(self.passes(agg))
            if when is not None:
                cond = cond & compiler.condition(ast.unparse(when))
            if rule.kind == "since":
                self.rules[key] = ("since", self._since(agg, f, rule.inputs[0], cond))
                return self.rules[key]
            plain = f.type if rule.kind in ("last", "first", "sum", "max", "min") else "boolean" if rule.kind == "any" else None
            vs = [compiler.node(n) if plain is None or f.type in ("list", "set", "map") else compiler.value(n, plain) for n in rule.inputs]
            made = []
            for i, v in enumerate(vs):
                if rule.kind == "sum" and f.type == "integer" and v.kind == "float":
                    raise Unsupported("an integer field cut off at every step")
                if rule.kind in ("last", "first", "sum", "max", "min"):
                    c, shape = coerce(v, f.type), v
                elif rule.kind == "any":
                    c, shape = F.when(~v.err, truthy(v)) if v.err is not None else truthy(v), V(v.col, "bool")
                else:
                    c, shape = v.col if v.err is None else F.when(~v.err, v.col), v
                spark = {"integer": "int", "float": "float", "string": "str", "boolean": "bool", "datetime": "dt"}.get(f.type, shape.kind) if rule.kind in ("last", "first") else shape.kind
                if rule.kind in ("sum", "max", "min"):
                    spark = "int" if f.type == "integer" else "float"
                made.append(V(F.col(self.add("_u", F.when(cond, c))), spark, shape.elem, shape.key))
            if rule.kind == "increment" and len(made) == 1:
                made.append(V(F.col(self.add("_u", F.when(cond, F.lit(1).cast("long")))), "int"))
            if any(v.kind == "none" for v in made):
                made = [V(v.col.cast("string"), "str") if v.kind == "none" else v for v in made]
            self.rules[key] = (rule.kind, made)
        return self.rules[key]


    def _since(self, agg: Aggregate, f: Field, value: ast.AST, cond: Column) -> list:
        """A value out of an event's time and its block's start alone: the last such event's time, and what to make of the two.

        Events come in order of time, so the start that each of them sees is the block's.
        """

        def finish(last: Column, start: Column) -> Column:
            seen = lambda base, name: V(start, "dt") if (base, name) == (agg.name, "_start_time") else None
            made = coerce(Compiler({"time": V(last, "dt")}, seen, self.functions).node(value), f.type)
            return F.when(last.isNotNull(), made)

        finish(F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp"))  # Unsupported comes up here
        return [V(F.col(self.add("_u", F.when(cond, F.col("_time")))), {"integer": "int"}.get(f.type, "float")), finish]


class Engine:
    """Runs a streaming spec, and a window spec over its blocks, on DataFrames.

    What the specs import is looked up in a list of allowed functions. ``functions`` maps further names to column builders
    (compiled values in, value out), ``python_functions`` to plain functions that are called value by value.

    Every aggregate reads the events for itself. For columnar files that is the cheapest way: each reads its own columns.
    ``once`` has the keyed events, narrowed to the attributes that the spec names, written to the shared folder first, so
    that input which is dear to parse (JSON, say) is read and parsed a single time however many aggregates there are.
    """

    def __init__(self, stream: StreamSpec | dict | str, window: WindowSpec | dict | str | None = None, functions: dict | None = None, python_functions: dict | None = None, once: bool = False):
        self.stream = stream if isinstance(stream, StreamSpec) else stream_spec(stream)
        self.window = window if window is None or isinstance(window, WindowSpec) else window_spec(window)
        given = {**(functions or {}), **(python_functions or {})}
        plain, native = imports.resolve([*self.stream.imports, *(self.window.imports if self.window else ())], given)
        self.functions, self.python_functions, self.once = {**native, **(functions or {})}, {**plain, **(python_functions or {})}, once
        self.tiers: dict[str, str] = {}

    def keyed(self, df: DataFrame, seq: str | None = None, state: dict[str, DataFrame] | None = None) -> _Events:
        """Events with identity and time, in the order given by ``seq`` among equal times.

        Only attributes that the spec names are kept. Rows without identity or time, or whose spec-wide condition is
        not true, go. Without ``seq`` the order of reading counts.
        """
        ev = self._keyed(df, seq, state)
        if self.once:
            ev.df = self._written(df, seq, ev.df)
        return ev

    def _keyed(self, df: DataFrame, seq: str | None, state: dict[str, DataFrame] | None = None) -> _Events:
        wanted = sorted(set().union(*(attributes_of(x, "source") for x in expressions(self.stream))))
        have = {f.name: f.dataType for f in df.schema}
        there = [a for a in wanted if a in have]
        order = F.col(f"`{seq}`").cast("long") if seq else F.monotonically_increasing_id()
        raw = df.select(order.alias("_seq"), *(F.col(f"`{a}`").alias(f"s{i}") for i, a in enumerate(there)))
        attributes = {a: column_value(F.col(f"s{i}"), have[a]) for i, a in enumerate(there)}

        def attribute(base: str, name: str) -> V | None:
            if base == "source":
                return attributes.get(name, none_value())
            if base.partition(".")[0] in ("source", *_IMPORTED):
                return None
            raise UnknownName(base)

        first = Compiler({}, attribute, self.functions, python_functions=self.python_functions)
        ident, time = first.value(self.stream.identity, "string"), first.value(self.stream.time, "datetime")
        id_col = F.when(truthy(ident), to_str(ident))
        when = Compiler({"time": V(F.col("_time"), "dt"), "identity": V(F.col("_id"), "str")}, attribute, self.functions, python_functions=self.python_functions).condition(self.stream.when)
        keyed = raw.withColumn("_id", id_col).withColumn("_time", coerce(time, "datetime")).filter("_id is not null and _time is not null")
        keyed = keyed if when is None else keyed.filter(when)
        return _Events(keyed, self.stream, attributes, self.functions, state, self.python_functions)

    def _written(self, df: DataFrame, seq: str | None, keyed: DataFrame) -> DataFrame:
        """The keyed events from the shared folder, written when they are first asked for."""
        if getattr(self, "_kept", (None, None, None))[:2] != (id(df), seq):
            self._kept = (id(df), seq, materialize(keyed, "keyed-events"), df)  # df is held, so that its id stays its own
        return self._kept[2]

    def failures(self, df: DataFrame, seq: str | None = None) -> dict[str, int]:
        """How often the value of each field could not be computed, or did not fit, for events that take part and meet its condition.

        Such an event leaves the field as it was, which no output shows. In one pass; fields whose rules feed on
        themselves in a way that only an ordered fold follows are left out.
        """
        ev, counts = self.keyed(df, seq), {}
        for agg in self.stream.aggregates:
            for f in agg.fields:
                try:
                    rule, when = rule_of(agg.name, f)
                    compiler = ev.compiler(agg, list(agg.fields).index(f))
                    missing = F.lit(False)
                    for n in rule.inputs:
                        if rule.kind != "since":
                            v = compiler.value(n, f.type) if f.type not in ("list", "set", "map") else compiler.node(n)
                            fitted = v.col if rule.kind in ("any", "append", "extend", "add", "increment", "put") else coerce(v, f.type)
                            missing = missing | fitted.isNull() | (F.lit(False) if v.err is None else F.coalesce(v.err, F.lit(True)))
                    cond = F.col(ev.passes(agg)) if when is None else F.col(ev.passes(agg)) & compiler.condition(ast.unparse(when))
                    counts[f"{agg.name}.{f.name}"] = ev.add("_f", (cond & missing).cast("long"))
                except Unsupported:
                    continue
        r = ev.df.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts.values())).first() if counts else {}
        return {name: r[c] for name, c in counts.items()}

    def rejects(self, df: DataFrame) -> dict[str, int]:
        """How many events have no identity and how many of the others no time, the two reasons to drop one unseen."""
        columns = {f.name: column_value(F.col(f"`{f.name}`"), f.dataType) for f in df.schema}
        compiler = Compiler({}, lambda base, name: columns.get(name, none_value()) if base == "source" else None, self.functions, python_functions=self.python_functions)
        who, when = truthy(compiler.value(self.stream.identity, "string")), coerce(compiler.value(self.stream.time, "datetime"), "datetime")
        r = df.agg(F.count_if(~who).alias("identity"), F.count_if(who & when.isNull()).alias("time")).first()
        return r.asDict()

    def blocks(self, df: DataFrame, seq: str | None = None, state: dict[str, DataFrame] | None = None, fold: bool = False, variables: bool = False) -> dict[str, DataFrame]:
        """Blocks of every stored aggregate, by name; with ``variables`` also the last values of variables, which are not stored.

        ``state`` holds what an earlier run returned with ``variables``; its blocks are carried on, and entities without new
        events stay. A session rule that looks at the session itself cannot be carried on and is refused. ``fold`` sends
        every aggregate through the ordered fold, which knows all rules; for tests.
        """
        wanted = [a for a in self.stream.aggregates if a.kind != "variable" or variables]
        out = self._from_fragments(df, seq, wanted) if self.once and state is None and not fold else {}
        for agg in wanted:
            if agg.name in out:
                continue
            carried = state is not None and agg.name in state
            new = self._aggregate(self.keyed(df, seq, state), agg, fold, carried)
            if carried and self.tiers[agg.name] == "C":
                same = ["_identity", *(d.name for d in agg.dimensions)]
                old = state[agg.name].join(new.select(*same), same, "left_anti")
                new = new.unionByName(old.select(*(F.col(c).cast(t).alias(c) for c, t in new.dtypes)))
            elif carried:
                kinds = {f.name: {"first": "last", "since": "last"}.get(k := rule_of(agg.name, f)[0].kind, k) for f in agg.fields}
                new = B.carried_on(state[agg.name], new, agg, kinds)
            out[agg.name] = new
        return out

    def _from_fragments(self, df: DataFrame, seq: str | None, wanted: list[Aggregate]) -> dict[str, DataFrame]:
        """Sessions and the identity aggregates over the same events from one set of fragments, for which the events are read once.

        Both kinds of rule must be mergeable. The fragments are written, since both are computed from them.
        """
        for a in wanted:
            self._aggregate(self._keyed(df, seq), a, False, False)  # for the tiers; nothing runs
        act = next((a for a in wanted if a.kind == "activity" and not a.dimensions and self.tiers[a.name] == "A"), None)
        mine = [a for a in wanted if act is not None and a.kind == "identity" and not a.dimensions and a.when == act.when and self.tiers[a.name] == "A"]
        if not mine:
            return {}
        ev, rules, first = self._keyed(df, seq) if len(mine) + 1 == len(wanted) else self.keyed(df, seq), [], {}
        for a in (act, *mine):
            first[a.name] = len(rules)
            rules += [(f, *ev.updates(a, f)) for f in a.fields]
        parts = materialize(B.fragments(ev.df.filter(ev.passes(act)), act.gap_s, rules), "fragments")
        of = lambda a: rules[first[a.name] : first[a.name] + len(a.fields)]
        return {act.name: B.sessions_of(parts, act, of(act), first=first[act.name])} | {a.name: B.identities_of(parts, of(a), first[a.name]) for a in mine}

    def _aggregate(self, ev: _Events, agg: Aggregate, fold: bool, carried: bool) -> DataFrame:
        if not fold:
            try:
                return self._grouped(ev, agg, carried)
            except Unsupported:
                pass
        self.tiers[agg.name] = "C"
        if carried and agg.kind == "activity":
            raise ValueError(f"{agg.name}: sessions whose rules need a fold are not carried on")
        return self._folded(ev, agg)

    def _grouped(self, ev: _Events, agg: Aggregate, bare: bool) -> DataFrame:
        rules = [(f, *ev.updates(agg, f)) for f in agg.fields]
        if bare and agg.kind == "activity" and any(k[0] in ("run", "_start_time", "_end_time") and agg.name in k for k in ev.made):
            raise ValueError(f"{agg.name}: sessions whose rules look at the session are not carried on")
        self.tiers[agg.name] = "B" if any(k[0] in ("run", "_start_time", "_end_time") for k in ev.made) else "A"
        dims = [(d, ev._once(("dim", agg.name, d.name), lambda d=d: ev._dimension(agg, d))) for d in agg.dimensions]
        passes = ev.passes(agg)
        if agg.kind == "activity" and self.tiers[agg.name] == "A" and ("sid", agg.name) not in ev.made:
            return B.session_blocks(ev.df.filter(passes), agg, rules, bare)
        keys = ev.keys(agg)
        return B.grouped(ev.df.filter(passes), agg, keys, {d.name: c for d, c in dims}, rules, bare)

    def _folded(self, ev: _Events, agg: Aggregate) -> DataFrame:
        """Events sorted by block and time, folded with one state in memory. A hot entity's fold is sequential by nature."""
        context: dict[str, dict[str, V]] = {}
        for base in {a.name for a in self.stream.aggregates if a.name != agg.name}:
            for x in [agg.when, *(y for f in agg.fields for y in (f.value, f.when))]:
                for name in attributes_of(x, base) if x else ():
                    context.setdefault(base, {})[name] = ev.running(self.stream.aggregate(base), name, agg, None)
        stateful = agg.when is not None and bool(attributes_of(agg.when, agg.name))
        known = {"source", "time", "identity", *(a.name for a in self.stream.aggregates)}
        for x in [*([agg.when] if stateful else []), *(y for f in agg.fields for y in (f.value, f.when) if y)]:
            interpret.check(ast.parse(x, mode="eval").body, self.python_functions, known)
        bare = Aggregate(agg.name, agg.kind, agg.fields, agg.dimensions, None if stateful else agg.when, agg.store, agg.gap_s)
        keys = ev.keys(bare)
        passes = ev.passes(bare)
        sources = sorted(set().union(*(attributes_of(x, "source") for f in agg.fields for x in (f.value, f.when) if x), attributes_of(agg.when, "source") if stateful else set()) & set(ev.attributes))
        cols = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)] + [F.col("_time").alias("time"), F.col("_seq").alias("seq")]
        mixed = [i for i, a in enumerate(sources) if holds_variant(ev.attributes[a])]
        cols += [(F.to_json(ev.attributes[a].col) if i in mixed else ev.attributes[a].col).alias(f"s{i}") for i, a in enumerate(sources)]
        flat = [(b, n) for b, ns in context.items() for n in ns]
        cols += [context[b][n].col.alias(f"c{i}") for i, (b, n) in enumerate(flat)]
        seeds = ev.seeds(agg)
        kept = [n for n in (*(f.name for f in agg.fields), "_start_time", "_end_time") if n in seeds]
        cols += [F.col(seeds[n]).alias(f"z{i}") for i, n in enumerate(kept)]
        rows = ev.df.filter(passes).select(*cols)
        key_names = [f"k{i}" for i in range(len(keys))]
        rows = rows.repartition(*key_names).sortWithinPartitions(*key_names, "time", "seq")

        probe = {}
        for f in agg.fields:
            probe[f.name] = self._fold_type(ev, agg, f)
        timed = agg.kind in ("block", "activity")
        schema = T.StructType([T.StructField("_identity", T.StringType())])
        if timed:
            schema.add("_start_time", T.TimestampType()).add("_end_time", T.TimestampType())
        for f in agg.fields:
            schema.add(f.name, probe[f.name])
        for d in agg.dimensions:
            schema.add(d.name, T.LongType() if d.type == "integer" else T.StringType())
        return rows.mapInPandas(_fold(agg, key_names, sources, flat, kept, schema, stateful, self.python_functions, mixed), schema)

    def _fold_type(self, ev: _Events, agg: Aggregate, f: Field) -> T.DataType:
        simple = {"integer": T.LongType(), "float": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "datetime": T.TimestampType()}
        if f.type in simple:
            return simple[f.type]
        back = {"int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "dt": T.TimestampType()}
        elem, key = "str", "str"
        try:
            whole = ev.compiler(agg, None).compile(f.value)
            elem, key = whole.elem or elem, whole.key or key
        except (Unsupported, UnknownName):
            pass
        for n in ast.walk(ast.parse(f.value, mode="eval").body):
            if elem == "str" and f.type in ("list", "set") and isinstance(n, ast.expr):
                try:
                    inner = ev.compiler(agg, None).node(n)
                except (Unsupported, UnknownName):
                    inner = None
                if inner is not None and inner.kind == "list":
                    elem = inner.elem or elem
            if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.args:
                try:
                    vs = [ev.compiler(agg, None).node(a) for a in n.args]
                except (Unsupported, UnknownName):
                    continue
                if n.func.attr in ("append", "add"):
                    elem = vs[0].kind
                elif n.func.attr == "extend" and vs[0].kind == "list":
                    elem = vs[0].elem or "str"
                elif n.func.attr in ("increment", "set"):
                    key, elem = vs[0].kind, vs[1].kind if len(vs) > 1 else "int"
        if f.type == "map":
            return T.MapType(back.get(key, T.StringType()), back.get(elem, T.LongType() if "increment" in f.value else T.StringType()))
        return T.ArrayType(back.get(elem, T.StringType()))

    def features(self, df: DataFrame, seq: str | None = None, state: dict[str, DataFrame] | None = None) -> DataFrame:
        """One row per accepted anchor: ``_identity``, ``_start_time`` of the anchor block, and ``<aggregate>.<field>``."""
        return self.windowed(self.blocks(df, seq, state))

    def windowed(self, made: dict[str, DataFrame]) -> DataFrame:
        from strandline.operators.windows import features

        if self.window is None:
            raise ValueError("no window spec")
        return features(self.stream, self.window, made, self.functions, self.python_functions)


def _fold(agg: Aggregate, keys: list[str], sources: list[str], flat: list[tuple[str, str]], kept: list[str], schema: T.StructType, stateful: bool, functions: dict, mixed: list[int]):
    trees = [(f, ast.parse(f.value, mode="eval").body, ast.parse(f.when, mode="eval").body if f.when else None) for f in agg.fields]
    gate = ast.parse(agg.when, mode="eval").body if stateful else None
    timed = agg.kind in ("block", "activity")
    names = schema.fieldNames()

    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, pd.Timestamp):
            t = v.to_pydatetime()
            return t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)
        if hasattr(v, "tolist"):
            v = v.tolist()
        return dict(v) if isinstance(v, list) and v and all(isinstance(x, tuple) for x in v) else v

    texts = {f.name for f in schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType)}

    def snapshot(key: tuple, state: interpret.State) -> dict:
        row = {"_identity": key[0], **{d.name: key[1 + i] for i, d in enumerate(agg.dimensions)}}
        for f in agg.fields:
            v = state[f.name]
            if f.name in texts and v:
                v = type(v)(x if x is None or isinstance(x, str) else str(x) for x in v)
            row[f.name] = sorted(v) if isinstance(v, set) else v
        if timed:
            row |= {"_start_time": state["_start_time"], "_end_time": state["_end_time"]}
        return row

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = interpret.Interpreter(functions)
        held, state, done = None, None, []
        for b in batches:
            for r in b.astype(object).itertuples(index=False, name=None):
                r = [plain(x) for x in r]
                nk = len(keys)
                for i in mixed:
                    if r[nk + 2 + i] is not None:
                        r[nk + 2 + i] = json.loads(r[nk + 2 + i])
                key, time = tuple(r[:nk]), r[nk]
                if key != held:
                    if state is not None:
                        done.append(snapshot(held, state))
                    held, state = key, None
                fresh = state is None
                if fresh:
                    state = interpret.State({f.name: interpret.default(f.type) for f in agg.fields})
                    state |= {"_identity": key[0], "_start_time": None, "_end_time": None, **{d.name: key[1 + i] for i, d in enumerate(agg.dimensions)}}
                    types = {f.name: f.type for f in agg.fields}
                    for name, v in zip(kept, r[len(r) - len(kept) :]):
                        if v is not None:
                            state[name] = set(v) if types.get(name) == "set" else v
                env = {"source": interpret.Record(zip(sources, r[nk + 2 : nk + 2 + len(sources)])), "time": time, "identity": key[0], agg.name: state}
                for (base, name), v in zip(flat, r[nk + 2 + len(sources) :]):
                    env.setdefault(base, interpret.State())[name] = v
                if gate is not None:
                    passed = machine.run(gate, env)
                    if passed is interpret.FAILED or not passed:
                        if fresh:
                            state = None
                        continue
                state["_start_time"] = time if state["_start_time"] is None or time < state["_start_time"] else state["_start_time"]
                state["_end_time"] = time if state["_end_time"] is None or time > state["_end_time"] else state["_end_time"]
                for f, value, when in trees:
                    if when is not None:
                        passed = machine.run(when, env)
                        if passed is interpret.FAILED or not passed:
                            continue
                    v = interpret.fits(machine.run(value, env), f.type)
                    if v is not interpret.FAILED:
                        state[f.name] = v
            if len(done) >= 1000:
                yield pd.DataFrame(done, columns=names).astype(object)
                done = []
        if state is not None:
            done.append(snapshot(held, state))
        if done:
            yield pd.DataFrame(done, columns=names).astype(object)

    return run


__all__ = ["Engine", "Rule", "attributes_of", "expressions", "rule_of"]
