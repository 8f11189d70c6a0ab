"""Field expressions, written in a small allow-listed part of Python, compiled to Spark columns.

A compiled value carries its column, its kind, and a column that tells whether the expression failed. A failure
makes the column null too, but is not the same as a legal None: ``None == 3`` is False and ``None or 3`` is 3,
while ``None > 3`` fails, and so does everything around it. Nothing is ever evaluated as Python text.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.instants import iso_instant


class Unsupported(ValueError):
    """The expression uses something that has no column form, or, where nothing else takes it, that is not on the list at all."""


class UnknownName(ValueError):
    """A name or attribute that the spec does not define."""


@dataclass(frozen=True)
class V:
    """``kind``: int float str bool dt date td list map none struct variant; ``elem``/``key`` for collections."""

    col: Column
    kind: str
    elem: str | None = None
    key: str | None = None
    err: Column | None = None
    fields: T.StructType | None = None


NONE, VARIANT = "none", "variant"
_NUM = ("int", "float", "bool")


def none_value() -> V:
    return V(F.lit(None), NONE)


def kind_of(t: T.DataType) -> tuple[str, str | None, str | None]:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int", None, None
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float", None, None
    if isinstance(t, T.BooleanType):
        return "bool", None, None
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "dt", None, None
    if isinstance(t, T.DateType):
        return "date", None, None
    if isinstance(t, T.ArrayType):
        return "list", kind_of(t.elementType)[0], None
    if isinstance(t, T.MapType):
        return "map", kind_of(t.valueType)[0], kind_of(t.keyType)[0]
    if isinstance(t, T.StructType):
        return "struct", None, None
    if isinstance(t, T.NullType):
        return NONE, None, None
    if isinstance(t, T.VariantType):
        return VARIANT, None, None
    return "str", None, None


def column_value(col: Column, t: T.DataType) -> V:
    """A column of a table as a value, widened to the types that the expressions know."""
    kind, elem, key = kind_of(t)
    if kind == "int":
        col = col.cast("long")
    elif kind == "float":
        col = col.cast("double")
    elif isinstance(t, T.TimestampNTZType):
        col = F.from_utc_timestamp(col.cast("timestamp"), F.current_timezone())  # without a zone means UTC
    elif kind == VARIANT:
        col = F.when(~F.is_variant_null(col), col)
    return V(col, kind, elem, key, None, t if isinstance(t, T.StructType) else None)


def holds_variant(v: V) -> bool:
    """Whether a value, or one inside it, may be of several types; such values go to Python as JSON."""
    return VARIANT in (v.kind, v.elem) or (v.fields is not None and "variant" in v.fields.simpleString())


def _any(*errs: Column | None) -> Column | None:
    out = None
    for e in errs:
        if e is not None:
            out = e if out is None else out | e
    return out


def failed(v: V) -> Column:
    return F.lit(False) if v.err is None else v.err


def _needing(*vs: V) -> Column:
    """An operation on ``vs`` fails if one of them failed or is None."""
    out = F.lit(False)
    for v in vs:
        out = out | v.col.isNull()
        if v.err is not None:
            out = out | v.err
    return out


def _result(col: Column, kind: str, *inputs: V, elem: str | None = None, key: str | None = None) -> V:
    """A value that fails wherever it is null or an input failed."""
    return V(col, kind, elem, key, _any(col.isNull(), *(v.err for v in inputs)))


def by_type(v: V, text: Callable[[V], Column], number: Callable[[V], Column], truth: Callable[[V], Column], other: Column) -> Column:
    """A variant treated as the type that each of its values has."""
    t = F.schema_of_variant(v.col)
    get = lambda kind, spark: V(F.try_variant_get(v.col, "$", spark), kind)
    return (
        F.when(t == "STRING", text(get("str", "string"))).when(t == "BOOLEAN", truth(get("bool", "boolean"))).when(t.isin("BIGINT", "INT"), number(get("int", "bigint")))
        .when((t == "DOUBLE") | t.startswith("DECIMAL"), number(get("float", "double"))).when(t.isNotNull(), other)
    )


def truthy(v: V) -> Column:
    """Python's truth of a value; never null. A failed value counts as false."""
    c = v.col
    if v.kind == NONE:
        return F.lit(False)
    if v.kind == VARIANT:
        return F.coalesce(by_type(v, truthy, truthy, truthy, ~F.to_json(c).isin("[]", "{}")), F.lit(False))
    if v.kind == "bool":
        t = c
    elif v.kind in ("int", "float"):
        t = c != 0
    elif v.kind == "str":
        t = F.length(c) > 0
    elif v.kind in ("list", "map"):
        t = F.size(c) > 0
    else:
        t = c.isNotNull()
    return F.coalesce(t, F.lit(False))


_STRPTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "f": "SSSSSS", "y": "yy", "b": "MMM", "B": "MMMM", "p": "a", "I": "hh", "j": "DDD", "z": "xx"}


def java_pattern(fmt: str) -> tuple[str, bool]:
    """A strptime format as a Spark one, and whether it reads an offset."""
    out, i = "", 0
    while i < len(fmt):
        if fmt[i] == "%":
            i += 1
            if i >= len(fmt) or (fmt[i] not in _STRPTIME and fmt[i] != "%"):
                raise Unsupported(f"format {fmt}")
            out += "%" if fmt[i] == "%" else _STRPTIME[fmt[i]]
        else:
            out += f"'{fmt[i]}'" if fmt[i].isalpha() else "''" if fmt[i] == "'" else fmt[i]
        i += 1
    return out, "%z" in fmt


#: Further forms of dates, once commas and the day of the week are gone: with the month by name, slashed, or American. Each by what it looks like.
_DATES = {r"^[A-Za-z]{4,} ": "MMMM d yyyy", r"^[A-Za-z]{3} ": "MMM d yyyy", r"^\d{1,2} [A-Za-z]{4,} ": "d MMMM yyyy", r"^\d{1,2} [A-Za-z]{3} ": "d MMM yyyy", r"^\d{4}/": "yyyy/M/d", r"^\d{1,2}/": "M/d/yyyy", r"^\d{4} [A-Za-z]{3} ": "yyyy MMM d"}
_TIMES = {r"[AaPp][Mm]$": " h:mm[:ss] a", r"": "[ H:mm[:ss]]"}


def parse_time(v: V) -> V:
    """ISO strings, the ``yyyy/MM/dd HH:mm:ss`` that logs use, and dates with the month by name or American; without an offset UTC."""
    if v.kind == "dt":
        return v
    if v.kind != "str":
        raise Unsupported("parse of something that is no string")
    # Bound to a variable of its own, the rarer forms keep out of the generated code of the usual ones.
    other = _bound(F.trim(v.col), _named_date)
    return _result(F.coalesce(iso_instant(v.col), other), "dt", v)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _named_date(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(text, r"^(?i)(mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+", ""), r",\s*|\s+", " ")
    zoned = F.regexp_replace(plain, r"(?i)\s*(gmt|utc|z)$", " +0000")

    def parts(z: Column) -> Column:
        bare = F.regexp_replace(F.trim(F.regexp_replace(z, r"\s[+-]\d{2}:?\d{2}$", "")), r"(?i)(\d)\s*([ap]m)$", "$1 $2")
        offset = F.regexp_extract(z, r"\s([+-]\d{2}:?\d{2})$", 1)
        return F.struct(bare.alias("bare"), F.concat(F.lit(" "), F.when(offset == "", "+0000").otherwise(F.replace(offset, F.lit(":"), F.lit("")))).alias("offset"))

    def parsed(p: Column) -> Column:
        out = None
        for looks, date in _DATES.items():
            one = None
            for ends, time in _TIMES.items():
                c = F.try_to_timestamp(F.concat(p["bare"], p["offset"]), F.lit(f"{date}{time} xx"))
                one = F.when(p["bare"].rlike(ends), c) if one is None else one.otherwise(c)
            out = (F if out is None else out).when(p["bare"].rlike(looks), one)
        return out

    return _bound(zoned, lambda z: _bound(parts(z), parsed))


def _number(v: V) -> Column:
    if v.kind == "bool":
        return v.col.cast("long")
    if v.kind in ("int", "float"):
        return v.col
    raise Unsupported(f"number out of {v.kind}")


def to_int(v: V) -> Column:
    if v.kind == "str":
        return F.when(v.col.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(v.col).try_cast("long"))
    if v.kind == "float":
        return F.when(~F.isnan(v.col), v.col.try_cast("long"))
    if v.kind in ("int", "bool"):
        return v.col.cast("long")
    if v.kind == VARIANT:
        return by_type(v, to_int, to_int, to_int, F.lit(None).cast("long"))
    return F.lit(None).cast("long")


def to_float(v: V) -> Column:
    if v.kind == "str":
        return F.trim(v.col).try_cast("double")
    if v.kind == VARIANT:
        return by_type(v, to_float, to_float, to_float, F.lit(None).cast("double"))
    return v.col.cast("double") if v.kind in _NUM else F.lit(None).cast("double")


def to_str(v: V) -> Column:
    if v.kind == "bool":
        return F.when(v.col, "True").when(~v.col, "False")
    if v.kind == "dt":
        micro = F.when(F.pmod(F.unix_micros(v.col), F.lit(1_000_000)) == 0, F.date_format(v.col, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(v.col, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        return F.concat(micro, F.lit("+00:00"))
    if v.kind in ("list", "map", "struct"):
        raise Unsupported("text of a collection")
    if v.kind == VARIANT:
        return by_type(v, to_str, to_str, to_str, F.to_json(v.col))
    return v.col.cast("string")


#: Spark types and defaults of the field types.
SPARK_TYPES = {"integer": "bigint", "float": "double", "string": "string", "boolean": "boolean", "datetime": "timestamp"}


def coerce(v: V, field_type: str) -> Column:
    """The value as the field's type; null where it is None, failed or does not fit, which leaves the field as it was."""
    ok = lambda c: c if v.err is None else F.when(~v.err, c)
    if v.kind == NONE:
        return F.lit(None).cast(SPARK_TYPES.get(field_type, "string"))
    if field_type == "integer":
        return ok(to_int(v))
    if field_type == "float":
        return ok(to_float(v))
    if field_type == "string":
        return ok(to_str(v))
    if field_type == "boolean":
        return ok(F.when(v.col.isNotNull(), truthy(v)))
    if field_type == "datetime":
        return ok(v.col if v.kind == "dt" else F.lit(None).cast("timestamp"))
    if field_type in ("list", "set") and v.kind == "list":
        return ok(v.col if field_type == "list" else F.array_sort(F.array_distinct(v.col)))
    if field_type == "map" and v.kind == "map":
        return ok(v.col)
    raise Unsupported(f"{v.kind} as {field_type}")


class Compiler:
    """Compiles expressions over names. ``names`` are plain values; ``attribute(base, field)`` resolves what spec names stand for.

    ``functions`` are the user's imported column builders (values in, value out). ``lists`` may replace a call such as
    ``sum(source.f)`` by a native window aggregate.
    """

    def __init__(self, names: dict[str, V], attribute: Callable[[str, str], V | None], functions: dict[str, Callable[..., V]] | None = None, lists: Callable[[str, str], V | None] | None = None, python_functions: dict[str, Callable] | None = None):
        self.names, self.attribute, self.functions, self.lists, self.python_functions = names, attribute, functions or {}, lists, python_functions or {}

    def compile(self, text: str) -> V:
        try:
            tree = ast.parse(text.strip(), mode="eval")
        except SyntaxError as e:
            raise ValueError(f"not an expression: {text}") from e
        return self.node(tree.body)

    def value(self, text: str | ast.AST, field_type: str) -> V:
        """The expression as a column, or, where it has no such form, evaluated value by value for a field of that type."""
        tree = ast.parse(text.strip(), mode="eval").body if isinstance(text, str) else text
        try:
            v = self.truth(tree) if field_type == "boolean" else self.node(tree)
            coerce(v, field_type)
            return v
        except Unsupported as e:
            return self.by_value(tree, field_type, e)

    def by_value(self, tree: ast.AST, field_type: str, cause: Exception | None = None) -> V:
        """The expression evaluated in Python over Arrow batches of the columns it names. What is not on the list is refused here."""
        from strandline.plans import interpret

        kind = {"integer": "int", "float": "float", "string": "str", "boolean": "bool", "datetime": "dt"}.get(field_type)
        leaves = self.leaves(tree)
        interpret.check(tree, self.python_functions, {path[0].partition(".")[0] for path in leaves})
        if kind is None:
            raise Unsupported(f"{ast.unparse(tree)} as {field_type}") from cause
        columns, shapes = [], []
        for i, v in enumerate(leaves.values()):
            inner = holds_variant(v)
            columns.append((F.to_json(v.col) if inner else v.col).alias(f"c{i}"))
            shapes.append("json" if inner else v.kind)
        run = interpret.batches(tree, list(leaves), shapes, field_type, self.python_functions)
        return V(F.arrow_udf(run, SPARK_TYPES[field_type])(F.struct(*columns) if columns else F.struct(F.lit(0).alias("c"))), kind)

    def leaves(self, tree: ast.AST) -> dict[tuple[str, ...], V]:
        """The columns that an expression names, by (name,) or (base, field)."""
        from strandline.plans import interpret

        bound, out = interpret.bound_names(tree), {}

        def visit(n: ast.AST) -> None:
            at = self._dotted(n)
            if at and at[0].partition(".")[0] not in bound and (v := self.attribute(*at)) is not None:
                out[at] = v
                return
            if isinstance(n, ast.Name) and n.id in self.names and n.id not in bound:
                out[(n.id,)] = self.names[n.id]
            if isinstance(n, ast.Call) and ast.unparse(n.func) in (*interpret._FUNCTIONS, *self.python_functions):
                for x in (*n.args, *n.keywords):
                    visit(x)
                return
            if isinstance(n, ast.Attribute) and ast.unparse(n) in interpret._CONSTANTS:
                return
            if isinstance(n, ast.Name) and n.id not in self.names and n.id not in bound:
                raise UnknownName(n.id)
            for child in ast.iter_child_nodes(n):
                visit(child)

        visit(tree)
        return out

    def condition(self, text: str | None) -> Column | None:
        """True, or false where the expression is falsy or fails. None without a condition."""
        if text is None:
            return None
        v = self.value(text, "boolean")
        t = truthy(v)
        return t if v.err is None else t & ~F.coalesce(v.err, F.lit(True))

    def node(self, n: ast.AST) -> V:
        made = getattr(self, f"_{type(n).__name__}", None)
        if made is None:
            raise Unsupported(type(n).__name__)
        return made(n)

    def _Constant(self, n: ast.Constant) -> V:
        v = n.value
        if v is None:
            return none_value()
        if isinstance(v, bool):
            return V(F.lit(v), "bool")
        if isinstance(v, int):
            return V(F.lit(v).cast("long"), "int")
        if isinstance(v, float):
            return V(F.lit(v), "float")
        if isinstance(v, str):
            return V(F.lit(v), "str")
        raise Unsupported(repr(v))

    def _Name(self, n: ast.Name) -> V:
        if n.id in self.names:
            return self.names[n.id]
        raise UnknownName(n.id)

    def _dotted(self, n: ast.AST) -> tuple[str, str] | None:
        """(base, field) of ``base.field``, ``base['field']`` and, for windows over a spec, ``spec.base.field``."""
        if isinstance(n, ast.Attribute):
            field_name, inner = n.attr, n.value
        elif isinstance(n, ast.Subscript) and isinstance(n.slice, ast.Constant) and isinstance(n.slice.value, str):
            field_name, inner = n.slice.value, n.value
        else:
            return None
        if isinstance(inner, ast.Name) and inner.id not in self.names:
            return inner.id, field_name
        if isinstance(inner, ast.Attribute) and isinstance(inner.value, ast.Name) and inner.value.id not in self.names:
            return f"{inner.value.id}.{inner.attr}", field_name
        return None

    def _Attribute(self, n: ast.Attribute) -> V:
        at = self._dotted(n)
        if at and (v := self.attribute(*at)) is not None:
            return v
        v = self.node(n.value)
        if v.kind == "struct":
            return self._struct_field(v, n.attr)
        if v.kind in ("dt", "date") and n.attr in ("year", "month", "day", "hour", "minute", "second"):
            part = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}[n.attr]
            return _result(part(v.col).cast("long"), "int", v)
        if v.kind == "td" and n.attr == "days":
            return _result(F.floor(v.col / 86_400_000_000).cast("long"), "int", v)
        if v.kind == "td" and n.attr == "seconds":
            return _result(F.floor(F.pmod(v.col, F.lit(86_400_000_000)) / 1_000_000).cast("long"), "int", v)
        if v.kind == NONE:
            return replace(none_value(), err=F.lit(True))
        raise Unsupported(f".{n.attr} of {v.kind}")

    def _struct_field(self, v: V, name: str) -> V:
        found = next((f for f in v.fields or () if f.name == name), None)
        if found is None:
            return replace(none_value(), err=v.err)
        inner = column_value(v.col[name], found.dataType)
        return replace(inner, err=_any(v.err, v.col.isNull()))

    def _BinOp(self, n: ast.BinOp) -> V:
        a, b = self.node(n.left), self.node(n.right)
        op = type(n.op).__name__
        self._typed(a, b)
        if NONE in (a.kind, b.kind):
            return replace(none_value(), err=F.lit(True))
        if op == "Add" and a.kind == b.kind == "str":
            return _result(F.concat(a.col, b.col), "str", a, b)
        if op == "Add" and a.kind == b.kind == "list" and a.elem == b.elem:
            return _result(F.concat(a.col, b.col), "list", a, b, elem=a.elem)
        if op == "Sub" and a.kind == b.kind == "dt":
            return _result(F.unix_micros(a.col) - F.unix_micros(b.col), "td", a, b)
        if op == "Sub" and a.kind == b.kind == "date":
            return _result(F.datediff(a.col, b.col).cast("long") * 86_400_000_000, "td", a, b)
        if a.kind not in _NUM or b.kind not in _NUM:
            if {a.kind, b.kind} <= {"str", "list", "map", *_NUM} and op != "Mult" and op != "Mod":
                return V(F.lit(None).cast("double"), "float", err=F.lit(True))
            raise Unsupported(f"{op} of {a.kind} and {b.kind}")
        x, y = _number(a), _number(b)
        kind = "float" if "float" in (a.kind, b.kind) else "int"
        if op == "Pow":
            return self._power(a, b, n.right)
        if op == "Add":
            return _result(F.try_add(x, y), kind, a, b)
        if op == "Sub":
            return _result(F.try_subtract(x, y), kind, a, b)
        if op == "Mult":
            return _result(F.try_multiply(x, y), kind, a, b)
        if op == "Div":
            return _result(F.try_divide(x.cast("double"), y.cast("double")), "float", a, b)
        safe = F.when(y != 0, y)
        if kind == "float":
            quotient = F.floor(x / safe)
            if op == "FloorDiv":
                return _result(quotient.cast("double"), "float", a, b)
            return _result(x - safe * quotient, "float", a, b) if op == "Mod" else self._unsupported(op)
        remainder = F.pmod(x, F.abs(safe))
        rest = F.when((safe < 0) & (remainder != 0), remainder + safe).otherwise(remainder)
        if op == "Mod":
            return _result(F.when(safe.isNotNull(), rest), "int", a, b)
        if op == "FloorDiv":
            return _result(((x - rest) / safe).cast("long"), "int", a, b)
        return self._unsupported(op)

    def _power(self, a: V, b: V, exponent: ast.AST) -> V:
        """A fixed small exponent is multiplied out, so whole numbers stay exact."""
        if not (isinstance(exponent, ast.Constant) and isinstance(exponent.value, int) and 0 <= exponent.value <= 8):
            raise Unsupported("a power whose exponent is not a small number")
        x = _number(a)
        out = F.when(x.isNotNull(), F.lit(1.0) if a.kind == "float" else F.lit(1).cast("long"))
        for _ in range(exponent.value):
            out = F.try_multiply(out, x)
        return _result(out, "float" if a.kind == "float" else "int", a, b)

    def _typed(self, *vs: V) -> None:
        if any(VARIANT in (v.kind, v.elem) for v in vs):
            raise Unsupported("a value of several types")

    def _unsupported(self, what: str) -> V:
        raise Unsupported(what)

    def _UnaryOp(self, n: ast.UnaryOp) -> V:
        if isinstance(n.op, ast.Not):
            return self.truth(n)
        v = self.node(n.operand)
        if isinstance(n.op, ast.USub) and v.kind in _NUM:
            return _result(-_number(v), "float" if v.kind == "float" else "int", v)
        if isinstance(n.op, ast.UAdd) and v.kind in _NUM:
            return v
        raise Unsupported(type(n.op).__name__)

    def _common(self, *vs: V) -> tuple[list[Column], V]:
        """Columns of one type for a choice between the values, and a value of that kind."""
        self._typed(*vs)
        kinds = {v.kind for v in vs} - {NONE}
        if not kinds:
            return [v.col for v in vs], none_value()
        if len(kinds) == 1:
            shape = next(v for v in vs if v.kind != NONE)
            return [v.col for v in vs], shape
        if kinds <= {"int", "float"}:
            return [v.col.cast("double") for v in vs], V(vs[0].col, "float")
        raise Unsupported(f"a choice between {sorted(kinds)}")

    def truth(self, n: ast.AST) -> V:
        """A value of which only the truth matters, so that choices may mix kinds."""
        if isinstance(n, ast.BoolOp):
            vs = [self.truth(x) for x in n.values]
            if len({v.kind for v in vs} - {NONE}) > 1:
                vs = [V(truthy(v), "bool", err=v.err) for v in vs]
            return self._chosen(isinstance(n.op, ast.Or), vs)
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not):
            v = self.truth(n.operand)
            return V(~truthy(v), "bool", err=v.err)
        return self.node(n)

    def _BoolOp(self, n: ast.BoolOp) -> V:
        return self._chosen(isinstance(n.op, ast.Or), [self.node(x) for x in n.values])

    def _chosen(self, keep_if: bool, vs: list[V]) -> V:
        out = vs[-1]
        for v in reversed(vs[:-1]):
            (x, y), shape = self._common(v, out)
            stop = truthy(v) if keep_if else ~truthy(v)
            err = None if v.err is None and out.err is None else F.coalesce(failed(v), F.lit(False)) | (~stop & F.coalesce(failed(out), F.lit(False)))
            out = replace(shape, col=F.when(stop, x).otherwise(y), err=err)
        return out

    def _IfExp(self, n: ast.IfExp) -> V:
        test, a, b = self.truth(n.test), self.node(n.body), self.node(n.orelse)
        (x, y), shape = self._common(a, b)
        t = truthy(test)
        branch = None if a.err is None and b.err is None else F.when(t, failed(a)).otherwise(failed(b))
        return replace(shape, col=F.when(t, x).otherwise(y), err=_any(test.err, branch))

    def _Compare(self, n: ast.Compare) -> V:
        left, out = self.node(n.left), None
        for op, right_node in zip(n.ops, n.comparators):
            right = self._operand(op, right_node)
            one = self._compared(type(op).__name__, left, right)
            out = one if out is None else V(out.col & one.col, "bool", err=_any(out.err, one.err))
            left = right
        return out

    def _operand(self, op: ast.cmpop, n: ast.AST) -> V:
        return self.node(n)

    def _compared(self, op: str, a: V, b: V) -> V:
        if not (op in ("Eq", "NotEq", "Is", "IsNot") and NONE in (a.kind, b.kind)):
            self._typed(a, b)
        alike = a.kind == b.kind or {a.kind, b.kind} <= set(_NUM)
        if op in ("Eq", "NotEq", "Is", "IsNot"):
            if NONE in (a.kind, b.kind):
                same = a.col.isNull() if b.kind == NONE else b.col.isNull()
                if a.kind == b.kind:
                    same = F.lit(True)
            elif op.startswith("Is") and a.kind != b.kind:
                same = F.lit(False)
            elif not alike:
                same = a.col.isNull() & b.col.isNull()
            elif a.kind != b.kind:
                same = _number(a).cast("double").eqNullSafe(_number(b).cast("double"))
            else:
                same = a.col.eqNullSafe(b.col)
            return V(same if op in ("Eq", "Is") else ~same, "bool", err=_any(a.err, b.err))
        if op in ("In", "NotIn"):
            v = self._contains(a, b)
            return v if op == "In" else V(~v.col, "bool", err=v.err)
        if NONE in (a.kind, b.kind) or not alike:
            return V(F.lit(False), "bool", err=F.lit(True))
        x, y = (_number(a), _number(b)) if a.kind != b.kind or a.kind == "bool" else (a.col, b.col)
        c = {"Lt": x < y, "LtE": x <= y, "Gt": x > y, "GtE": x >= y}[op]
        return V(F.coalesce(c, F.lit(False)), "bool", err=_needing(a, b))

    def _contains(self, a: V, b: V) -> V:
        if b.kind == "str":
            if a.kind != "str":
                return V(F.lit(False), "bool", err=F.lit(True))
            return V(F.coalesce(b.col.contains(a.col), F.lit(False)), "bool", err=_needing(a, b))
        missing = b.col.isNull()
        if b.kind == "list":
            if a.kind == NONE:
                inside = F.exists(b.col, lambda x: x.isNull())
            elif a.kind != b.elem and not {a.kind, b.elem} <= {"int", "float"}:
                inside = F.lit(False)
            else:
                inside = F.exists(b.col, lambda x: x.eqNullSafe(a.col))
            return V(F.coalesce(inside, F.lit(False)), "bool", err=_any(a.err, b.err, missing))
        if b.kind == "map":
            return V(F.coalesce(F.map_contains_key(b.col, a.col), F.lit(False)), "bool", err=_any(a.err, b.err, missing))
        if b.kind == NONE:
            return V(F.lit(False), "bool", err=F.lit(True))
        raise Unsupported(f"in {b.kind}")

    def _List(self, n: ast.List | ast.Tuple | ast.Set) -> V:
        vs = [self.node(x) for x in n.elts]
        if not vs:
            raise Unsupported("an empty list has no element type")
        cols, shape = self._common(*vs)
        return V(F.array(*cols), "list", shape.kind, err=_any(*(v.err for v in vs)))

    _Tuple = _List
    _Set = _List

    def _Dict(self, n: ast.Dict) -> V:
        ks, vs = [self.node(k) for k in n.keys], [self.node(v) for v in n.values]
        if not ks:
            raise Unsupported("an empty map has no types")
        kc, kshape = self._common(*ks)
        vc, vshape = self._common(*vs)
        return V(F.create_map(*(x for kv in zip(kc, vc) for x in kv)), "map", vshape.kind, kshape.kind, err=_any(*(v.err for v in (*ks, *vs))))

    def _Subscript(self, n: ast.Subscript) -> V:
        at = self._dotted(n)
        if at and (v := self.attribute(*at)) is not None:
            return v
        if self.lists and isinstance(n.slice, (ast.Constant, ast.UnaryOp)) and (d := self._dotted(n.value)):
            try:
                index = ast.literal_eval(n.slice)
            except ValueError:
                index = None
            if index in (0, -1) and (v := self.lists("first" if index == 0 else "last", ".".join(d))) is not None:
                return v
        v = self.node(n.value)
        if isinstance(n.slice, ast.Slice):
            return self._sliced(v, n.slice)
        k = self.node(n.slice)
        if v.kind == NONE or k.kind == NONE:
            return replace(none_value(), err=F.lit(True))
        if v.kind == "list":
            i = k.col.cast("int")
            spot = F.when(i < 0, F.size(v.col) + i).otherwise(i)
            inside = spot.between(0, F.size(v.col) - 1)
            return V(F.when(inside, F.get(v.col, F.when(inside, spot))), v.elem or "str", err=_any(v.err, k.err, ~F.coalesce(inside, F.lit(False))))
        if v.kind == "map":
            has = F.coalesce(F.map_contains_key(v.col, k.col), F.lit(False))
            return V(F.try_element_at(v.col, k.col), v.elem or "str", err=_any(v.err, k.err, ~has))
        if v.kind == "str" and k.kind == "int":
            i = F.when(k.col < 0, F.length(v.col) + k.col).otherwise(k.col)
            return _result(F.when(i.between(0, F.length(v.col) - 1), F.substring(v.col, (i + 1).cast("int"), F.lit(1))), "str", v, k)
        if v.kind == "struct" and isinstance(n.slice, ast.Constant):
            return self._struct_field(v, str(n.slice.value))
        raise Unsupported(f"subscript of {v.kind}")

    def _sliced(self, v: V, s: ast.Slice) -> V:
        if s.step is not None or v.kind not in ("str", "list"):
            raise Unsupported("slice")
        size = F.length(v.col) if v.kind == "str" else F.size(v.col)

        def bound(n: ast.AST | None, missing: Column) -> Column:
            if n is None:
                return missing
            i = self.node(n).col.cast("int")
            return F.least(F.greatest(F.when(i < 0, size + i).otherwise(i), F.lit(0)), size)

        lo, hi = bound(s.lower, F.lit(0)), bound(s.upper, size)
        n = F.greatest(hi - lo, F.lit(0))
        return _result(F.substring(v.col, lo + 1, n) if v.kind == "str" else F.slice(v.col, lo + 1, n), v.kind, v, elem=v.elem)

    def _ListComp(self, n: ast.ListComp) -> V:
        if len(n.generators) == 2 and isinstance(n.elt, ast.Name):
            outer, inner = n.generators
            if isinstance(inner.iter, ast.Name) and isinstance(outer.target, ast.Name) and inner.iter.id == outer.target.id and isinstance(inner.target, ast.Name) and n.elt.id == inner.target.id and not outer.ifs and not inner.ifs:
                v = self.node(outer.iter)
                if v.kind == "list" and v.elem in ("list", None):
                    return V(F.flatten(v.col), "list", None, err=_any(v.err, v.col.isNull()))
        if len(n.generators) == 1 and isinstance(n.generators[0].target, ast.Tuple):
            return self._zipped(n.elt, n.generators[0])
        if len(n.generators) != 1 or not isinstance(n.generators[0].target, ast.Name) or n.generators[0].is_async:
            raise Unsupported("comprehension")
        g = n.generators[0]
        v = self.node(g.iter)
        if v.kind != "list":
            raise Unsupported("comprehension over no list")
        self._typed(v)
        name = g.target.id
        made: list[V] = []

        def inside(x: Column, n_: ast.AST) -> V:
            sub = Compiler({**self.names, name: V(x, v.elem or "str")}, self.attribute, self.functions)
            made.append(sub.node(n_))
            return made[-1]

        items = v.col
        for test in g.ifs:
            items = F.filter(items, lambda x: truthy(inside(x, test)))
        out = F.transform(items, lambda x: inside(x, n.elt).col)
        bad = made[-1].err
        err = _any(v.err, v.col.isNull(), None if bad is None else F.exists(items, lambda x: F.coalesce(failed(inside(x, n.elt)), F.lit(False))))
        return V(out, "list", made[-1].kind, err=err)

    _GeneratorExp = _ListComp

    def _SetComp(self, n: ast.SetComp) -> V:
        v = self._ListComp(ast.ListComp(n.elt, n.generators))
        return replace(v, col=F.array_sort(F.array_distinct(v.col)))

    def _DictComp(self, n: ast.DictComp) -> V:
        """Of equal keys the last counts."""
        k, v = (self._ListComp(ast.ListComp(x, n.generators)) for x in (n.key, n.value))
        self._typed(k, v)
        back = F.reverse(F.arrays_zip(k.col.alias("k"), v.col.alias("v")))
        names = F.reverse(k.col)
        last = F.filter(back, lambda e, i: F.array_position(names, e["k"]) == i + 1)
        return V(F.map_from_entries(F.reverse(last)), "map", v.elem, k.elem, err=_any(k.err, v.err, F.exists(k.col, lambda x: x.isNull())))

    def _zipped(self, elt: ast.AST, g: ast.comprehension) -> V:
        """``[... for a, b in zip(x, y)]``, as long as the shorter list."""
        call, names = g.iter, [t.id for t in g.target.elts if isinstance(t, ast.Name)]
        if not (isinstance(call, ast.Call) and isinstance(call.func, ast.Name) and call.func.id == "zip" and len(call.args) == len(names) == len(g.target.elts) == 2) or g.ifs:
            raise Unsupported("comprehension")
        x, y = (self.node(a) for a in call.args)
        if x.kind != "list" or y.kind != "list":
            raise Unsupported("zip of no lists")
        n = F.least(F.size(x.col), F.size(y.col))
        made: list[V] = []

        def inside(a: Column, b: Column) -> V:
            made.append(Compiler({**self.names, names[0]: V(a, x.elem or "str"), names[1]: V(b, y.elem or "str")}, self.attribute, self.functions).node(elt))
            return made[-1]

        xs, ys = F.slice(x.col, 1, n), F.slice(y.col, 1, n)
        out = F.zip_with(xs, ys, lambda a, b: inside(a, b).col)
        bad = F.zip_with(xs, ys, lambda a, b: F.coalesce(failed(inside(a, b)), F.lit(False)))
        return V(out, "list", made[-1].kind, err=_any(_needing(x, y), F.exists(bad, lambda z: z)))

    def _Call(self, n: ast.Call) -> V:
        if n.keywords:
            raise Unsupported("keyword arguments")
        if isinstance(n.func, ast.Name):
            return self._function(n.func.id, n.args)
        if isinstance(n.func, ast.Attribute):
            whole = ast.unparse(n.func)
            if whole in self.functions:
                return self.functions[whole](*map(self.node, n.args))
            if whole in self.python_functions:
                raise Unsupported(f"{whole} has no column form")
            if whole in ("parser.parse", "dateutil.parser.parse"):
                return parse_time(self.node(n.args[0]))
            if whole in ("datetime.strptime", "datetime.datetime.strptime"):
                return self._strptime(*n.args)
            if whole in ("datetime.fromtimestamp", "datetime.datetime.fromtimestamp"):
                v = self.node(n.args[0])
                return _result(F.timestamp_micros(F.round(_number(v).cast("double") * 1_000_000).cast("long")), "dt", v)
            target = self.node(n.func.value)
            self._typed(target)
            return self._method(target, n.func.attr, [self.node(a) for a in n.args])
        raise Unsupported("call")

    def _strptime(self, text: ast.AST, fmt: ast.AST) -> V:
        if not (isinstance(fmt, ast.Constant) and isinstance(fmt.value, str)):
            raise Unsupported("a format that is not fixed")
        v = self.node(text)
        if v.kind != "str":
            return V(F.lit(None).cast("timestamp"), "dt", err=F.lit(True))
        pattern, zoned = java_pattern(fmt.value)
        c = F.try_to_timestamp(v.col if zoned else F.concat(v.col, F.lit(" +0000")), F.lit(pattern if zoned else f"{pattern} xx"))
        return _result(c, "dt", v)

    def _function(self, name: str, args: list[ast.AST]) -> V:
        if name in self.functions:
            return self.functions[name](*map(self.node, args))
        if name in self.python_functions:
            raise Unsupported(f"{name} has no column form")
        if self.lists and name in ("sum", "len", "max", "min") and len(args) == 1 and (d := self._dotted(args[0])):
            if (v := self.lists(name, ".".join(d))) is not None:
                return v
        if name == "parse" and len(args) == 1:
            return parse_time(self.node(args[0]))
        vs = [self.node(a) for a in args]
        if name == "bool" and len(vs) == 1:
            return V(truthy(vs[0]), "bool", err=vs[0].err)
        if name == "round" and len(vs) == 2 and isinstance(args[1], ast.Constant) and isinstance(args[1].value, int):
            return _result(F.bround(_number(vs[0]), F.lit(args[1].value)), "float" if vs[0].kind == "float" else "int", vs[0])
        if name in ("any", "all") and len(vs) == 1 and vs[0].kind == "list" and vs[0].elem in (*_NUM, "str"):
            test = (F.exists if name == "any" else F.forall)(vs[0].col, lambda x: truthy(V(x, vs[0].elem)))
            return V(F.coalesce(test, F.lit(False)), "bool", err=_any(vs[0].err, vs[0].col.isNull()))
        if name in ("max", "min") and len(vs) > 1:
            if NONE in {v.kind for v in vs}:
                return replace(none_value(), err=F.lit(True))
            cols, shape = self._common(*vs)
            return replace(shape, col=(F.greatest if name == "max" else F.least)(*cols), err=_needing(*vs))
        if len(vs) != 1:
            raise Unsupported(f"{name} of {len(vs)} values")
        v = vs[0]
        if v.elem == VARIANT or (v.kind == VARIANT and name not in ("int", "float", "str")):
            raise Unsupported(f"{name} of a value of several types")
        if v.kind == NONE and name not in ("str",):
            return V(F.lit(None).cast("long"), "int", err=F.lit(True))
        if name == "int":
            return _result(to_int(v), "int", v)
        if name == "float":
            return _result(to_float(v), "float", v)
        if name == "str":
            return V(F.coalesce(to_str(v), F.lit("None")) if v.kind != NONE else F.lit("None"), "str", err=v.err)
        if name == "abs":
            return _result(F.abs(_number(v)), "float" if v.kind == "float" else "int", v)
        if name == "round":
            return _result(F.bround(_number(v), 0).cast("long"), "int", v)
        if name == "ord" and v.kind == "str":
            return _result(F.when(F.length(v.col) == 1, F.ascii(v.col).cast("long")), "int", v)
        if name == "list" and v.kind == "list":
            return v
        if name in ("set", "sorted") and v.kind == "list":
            return _result(F.array_sort(F.array_distinct(v.col) if name == "set" else v.col), "list", v, elem=v.elem)
        if name == "len":
            return _result((F.length(v.col) if v.kind == "str" else F.size(v.col)).cast("long"), "int", v) if v.kind in ("str", "list", "map") else self._unsupported(name)
        if name == "sum" and v.kind == "list" and v.elem in _NUM:
            holes = F.exists(v.col, lambda x: x.isNull())
            zero = F.lit(0.0) if v.elem == "float" else F.lit(0).cast("long")
            total = F.aggregate(F.transform(v.col, lambda x: x.cast("double" if v.elem == "float" else "long")), zero, F.try_add)
            return V(total, "float" if v.elem == "float" else "int", err=_any(v.err, v.col.isNull(), holes))
        if name in ("max", "min") and v.kind == "list":
            holes = F.coalesce(F.exists(v.col, lambda x: x.isNull()), F.lit(True))
            return V((F.array_max if name == "max" else F.array_min)(v.col), v.elem or "str", err=_any(v.err, holes | (F.size(v.col) == 0)))
        raise Unsupported(name)

    def _method(self, v: V, name: str, args: list[V]) -> V:
        if v.kind == NONE:
            return replace(none_value(), err=F.lit(True))
        if v.kind == "str":
            return self._string_method(v, name, args)
        if v.kind == "dt" and name == "date" and not args:
            return _result(F.to_date(v.col), "date", v)
        if v.kind == "dt" and name == "timestamp" and not args:
            return _result(F.unix_micros(v.col) / 1e6, "float", v)
        if v.kind in ("dt", "date") and name == "isoformat" and not args:
            return _result(F.replace(to_str(v), F.lit(" "), F.lit("T")), "str", v)
        if v.kind in ("dt", "date") and name == "weekday" and not args:
            return _result(F.weekday(v.col).cast("long"), "int", v)
        if v.kind == "td" and name == "total_seconds" and not args:
            return _result(v.col / 1e6, "float", v)
        if v.kind == "map" and name == "keys" and not args:
            return _result(F.map_keys(v.col), "list", v, elem=v.key)
        if v.kind == "map" and name == "values" and not args:
            return _result(F.map_values(v.col), "list", v, elem=v.elem)
        if v.kind == "map" and name == "get" and args:
            c = F.try_element_at(v.col, args[0].col)
            return V(F.coalesce(c, args[1].col) if len(args) > 1 else c, v.elem or "str", err=_any(v.err, v.col.isNull(), *(a.err for a in args)))
        if v.kind == "list" and name in ("count", "index") and len(args) == 1:
            hits = F.filter(v.col, lambda x: x.eqNullSafe(args[0].col))
            c = F.size(hits) if name == "count" else F.array_position(v.col, args[0].col) - 1
            return _result(F.when(c >= 0, c).cast("long"), "int", v, args[0])
        raise Unsupported(f".{name} of {v.kind}")

    def _string_method(self, v: V, name: str, args: list[V]) -> V:
        c = v.col
        strings = [a.col for a in args]
        if any(a.kind != "str" for a in args) and not (name == "join" and args[0].kind == "list"):
            return V(F.lit(None).cast("string"), "str", err=F.lit(True)) if any(a.kind == NONE for a in args) else self._unsupported(name)
        if name == "split":
            if not args:
                return _result(F.filter(F.split(F.trim(c), r"\s+", -1), lambda x: x != ""), "list", v, elem="str")
            return _result(F.split(c, F.concat(F.lit(r"\Q"), strings[0], F.lit(r"\E")), -1), "list", v, *args, elem="str")
        simple = {"lower": F.lower, "upper": F.upper}
        if name in simple and not args:
            return _result(simple[name](c), "str", v)
        if name in ("strip", "lstrip", "rstrip") and len(args) <= 1:
            if args:
                return _result({"strip": F.btrim, "lstrip": F.ltrim, "rstrip": F.rtrim}[name](c, strings[0]), "str", v, *args)
            pattern = {"strip": r"^\s+|\s+$", "lstrip": r"^\s+", "rstrip": r"\s+$"}[name]
            return _result(F.regexp_replace(c, pattern, ""), "str", v)
        if name in ("startswith", "endswith") and len(args) == 1:
            return _result(getattr(c, name)(strings[0]), "bool", v, *args)
        if name == "replace" and len(args) == 2:
            return _result(F.replace(c, *strings), "str", v, *args)
        if name == "find" and len(args) == 1:
            return _result((F.instr(c, args[0].col) - 1).cast("long"), "int", v, *args)
        if name == "join" and len(args) == 1:
            return _result(F.call_function("array_join", F.when(~F.exists(args[0].col, lambda x: x.isNull()), args[0].col), c), "str", v, *args) if args[0].elem == "str" else self._unsupported(name)
        if name == "isdigit" and not args:
            return _result(c.rlike(r"^\d+$"), "bool", v)
        raise Unsupported(f".{name} of str")
