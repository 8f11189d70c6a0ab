"""The same expressions, evaluated value by value: for rules that only an ordered fold can follow, and for what has no column form.

Only listed syntax, functions and methods work; ``check`` refuses anything else before a run starts. An expression
that fails on a value yields FAILED, never an exception, except for names that the spec does not define.
"""

from __future__ import annotations

import ast
import datetime as dt
import json
import string
from collections.abc import Iterable
from typing import Any

import pyarrow as pa

from strandline.plans.expr import UnknownName, Unsupported


class FAILED:
    """What a failed expression yields: the class itself, which stays the same in every process."""


_STRING = {
    "split", "rsplit", "splitlines", "partition", "rpartition", "strip", "lstrip", "rstrip", "lower", "upper", "title", "capitalize", "swapcase", "casefold", "startswith", "endswith", "removeprefix", "removesuffix", "replace", "find", "rfind", "index", "rindex",
    "join", "count", "format", "ljust", "rjust", "center", "zfill", "isdigit", "isdecimal", "isnumeric", "isalpha", "isalnum", "isspace", "isupper", "islower", "istitle",
}
_LIST = {"append", "extend", "insert", "remove", "pop", "index", "count", "reverse", "sort", "clear", "copy"}
_SET = {"add", "discard", "remove", "union", "intersection", "difference", "symmetric_difference", "update", "intersection_update", "difference_update", "symmetric_difference_update", "pop", "clear", "copy", "issubset", "issuperset", "isdisjoint"}
_MAP = {"set", "increment", "get", "keys", "values", "items", "update", "pop", "clear", "copy", "setdefault"}
_TIME = {"date", "time", "timestamp", "isoformat", "weekday", "isoweekday", "strftime", "replace", "total_seconds", "year", "month", "day", "hour", "minute", "second", "microsecond", "days", "seconds"}
_METHODS: list[tuple[type | tuple, set[str]]] = [(str, _STRING), (list, _LIST), (set, _SET), (dict, _MAP), ((dt.datetime, dt.date, dt.time, dt.timedelta), _TIME)]
_ANY_METHOD = _STRING | _LIST | _SET | _MAP | _TIME
_LARGEST = 1_000_000


class Record(dict):
    """Event attributes; a missing one is None."""


class State(dict):
    """An aggregate's fields; a missing one is an error of the spec."""


def parse(text: str) -> dt.datetime:
    """A time out of text: ISO, slashed, and whatever else names day, month and year without doubt. Without an offset it is UTC."""
    text = text.strip()
    for f in (dt.datetime.fromisoformat, lambda x: dt.datetime.strptime(x, "%Y/%m/%d %H:%M:%S")):
        try:
            t = f(text)
            return t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)
        except ValueError:
            continue
    from dateutil import parser

    t, other = (parser.parse(text, default=dt.datetime(y, m, d)) for y, m, d in ((2000, 1, 1), (2004, 2, 2)))
    if t != other:
        raise ValueError(f"{text}: not a whole date")
    return t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)


class _Format(string.Formatter):
    """``str.format`` without access to attributes."""

    def get_field(self, name: str, args: Any, kwargs: Any) -> Any:
        if "." in name or "_" in name[:1]:
            raise ValueError(name)
        return super().get_field(name, args, kwargs)

    def format_field(self, value: Any, spec: str) -> str:
        return _formatted(value, spec)


def _formatted(value: Any, spec: str) -> str:
    if any(len(x) > 4 for x in "".join(c if c.isdigit() else " " for c in spec).split()):
        raise ValueError(spec)
    return format(value, spec)


def _times(a: Any, b: Any) -> Any:
    for x, n in ((a, b), (b, a)):
        if isinstance(x, (str, list)) and isinstance(n, int) and len(x) * n > _LARGEST:
            raise OverflowError
    return a * b


def _remainder(a: Any, b: Any) -> Any:
    if isinstance(a, str):
        if "*" in a or any(len(x) > 4 for x in "".join(c if c.isdigit() else " " for c in a).split()):
            raise ValueError(a)
    return a % b


def _power(a: Any, b: Any) -> Any:
    if isinstance(a, int) and isinstance(b, int) and b > 0 and a.bit_length() * b > 10_000:
        raise OverflowError
    return a**b


def _shifted(a: int, b: int) -> int:
    if b > 10_000:
        raise OverflowError
    return a << b


def _range(*args: int) -> list[int]:
    r = range(*args)
    if len(r) > _LARGEST:
        raise OverflowError
    return list(r)


_FUNCTIONS = {
    "int": int, "float": float, "str": str, "bool": bool, "len": len, "sum": sum, "max": max, "min": min, "abs": abs, "round": round, "ord": ord, "chr": chr, "list": list, "set": set, "tuple": list, "zip": lambda *x: list(zip(*x)), "sorted": sorted, "dict": dict,
    "any": any, "all": all, "reversed": lambda x: list(reversed(x)), "enumerate": lambda *x: list(enumerate(*x)), "range": _range, "divmod": divmod, "pow": _power, "parse": parse, "parser.parse": parse, "dateutil.parser.parse": parse, "timedelta": dt.timedelta, "datetime.timedelta": dt.timedelta,
    "datetime": dt.datetime, "datetime.datetime": dt.datetime, "datetime.strptime": dt.datetime.strptime, "datetime.datetime.strptime": dt.datetime.strptime, "datetime.fromtimestamp": lambda x, tz=dt.timezone.utc: dt.datetime.fromtimestamp(x, tz), "datetime.datetime.fromtimestamp": lambda x, tz=dt.timezone.utc: dt.datetime.fromtimestamp(x, tz),
}
_CONSTANTS = {"timezone.utc": dt.timezone.utc, "datetime.timezone.utc": dt.timezone.utc}
_OPS = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: _times, ast.Div: lambda a, b: a / b, ast.FloorDiv: lambda a, b: a // b, ast.Mod: _remainder, ast.Pow: _power,
    ast.BitAnd: lambda a, b: a & b, ast.BitOr: lambda a, b: a | b, ast.BitXor: lambda a, b: a ^ b, ast.LShift: _shifted, ast.RShift: lambda a, b: a >> b,
    ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b,
    ast.Is: lambda a, b: a is b, ast.IsNot: lambda a, b: a is not b, ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b,
}
_UNARY = {ast.Not: lambda v: not v, ast.USub: lambda v: -v, ast.UAdd: lambda v: +v, ast.Invert: lambda v: ~v}
_SYNTAX = (
    ast.Constant, ast.Name, ast.Load, ast.Store, ast.Attribute, ast.Subscript, ast.Slice, ast.BinOp, ast.UnaryOp, ast.BoolOp, ast.And, ast.Or, ast.IfExp, ast.Compare, ast.List, ast.Tuple, ast.Set, ast.Dict, ast.ListComp, ast.GeneratorExp, ast.SetComp, ast.DictComp,
    ast.comprehension, ast.Call, ast.keyword, ast.JoinedStr, ast.FormattedValue, *_OPS, *_UNARY,
)


def root_of(n: ast.AST) -> str | None:
    """The name that a chain of attributes starts with."""
    while isinstance(n, ast.Attribute):
        n = n.value
    return n.id if isinstance(n, ast.Name) else None


def bound_names(tree: ast.AST) -> set[str]:
    """Names that comprehensions bind."""
    return {x.id for g in ast.walk(tree) if isinstance(g, ast.comprehension) for x in ast.walk(g.target) if isinstance(x, ast.Name)}


def check(tree: ast.AST, functions: Iterable[str] = (), known: Iterable[str] = ()) -> None:
    """Raises Unsupported, before anything runs, where an expression uses what is not on the list. ``known`` are names with a value."""
    names, values = {*_FUNCTIONS, *functions}, {*known, *bound_names(tree)}
    roots = {x.partition(".")[0] for x in (*names, *_CONSTANTS)}
    for n in ast.walk(tree):
        if isinstance(n, ast.Name) and n.id not in values and n.id not in roots:
            raise UnknownName(n.id)
        if isinstance(n, ast.comprehension) and n.is_async:
            raise Unsupported("async")
        if not isinstance(n, _SYNTAX):
            raise Unsupported(f"{type(n).__name__} in {ast.unparse(tree)}")
        if isinstance(n, ast.Attribute) and n.attr.startswith("__"):
            raise Unsupported(f".{n.attr}")
        if isinstance(n, ast.Call):
            called = ast.unparse(n.func)
            if called in names:
                continue
            if isinstance(n.func, ast.Name):
                raise UnknownName(n.func.id)
            if not isinstance(n.func, ast.Attribute) or n.func.attr not in _ANY_METHOD:
                raise Unsupported(f"{called}()")
            if n.func.attr in _FUNCTIONS and (root := root_of(n.func)) is not None and root not in values:
                raise UnknownName(root)


def _fluent(target: Any, name: str, args: list[Any], kwargs: dict[str, Any]) -> Any:
    """A collection's method; one that returns nothing returns the collection, and None is never put in."""
    if isinstance(target, dict) and name == "increment":
        if args[0] is not None:
            target[args[0]] = target.get(args[0], 0) + (args[1] if len(args) > 1 else 1)
        return target
    if isinstance(target, dict) and name == "set":
        if args[0] is not None:
            target[args[0]] = args[1]
        return target
    if name in ("append", "add") and args and args[0] is None or name == "insert" and args[1] is None:
        return target
    out = getattr(target, name)(*args, **kwargs)
    out = target if out is None else out
    return out if isinstance(out, (str, int, float, list, set, dict)) or not isinstance(out, Iterable) else [list(x) if isinstance(x, tuple) else x for x in out]


class Interpreter:
    def __init__(self, functions: dict[str, Any] | None = None):
        self.functions = {**_FUNCTIONS, **(functions or {})}

    def run(self, tree: ast.AST, env: dict[str, Any]) -> Any:
        try:
            return self._eval(tree, env)
        except UnknownName:
            raise
        except Exception:  # noqa: BLE001
            return FAILED

    def _eval(self, n: ast.AST, env: dict[str, Any]) -> Any:
        ev = self._eval
        if isinstance(n, ast.Constant):
            return n.value
        if isinstance(n, ast.Name):
            if n.id in env:
                return env[n.id]
            raise UnknownName(n.id)
        if isinstance(n, ast.Attribute):
            if root_of(n) not in env and (whole := ast.unparse(n)) in _CONSTANTS:
                return _CONSTANTS[whole]
            return self._attribute(ev(n.value, env), n.attr)
        if isinstance(n, ast.Subscript):
            base = ev(n.value, env)
            if isinstance(n.slice, ast.Slice):
                return base[slice(*(None if x is None else ev(x, env) for x in (n.slice.lower, n.slice.upper, n.slice.step)))]
            key = ev(n.slice, env)
            return self._attribute(base, key) if isinstance(base, (Record, State)) else base[key]
        if isinstance(n, (ast.BinOp,)):
            return _OPS[type(n.op)](ev(n.left, env), ev(n.right, env))
        if isinstance(n, ast.UnaryOp):
            return _UNARY[type(n.op)](ev(n.operand, env))
        if isinstance(n, ast.BoolOp):
            v = None
            for x in n.values:
                v = ev(x, env)
                if bool(v) == isinstance(n.op, ast.Or):
                    return v
            return v
        if isinstance(n, ast.IfExp):
            return ev(n.body if ev(n.test, env) else n.orelse, env)
        if isinstance(n, ast.Compare):
            left = ev(n.left, env)
            for op, x in zip(n.ops, n.comparators):
                right = ev(x, env)
                if not _OPS[type(op)](left, right):
                    return False
                left = right
            return True
        if isinstance(n, (ast.List, ast.Tuple)):
            return [ev(x, env) for x in n.elts]
        if isinstance(n, ast.Set):
            return {ev(x, env) for x in n.elts}
        if isinstance(n, ast.Dict):
            return {ev(k, env): ev(v, env) for k, v in zip(n.keys, n.values)}
        if isinstance(n, (ast.ListComp, ast.GeneratorExp)):
            return list(self._comprehension(n.elt, n.generators, env))
        if isinstance(n, ast.SetComp):
            return set(self._comprehension(n.elt, n.generators, env))
        if isinstance(n, ast.DictComp):
            return dict(self._comprehension(ast.Tuple([n.key, n.value], ast.Load()), n.generators, env))
        if isinstance(n, ast.JoinedStr):
            return "".join(ev(x, env) for x in n.values)
        if isinstance(n, ast.FormattedValue):
            v = ev(n.value, env)
            v = {115: str, 114: repr, 97: ascii}[n.conversion](v) if n.conversion in (115, 114, 97) else v
            return _formatted(v, ev(n.format_spec, env) if n.format_spec else "")
        if isinstance(n, ast.Call):
            return self._call(n, env)
        raise ValueError(type(n).__name__)

    def _comprehension(self, elt: ast.AST, generators: list[ast.comprehension], env: dict[str, Any]):
        if not generators:
            yield self._eval(elt, env)
            return
        g, *rest = generators
        for x in self._eval(g.iter, env):
            pairs = zip(g.target.elts, x) if isinstance(g.target, ast.Tuple) else [(g.target, x)]
            inner = {**env, **{t.id: v for t, v in pairs}}
            if all(self._eval(t, inner) for t in g.ifs):
                yield from self._comprehension(elt, rest, inner)

    def _attribute(self, base: Any, name: str) -> Any:
        if isinstance(base, Record):
            return base.get(name)
        if isinstance(base, State):
            if name in base:
                return base[name]
            raise UnknownName(name)
        if isinstance(base, dict) and name not in _MAP:
            return base[name]
        for kind, names in _METHODS:
            if isinstance(base, kind) and name in names:
                return getattr(base, name)
        raise AttributeError(name)

    def _call(self, n: ast.Call, env: dict[str, Any]) -> Any:
        args = [self._eval(a, env) for a in n.args]
        kwargs = {k.arg: self._eval(k.value, env) for k in n.keywords if k.arg}
        name = ast.unparse(n.func)
        if name in self.functions and root_of(n.func) not in env:
            out = self.functions[name](*args, **kwargs)
            return out.replace(tzinfo=dt.timezone.utc) if isinstance(out, dt.datetime) and not out.tzinfo else out
        if not isinstance(n.func, ast.Attribute):
            raise UnknownName(name)
        target = self._eval(n.func.value, env)
        if isinstance(target, (list, set, dict)) and not isinstance(target, (Record, State)):
            allowed = next(names for kind, names in _METHODS if isinstance(target, kind))
            if n.func.attr not in allowed:
                raise AttributeError(n.func.attr)
            return _fluent(target, n.func.attr, args, kwargs)
        if isinstance(target, str) and n.func.attr == "format":
            return _Format().vformat(target, args, kwargs)
        if isinstance(target, str) and n.func.attr in ("ljust", "rjust", "center", "zfill") and args[0] > _LARGEST:
            raise OverflowError
        return self._attribute(target, n.func.attr)(*args, **kwargs)


def fits(value: Any, field_type: str) -> Any:
    """The value as the field's type, or FAILED, which leaves the field as it was."""
    if value is FAILED or value is None:
        return FAILED
    try:
        if field_type == "integer":
            return int(value)
        if field_type == "float":
            return float(value)
        if field_type == "string":
            return str(value)
        if field_type == "boolean":
            return bool(value)
        if field_type == "datetime":
            return value if isinstance(value, dt.datetime) else FAILED
        return {"list": list, "set": set, "map": dict}[field_type](value)
    except (TypeError, ValueError, OverflowError):
        return FAILED


def default(field_type: str) -> Any:
    return {"integer": 0, "float": 0.0, "string": "", "boolean": False, "datetime": None, "list": [], "set": set(), "map": {}}[field_type]


def value_of(v: Any, shape: str) -> Any:
    """A value out of an Arrow batch as expressions know it."""
    if v is None or v != v:
        return None
    if shape == "json":
        return json.loads(v)
    if isinstance(v, dt.datetime):
        return v.astimezone(dt.timezone.utc) if v.tzinfo else v.replace(tzinfo=dt.timezone.utc)
    if shape == "map":
        return dict(v)
    if shape == "td":
        return dt.timedelta(microseconds=v)
    if isinstance(v, list):
        return [value_of(x, "") for x in v]
    return Record(v) if isinstance(v, dict) else v


def batches(tree: ast.AST, paths: list[tuple[str, ...]], shapes: list[str], field_type: str, functions: dict[str, Any]):
    """An Arrow function that evaluates ``tree`` for each row; ``paths`` say where the row's values go, (name,) or (base, field)."""
    kind = {"integer": pa.int64(), "float": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "datetime": pa.timestamp("us", "UTC")}[field_type]

    def run(rows: pa.Array) -> pa.Array:
        machine, out = Interpreter(functions), []
        columns = [rows.field(i).to_pylist() for i in range(len(paths))]
        for i in range(len(rows)):
            env: dict[str, Any] = {}
            for path, shape, values in zip(paths, shapes, columns):
                v = value_of(values[i], shape)
                if len(path) == 1:
                    env[path[0]] = v
                    continue
                at = env
                for x in path[0].split("."):
                    at = at.setdefault(x, Record() if x == "source" else State())
                at[path[1]] = v
            v = fits(machine.run(tree, env), field_type)
            out.append(None if v is FAILED else v)
        return pa.array(out, kind)

    return run
