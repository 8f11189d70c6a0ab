"""What a spec's ``Import`` may name: listed functions of the standard library, and nothing else.

No module is imported by name. A name that is not listed can be given to ``Engine`` with ``python_functions`` (called
value by value) or ``functions`` (columns in, column out).
"""

from __future__ import annotations

import datetime as dt
import json
import math
import re
import statistics
from collections.abc import Callable, Iterable
from typing import Any
from urllib.parse import unquote

from pyspark.sql import functions as F

from strandline.plans import interpret
from strandline.plans.expr import V, _number, _result, parse_time

_ONE = ("ceil", "floor", "trunc", "sqrt", "exp", "log", "log2", "log10", "log1p", "expm1", "fabs", "sin", "cos", "tan", "atan", "degrees", "radians", "isnan", "isinf", "isfinite")
#: Modules and their functions. ``re`` works on text alone and returns text.
ALLOWED: dict[str, dict[str, Any]] = {
    "math": {n: getattr(math, n) for n in (*_ONE, "pow", "hypot", "atan2", "gcd", "isclose", "fmod", "copysign")},
    "statistics": {n: getattr(statistics, n) for n in ("mean", "median", "mode", "stdev", "pstdev", "variance", "pvariance")},
    "datetime": {"datetime": dt.datetime, "timedelta": dt.timedelta, "date": dt.date, "timezone": dt.timezone},
    "dateutil.parser": {"parse": interpret.parse},
    "dateutil": {"parser": None},
    "json": {"loads": json.loads, "dumps": json.dumps},
    "re": {"sub": re.sub, "split": re.split, "findall": re.findall, "escape": re.escape},
    "urllib.parse": {"unquote": unquote},
}
#: Known to expressions by these names already.
_BUILT_IN = {"datetime", "dateutil", "dateutil.parser"}


def _native(f: Callable) -> Callable[[V], V]:
    return lambda v: _result(f(_number(v).cast("double")), "float", v)


def _whole(f: Callable) -> Callable[[V], V]:
    return lambda v: _result(f(_number(v).cast("double")).cast("long"), "int", v)


#: Functions that have a column form. Outside their domain they give no value, as an error would.
NATIVE: dict[str, Callable[..., V]] = {
    "math.sqrt": _native(lambda x: F.when(x >= 0, F.sqrt(x))), "math.exp": _native(F.exp), "math.log": _native(lambda x: F.when(x > 0, F.log(x))), "math.log2": _native(lambda x: F.when(x > 0, F.log2(x))), "math.log10": _native(lambda x: F.when(x > 0, F.log10(x))),
    "math.log1p": _native(lambda x: F.when(x > -1, F.log1p(x))), "math.fabs": _native(F.abs), "math.floor": _whole(F.floor), "math.ceil": _whole(F.ceil),
    "dateutil.parser.parse": parse_time,
}


class UnknownImport(ValueError):
    """An import of something that is neither listed nor given."""


def resolve(imports: Iterable[tuple[str, tuple[str, ...]]], given: Iterable[str] = ()) -> tuple[dict[str, Callable], dict[str, Callable[..., V]]]:
    """(called value by value, column form) of what the imports name, by the name that expressions use.

    ``import m`` gives ``m.f`` for each listed f, ``from m import f as g`` gives ``g``. Names that are ``given`` are left
    to the caller. A module or function that is not listed raises UnknownImport.
    """
    plain: dict[str, Callable] = {}
    native: dict[str, Callable[..., V]] = {}
    have = set(given)
    for module, identifiers in imports:
        module, _, alias = (x.strip() for x in module.partition(" as "))
        wanted = [(f"{alias or module}.{f}", f) for f in ALLOWED.get(module, ())] if not identifiers else []
        for i in identifiers:
            name, _, other = (x.strip() for x in i.partition(" as "))
            wanted.append((other or name, name))
        if not identifiers and module not in ALLOWED and not any(x.startswith(f"{alias or module}.") for x in have):
            raise UnknownImport(f"import of {module}: not listed; give its functions to the engine")
        for known_as, f in wanted:
            if known_as in have:
                continue
            if f not in ALLOWED.get(module, {}):
                raise UnknownImport(f"import of {f} from {module}: not listed; give it to the engine")
            if module in _BUILT_IN and known_as == f:
                continue
            if callable(ALLOWED[module][f]):
                plain[known_as] = ALLOWED[module][f]
                if ALLOWED[module][f] is dt.datetime:
                    plain |= {f"{known_as}.{x}": interpret._FUNCTIONS[f"datetime.{x}"] for x in ("strptime", "fromtimestamp")}
            if f"{module}.{f}" in NATIVE:
                native[known_as] = NATIVE[f"{module}.{f}"]
    return plain, native


__all__ = ["ALLOWED", "NATIVE", "UnknownImport", "resolve"]
