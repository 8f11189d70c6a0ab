"""Specs: a declarative description of aggregates over an event stream, and of windows over their blocks.

A spec is YAML or a dict. Types are tags such as ``Any:Aggregate:Block``; only what follows the vendor's prefix
counts, and letter case does not.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path
from typing import Any

import yaml

VERSION = "2018-03-01"
FIELD_TYPES = ("integer", "float", "string", "boolean", "datetime", "map", "list", "set")
AGGREGATES = ("identity", "block", "activity", "variable", "window")
STORES = ("memory", "dynamo", "table")


def tag(raw: Any) -> str:
    """``X:Aggregate:Block`` -> ``aggregate:block``; a bare name stays, in lower case."""
    parts = str(raw or "").lower().split(":")
    return ":".join(parts[1:]) if len(parts) > 2 else ":".join(parts)


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    value: str
    when: str | None = None


@dataclass(frozen=True)
class Aggregate:
    name: str
    kind: str
    fields: tuple[Field, ...]
    dimensions: tuple[Field, ...] = ()
    when: str | None = None
    store: str | None = None
    gap_s: int | None = None
    window_type: str | None = None
    window_value: int | None = None
    source: str | None = None

    def field(self, name: str) -> Field | None:
        return next((f for f in (*self.fields, *self.dimensions) if f.name == name), None)


@dataclass(frozen=True)
class StreamSpec:
    name: str
    identity: str
    time: str
    aggregates: tuple[Aggregate, ...]
    when: str | None = None
    imports: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def aggregate(self, name: str) -> Aggregate | None:
        return next((a for a in self.aggregates if a.name == name), None)


@dataclass(frozen=True)
class WindowSpec:
    name: str
    condition: str
    maximum: int | None
    aggregates: tuple[Aggregate, ...]
    when: str | None = None
    imports: tuple[tuple[str, tuple[str, ...]], ...] = ()


def load_raw(spec: str | Path | dict) -> dict:
    """A dict as it is; otherwise a YAML file's content."""
    if isinstance(spec, dict):
        return spec
    text = Path(spec).read_text(encoding="utf-8")
    loaded = yaml.safe_load(text)
    if not isinstance(loaded, dict):
        raise ValueError(f"{spec}: not a mapping")
    return loaded


def _expr(raw: Any) -> str | None:
    return None if raw is None else str(raw).strip()


def _fields(raw: Any) -> tuple[Field, ...]:
    return tuple(Field(str(f["Name"]), str(f.get("Type", "string")).lower(), _expr(f.get("Value")) or "None", _expr(f.get("When"))) for f in raw or ())


def _aggregate(raw: dict) -> Aggregate:
    return Aggregate(
        str(raw["Name"]), tag(raw["Type"]).rpartition(":")[2], _fields(raw.get("Fields")), _fields(raw.get("Dimensions")), _expr(raw.get("When")), raw.get("Store"),
        raw.get("SeparateByInactiveSeconds"), str(raw["WindowType"]).lower() if raw.get("WindowType") else None, raw.get("WindowValue"), raw.get("Source"),
    )


def _imports(raw: dict) -> tuple[tuple[str, tuple[str, ...]], ...]:
    return tuple((str(i["Module"]), tuple(str(x) for x in i.get("Identifiers") or ())) for i in raw.get("Import") or ())


def stream_spec(spec: str | Path | dict) -> StreamSpec:
    raw = load_raw(spec)
    return StreamSpec(str(raw["Name"]), str(raw["Identity"]), str(raw["Time"]), tuple(map(_aggregate, raw["Aggregates"])), _expr(raw.get("When")), _imports(raw))


def window_spec(spec: str | Path | dict) -> WindowSpec:
    raw = load_raw(spec)
    anchor = raw["Anchor"]
    return WindowSpec(str(raw["Name"]), str(anchor["Condition"]), anchor.get("Max"), tuple(map(_aggregate, raw["Aggregates"])), _expr(raw.get("When")), _imports(raw))
