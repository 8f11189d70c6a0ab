"""Checks of a spec as written. All errors are collected and reported together."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass
from typing import Any

from strandline.plans.spec import AGGREGATES, FIELD_TYPES, STORES, VERSION, tag


@dataclass(frozen=True)
class Problem:
    """``kind``: required, empty, identifier, number, value, expression, type, import, yaml."""

    where: str
    attribute: str
    kind: str
    detail: str = ""

    def __str__(self) -> str:
        return f"`{self.attribute}` under `{self.where}`: {self.kind}{': ' + self.detail if self.detail else ''}"


class SpecError(ValueError):
    def __init__(self, problems: list[Problem]):
        self.problems = list(dict.fromkeys(problems))
        super().__init__("\n".join(map(str, self.problems)))


_NEEDED = {
    "transform:streaming": ("Identity", "Time", "Stores", "Version", "Aggregates"),
    "transform:window": ("Anchor", "Version", "Aggregates"),
    "identity": ("Store", "Fields"),
    "block": ("Store", "Dimensions", "Fields"),
    "activity": ("Store", "SeparateByInactiveSeconds", "Fields"),
    "variable": ("Fields",),
    "window": ("WindowType", "WindowValue", "Source", "Fields"),
}


class _Checks:
    def __init__(self):
        self.found: list[Problem] = []

    def add(self, where: str, attribute: str, kind: str, detail: str = "") -> None:
        self.found.append(Problem(where, attribute, kind, detail))

    def present(self, where: str, item: dict, attributes: tuple[str, ...]) -> None:
        for a in attributes:
            if a not in item:
                self.add(where, a, "required")
        for a, v in item.items():
            if not v and a in (*attributes, "Name", "Type", "Value", "When", "Max"):
                self.add(where, a, "empty")

    def name(self, where: str, item: dict) -> None:
        n = item.get("Name")
        if not n:
            return
        if not isinstance(n, str) or not n.isidentifier():
            self.add(where, "Name", "identifier", "not a valid identifier")
        elif n.startswith("_"):
            self.add(where, "Name", "identifier", "starts with an underscore")
        elif n.startswith("run_"):
            self.add(where, "Name", "identifier", "starts with run_")

    def number(self, where: str, item: dict, attribute: str, least: int | None) -> None:
        if attribute not in item:
            return
        v = item[attribute]
        if isinstance(v, bool) or not isinstance(v, int) or (least is not None and v < least):
            self.add(where, attribute, "number", f"an integer{'' if least is None else f' of at least {least}'}")

    def one_of(self, where: str, item: dict, attribute: str, values: tuple[str, ...]) -> None:
        if attribute in item and item[attribute] not in values:
            self.add(where, attribute, "value", f"one of {', '.join(values)}")

    def expression(self, where: str, item: dict, attribute: str) -> None:
        v = item.get(attribute)
        if v is None or v == "":
            return
        try:
            ast.parse(str(v).strip(), mode="eval")
        except SyntaxError:
            self.add(where, attribute, "expression", "does not parse")

    def fields(self, where: str, raw: Any, dimension: bool = False) -> None:
        for f in raw or ():
            at = f"{where}.{f.get('Name', '?')}"
            self.present(at, f, ("Name", "Type", "Value"))
            self.name(at, f)
            if dimension:
                self.one_of(at, f, "Type", ("integer", "string"))
            elif "Type" in f and str(f["Type"]).lower() not in FIELD_TYPES:
                self.add(at, "Type", "type", "not defined")
            self.expression(at, f, "Value")
            self.expression(at, f, "When")

    def aggregate(self, where: str, a: dict, allowed: tuple[str, ...]) -> None:
        at = f"{where}.{a.get('Name', '?')}"
        kind = tag(a.get("Type")).rpartition(":")[2]
        self.present(at, a, ("Name", "Type"))
        self.name(at, a)
        if "Type" in a and kind not in allowed:
            self.add(at, "Type", "type", "not defined" if kind not in AGGREGATES else "not allowed here")
        if kind in _NEEDED:
            self.present(at, a, _NEEDED[kind])
        self.number(at, a, "SeparateByInactiveSeconds", 1)
        self.number(at, a, "WindowValue", None)
        if "WindowType" in a and str(a["WindowType"]).lower() not in ("day", "hour", "count"):
            self.add(at, "WindowType", "value", "one of day, hour, count")
        self.expression(at, a, "When")
        self.fields(at, a.get("Fields"))
        self.fields(at, a.get("Dimensions"), dimension=True)


def problems(raw: dict) -> list[Problem]:
    """Everything that is wrong with a spec; an empty list for a valid one."""
    c = _Checks()
    name = str(raw.get("Name", "?"))
    kind = tag(raw.get("Type"))
    c.present(name, raw, ("Name", "Type"))
    if kind not in ("transform:streaming", "transform:window"):
        c.add(name, "Type", "type", "not defined")
        return list(dict.fromkeys(c.found))
    c.present(name, raw, _NEEDED[kind])
    c.name(name, raw)
    c.one_of(name, {k: str(v) for k, v in raw.items() if k == "Version"}, "Version", (VERSION,))
    for x in ("Identity", "Time", "When"):
        c.expression(name, raw, x)
    for i in raw.get("Import") or ():
        if not isinstance(i, dict) or not re.fullmatch(r"[A-Za-z_][\w.]*", str(i.get("Module", ""))):
            c.add(name, "Import", "import", "a module name is required")
    for s in raw.get("Stores") or ():
        at = f"{name}.{s.get('Name', '?')}"
        c.present(at, s, ("Name", "Type"))
        store = tag(s.get("Type")).rpartition(":")[2]
        if store not in STORES:
            c.add(at, "Type", "type", "not defined")
        if store == "dynamo":
            c.present(at, s, ("Table",))
    anchor = raw.get("Anchor")
    if kind == "transform:window" and isinstance(anchor, dict):
        at = f"{name}.anchor"
        c.present(at, anchor, ("Condition",))
        c.expression(at, anchor, "Condition")
        c.number(at, anchor, "Max", 1)
    allowed = ("identity", "block", "activity", "variable") if kind == "transform:streaming" else ("window", "variable")
    for a in raw.get("Aggregates") or ():
        c.aggregate(name, a, allowed)
    return list(dict.fromkeys(c.found))


def validate(raw: dict) -> None:
    """Raises a SpecError with all problems."""
    if found := problems(raw):
        raise SpecError(found)
