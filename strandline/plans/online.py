"""One entity's spec evaluated event by event in plain Python, for serving and as the yardstick of the compiled plans."""

from __future__ import annotations

import ast
import copy
import datetime as dt
from typing import Any

from strandline.plans import interpret
from strandline.plans.spec import Aggregate, StreamSpec, stream_spec


class Online:
    """Feed records in order of time with ``evaluate``; read ``blocks``, or a live field as ``online["aggregate"]["field"]``."""

    def __init__(self, spec: StreamSpec | dict | str, identity: str, functions: dict[str, Any] | None = None):
        self.spec = spec if isinstance(spec, StreamSpec) else stream_spec(spec)
        self.identity = identity
        self.machine = interpret.Interpreter(functions)
        self.live = {a.name: self._fresh(a) for a in self.spec.aggregates}
        self.stored: dict[str, dict[tuple, interpret.State]] = {a.name: {} for a in self.spec.aggregates}
        self.trees: dict[str, ast.AST] = {}

    def __getitem__(self, aggregate: str) -> interpret.State:
        return self.live[aggregate]

    def _fresh(self, a: Aggregate) -> interpret.State:
        s = interpret.State({f.name: copy.copy(interpret.default(f.type)) for f in a.fields})
        return interpret.State(s | {"_identity": self.identity, "_start_time": None, "_end_time": None} | {d.name: None for d in a.dimensions})

    def _value(self, text: str, env: dict[str, Any]) -> Any:
        if text not in self.trees:
            self.trees[text] = ast.parse(text, mode="eval").body
        return self.machine.run(self.trees[text], env)

    def _true(self, text: str | None, env: dict[str, Any]) -> bool:
        if text is None:
            return True
        v = self._value(text, env)
        return v is not interpret.FAILED and bool(v)

    def evaluate(self, record: dict[str, Any]) -> bool:
        """Takes one record in; False if it has another identity, no time, or fails the spec's condition."""
        env: dict[str, Any] = {"source": interpret.Record(record)}
        who, time = self._value(self.spec.identity, env), self._value(self.spec.time, env)
        if who is interpret.FAILED or str(who) != self.identity or not isinstance(time, dt.datetime):
            return False
        time = time if time.tzinfo else time.replace(tzinfo=dt.timezone.utc)
        env |= {"time": time, "identity": self.identity, **self.live}
        if not self._true(self.spec.when, env):
            return False
        for a in self.spec.aggregates:
            self._aggregate(a, env, time)
        return True

    def _aggregate(self, a: Aggregate, env: dict[str, Any], time: dt.datetime) -> None:
        dims = []
        for d in a.dimensions:
            v = interpret.fits(self._value(d.value, env), d.type)
            if v is interpret.FAILED:
                return
            dims.append(v)
        if not self._true(a.when, env):
            return
        state = self.live[a.name]
        if a.kind in ("identity", "block"):
            state = self.stored[a.name].setdefault(tuple(dims), self._fresh(a))
            state |= {d.name: v for d, v in zip(a.dimensions, dims)}
        elif a.kind == "activity":
            gap = dt.timedelta(seconds=a.gap_s)
            if state["_start_time"] is None or time < state["_start_time"] - gap or time > state["_end_time"] + gap:
                state = self._fresh(a)
                self.stored[a.name][(time, len(self.stored[a.name]))] = state
        self.live[a.name] = env[a.name] = state
        state["_start_time"] = min(filter(None, (state["_start_time"], time)))
        state["_end_time"] = max(filter(None, (state["_end_time"], time)))
        for f in a.fields:
            if self._true(f.when, env):
                v = interpret.fits(self._value(f.value, env), f.type)
                if v is not interpret.FAILED:
                    state[f.name] = v

    def blocks(self) -> dict[str, list[dict[str, Any]]]:
        """All stored blocks by aggregate; sets come sorted, times only for keyed blocks and sessions."""
        out = {}
        for a in self.spec.aggregates:
            if a.kind == "variable":
                continue
            hide = set() if a.kind in ("block", "activity") else {"_start_time", "_end_time"}
            out[a.name] = [{k: sorted(v) if isinstance(v, set) else v for k, v in s.items() if k not in hide} for s in self.stored[a.name].values()]
        return out
