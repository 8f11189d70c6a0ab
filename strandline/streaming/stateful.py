"""A spec evaluated event by event on a stream, one state per entity, by transformWithStateInPandas.

Needs the RocksDB state store provider. Events of one entity within a micro-batch are taken in order of time; across
batches the order of arrival counts, as for any online evaluation.
"""

from __future__ import annotations

import datetime as dt
import json
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from strandline.plans.engine import Engine
from strandline.plans.online import Online

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "identity string, aggregate string, snapshot string"


class _Processor(StatefulProcessor):
    def __init__(self, spec, functions: dict | None):
        self.spec, self.functions = spec, functions

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("online", "pickled binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        online = Online(self.spec, key[0], self.functions)
        if self.kept.exists():
            online.live, online.stored = pickle.loads(self.kept.get()[0])
        for r in sorted((r for b in rows for r in b.to_dict("records")), key=lambda r: (r["at__"], r["seq__"])):
            online.evaluate({k: _plain(v) for k, v in r.items() if not k.endswith("__")})
        self.kept.update((pickle.dumps((online.live, online.stored)),))
        out = [(key[0], name, json.dumps(b, default=str)) for name, blocks in online.blocks().items() for b in blocks]
        yield pd.DataFrame(out, columns=["identity", "aggregate", "snapshot"])

    def close(self) -> None:
        pass


def _plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, pd.Timestamp):
        t = v.to_pydatetime()
        return t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)
    return v.tolist() if hasattr(v, "tolist") else v


def evaluate(events: DataFrame, engine: Engine, seq: str, functions: dict | None = None) -> DataFrame:
    """All blocks of every entity that had events in the batch: (identity, aggregate, snapshot as JSON). Update mode."""
    from strandline.plans.expr import Compiler, coerce, column_value, none_value, to_str, truthy

    columns = {f.name: column_value(F.col(f"`{f.name}`"), f.dataType) for f in events.schema}
    compiler = Compiler({}, lambda base, name: columns.get(name, none_value()) if base == "source" else None, engine.functions)
    who, when = compiler.compile(engine.stream.identity), compiler.compile(engine.stream.time)
    kept = [F.col(f"`{c}`").alias(c) for c in events.columns if not c.endswith("__")]
    keyed = events.select(*kept, F.when(truthy(who), to_str(who)).alias("id__"), coerce(when, "datetime").alias("at__"), F.col(f"`{seq}`").cast("long").alias("seq__"))
    rows = keyed.filter("id__ is not null and at__ is not null")
    return rows.groupBy("id__").transformWithStateInPandas(_Processor(engine.stream, functions), OUTPUT, "Update", "None")
