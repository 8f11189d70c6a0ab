"""Queries over events and orders, one or more per operator of the spec engine, and the SQL they are held against."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.plans.engine import Engine
from strandline.session import shared_dir
from strandline.sources import readers
from strandline.sources import state as store
from strandline.streaming import runs
from strandline.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


def aggregate(kind: str, name: str, fields: list[tuple], dims: list[tuple] = (), **more) -> dict:
    raw = [{"Name": n, "Type": t, "Value": v, **({"When": w[0]} if w else {})} for n, t, v, *w in fields]
    out = {"Type": f"Own:Aggregate:{kind}", "Name": name, "Fields": raw, **({"Store": "kept"} if kind != "Variable" else {}), **more}
    return out | ({"Dimensions": [{"Name": n, "Type": t, "Value": v} for n, t, v in dims]} if dims else {})


def stream(*aggregates: dict, identity: str = "str(source.user_id)", time: str = "source.ts", **more) -> dict:
    return {"Type": "Own:Transform:Streaming", "Version": "2018-03-01", "Name": "own", "Identity": identity, "Time": time, "Stores": [{"Type": "Own:Store:Table", "Name": "kept"}], "Aggregates": list(aggregates), **more}


def window(name: str, kind: str, value: int, fields: list[tuple], source: str = "own.session", **more) -> dict:
    return aggregate("Window", name, fields, WindowType=kind, WindowValue=value, Source=source, **more)


def windows(*aggregates: dict, condition: str = "own.session.events > 0", **anchor) -> dict:
    return {"Type": "Own:Transform:Window", "Version": "2018-03-01", "Name": "near", "Anchor": {"Condition": condition, **anchor}, "Aggregates": list(aggregates)}


def shown(df: DataFrame, **renamed: str) -> DataFrame:
    """Plain column names, times without a zone, decimals rounded for comparison."""
    out = []
    for f in df.schema:
        name = renamed.get(f.name, f.name.replace(".", "_").lstrip("_"))
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        if kind == "timestamp":
            c = c.cast("timestamp_ntz")
        elif kind == "double":
            c = F.round(c, 4)
        out.append(c.alias(name))
    return df.select(*out)


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


def run(spark: SparkSession, folder: str, spec: dict, name: str, **renamed: str) -> DataFrame:
    return shown(Engine(spec).blocks(events(spark, folder), "event_id")[name], identity="user_id", _identity="user_id", **renamed)


U = "CAST(user_id AS VARCHAR) AS user_id"


def counting(name: str) -> tuple:
    return ("events", "integer", f"{name}.events + 1")


PROFILE = stream(aggregate("Identity", "state", [counting("state"), ("total", "float", "state.total + source.value"), ("last_type", "string", "source.event_type"), ("top", "float", "max(source.value, state.top)")]))


@query(f"SELECT {U}, count(*) AS events, round(sum(value), 4) AS total, arg_max(event_type, (ts, event_id)) AS last_type, round(greatest(0.0, max(value)), 4) AS top FROM events GROUP BY user_id")
def identity_profile(spark: SparkSession, folder: str) -> DataFrame:
    return run(spark, folder, PROFILE, "state")


@query(f"SELECT {U}, count(*) FILTER (WHERE value > 50) AS dear, round(coalesce(sum(value) FILTER (WHERE value <= 50), 0), 4) AS cheap FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def identity_when_filter(spark: SparkSession, folder: str) -> DataFrame:
    spec = stream(aggregate("Identity", "state", [("dear", "integer", "state.dear + 1", "source.value > 50"), ("cheap", "float", "state.cheap + source.value", "not source.value > 50")], When="source.event_type == 'purchase'"))
    return run(spark, folder, spec, "state")


@query(f"SELECT {U}, count(*) AS events FROM events WHERE event_type <> 'error' AND value >= 10 GROUP BY user_id")
def transformer_when_filter(spark: SparkSession, folder: str) -> DataFrame:
    return run(spark, folder, stream(aggregate("Identity", "state", [counting("state")]), When="source.event_type != 'error' and source.value >= 10"), "state")


@query(f"SELECT {U}, event_type AS kind, count(*) AS events, round(max(value), 4) AS top FROM events GROUP BY user_id, event_type")
def identity_dims(spark: SparkSession, folder: str) -> DataFrame:
    spec = stream(aggregate("Identity", "state", [counting("state"), ("top", "float", "source.value", "source.value >= state.top")], [("kind", "string", "source.event_type")]))
    return run(spark, folder, spec, "state")


@query(f"""SELECT {U}, strftime(ts, '%Y-%m-%d') AS day, min(ts) AS start_time, max(ts) AS end_time, count(*) AS events,
arg_min(event_type, ts) AS first_type, arg_max(event_type, ts) AS last_type FROM events GROUP BY user_id, day""")
def block_daily(spark: SparkSession, folder: str) -> DataFrame:
    fields = [counting("daily"), ("first_type", "string", "source.event_type", "time == daily._start_time"), ("last_type", "string", "source.event_type", "time == daily._end_time")]
    return run(spark, folder, stream(aggregate("Block", "daily", fields, [("day", "string", "str(time.date())")])), "daily")


@query("""SELECT CAST(o_custkey AS VARCHAR) AS custkey, o_orderpriority AS priority, min(o_orderdate) AS start_time, max(o_orderdate) AS end_time, count(*) AS events,
round(arg_max(o_totalprice, (o_orderdate, o_orderkey)), 4) AS last_price, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_key FROM orders GROUP BY o_custkey, o_orderpriority""")
def block_orders_ties(spark: SparkSession, folder: str) -> DataFrame:
    fields = [counting("kept"), ("last_price", "float", "source.o_totalprice"), ("last_key", "integer", "source.o_orderkey")]
    spec = stream(aggregate("Block", "kept", fields, [("priority", "string", "source.o_orderpriority")]), identity="str(source.o_custkey)", time="source.o_orderdate")
    return shown(Engine(spec).blocks(table(spark, folder, "orders"), "o_orderkey")["kept"], _identity="custkey")


def session_spec(gap_s: int, when: str | None = None) -> dict:
    fields = [counting("session"), ("total", "float", "session.total + source.value"), ("last_type", "string", "source.event_type"), ("kinds", "set", "session.kinds.add(source.event_type)")]
    profile = aggregate("Identity", "state", [counting("state"), ("top", "float", "max(source.value, state.top)")])
    return stream(aggregate("Activity", "session", fields, SeparateByInactiveSeconds=gap_s, **({"When": when} if when else {})), profile)


def sessions_sql(gap_s: int, where: str = "true") -> str:
    return f"""gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL {gap_s} SECOND THEN 0 ELSE 1 END AS opens FROM events WHERE {where}),
parts AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS part FROM gaps),
s AS (SELECT CAST(user_id AS VARCHAR) AS user_id, min(ts) AS st, max(ts) AS et, count(*) AS n, sum(value) AS total, arg_max(event_type, (ts, event_id)) AS last_type,
  string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, string_agg(event_type, ',' ORDER BY ts, event_id) AS types FROM parts GROUP BY user_id, part)"""


def _activity(gap_s: int, when: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def go(spark: SparkSession, folder: str) -> DataFrame:
        return run(spark, folder, session_spec(gap_s, when), "session").withColumn("kinds", F.array_join("kinds", ","))

    return go


_SHOWN = "SELECT user_id, st AS start_time, et AS end_time, n AS events, round(total, 4) AS total, last_type, kinds FROM s"
for _name, _gap in (("activity_30m", 1800), ("activity_6h", 21600), ("activity_1d", 86400)):
    QUERIES[_name], ORACLE[_name] = _activity(_gap), f"WITH {sessions_sql(_gap)} {_SHOWN}"
QUERIES["activity_filtered"] = _activity(21600, "source.event_type != 'view'")
ORACLE["activity_filtered"] = f"WITH {sessions_sql(21600, "event_type <> 'view'")} {_SHOWN}"


@query(f"""WITH v AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS bought FROM events)
SELECT {U}, count(*) FILTER (WHERE bought > 50) AS after_dear, round(coalesce(arg_max(bought, (ts, event_id)), 0), 4) AS last_bought FROM v GROUP BY user_id""")
def variable_sticky(spark: SparkSession, folder: str) -> DataFrame:
    spec = stream(
        aggregate("Variable", "vars", [("bought", "float", "source.value", "source.event_type == 'purchase'")]),
        aggregate("Identity", "state", [("after_dear", "integer", "state.after_dear + 1", "vars.bought > 50"), ("last_bought", "float", "vars.bought")]),
    )
    return run(spark, folder, spec, "state")


@query(f"SELECT {U}, bool_or(event_type = 'purchase' AND value > 95) AS splurged FROM events GROUP BY user_id")
def field_bool_or(spark: SparkSession, folder: str) -> DataFrame:
    return run(spark, folder, stream(aggregate("Identity", "state", [("splurged", "boolean", "state.splurged or (source.event_type == 'purchase' and source.value > 95)")])), "state")


@query(f"SELECT {U}, coalesce(string_agg(event_type, ',' ORDER BY ts, event_id) FILTER (WHERE value > 50), '') AS kinds FROM events GROUP BY user_id")
def field_list_append(spark: SparkSession, folder: str) -> DataFrame:
    spec = stream(aggregate("Identity", "state", [("kinds", "list", "state.kinds.append(source.event_type)", "source.value > 50")]))
    return run(spark, folder, spec, "state").withColumn("kinds", F.array_join("kinds", ","))


@query(f"SELECT {U}, string_agg(replace(event_type, 'i', '|'), '|' ORDER BY ts, event_id) AS pieces FROM events GROUP BY user_id")
def list_extend(spark: SparkSession, folder: str) -> DataFrame:
    spec = stream(aggregate("Identity", "state", [("pieces", "list", "state.pieces.extend(source.event_type.split('i'))")]))
    return run(spark, folder, spec, "state").withColumn("pieces", F.array_join("pieces", "|"))


@query(f"SELECT {U}, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
def field_set_add(spark: SparkSession, folder: str) -> DataFrame:
    spec = stream(aggregate("Identity", "state", [("kinds", "set", "state.kinds.add(source.event_type)")]))
    return run(spark, folder, spec, "state").withColumn("kinds", F.array_join("kinds", ","))


def _pairs(name: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(name)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


@query(f"SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS kinds FROM (SELECT {U}, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def field_map_increment(spark: SparkSession, folder: str) -> DataFrame:
    spec = stream(aggregate("Identity", "state", [("kinds", "map", "state.kinds.increment(source.event_type)")]))
    return run(spark, folder, spec, "state").withColumn("kinds", _pairs("kinds"))


@query(f"SELECT user_id, string_agg(event_type || '=' || e, ',' ORDER BY event_type) AS kinds FROM (SELECT {U}, event_type, arg_max(event_id, (ts, event_id)) AS e FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def field_map_set(spark: SparkSession, folder: str) -> DataFrame:
    spec = stream(aggregate("Identity", "state", [("kinds", "map", "state.kinds.set(source.event_type, source.event_id)")]))
    return run(spark, folder, spec, "state").withColumn("kinds", _pairs("kinds"))


@query(f"""WITH r AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (WHERE event_type = 'error') OVER w AS bad FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT {U}, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS bad,
  round(coalesce(arg_max(bad / n, (ts, event_id)) FILTER (WHERE event_type = 'purchase'), 0), 4) AS share FROM r GROUP BY user_id""")
def derived_asof_ratio(spark: SparkSession, folder: str) -> DataFrame:
    fields = [("n", "integer", "state.n + 1"), ("bad", "integer", "state.bad + 1", "source.event_type == 'error'"), ("share", "float", "state.bad / state.n", "source.event_type == 'purchase'")]
    return run(spark, folder, stream(aggregate("Identity", "state", fields)), "state")


_ORDERED = "o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


@query(f"""WITH RECURSIVE {_ORDERED}, f AS (SELECT user_id, i, value AS x FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.i, 0.5 * f.x + o.value FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT {U}, round(arg_max(x, i), 4) AS x FROM f GROUP BY user_id""")
def fold_ewma(spark: SparkSession, folder: str) -> DataFrame:
    return run(spark, folder, stream(aggregate("Identity", "state", [("x", "float", "0.5 * state.x + source.value")])), "state")


@query(f"""WITH RECURSIVE {_ORDERED}, f AS (SELECT user_id, i, floor(value / 10) AS x FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.i, CASE WHEN f.x = 0 OR floor(o.value / 10) < f.x THEN floor(o.value / 10) ELSE f.x END FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT {U}, round(arg_max(x, i), 4) AS low FROM f GROUP BY user_id""")
def running_min_zero_reset(spark: SparkSession, folder: str) -> DataFrame:
    return run(spark, folder, stream(aggregate("Identity", "state", [("low", "float", "source.value // 10", "state.low == 0 or source.value // 10 < state.low")])), "state")


@query(f"SELECT {U}, least(count(*), 5) AS events FROM events GROUP BY user_id")
def aggregate_when_own_state(spark: SparkSession, folder: str) -> DataFrame:
    return run(spark, folder, stream(aggregate("Identity", "state", [counting("state")], When="state.events < 5")), "state")


@query(f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events)
SELECT {U}, coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (WHERE event_type <> 'view' OR back = 1), '') AS kinds FROM o GROUP BY user_id""")
def set_discard_fold(spark: SparkSession, folder: str) -> DataFrame:
    spec = stream(aggregate("Identity", "state", [("kinds", "set", "state.kinds.discard('view').add(source.event_type)")]))
    return run(spark, folder, spec, "state").withColumn("kinds", F.array_join("kinds", ","))


@query(f"SELECT {U}, event_type AS kind, min(ts) AS start_time, max(ts) AS end_time, CAST(floor(epoch(max(ts) - min(ts)) / 86400) AS BIGINT) AS days, min(ts) AS seen FROM events GROUP BY user_id, event_type")
def days_since_first(spark: SparkSession, folder: str) -> DataFrame:
    fields = [("days", "integer", "(time - kept._start_time).days"), ("seen", "datetime", "time", "time == kept._start_time")]
    return run(spark, folder, stream(aggregate("Block", "kept", fields, [("kind", "string", "source.event_type")])), "kept")


@query("""WITH d AS (SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(ts AS DATE) AS day, min(ts) AS st, count(*) AS n FROM events GROUP BY 1, 2),
l AS (SELECT *, lag(n) OVER w AS a, lag(n, 2) OVER w AS b FROM d WINDOW w AS (PARTITION BY user_id ORDER BY st))
SELECT user_id, st AS start_time, a AS last_events, a + b AS both_events FROM l WHERE b IS NOT NULL""")
def window_block_source(spark: SparkSession, folder: str) -> DataFrame:
    made = stream(aggregate("Block", "daily", [counting("daily")], [("day", "string", "str(time.date())")]))
    spec = windows(window("last", "count", -1, [("events", "integer", "source.events[0]")], source="own.daily"), window("both", "count", -2, [("events", "integer", "sum(source.events)")], source="own.daily"), condition="own.daily.events > 0")
    return near(spark, folder, spec, made)


def per_event(fields: list[tuple]) -> dict:
    return stream(aggregate("Identity", "x", fields, [("event", "integer", "source.event_id")]))


def scalars(spark: SparkSession, folder: str, fields: list[tuple], df: DataFrame | None = None) -> DataFrame:
    out = Engine(per_event(fields)).blocks(events(spark, folder) if df is None else df, "event_id")["x"]
    return shown(out).drop("identity")


@query("""SELECT event_id AS event, CAST(trunc(value) AS BIGINT) AS whole, CAST(event_id AS DOUBLE) AS real, CAST(event_id AS VARCHAR) AS text, value <> 0 AS truth,
0 AS unread, CAST(0 AS BIGINT) AS word, CASE WHEN value > 50 THEN 'True' ELSE 'False' END AS flag FROM events""")
def cast_rules(spark: SparkSession, folder: str) -> DataFrame:
    fields = [("whole", "integer", "source.value"), ("real", "float", "source.event_id"), ("text", "string", "source.event_id"), ("truth", "boolean", "source.value"), ("unread", "integer", "'7.9'"), ("word", "integer", "int(source.event_type)"), ("flag", "string", "source.value > 50")]
    return scalars(spark, folder, fields).withColumn("unread", F.col("unread").cast("int"))


@query("""SELECT event_id AS event, upper(event_type) AS loud, event_type LIKE 'p%' AS p, replace(event_type, 'e', '3') AS swapped, instr(event_type, 'r') - 1 AS spot,
substring(event_type, 1, 3) AS head, event_type[-1:] AS tail, event_type || '-' || CAST(event_id AS VARCHAR) AS joined, contains(event_type, 'ie') AS ie, CAST(length(event_type) AS BIGINT) AS n,
CAST(ascii(event_type) AS BIGINT) AS code, string_split(event_type, 'i')[1] AS before_i FROM events""")
def expr_strings(spark: SparkSession, folder: str) -> DataFrame:
    t = "source.event_type"
    fields = [("loud", "string", f"{t}.upper()"), ("p", "boolean", f"{t}.startswith('p')"), ("swapped", "string", f"{t}.replace('e', '3')"), ("spot", "integer", f"{t}.find('r')"), ("head", "string", f"{t}[0:3]"), ("tail", "string", f"{t}[-1]"), ("joined", "string", f"{t} + '-' + str(source.event_id)"), ("ie", "boolean", f"'ie' in {t}"), ("n", "integer", f"len({t})"), ("code", "integer", f"ord({t}[0])"), ("before_i", "string", f"{t}.split('i')[0]")]
    return scalars(spark, folder, fields)


@query("""SELECT event_id AS event, strftime(ts, '%Y-%m-%d') AS day, CAST(hour(ts) AS BIGINT) AS hour, CAST(isodow(ts) - 1 AS BIGINT) AS weekday,
CAST(floor(epoch(ts - TIMESTAMP '2024-01-10 00:00:00') / 86400) AS BIGINT) AS since, TIMESTAMP '2024-02-03 04:05:06' AS fixed, TIMESTAMP '2024-02-03 02:05:06' AS shifted, CAST(floor(epoch(ts)) AS BIGINT) AS secs FROM events""")
def expr_dates(spark: SparkSession, folder: str) -> DataFrame:
    fields = [("day", "string", "str(time.date())"), ("hour", "integer", "time.hour"), ("weekday", "integer", "time.weekday()"), ("since", "integer", "(time - parse('2024-01-10T00:00:00')).days"), ("fixed", "datetime", "datetime.strptime('2024/02/03 04:05:06', '%Y/%m/%d %H:%M:%S')"), ("shifted", "datetime", "parse('2024-02-03T04:05:06+02:00')"), ("secs", "integer", "int(time.timestamp())")]
    return scalars(spark, folder, fields)


@query("""SELECT event_id AS event, round(value + 1, 4) AS plus, round(value * 2 - 3, 4) AS mixed, round(value / 3, 4) AS ratio, CAST(floor(-event_id / 7.0) AS BIGINT) AS down,
((-event_id % 7) + 7) % 7 AS rest, CAST(abs(3 - event_id) AS BIGINT) AS size, 5 AS kept, round(greatest(value, 50.0), 4) AS most, value > 10 AND value <= 60 AS within FROM events""")
def expr_arith(spark: SparkSession, folder: str) -> DataFrame:
    e, v = "source.event_id", "source.value"
    fields = [("plus", "float", f"{v} + 1"), ("mixed", "float", f"{v} * 2 - 3"), ("ratio", "float", f"{v} / 3"), ("down", "integer", f"-{e} // 7"), ("rest", "integer", f"-{e} % 7"), ("size", "integer", f"abs(3 - {e})"), ("kept", "integer", "1 / 0 if False else 5"), ("most", "float", f"max({v}, 50.0)"), ("within", "boolean", f"10 < {v} <= 60")]
    return scalars(spark, folder, fields).withColumn("kept", F.col("kept").cast("int"))


@query("""SELECT event_id AS event, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) > 50 AS big, '' AS gone FROM events""")
def json_access(spark: SparkSession, folder: str) -> DataFrame:
    df = events(spark, folder).withColumn("props", F.from_json("props", "k bigint"))
    return scalars(spark, folder, [("k", "integer", "source.props.k"), ("big", "boolean", "source['props']['k'] > 50"), ("gone", "string", "source.props.no_such_key")], df)


@query("SELECT event_id AS event, true AS none_is_none, false AS none_is_3, true AS none_is_not_3, 'else' AS branch, false AS failed, 3 AS chosen, '' AS text FROM events")
def missing_attr_nullsafe(spark: SparkSession, folder: str) -> DataFrame:
    m = "source.no_such_attribute"
    fields = [("none_is_none", "boolean", f"{m} is None"), ("none_is_3", "boolean", f"{m} == 3"), ("none_is_not_3", "boolean", f"{m} != 3"), ("branch", "string", f"'then' if {m} else 'else'"), ("failed", "boolean", f"{m} > 1 or True"), ("chosen", "integer", f"{m} or 3"), ("text", "string", m)]
    return scalars(spark, folder, fields).withColumn("chosen", F.col("chosen").cast("int"))


GAP = 21600
_NEAR = f"WITH {sessions_sql(GAP)}, ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY st) AS i FROM s)"


def near(spark: SparkSession, folder: str, spec: dict, stream_spec: dict | None = None, once: bool = False) -> DataFrame:
    made = Engine(stream_spec or session_spec(GAP), spec, once=once).features(events(spark, folder), "event_id")
    return shown(made, _identity="user_id")


def counted(lo: str, hi: str, least: int, cols: str) -> str:
    return f"""{_NEAR} SELECT a.user_id, a.st AS start_time, {cols} FROM ranked a JOIN ranked b ON b.user_id = a.user_id AND b.i BETWEEN {lo} AND {hi} GROUP BY a.user_id, a.st, a.i HAVING count(*) = {least}"""


def timed(span: str, ahead: bool, cols: str) -> str:
    on = f"b.st > a.st AND b.st < a.st + INTERVAL {span}" if ahead else f"b.st < a.st AND b.st > a.st - INTERVAL {span}"
    return f"{_NEAR} SELECT a.user_id, a.st AS start_time, {cols} FROM ranked a JOIN ranked b ON b.user_id = a.user_id AND {on} GROUP BY a.user_id, a.st"


@query(counted("a.i - 1", "a.i - 1", 1, "min(b.n) AS last_events, min(b.last_type) AS last_kind"))
def window_count_prev1(spark: SparkSession, folder: str) -> DataFrame:
    return near(spark, folder, windows(window("last", "count", -1, [("events", "integer", "source.events[0]"), ("kind", "string", "source.last_type[0]")])))


@query(counted("a.i - 3", "a.i - 1", 3, "CAST(sum(b.n) AS BIGINT) AS last_events, round(max(b.total), 4) AS last_top"))
def window_count_prev3(spark: SparkSession, folder: str) -> DataFrame:
    return near(spark, folder, windows(window("last", "count", -3, [("events", "integer", "sum(source.events)"), ("top", "float", "max(source.total)")])))


@query(counted("a.i + 1", "a.i + 1", 1, "min(b.n) AS next_events"))
def window_count_next1(spark: SparkSession, folder: str) -> DataFrame:
    return near(spark, folder, windows(window("next", "count", 1, [("events", "integer", "source.events[0]")])))


@query(timed("7 DAY", False, "CAST(sum(b.n) AS BIGINT) AS week_events, count(*) AS week_sessions, round(min(b.total), 4) AS week_low"))
def window_day_prev7(spark: SparkSession, folder: str) -> DataFrame:
    return near(spark, folder, windows(window("week", "day", -7, [("events", "integer", "sum(source.events)"), ("sessions", "integer", "len(source.events)"), ("low", "float", "min(source.total)")])))


@query(timed("3 DAY", True, "CAST(sum(b.n) AS BIGINT) AS ahead_events"))
def window_day_next3(spark: SparkSession, folder: str) -> DataFrame:
    return near(spark, folder, windows(window("ahead", "day", 3, [("events", "integer", "sum(source.events)")])))


@query(timed("24 HOUR", False, "max(b.n) AS day_most, arg_max(b.last_type, b.st) AS day_kind"))
def window_hour_prev24(spark: SparkSession, folder: str) -> DataFrame:
    return near(spark, folder, windows(window("day", "hour", -24, [("most", "integer", "max(source.events)"), ("kind", "string", "source.last_type[-1]")])))


@query(timed("24 HOUR", True, "min(b.n) AS day_least"))
def window_hour_next24(spark: SparkSession, folder: str) -> DataFrame:
    return near(spark, folder, windows(window("day", "hour", 24, [("least", "integer", "min(source.events)")])))


@query(f"""{_NEAR}, p AS (SELECT a.user_id, a.st, min(b.n) AS e FROM ranked a JOIN ranked b ON b.user_id = a.user_id AND b.i = a.i - 1 GROUP BY a.user_id, a.st),
q AS (SELECT a.user_id, a.st, CAST(sum(b.n) AS BIGINT) AS e FROM ranked a JOIN ranked b ON b.user_id = a.user_id AND b.st > a.st AND b.st < a.st + INTERVAL 2 DAY GROUP BY a.user_id, a.st)
SELECT p.user_id, p.st AS start_time, p.e AS last_events, q.e AS ahead_events FROM p JOIN q ON p.user_id = q.user_id AND p.st = q.st""")
def window_multi_valid(spark: SparkSession, folder: str) -> DataFrame:
    return near(spark, folder, windows(window("last", "count", -1, [("events", "integer", "source.events[0]")]), window("ahead", "day", 2, [("events", "integer", "sum(source.events)")])))


@query(counted("a.i - 7", "a.i - 1", 7, "round(sum(b.total) / 7, 4) AS avg_total, round(sum(b.n) / 7, 4) AS avg_events"))
def window_moving_avg(spark: SparkSession, folder: str) -> DataFrame:
    return near(spark, folder, windows(window("avg", "count", -7, [("total", "float", "sum(source.total) / len(source.total)"), ("events", "float", "sum(source.events) / len(source.events)")])))


@query(counted("a.i - 3", "a.i - 1", 3, "string_agg(b.kinds, ',' ORDER BY b.st) AS last_kinds"))
def window_list_flatten(spark: SparkSession, folder: str) -> DataFrame:
    out = near(spark, folder, windows(window("last", "count", -3, [("kinds", "list", "[k for kinds in source.kinds for k in kinds]")])))
    return out.withColumn("last_kinds", F.array_join("last_kinds", ","))


@query(f"{_NEAR} SELECT a.user_id, a.st AS start_time, b.n AS last_events FROM ranked a JOIN ranked b ON b.user_id = a.user_id AND b.i = a.i - 1 WHERE a.total > 100 AND a.last_type = 'purchase'")
def anchor_condition(spark: SparkSession, folder: str) -> DataFrame:
    return near(spark, folder, windows(window("last", "count", -1, [("events", "integer", "source.events[0]")]), condition="own.session.total > 100 and own.session.last_type == 'purchase'"))


@query(f"{_NEAR} SELECT a.user_id, a.st AS start_time, a.n AS last_own, round(a.total - b.total, 4) AS last_rise FROM ranked a JOIN ranked b ON b.user_id = a.user_id AND b.i = a.i - 1")
def anchor_field(spark: SparkSession, folder: str) -> DataFrame:
    return near(spark, folder, windows(window("last", "count", -1, [("own", "integer", "anchor.events"), ("rise", "float", "anchor.total - source.total[0]")])))


@query(f"""{_NEAR}, v AS (SELECT a.user_id, a.st, b.n AS e, row_number() OVER (PARTITION BY a.user_id, CAST(a.st AS DATE) ORDER BY a.st) AS nth
  FROM ranked a JOIN ranked b ON b.user_id = a.user_id AND b.i = a.i - 1 WHERE a.n > 0)
SELECT user_id, st AS start_time, e AS last_events FROM v WHERE nth <= 1""")
def anchor_max_per_day(spark: SparkSession, folder: str) -> DataFrame:
    return near(spark, folder, windows(window("last", "count", -1, [("events", "integer", "source.events[0]")]), Max=1))


@query(f"""{_NEAR}, p AS (SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS n, max(value) AS top FROM events GROUP BY 1)
SELECT a.user_id, a.st AS start_time, b.n AS last_events, round(p.top, 4) AS last_top FROM ranked a JOIN ranked b ON b.user_id = a.user_id AND b.i = a.i - 1 JOIN p ON p.user_id = a.user_id WHERE p.n > 65""")
def anchor_identity_join(spark: SparkSession, folder: str) -> DataFrame:
    return near(spark, folder, windows(window("last", "count", -1, [("events", "integer", "source.events[0]"), ("top", "float", "own.state.top")]), condition="own.state.events > 65"))


@query(f"{_NEAR} SELECT a.user_id, a.st AS start_time, CASE WHEN a.n > 1 THEN b.n ELSE 0 END AS last_some, '' AS last_none FROM ranked a JOIN ranked b ON b.user_id = a.user_id AND b.i = a.i - 1")
def window_field_when_default(spark: SparkSession, folder: str) -> DataFrame:
    return near(spark, folder, windows(window("last", "count", -1, [("some", "integer", "source.events[0]", "anchor.events > 1"), ("none", "string", "source.last_type[0]", "False")])))


@query(f"""{_NEAR},
l AS (SELECT a.user_id, a.st, min(b.n) AS e FROM ranked a JOIN ranked b ON b.user_id = a.user_id AND b.i = a.i - 1 GROUP BY a.user_id, a.st),
w AS (SELECT a.user_id, a.st, CAST(sum(b.n) AS BIGINT) AS e, round(sum(b.total), 4) AS t FROM ranked a JOIN ranked b ON b.user_id = a.user_id AND b.st < a.st AND b.st > a.st - INTERVAL 7 DAY GROUP BY a.user_id, a.st),
x AS (SELECT a.user_id, a.st, CAST(sum(b.n) AS BIGINT) AS e FROM ranked a JOIN ranked b ON b.user_id = a.user_id AND b.st > a.st AND b.st < a.st + INTERVAL 3 DAY GROUP BY a.user_id, a.st),
p AS (SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS n FROM events GROUP BY 1),
v AS (SELECT a.user_id, a.st, l.e AS last_events, w.e AS week_events, w.t AS week_total, x.e AS ahead_events, a.n AS label_own, p.n AS label_all,
  row_number() OVER (PARTITION BY a.user_id, CAST(a.st AS DATE) ORDER BY a.st) AS nth
  FROM ranked a JOIN l USING (user_id, st) JOIN w USING (user_id, st) JOIN x USING (user_id, st) JOIN p ON p.user_id = a.user_id)
SELECT user_id, st AS start_time, last_events, week_events, week_total, ahead_events, label_own, label_all FROM v WHERE nth <= 2""")
def features_wide(spark: SparkSession, folder: str) -> DataFrame:
    spec = windows(
        window("last", "count", -1, [("events", "integer", "source.events[0]")]),
        window("week", "day", -7, [("events", "integer", "week.events + sum(source.events)"), ("total", "float", "sum(source.total)")]),
        window("ahead", "day", 3, [("events", "integer", "sum(source.events)")]),
        aggregate("Variable", "label", [("own", "integer", "anchor.events"), ("all", "integer", "own.state.events")]),
        Max=2,
    )
    return near(spark, folder, spec, once=True)


_CUT = "2024-01-15 00:00:00"


def two_batches() -> dict:
    vars_ = aggregate("Variable", "vars", [("bought", "float", "source.value", "source.event_type == 'purchase'")])
    fields = [counting("session"), ("total", "float", "session.total + source.value"), ("last_type", "string", "source.event_type"), ("bought", "float", "vars.bought")]
    return stream(vars_, aggregate("Activity", "session", fields, SeparateByInactiveSeconds=GAP))


@query(f"""WITH v AS (SELECT *, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS bought FROM events),
{sessions_sql(GAP).replace('FROM events', 'FROM v')},
b AS (SELECT CAST(user_id AS VARCHAR) AS user_id, min(ts) AS st, arg_max(bought, (ts, event_id)) AS bought FROM parts GROUP BY user_id, part)
SELECT s.user_id, s.st AS start_time, s.et AS end_time, s.n AS events, round(s.total, 4) AS total, s.last_type, round(b.bought, 4) AS bought FROM s JOIN b USING (user_id, st)""")
def state_two_batches(spark: SparkSession, folder: str) -> DataFrame:
    df, engine = events(spark, folder), Engine(two_batches())
    early = F.col("ts") < F.lit(_CUT).cast("timestamp_ntz")
    first = engine.blocks(df.filter(early), "event_id", variables=True)
    return shown(engine.blocks(df.filter(~early), "event_id", first)["session"], _identity="user_id")


@query(f"SELECT coalesce(a.u, b.u) AS user_id, coalesce(a.n, 0) + coalesce(b.n, 0) AS events FROM (SELECT CAST(user_id AS VARCHAR) AS u, count(*) AS n FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '{_CUT}' GROUP BY 1) a FULL OUTER JOIN (SELECT CAST(user_id AS VARCHAR) AS u, count(*) AS n FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '{_CUT}' GROUP BY 1) b ON a.u = b.u")
def state_only_identities(spark: SparkSession, folder: str) -> DataFrame:
    df = events(spark, folder)
    engine = Engine(stream(aggregate("Identity", "state", [counting("state")]), When="source.event_type == 'error'"))
    early = F.col("ts") < F.lit(_CUT).cast("timestamp_ntz")
    first = engine.blocks(df.filter(early), "event_id")
    return shown(engine.blocks(df.filter(~early), "event_id", first)["state"], _identity="user_id")


@query("SELECT 'mac-' || user_id AS source_mac, CAST(6 AS INTEGER) AS protocol, CAST(event_id AS BIGINT) AS timestamp, CAST(user_id AS VARCHAR) AS other_123 FROM events WHERE event_type <> 'error'")
def ipfix_explode(spark: SparkSession, folder: str) -> DataFrame:
    e = events(spark, folder)
    mac = F.when(F.col("event_type") != "error", F.concat(F.lit('{"I": 56, "V": "mac-'), F.col("user_id"), F.lit('"}, '))).otherwise("")
    line = F.concat(F.lit('{"Other": 1, "DataSets": [['), mac, F.lit('{"I": 4, "V": 6}, {"I": 150, "V": '), F.col("event_id"), F.lit('}, {"I": 123, "V": '), F.col("user_id"), F.lit("}]]}"))
    out = readers.ipfix(e.select(line.alias("value")))
    return out.select("source_mac", "protocol", "timestamp", F.try_element_at("other", F.lit("123")).alias("other_123"))


def _streamed(spark: SparkSession, folder: str, make: Callable[[DataFrame], DataFrame], mode: str, what: str) -> DataFrame:
    """A stream over the events file run to its end; append mode writes files, complete mode keeps its last result in files."""
    at = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    source = spark.readStream.schema(events(spark, folder).schema).option("pathGlobFilter", "*.parquet").parquet(_as_folder(folder, "events"))
    made = make(source.filter(F.col("event_id").isNotNull()))
    writer = made.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{at}/log")
    if mode == "append":
        q = writer.format("parquet").option("path", f"{at}/out").start()
    else:
        q = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out")).start()
    q.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{at}/out")


def _as_folder(folder: str, name: str) -> str:
    """A file source reads a folder, or files by pattern."""
    path = Path(folder) / f"{name}.parquet"
    return f"{folder}/{name}.parque[t]" if path.is_file() else str(path)


@query(f"WITH {sessions_sql(GAP)} SELECT user_id, st AS start_time, et AS end_time, n AS events, round(total, 4) AS total FROM s")
def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    out = _streamed(spark, folder, lambda df: runs.sessions(df, F.col("user_id"), F.col("ts"), GAP, F.col("value")), "complete", "stream-sessions")
    return shown(out.select(F.col("identity").alias("user_id"), F.col("start").alias("start_time"), F.col("end").alias("end_time"), F.col("n").alias("events"), "total"))


@query(f"SELECT {U}, count(*) AS events, round(sum(value), 4) AS total, round(max(value), 4) AS most FROM events GROUP BY user_id")
def stream_identity(spark: SparkSession, folder: str) -> DataFrame:
    out = _streamed(spark, folder, lambda df: runs.profiles(df, F.col("user_id"), F.col("value")), "complete", "stream-identity")
    return shown(out.select(F.col("identity").alias("user_id"), F.col("n").alias("events"), "total", "most"))


@query("SELECT CAST(k AS VARCHAR) AS key, count(*) AS events, round(sum(v), 4) AS total FROM (SELECT user_id AS k, value AS v FROM events UNION ALL SELECT o_custkey, o_totalprice FROM orders) GROUP BY k")
def union_inputs(spark: SparkSession, folder: str) -> DataFrame:
    a = events(spark, folder).select(F.col("user_id").alias("k"), F.col("value").alias("v"), F.col("ts").alias("t"))
    b = table(spark, folder, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderdate").alias("t"))
    spec = stream(aggregate("Identity", "state", [counting("state"), ("total", "float", "state.total + source.v")]), identity="str(source.k)", time="source.t")
    return shown(Engine(spec).blocks(a.unionByName(b))["state"], _identity="key")


@query(f"{_NEAR} SELECT user_id, st AS start_time, n AS events FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY st DESC) AS back FROM ranked) WHERE back <= 3")
def topn_last_blocks(spark: SparkSession, folder: str) -> DataFrame:
    made = Engine(session_spec(GAP)).blocks(events(spark, folder), "event_id")["session"]
    return shown(store.nearest(made, -3).select("_identity", "_start_time", "events"), _identity="user_id")


@query("SELECT '[\"' || user_id || '/state//\", {\"_identity\":\"' || user_id || '\",\"events\":' || count(*) || '}]' AS value FROM events GROUP BY user_id")
def sink_block_lines(spark: SparkSession, folder: str) -> DataFrame:
    from strandline import sinks

    engine = Engine(stream(aggregate("Identity", "state", [counting("state")])))
    return sinks.block_lines(engine.blocks(events(spark, folder), "event_id")["state"], engine.stream.aggregate("state"))


# Lines of JSON whose attribute ``won`` holds numbers, text and nothing, between lines that are no objects.
_KEPT_LINE = "event_type NOT IN ('error', 'view')"
_WON = "CASE event_type WHEN 'purchase' THEN CAST(value AS VARCHAR) WHEN 'signup' THEN '\"abc\"' ELSE 'null' END"


def written_lines(spark: SparkSession, folder: str) -> str:
    """The events as a folder of JSON lines, some of them broken."""
    e, path = events(spark, folder), f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    won = F.when(F.col("event_type") == "purchase", F.col("value").cast("string")).when(F.col("event_type") == "signup", '"abc"').otherwise("null")
    line = F.concat(F.lit('{"user": "u'), F.col("user_id"), F.lit('", "no": '), F.col("event_id"), F.lit(', "at": "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('", "won": '), won, F.lit("}"))
    broken = F.when(F.col("event_type") == "error", "{no object").when(F.col("event_type") == "view", "[1, 2]")
    e.select(F.coalesce(broken, line).alias("value")).write.text(path)
    return path


@query(f"""SELECT 'u' || CAST(user_id AS VARCHAR) AS user, count(*) AS n, round(coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0), 4) AS total,
count(*) FILTER (WHERE event_type = 'signup') AS words, count(*) FILTER (WHERE event_type = 'click') AS gone FROM events WHERE {_KEPT_LINE} GROUP BY user_id""")
def json_mixed_types(spark: SparkSession, folder: str) -> DataFrame:
    fields = [("n", "integer", "s.n + 1"), ("total", "float", "s.total + source.won", "source.won is not None and source.won != 'abc'"), ("words", "integer", "s.words + 1", "source.won == 'abc'"), ("gone", "integer", "s.gone + 1", "source.won is None")]
    spec = stream(aggregate("Identity", "s", fields), identity="source.user", time="parse(source.at)")
    df = readers.json_lines(spark, written_lines(spark, folder))
    return shown(Engine(spec, once=True).blocks(df, "_order")["s"], _identity="user")


@query(f"SELECT 'u' || CAST(user_id AS VARCHAR) AS user, event_id AS no, CASE WHEN event_type = 'purchase' THEN value END AS won FROM events WHERE {_KEPT_LINE}")
def json_declared_types(spark: SparkSession, folder: str) -> DataFrame:
    return readers.json_lines(spark, written_lines(spark, folder), "user string, no long, won double").drop("_order")


@query("SELECT count(*) AS lines, CAST(0 AS BIGINT) AS blank, count(*) FILTER (WHERE event_type IN ('error', 'view')) AS no_object FROM events")
def json_rejects(spark: SparkSession, folder: str) -> DataFrame:
    r = readers.json_rejects(spark, written_lines(spark, folder))
    return spark.createDataFrame([tuple(r.values())], "lines long, blank long, no_object long")


@query("SELECT r_name AS key, CAST(r_regionkey + 1 AS BIGINT) AS total FROM region")
def records_source(spark: SparkSession, folder: str) -> DataFrame:
    rows = [r.asDict() for r in table(spark, folder, "region").collect()]
    spec = stream(aggregate("Identity", "s", [("total", "integer", "s.total + source.r_regionkey + 1")]), identity="source.r_name", time="parse('2024-01-01')")
    return shown(Engine(spec).blocks(readers.records(spark, rows, "r_name string, r_regionkey long"), "_order")["s"], _identity="key")


@query("""SELECT event_id AS event, event_type || '-' || CAST(event_id AS VARCHAR) AS joined, event_id * event_id AS square, rpad(event_type, 10, '.') AS padded,
lpad(CAST(event_id % 1000 AS VARCHAR), 5, '0') AS digits, list_contains(string_split(event_type, 'i'), 'v') AS has_v, CAST(len(list_distinct(string_split(event_type, ''))) AS BIGINT) AS letters FROM events""")
def expr_format_power(spark: SparkSession, folder: str) -> DataFrame:
    t = "source.event_type"
    fields = [("joined", "string", f"'{{}}-{{}}'.format({t}, source.event_id)"), ("square", "integer", "source.event_id ** 2"), ("padded", "string", f"{t}.ljust(10, '.')"), ("digits", "string", "f'{source.event_id % 1000:05d}'"), ("has_v", "boolean", f"any(x == 'v' for x in {t}.split('i'))"), ("letters", "integer", f"len({{c for c in {t}}})")]
    return scalars(spark, folder, fields)


@query("""SELECT event_id AS event, date_trunc('second', ts) AS named, date_trunc('second', ts) AS mail, date_trunc('minute', ts) AS american, date_trunc('day', ts) AS day FROM events""")
def expr_dateutil(spark: SparkSession, folder: str) -> DataFrame:
    forms = {"named": "MMM d yyyy HH:mm:ss", "mail": "dd MMM yyyy HH:mm:ss 'GMT'", "american": "M/d/yyyy h:mm a", "day": "d MMMM yyyy"}
    df = events(spark, folder)
    df = df.withColumns({f"as_{k}": F.date_format("ts", v) for k, v in forms.items()}).withColumn("as_mail", F.concat(F.date_format("ts", "EEE"), F.lit(", "), F.col("as_mail")))
    return scalars(spark, folder, [(k, "datetime", f"parse(source.as_{k})") for k in forms], df)


@query("""SELECT event_id AS event, CAST(floor(sqrt(value)) AS BIGINT) AS root, round(ln(value + 1), 4) AS grown, CASE WHEN value >= 50 THEN 50 ELSE CAST(floor(value) AS BIGINT) END AS capped,
regexp_replace(event_type, '[aeiou]', '', 'g') AS bare FROM events""")
def spec_imports(spark: SparkSession, folder: str) -> DataFrame:
    fields = [("root", "integer", "math.floor(math.sqrt(source.value))"), ("grown", "float", "grow(source.value)"), ("capped", "integer", "capped(source.value)"), ("bare", "string", "sub('[aeiou]', '', source.event_type)")]
    spec = per_event(fields) | {"Import": [{"Module": "math"}, {"Module": "math", "Identifiers": ["log1p as grow"]}, {"Module": "re", "Identifiers": ["sub"]}, {"Module": "our.own", "Identifiers": ["capped"]}]}
    engine = Engine(spec, python_functions={"capped": lambda v: min(50, int(v))})
    return shown(engine.blocks(events(spark, folder), "event_id")["x"]).drop("identity")


@query("SELECT unnest(['x.ratio', 'x.whole', 'x.kept']) AS field, unnest([count(*) FILTER (WHERE event_type = 'error'), count(*) FILTER (WHERE event_type <> 'error' AND event_type <> 'view'), 0]) AS n FROM events")
def expr_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Values that could not be computed, by field; an event that does not meet a field's condition does not count."""
    fields = [("ratio", "float", "1 / (source.event_type != 'error')"), ("whole", "integer", "int(source.event_type)", "source.event_type != 'error' and source.event_type != 'view'"), ("kept", "integer", "x.kept + 1")]
    failed = Engine(stream(aggregate("Identity", "x", fields))).failures(events(spark, folder), "event_id")
    return spark.createDataFrame(list(failed.items()), "field string, n long")


@query(f"""{_NEAR}, v AS (SELECT a.user_id, a.st, sum(b.n) AS e, max(b.n) AS most, string_agg(CAST(b.n AS VARCHAR), '/' ORDER BY b.st) AS text FROM ranked a JOIN ranked b ON b.user_id = a.user_id AND b.i BETWEEN a.i - 3 AND a.i - 1 GROUP BY a.user_id, a.st, a.i HAVING count(*) = 3)
SELECT user_id, st AS start_time, round(e / 3, 2) AS last_mean, most > 2 AS last_some, text AS last_text FROM v""")
def window_python(spark: SparkSession, folder: str) -> DataFrame:
    fields = [("mean", "float", "round(sum(source.events) / 3, 2)"), ("some", "boolean", "any(e > 2 for e in source.events)"), ("text", "string", "'{}/{}/{}'.format(source.events[0], source.events[1], source.events[2])")]
    return near(spark, folder, windows(window("last", "count", -3, fields)))


@query(f"{_NEAR}, p AS (SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS n FROM events GROUP BY 1) SELECT a.user_id, a.st AS start_time, b.n AS last_events FROM ranked a JOIN ranked b ON b.user_id = a.user_id AND b.i = a.i - 1 JOIN p ON p.user_id = a.user_id WHERE p.n > 65 AND a.n > 0")
def window_spec_when(spark: SparkSession, folder: str) -> DataFrame:
    """A condition of the whole window spec leaves anchors out."""
    return near(spark, folder, windows(window("last", "count", -1, [("events", "integer", "source.events[0]")])) | {"When": "own.state.events > 65"})


def _featured(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    spec = windows(window("week", "day", -7, [("events", "integer", "sum(source.events)")]), window("last", "count", -1, [("kind", "string", "source.last_type[0]")]))
    engine = Engine(session_spec(GAP), spec)
    made = engine.blocks(events(spark, folder), "event_id")
    return engine.windowed(made), made


_FEATURED = f"""{_NEAR}, f AS (SELECT a.user_id, a.st, min(l.last_type) AS kind, CAST(sum(b.n) AS BIGINT) AS e FROM ranked a JOIN ranked l ON l.user_id = a.user_id AND l.i = a.i - 1
  JOIN ranked b ON b.user_id = a.user_id AND b.st < a.st AND b.st > a.st - INTERVAL 7 DAY GROUP BY a.user_id, a.st)"""


@query(f"""{_FEATURED} SELECT user_id AS "last._identity", kind AS "last.kind", user_id AS "week._identity", CAST(e AS VARCHAR) AS "week.events" FROM f""")
def sink_features_csv(spark: SparkSession, folder: str) -> DataFrame:
    from strandline import sinks

    path = f"{shared_dir(spark)}/features-{uuid.uuid4().hex}"
    sinks.write_features(_featured(spark, folder)[0], path)
    return spark.read.option("header", True).csv(path)


@query(f"""{_FEATURED}, r AS (SELECT user_id, string_agg('{{"last._identity":"' || user_id || '","last.kind":"' || kind || '","week._identity":"' || user_id || '","week.events":' || e || '}}', ', ' ORDER BY st) AS rows FROM f GROUP BY user_id)
SELECT '["' || i.u || '", [' || coalesce(r.rows, '') || ']]' AS value FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS u FROM events) i LEFT JOIN r ON r.user_id = i.u""")
def sink_feature_lines(spark: SparkSession, folder: str) -> DataFrame:
    from strandline import sinks

    features, made = _featured(spark, folder)
    return sinks.feature_lines(features, made["session"])


def _iso_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({c}) % 1000000 = 0 THEN '' ELSE strftime({c}, '.%f') END || '+00:00'"


@query(f"""WITH {sessions_sql(GAP)} SELECT '["' || user_id || '/session//' || {_iso_sql('st')} || '", {{"_identity":"' || user_id || '","_start_time":"' || {_iso_sql('st')} || '","_end_time":"' || {_iso_sql('et')} || '","events":' || n || '}}]' AS value FROM s""")
def sink_block_lines_activity(spark: SparkSession, folder: str) -> DataFrame:
    from strandline import sinks

    engine = Engine(stream(aggregate("Activity", "session", [counting("session")], SeparateByInactiveSeconds=GAP)))
    return sinks.block_lines(engine.blocks(events(spark, folder), "event_id")["session"], engine.stream.aggregate("session"))


@query("""SELECT '["' || user_id || '/daily/' || event_type || '/", {"_identity":"' || user_id || '","_start_time":"' || ISO_MIN || '","_end_time":"' || ISO_MAX || '","events":' || count(*) || ',"kind":"' || event_type || '"}]' AS value FROM events GROUP BY user_id, event_type""".replace("ISO_MIN", _iso_sql("min(ts)")).replace("ISO_MAX", _iso_sql("max(ts)")))
def sink_block_lines_dims(spark: SparkSession, folder: str) -> DataFrame:
    from strandline import sinks

    engine = Engine(stream(aggregate("Block", "daily", [counting("daily")], [("kind", "string", "source.event_type")])))
    return sinks.block_lines(engine.blocks(events(spark, folder), "event_id")["daily"], engine.stream.aggregate("daily"))


@query(ORACLE["state_two_batches"])
def store_replaced(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs on one store, the second replacing what the first one saved."""
    df, engine = events(spark, folder), Engine(two_batches())
    early = F.col("ts") < F.lit(_CUT).cast("timestamp_ntz")
    kept = store.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    kept.save(engine.blocks(df.filter(early), "event_id", kept.load(), variables=True))
    kept.save(engine.blocks(df.filter(~early), "event_id", kept.load(), variables=True))
    kept.finalize()
    return shown(kept.load()["session"], _identity="user_id")


@query("SELECT event_type AS kind, count(DISTINCT user_id) AS users, count(*) AS events FROM events GROUP BY event_type")
def store_memory_views(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks held by the session, asked for in SQL."""
    kept = store.MemoryStore(spark, "held")
    kept.save(Engine(stream(aggregate("Identity", "state", [counting("state")], [("kind", "string", "source.event_type")]))).blocks(events(spark, folder), "event_id"))
    return spark.sql("SELECT kind, count(*) AS users, sum(events) AS events FROM held_state GROUP BY kind")


@query("SELECT CAST(user_id AS VARCHAR) AS user_id, event_type AS kind, count(*) AS events FROM events WHERE user_id = 7 AND event_type = 'click' GROUP BY user_id, event_type")
def store_point_get(spark: SparkSession, folder: str) -> DataFrame:
    made = Engine(stream(aggregate("Identity", "state", [counting("state")], [("kind", "string", "source.event_type")]))).blocks(events(spark, folder), "event_id")["state"]
    kept = store.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    kept.save({"state": made})
    return shown(store.get(kept.load()["state"], "7", kind="click"), _identity="user_id")


@query(f"WITH {sessions_sql(GAP)} SELECT user_id, st AS start_time, n AS events FROM s WHERE user_id = '7' AND st > TIMESTAMP '2024-01-05 00:00:00' AND st < TIMESTAMP '2024-01-20 00:00:00'")
def store_between(spark: SparkSession, folder: str) -> DataFrame:
    made = Engine(session_spec(GAP)).blocks(events(spark, folder), "event_id")["session"]
    at = lambda day: F.lit(f"2024-01-{day} 00:00:00+00:00").cast("timestamp")
    return shown(store.between(made, "7", at("05"), at("20")).select("_identity", "_start_time", "events"), _identity="user_id")


@query("SELECT CAST(user_id AS VARCHAR) AS partition_key, 'state/' || event_type || '/' AS range_key, count(*) AS events FROM events GROUP BY user_id, event_type")
def store_items_written(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks put into a key-value table whose client here keeps its items in files of the shared folder."""
    from strandline import sinks

    engine = Engine(stream(aggregate("Identity", "state", [counting("state")], [("kind", "string", "source.event_type")])))
    made, agg = engine.blocks(events(spark, folder), "event_id")["state"], engine.stream.aggregate("state")
    path = f"{shared_dir(spark)}/items-{uuid.uuid4().hex}"
    store.write_items(made, sinks.block_key(agg), lambda: FileClient(path))
    items = spark.read.json(path).dropDuplicates(["partition_key", "range_key"])
    return items.select("partition_key", "range_key", "events")


class FileClient:
    """A key-value client for tests: items as JSON lines in a folder."""

    def __init__(self, path: str):
        self.folder = Path(path.removeprefix("file://"))
        self.folder.mkdir(parents=True, exist_ok=True)
        self.name = uuid.uuid4().hex

    def put_items(self, items: list[dict]) -> None:
        with (self.folder / f"{self.name}.json").open("a", encoding="utf-8") as f:
            f.writelines(json.dumps(x) + "\n" for x in items)


_FAULTS = [
    ("own.s", "Fields", "required"), ("own.s._x", "Name", "identifier"), ("own.s.y", "Type", "type"), ("own.s.z", "Value", "expression"), ("own", "Version", "value"), ("own.t", "SeparateByInactiveSeconds", "number"), ("own.s.w", "Value", "empty"),
    ("own.kept", "Table", "required"), ("own.u", "Type", "type"), ("own.s.d", "Type", "value"), ("near.anchor", "Max", "number"), ("near.anchor", "Max", "empty"), ("near.w", "WindowValue", "empty"), ("near.w", "WindowType", "value"),
]


@query("SELECT * FROM (VALUES " + ", ".join(str(x) for x in _FAULTS) + ") AS t(place, attribute, kind)")
def spec_problems(spark: SparkSession, folder: str) -> DataFrame:
    """What validation finds in specs with one fault of each kind."""
    from strandline.plans.validate import problems

    fields = [("_x", "integer", "1"), ("y", "decimal", "1"), ("z", "integer", "1 +"), ("w", "integer", "")]
    bad = stream(
        aggregate("Identity", "s", fields, [("d", "float", "source.d")]), aggregate("Identity", "s", []) | {"Fields": [{"Name": "a", "Type": "integer", "Value": "1"}]}, aggregate("Activity", "t", [("n", "integer", "t.n + 1")], SeparateByInactiveSeconds="many"), aggregate("Window", "u", [("n", "integer", "1")], WindowType="day", WindowValue=1, Source="own.s"),
    ) | {"Version": "2000-01-01", "Stores": [{"Type": "Own:Store:Dynamo", "Name": "kept"}]}
    del bad["Aggregates"][1]["Fields"]
    off = windows(window("w", "month", 0, [("n", "integer", "1")]), Max=0)
    found = {(p.where, p.attribute, p.kind) for p in [*problems(bad), *problems(off)]}
    return spark.createDataFrame(sorted(found), "place string, attribute string, kind string")


@query(f"""WITH {sessions_sql(GAP)} SELECT user_id, st AS start_time, et AS end_time, n AS events, round(total, 4) AS total FROM s
WHERE et + INTERVAL {GAP} SECOND <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def stream_sessions_append(spark: SparkSession, folder: str) -> DataFrame:
    """Append mode behind a watermark of a day: the sessions that are closed for good when the input ends."""
    out = _streamed(spark, folder, lambda df: runs.sessions(df, F.col("user_id"), F.col("ts"), GAP, F.col("value"), "1 day"), "append", "closed-sessions")
    return shown(out.select(F.col("identity").alias("user_id"), F.col("start").alias("start_time"), F.col("end").alias("end_time"), F.col("n").alias("events"), "total"))


@query(ORACLE["state_two_batches"])
def stream_carried_spec(spark: SparkSession, folder: str) -> DataFrame:
    """A spec over two micro-batches, each onto the state that the one before left in its buckets."""
    df, engine, at = events(spark, folder), Engine(two_batches()), f"{shared_dir(spark)}/carried-{uuid.uuid4().hex}"
    early = F.col("ts") < F.lit(_CUT).cast("timestamp_ntz")
    step = runs.carried_spec(engine, at, "event_id", buckets=8)
    step(df.filter(early), 0)
    step(df.filter(~early), 1)
    return shown(runs.blocks_at(spark, engine, at, 1)["session"].drop("_bucket"), _identity="user_id")


@query(f"SELECT {U}, count(*) AS events, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id")
def stream_online(spark: SparkSession, folder: str) -> DataFrame:
    """Events one by one on a stream, a state per entity."""
    from strandline.streaming import stateful

    engine = Engine(stream(aggregate("Identity", "state", [counting("state"), ("last_type", "string", "source.event_type")])))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, stateful.PROVIDER)
    try:
        out = _streamed(spark, folder, lambda df: stateful.evaluate(df.select("event_id", "user_id", "ts", "event_type"), engine, "event_id"), "update", "online")
    finally:
        spark.conf.set(key, before)
    return out.select(F.col("identity").alias("user_id"), F.from_json("snapshot", "events long, last_type string").alias("s")).select("user_id", "s.events", "s.last_type")
