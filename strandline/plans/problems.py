"""Queries over key_log and store_items for the data-pipeline operators, and the SQL they are held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.instants import day_string, iso_instant, joined_dims, micros, nonblank
from strandline.operators import features, late, rolling, sessions, skew
from strandline.session import materialize, shared_dir
from strandline.streaming import runs
from strandline.tables import table

GAP_S = 1800
_SECOND_BATCH = "2018-04-05 00:00:00+00:00"


def log_instant() -> Column:
    """Microseconds of a key_log row: key_timestamp, or when that is null _start_time; null if the row has neither."""
    return micros(F.coalesce(F.col("key_timestamp"), iso_instant("_start_time")))


def item_instant() -> Column:
    """Microseconds of a store_items row: _start_time, or when that is null the last piece of range_key."""
    start = F.col("_start_time")
    return micros(F.when(start.isNotNull(), iso_instant(start)).otherwise(iso_instant(F.substring_index("range_key", "/", -1))))


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _seconds(us: str) -> Column:
    return F.floor(F.col(us) / 1_000_000).cast("long")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    out = sessions.sessionize(table(spark, folder, "store_items"), F.col("partition_key"), item_instant(), gap_s=GAP_S)
    return out.select(F.col("key").alias("partition_key"), _seconds("start_us").alias("start_s"), _seconds("end_us").alias("end_s"))


def p1_sessions(spark: SparkSession, folder: str) -> DataFrame:
    items = sessions.put_items(table(spark, folder, "store_items"))
    out = sessions.sessionize(items, F.col("partition_key"), F.col("instant_us"), F.col("events"), GAP_S)
    start, end = _seconds("start_us"), _seconds("end_us")
    return out.select(F.col("key").alias("partition_key"), start.alias("start_s"), end.alias("end_s"), (end - start).alias("duration_s"), "n_items", "n_events")


def _long(log: DataFrame, kinds: list[tuple[int, str]], with_dims: bool) -> DataFrame:
    by = {"key_identity": F.col("key_identity")} | ({"dims": joined_dims("key_dimensions")} if with_dims else {})
    return features.kind_cells(log, by, F.col("key_group"), F.col("event_uid"), F.col("event_value"), log_instant(), kinds)


def _dated(spark: SparkSession, folder: str) -> tuple[DataFrame, list[tuple[int, str]], int | None]:
    """The long table of the log, the kinds, and the log's last instant, all from one scan: it is noted while the table is written."""
    kinds = features.kind_list(table(spark, folder, "event_kinds"))
    seen = Observation()
    log = table(spark, folder, "key_log").observe(seen, F.max(log_instant()).alias("last"), F.count(F.lit(1)).alias("n"))
    long = materialize(_long(log, kinds, with_dims=False), "kind-cells")
    return long, kinds, seen.get["last"]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    kinds = features.kind_list(table(spark, folder, "event_kinds"))
    pivoted = features.pivot_cells(_long(table(spark, folder, "key_log"), kinds, with_dims=True), ["key_identity", "dims"], kinds)
    return features.filled_cells(pivoted, ["key_identity", "dims"]).select("key_identity", "kind_no", "dims")


def p2_cells(spark: SparkSession, folder: str) -> DataFrame:
    long, kinds, as_of = _dated(spark, folder)
    cells = features.filled_cells(features.pivot_cells(long, ["key_identity"], kinds, as_of), ["key_identity"])
    return cells.select("key_identity", "kind_no", "n", F.round("recency_s", 3).alias("recency_s"), F.round("total", 4).alias("total"))


def p2_feature_table(spark: SparkSession, folder: str) -> DataFrame:
    long, kinds, as_of = _dated(spark, folder)
    return features.feature_table(long.withColumn("total", F.round("total", 4)), "key_identity", kinds, as_of)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    log, items = table(spark, folder, "key_log"), table(spark, folder, "store_items")
    a = skew.hot_keys(log, F.col("key_identity"), _tasks(spark)).select(F.lit("key_log").alias("table_name"), F.col("k").alias("hot_key"))
    b = skew.hot_keys(items, F.col("partition_key"), _tasks(spark)).select(F.lit("store_items").alias("table_name"), F.col("k").alias("hot_key"))
    return a.unionByName(b)


def p3_per_key(spark: SparkSession, folder: str) -> DataFrame:
    """Per identity: all its records beside its latest state, joined by fragment and replicate."""
    log = table(spark, folder, "key_log").select(F.col("key_identity").alias("k"), F.col("event_value").alias("v"), log_instant().alias("us")).filter(nonblank("k"))
    states = table(spark, folder, "identity_state")
    newest = F.row_number().over(Window.partitionBy("_identity").orderBy(F.desc_nulls_last("updated_at"), F.desc("state_id")))
    latest = states.withColumn("rank", newest).filter("rank = 1").select(F.col("_identity").alias("k"), "country", "max_level_completed")
    plan = skew.plan_for(log, F.col("k"), _tasks(spark))
    joined = skew.balanced_join(log, latest, "k", plan)
    per_key = joined.groupBy("k", "country", "max_level_completed").agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"), F.max("us").alias("last_us"))
    return per_key.select(F.col("k").alias("key_identity"), "country", "max_level_completed", "n_rows", F.round("total", 4).alias("total"), _seconds("last_us").alias("last_s"))


def _totals(spark: SparkSession, folder: str) -> DataFrame:
    return rolling.rolling_totals(table(spark, folder, "key_log"), F.col("key_identity"), log_instant(), F.col("event_value"), F.col("event_uid"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    quiet = _totals(spark, folder).filter("n_7 = 0 and n_30 > 0")
    return quiet.select(F.col("entity").alias("key_identity"), day_string(F.col("day")).alias("day_utc"))


def _shown_totals() -> list[Column]:
    return [F.round(c, 4).alias(c) if c[0] in "at" else F.col(c) for c in ("n_7", "total_7", "avg_7", "n_30", "total_30", "avg_30")]


def p4_rolling(spark: SparkSession, folder: str) -> DataFrame:
    return _totals(spark, folder).select(F.col("entity").alias("key_identity"), day_string(F.col("day")).alias("day_utc"), "n", *_shown_totals())


def p4_anchors(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "key_log")
    found = rolling.anchored(_totals(spark, folder), log, F.col("key_identity"), log_instant(), F.col("key_group"), F.col("event_uid"), F.col("log_id"), table(spark, folder, "anchor_specs"))
    return found.select("anchor_no", F.col("entity").alias("key_identity"), day_string(F.col("day")).alias("day_utc"), F.col("tie").alias("log_id"), *_shown_totals())


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    return late.judged(table(spark, folder, "key_log"), F.col("event_uid"), F.col("log_id"), micros("arrived_at"), log_instant(), F.col("event_value"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return late.change_log(_judged(spark, folder)).select(F.col("tie").alias("log_id"), "verdict")


def p5_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of the multisets that late records changed, with their counts at the period's end and at the cut-off."""
    out = late.changed_entries(late.multisets(_judged(spark, folder)))
    return out.withColumn("day_utc", day_string(F.col("period").cast("int"))).drop("period")


def p5_two_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The corrected entries where the log comes in two batches by arrival, the second onto the first one's state."""
    log, at = table(spark, folder, "key_log"), f"{shared_dir(spark)}/late-batches-{uuid.uuid4().hex}"
    columns = {"uid": F.col("event_uid"), "tie": F.col("log_id"), "arrived_us": micros("arrived_at"), "instant_us": log_instant(), "value": F.col("event_value")}
    step, early = runs.carried_multisets(at, columns), F.coalesce(F.col("arrived_at") < F.lit(_SECOND_BATCH).cast("timestamp"), F.lit(False))
    step(log.filter(early), 0)
    step(log.filter(~early), 1)
    out = late.changed_entries(runs.multisets_at(spark, at, 1)).filter("n_final > n_at_close")
    return out.select(day_string(F.col("period").cast("int")).alias("day_utc"), "value", "n_at_close", "n_final")


def p5_periods(spark: SparkSession, folder: str) -> DataFrame:
    out = late.period_aggregates(late.multisets(_judged(spark, folder)))
    rounded = {c: F.round(c, 4) for c in out.columns if c.startswith(("total_", "median_"))}
    return out.withColumns(rounded).withColumn("day_utc", day_string(F.col("period").cast("int"))).drop("period")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_sessions, p2_found, p2_cells, p2_feature_table, p3_found, p3_per_key, p4_found, p4_rolling, p4_anchors, p5_found, p5_entries, p5_two_batches, p5_periods)
}


def _iso_sql(c: str) -> str:
    return f"TRY_CAST(CASE WHEN regexp_matches(trim({c}), '([zZ]|[+-][0-9]{{2}}(:?[0-9]{{2}})?)$') OR NOT contains({c}, ':') THEN trim({c}) ELSE trim({c}) || 'Z' END AS TIMESTAMPTZ)"


_LOG = f"""log AS (
  SELECT *, epoch_us(coalesce(key_timestamp, {_iso_sql('_start_time')})) AS us
  FROM key_log)"""
_LAST = "regexp_extract(range_key, '[^/]*$')"
_ITEMS = f"""items AS (
  SELECT *, epoch_us(CASE WHEN _start_time IS NOT NULL THEN {_iso_sql('_start_time')} ELSE {_iso_sql(_LAST)} END) AS us
  FROM store_items WHERE trim(coalesce(partition_key, '')) <> '')"""
_SESSIONS = """gaps AS (
  SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY partition_key ORDER BY us) <= 1800000000 THEN 0 ELSE 1 END AS opens
  FROM points),
numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY partition_key ORDER BY us ROWS UNBOUNDED PRECEDING) AS part FROM gaps)"""
_KINDS = """kinds AS (
  SELECT min(kind_no) AS kind_no, translate(lower(kind_name), ' _-.', '') AS plain FROM event_kinds GROUP BY 2)"""
_ONCE = f"""WITH {_KINDS}, {_LOG},
once AS (
  SELECT l.key_identity, k.kind_no, l.event_uid, max(l.event_value) AS v, max(l.us) AS us
  FROM log l JOIN kinds k ON translate(lower(l.key_group), ' _-.', '') = k.plain
  WHERE trim(coalesce(l.key_identity, '')) <> '' GROUP BY ALL)"""


def _wide_sql(folder: str) -> str | None:
    """Conditional aggregates for each kind of the fixed list; none where that table is not at hand."""
    path = Path(folder) / "event_kinds.parquet"
    if not path.exists():
        return None
    kinds = sorted((r["kind_no"], r["kind_name"]) for r in pq.read_table(path, columns=["kind_no", "kind_name"]).to_pylist())
    cells = ",\n".join(
        f"""count(*) FILTER (WHERE kind_no = {no}) AS "n_{name}", (any_value(top) - max(us) FILTER (WHERE kind_no = {no})) / 1e6 AS "recency_s_{name}", round(coalesce(sum(v) FILTER (WHERE kind_no = {no}), 0), 4) AS "total_{name}\""""
        for no, name in kinds
    )
    return f"{_ONCE}\nSELECT key_identity, {cells}\nFROM once, (SELECT max(us) AS top FROM log) GROUP BY key_identity"


_ROLL = f"""{_LOG},
once AS (
  SELECT key_identity, CAST(floor(us / 86400000000) AS INTEGER) AS day, event_uid, max(event_value) AS v
  FROM log WHERE us IS NOT NULL AND trim(coalesce(key_identity, '')) <> '' GROUP BY ALL),
daily AS (SELECT key_identity, day, count(*) AS n, coalesce(sum(v), 0) AS total FROM once GROUP BY ALL),
spans AS (SELECT key_identity, unnest(range(min(day), max(day) + 1)) AS day FROM daily GROUP BY key_identity),
dense AS (
  SELECT s.key_identity, s.day, coalesce(d.n, 0) AS n, coalesce(d.total, 0) AS total
  FROM spans s LEFT JOIN daily d ON d.key_identity = s.key_identity AND d.day = s.day),
rolled AS (
  SELECT key_identity, day, n,
    sum(n) OVER w7 AS n_7, sum(total) OVER w7 AS total_7, sum(n) OVER w30 AS n_30, sum(total) OVER w30 AS total_30
  FROM dense
  WINDOW w7 AS (PARTITION BY key_identity ORDER BY day ROWS 6 PRECEDING),
         w30 AS (PARTITION BY key_identity ORDER BY day ROWS 29 PRECEDING))"""
_DAY = "strftime(DATE '1970-01-01' + CAST(day AS INTEGER), '%Y-%m-%d') AS day_utc"
_TOTALS = """CAST(n_7 AS BIGINT) AS n_7, round(total_7, 4) AS total_7, round(total_7 / 7.0, 4) AS avg_7,
  CAST(n_30 AS BIGINT) AS n_30, round(total_30, 4) AS total_30, round(total_30 / 30.0, 4) AS avg_30"""
_JUDGED = f"""{_LOG},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY event_uid ORDER BY arrived_at NULLS LAST, log_id) AS rank FROM log),
placed AS (
  SELECT log_id, event_value AS value, CAST(floor(us / 86400000000) AS BIGINT) AS day, epoch_us(arrived_at) AS a
  FROM ranked WHERE rank = 1 AND us IS NOT NULL),
judged AS (
  SELECT *, CASE WHEN a < (day + 1) * 86400000000 THEN 'on_time'
    WHEN a <= (day + 1) * 86400000000 + 172800000000 THEN 'corrected' ELSE 'dropped' END AS verdict
  FROM placed)"""


def _phase(x: str, kept: str) -> str:
    c = f"FILTER (WHERE {kept})"
    return f"""count(*) {c} AS n_{x}, count(value) {c} AS n_values_{x}, count(DISTINCT value) {c} AS n_distinct_{x},
  min(value) {c} AS least_{x}, max(value) {c} AS most_{x}, round(sum(value) {c}, 4) AS total_{x}, round(median(value) {c}, 4) AS median_{x}"""


ORACLE: dict[str, str] = {
    "p1_found": f"""WITH {_ITEMS}, points AS (SELECT DISTINCT partition_key, us FROM items WHERE us IS NOT NULL), {_SESSIONS}
SELECT partition_key, CAST(floor(min(us) / 1000000) AS BIGINT) AS start_s, CAST(floor(max(us) / 1000000) AS BIGINT) AS end_s
FROM numbered GROUP BY partition_key, part""",
    "p1_sessions": f"""WITH {_ITEMS},
puts AS (
  SELECT *, row_number() OVER (PARTITION BY partition_key, regexp_replace(range_key, '[^/]*$', ''), us
    ORDER BY written_at DESC NULLS LAST, item_id DESC) AS rank
  FROM items WHERE us IS NOT NULL),
points AS (SELECT partition_key, us, events FROM puts WHERE rank = 1), {_SESSIONS}
SELECT partition_key, CAST(floor(min(us) / 1000000) AS BIGINT) AS start_s, CAST(floor(max(us) / 1000000) AS BIGINT) AS end_s,
  CAST(floor(max(us) / 1000000) AS BIGINT) - CAST(floor(min(us) / 1000000) AS BIGINT) AS duration_s,
  count(*) AS n_items, CAST(coalesce(sum(events), 0) AS BIGINT) AS n_events
FROM numbered GROUP BY partition_key, part""",
    "p2_found": f"""WITH {_KINDS}
SELECT DISTINCT l.key_identity, k.kind_no, coalesce(array_to_string(list_filter(l.key_dimensions, lambda x: x IS NOT NULL), '|'), '') AS dims
FROM key_log l JOIN kinds k ON translate(lower(l.key_group), ' _-.', '') = k.plain
WHERE trim(coalesce(l.key_identity, '')) <> ''""",
    "p2_cells": f"""{_ONCE}
SELECT key_identity, kind_no, count(*) AS n, round(((SELECT max(us) FROM log) - max(us)) / 1e6, 3) AS recency_s, round(coalesce(sum(v), 0), 4) AS total
FROM once GROUP BY key_identity, kind_no""",
    "p3_found": """SELECT 'key_log' AS table_name, key_identity AS hot_key FROM key_log WHERE trim(coalesce(key_identity, '')) <> ''
GROUP BY key_identity HAVING count(*) * 100 >= (SELECT count(*) FROM key_log)
UNION ALL
SELECT 'store_items', partition_key FROM store_items WHERE trim(coalesce(partition_key, '')) <> ''
GROUP BY partition_key HAVING count(*) * 100 >= (SELECT count(*) FROM store_items)""",
    "p3_per_key": f"""WITH {_LOG},
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY _identity ORDER BY updated_at DESC NULLS LAST, state_id DESC) AS rank FROM identity_state)
  WHERE rank = 1)
SELECT l.key_identity, s.country, s.max_level_completed, count(*) AS n_rows, round(coalesce(sum(l.event_value), 0), 4) AS total,
  CAST(floor(max(us) / 1000000) AS BIGINT) AS last_s
FROM log l LEFT JOIN latest s ON s._identity = l.key_identity
WHERE trim(coalesce(l.key_identity, '')) <> '' GROUP BY ALL""",
    "p4_found": f"WITH {_ROLL} SELECT key_identity, {_DAY} FROM rolled WHERE n_7 = 0 AND n_30 > 0",
    "p4_rolling": f"WITH {_ROLL} SELECT key_identity, {_DAY}, n, {_TOTALS} FROM rolled",
    "p4_anchors": f"""WITH {_ROLL},
hits AS (
  SELECT s.anchor_no, s.anchor_max, l.key_identity, CAST(floor(l.us / 86400000000) AS INTEGER) AS day, min(l.us) AS us, min(l.log_id) AS log_id
  FROM log l JOIN anchor_specs s ON translate(lower(l.key_group), ' _-.', '') = translate(lower(s.anchor_group), ' _-.', '')
  WHERE l.us IS NOT NULL AND trim(coalesce(l.key_identity, '')) <> ''
  GROUP BY s.anchor_no, s.anchor_max, l.key_identity, day, l.event_uid),
ranked AS (SELECT *, row_number() OVER (PARTITION BY anchor_no, key_identity, day ORDER BY us, log_id) AS rank FROM hits)
SELECT anchor_no, key_identity, {_DAY}, log_id, {_TOTALS}
FROM ranked JOIN rolled USING (key_identity, day) WHERE anchor_max IS NULL OR rank <= anchor_max""",
    "p5_found": f"WITH {_JUDGED} SELECT log_id, verdict FROM judged WHERE verdict <> 'on_time'",
    "p5_entries": f"""WITH {_JUDGED}
SELECT {_DAY}, value, count(*) FILTER (WHERE verdict = 'on_time') AS n_at_close, count(*) FILTER (WHERE verdict <> 'dropped') AS n_final,
  count(*) FILTER (WHERE verdict = 'dropped') AS n_dropped
FROM judged GROUP BY day, value HAVING count(*) FILTER (WHERE verdict <> 'on_time') > 0""",
    "p5_two_batches": f"""WITH {_JUDGED}
SELECT {_DAY}, value, count(*) FILTER (WHERE verdict = 'on_time') AS n_at_close, count(*) FILTER (WHERE verdict <> 'dropped') AS n_final
FROM judged GROUP BY day, value HAVING count(*) FILTER (WHERE verdict = 'corrected') > 0""",
    "p5_periods": f"""WITH {_JUDGED}
SELECT {_phase('close', "verdict = 'on_time'")}, {_phase('final', "verdict <> 'dropped'")},
  count(*) FILTER (WHERE verdict = 'corrected') AS n_corrected, count(*) FILTER (WHERE verdict = 'dropped') AS n_dropped, {_DAY}
FROM judged GROUP BY day""",
}

if (_wide := _wide_sql("/root/testdata/sf0.001")) is not None:
    ORACLE["p2_feature_table"] = _wide
