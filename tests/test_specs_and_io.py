"""Validation, command line, sources, sinks, state tables and streams."""

import json

import pytest
import yaml
from pyspark.sql import functions as F

from strandline import cli, sinks
from strandline.plans.engine import Engine
from strandline.plans.spec import stream_spec
from strandline.plans.validate import SpecError, problems, validate
from strandline.sources import readers
from strandline.sources import state as store
from strandline.streaming import runs
from tests.test_engine import BEDS, BEDS_WINDOW, FIRST, SECOND, plain


def changed(path, value, spec=BEDS):
    doc = json.loads(json.dumps(spec))
    at = doc
    for p in path[:-1]:
        at = at[p]
    if value is None:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return doc


def test_valid_specs():
    validate(BEDS)
    validate(BEDS_WINDOW)


@pytest.mark.parametrize(
    "doc,where,attribute,kind",
    [
        (changed(["Version"], "2018-03-02"), "own", "Version", "value"), (changed(["Time"], None), "own", "Time", "required"), (changed(["Anchor", "Max"], "one", BEDS_WINDOW), "near.anchor", "Max", "number"),
        (changed(["Anchor", "Max"], 0, BEDS_WINDOW), "near.anchor", "Max", "number"), (changed(["Aggregates", 1, "Fields", 0, "Type"], "decimal"), "own.plot.crop", "Type", "type"), (changed(["When"], "source.x ="), "own", "When", "expression"),
        (changed(["When"], "source.x = 1"), "own", "When", "expression"), (changed(["Aggregates", 1, "Fields"], None), "own.plot", "Fields", "required"), (changed(["Aggregates", 1, "Fields", 0, "Name"], "_crop"), "own.plot._crop", "Name", "identifier"),
        (changed(["Aggregates", 1, "Fields", 0, "Name"], "run_x"), "own.plot.run_x", "Name", "identifier"), (changed(["Aggregates", 1, "Fields", 0, "Name"], "a-b"), "own.plot.a-b", "Name", "identifier"), (changed(["Type"], "Own:Transform:Other"), "own", "Type", "type"),
        (changed(["Aggregates", 1, "Dimensions"], [{"Name": "d", "Type": "float", "Value": "source.d"}]), "own.plot.d", "Type", "value"), (changed(["Aggregates", 2, "SeparateByInactiveSeconds"], 0), "own.visit", "SeparateByInactiveSeconds", "number"),
        (changed(["Aggregates", 2, "SeparateByInactiveSeconds"], None), "own.visit", "SeparateByInactiveSeconds", "required"), (changed(["Aggregates", 0, "Fields", 0, "Value"], ""), "own.vars.zone", "Value", "empty"), (changed(["Aggregates", 0, "WindowValue"], 0, BEDS_WINDOW), "near.before", "WindowValue", "empty"),
        (changed(["Stores", 0, "Type"], "Own:Store:Dynamo"), "own.kept", "Table", "required"), (changed(["Import"], [{"Identifiers": ["x"]}]), "own", "Import", "import"), (changed(["Aggregates", 0, "Type"], "Own:Aggregate:Block", BEDS_WINDOW), "near.before", "Type", "type"),
    ],
)
def test_problems_are_found(doc, where, attribute, kind):
    assert (where, attribute, kind) in {(p.where, p.attribute, p.kind) for p in problems(doc)}
    with pytest.raises(SpecError):
        validate(doc)


def test_problems_are_collected_once():
    doc = changed(["Version"], "x", changed(["Time"], None))
    assert len(problems(doc)) == len(set(problems(doc))) >= 2


@pytest.fixture
def folder(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "s.yml").write_text(yaml.safe_dump(BEDS))
    (tmp_path / "w.yml").write_text(yaml.safe_dump(BEDS_WINDOW))
    lines = [json.dumps({"bed": u, "read_at": t, **({"crop": c} if c else {})}) for u, t, c in FIRST]
    (tmp_path / "raw.json").write_text("\n".join([*lines[:3], "{broken", *lines[3:], "[1]"]) + "\n")
    return tmp_path


def test_validate_command(folder, capsys):
    assert cli.main(["validate", "s.yml", "w.yml"]) == 0
    (folder / "bad.yml").write_text("a: [1\n")
    (folder / "worse.yml").write_text(yaml.safe_dump(changed(["Version"], "1")))
    assert cli.main(["validate", "bad.yml", "s.yml", "worse.yml"]) == 1
    said = capsys.readouterr()
    assert "Invalid yaml" in said.err and "2018-03-01" in said.err and "Document is valid" in said.out


def test_transform_command(spark, folder, capsys):
    assert cli.main(["transform", str(folder / "raw.json")]) == 0  # finds both specs
    got = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert got == [["bed-1", [{"before._identity": "bed-1", "before.readings": 1, "hours._identity": "bed-1", "hours.total": 1}]], ["bed-2", []], ["bed-3", []]]
    assert cli.main(["transform", "--streaming", "s.yml", "--output", str(folder / "out"), str(folder / "raw.json")]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert ["bed-1/visit//2021-05-03T05:00:00+00:00", {"_identity": "bed-1", "_start_time": "2021-05-03T05:00:00+00:00", "_end_time": "2021-05-03T05:25:00+00:00", "readings": 3, "crop": "kale", "zone": "dry"}] in lines
    assert len(lines) == 8 == spark.read.text(str(folder / "out")).count()
    assert cli.main(["transform", "--processor", "none", "raw.json"]) == 1
    assert cli.main(["transform", "--runner", "none", "raw.json"]) == 1
    assert cli.main(["package", str(folder / "lib.zip")]) == 0 and (folder / "lib.zip").stat().st_size > 1000


def test_no_spec_is_an_error(tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    assert cli.main(["transform", "raw.json"]) == 1


def test_spec_from_a_file(folder):
    assert stream_spec(str(folder / "s.yml")) == stream_spec(BEDS)


def test_feature_file(spark, folder):
    df = readers.json_lines(spark, str(folder / "raw.json"))
    sinks.write_features(Engine(BEDS, BEDS_WINDOW).features(df, "_order"), str(folder / "csv"))
    text = "".join(p.read_text() for p in (folder / "csv").glob("*.csv") if p.stat().st_size)
    assert text.splitlines() == ["before._identity,before.readings,hours._identity,hours.total", "bed-1,1,bed-1,1"]


def test_json_lines_with_a_schema_and_broken_lines(spark, folder):
    df = readers.json_lines(spark, [str(folder / "raw.json")], "bed string, read_at string, crop string, other long")
    assert df.count() == 7 and df.filter("other is not null").count() == 0


def test_ipfix(spark):
    message = {"Other": 1, "DataSets": [[{"I": 56, "V": "aa"}, {"I": 4, "V": 6}, {"I": 182, "V": 80}, {"I": 183, "V": 81}, {"I": 12, "V": "0.0.0.0"}, {"I": 150, "V": 1522385684}], [{"I": 56, "V": "bb"}, {"I": 123, "V": 321}], [{"I": 4, "V": 3}], []]}
    lines = spark.createDataFrame([(json.dumps(message),), ("no json",), ('{"a": 1}',), (None,), ("[]",)], "value string")
    got = {r.source_mac: r for r in readers.ipfix(lines).collect()}
    assert set(got) == {"aa", "bb"} and got["bb"].other == {"123": "321"}
    assert (got["aa"].protocol, got["aa"].source_port, got["aa"].dest_port, got["aa"].dest_ip, got["aa"].timestamp) == (6, 80, 81, "0.0.0.0", 1522385684)


def test_state_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("a", 3, 30), ("b", 1, 5)], "_identity string, s long, n long").withColumn("_start_time", F.timestamp_seconds("s")).drop("s")
    store.save({"x": df}, str(tmp_path / "v1"))
    x = store.load(spark, str(tmp_path / "v1"), ["x"])["x"]
    assert store.get_all(x, "a").count() == 3
    assert [r.n for r in store.between(x, "a", F.timestamp_seconds(F.lit(1)), F.timestamp_seconds(F.lit(3))).collect()] == [20]
    assert sorted(r.n for r in store.nearest(x, -2).collect()) == [5, 20, 30] and sorted(r.n for r in store.nearest(x, 1).collect()) == [5, 10]
    new = x.filter("n = 30").withColumn("n", F.lit(31).cast("long"))
    keys = ["_identity", "_start_time"]
    assert sorted(r.n for r in store.put(x, new, keys).collect()) == [5, 10, 20, 31]
    assert store.remove(x, new, keys).count() == 3


def test_spec_carried_over_micro_batches(spark, tmp_path):
    from tests.test_engine import beds

    engine, whole = Engine(BEDS), Engine(BEDS).blocks(beds(spark, FIRST + SECOND), "seq")
    step = runs.carried_spec(engine, str(tmp_path / "state"), "seq")
    step(beds(spark, FIRST), 0)
    step(beds(spark, SECOND), 1)
    step(beds(spark, SECOND), 1)  # run again after a failure
    found = runs.blocks_at(spark, engine, str(tmp_path / "state"), 1)
    assert set(found) == set(whole)
    for name, df in found.items():
        assert plain(df.drop("_bucket")) == plain(whole[name])


def test_only_touched_buckets_are_written_and_old_versions_go(spark, tmp_path):
    from tests.test_engine import beds

    engine, at = Engine(BEDS), tmp_path / "state"
    step = runs.carried_spec(engine, str(at), "seq")
    for n, rows in enumerate((FIRST, SECOND[:1], SECOND[1:], SECOND[1:2])):
        step(beds(spark, rows), n)
    buckets = lambda v: {p.name for p in (at / f"v{v}/plot").glob("_bucket=*")}
    bed = lambda name: {f"_bucket={spark.range(1).select(runs._bucket(F.lit(name))).first()[0]}"}
    assert buckets(1) == bed("bed-1") and buckets(3) == bed("bed-3")
    assert bed("bed-1").isdisjoint(buckets(0)) and bed("bed-2") <= buckets(0)


def test_periods_past_the_cut_off_are_closed_and_their_uids_forgotten(spark, tmp_path):
    from strandline.operators import late
    from tests.test_late import DAY, SCHEMA

    rows = [(i, i, d * DAY + h * DAY // 4, d * DAY, float(i % 3)) for i, (d, h) in enumerate((d, h) for d in range(8) for h in (0, 5, 20))] + [(i, 100 + i, 9 * DAY, d * DAY, float(i % 3)) for i, d in ((0, 0), (18, 6))] + [(99, 99, 11 * DAY + DAY // 2, 11 * DAY, 1.0)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    c = {"uid": F.col("uid"), "tie": F.col("tie"), "arrived_us": F.col("a"), "instant_us": F.col("t"), "value": F.col("value")}
    step, at = runs.carried_multisets(str(tmp_path / "m"), c), str(tmp_path / "m")
    for n in range(4):
        step(df.filter(f"a >= {n * 4 * DAY} and a < {(n + 1) * 4 * DAY}"), n)
    whole = {(r.period, r.value): (r.n_on_time, r.n_corrected) for r in late.multisets(late.judged(df, *c.values())).collect()}
    assert {(r.period, r.value): (r.n_on_time, r.n_corrected) for r in runs.multisets_at(spark, at, 3).collect() if r.n_on_time + r.n_corrected} == {k: v for k, v in whole.items() if sum(v)}
    newest = max(a for _, _, a, _, _ in rows)
    seen = {r.period for r in spark.read.parquet(f"{at}/v3/seen").collect()}
    assert seen and all((p + 1) * DAY + 2 * DAY >= newest for p in seen)
    assert not (tmp_path / "m/v0").exists() and not (tmp_path / "m/v1").exists() and (tmp_path / "m/v2").exists()
    counts = {(r.period, r.value): r.n_dropped for r in runs.multisets_at(spark, at, 3).collect()}
    assert counts[0, 0.0] == 1  # delivered again after the cut-off: by then nobody knows that it was counted


def test_multisets_corrected_batch_by_batch(spark, tmp_path):
    from strandline.operators import late
    from tests.test_late import DAY, SCHEMA

    rows = [(1, 1, 0, 0, 2.0), (2, 2, DAY, 0, 2.0), (1, 3, 2 * DAY, 0, 9.0), (3, 4, 2 * DAY, DAY, None), (4, 5, 9 * DAY, 0, 2.0), (None, 6, 0, 0, 2.0)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in sorted(rows, key=lambda r: r[2])], SCHEMA)
    c = {"uid": F.col("uid"), "tie": F.col("tie"), "arrived_us": F.col("a"), "instant_us": F.col("t"), "value": F.col("value")}
    whole = late.multisets(late.judged(df, *c.values()))
    step = runs.carried_multisets(str(tmp_path / "m"), c)
    for n, part in enumerate((df.filter(f"a < {DAY}"), df.filter(f"a >= {DAY} and a < {5 * DAY}"), df.filter(f"a >= {5 * DAY}"))):
        step(part, n)
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, runs.multisets_at(spark, str(tmp_path / "m"), 2).collect()), key=key) == sorted(map(tuple, whole.collect()), key=key)


def test_a_store_is_replaced_from_itself(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "kept"))
    assert kept.load() is None and kept.names() == []
    kept.save({"x": spark.range(3), "y": spark.range(1)})
    kept.save({"x": kept.load()["x"].selectExpr("id + 10 as id")})
    assert kept.names() == ["x"] and sorted(r.id for r in kept.load()["x"].collect()) == [10, 11, 12]
    assert kept.finalize() == 1 and sorted(r.id for r in store.Store(spark, str(tmp_path / "kept")).load()["x"].collect()) == [10, 11, 12]


def test_a_store_in_memory(spark):
    kept = store.MemoryStore(spark, "mem")
    assert kept.load() is None
    kept.save({"x": spark.range(3), "y": spark.range(1)})
    kept.save({"x": kept.load()["x"].selectExpr("id + 10 as id")})
    assert [r.id for r in spark.sql("select id from mem_x order by id").collect()] == [10, 11, 12] and not spark.catalog.tableExists("mem_y")
    kept.finalize()
    assert kept.load() is None and not spark.catalog.tableExists("mem_x")


def test_lines_of_every_kind(spark, tmp_path):
    lines = ['{"a": 1, "b": {"x": "1", "y-z": [1, 2]}, "it\'s": 5, "n": null}', '{"a": "1", "b": {"x": 2}}', '{"a": [1], "b": null, "big": 12345678901234567890}', '{"a": 1, "a": 2}', '"text"', "12", "null", "  ", '{"open": ', "[]"]
    (tmp_path / "l.json").write_text("\n".join(lines) + "\n")
    found = readers.json_lines(spark, str(tmp_path / "l.json"))
    assert {f.name: f.dataType.simpleString() for f in found.schema if f.name != "_order"} == {"a": "variant", "b": "struct<x:variant,y-z:array<bigint>>", "big": "double", "it's": "bigint", "n": "string"}
    assert [(r["it's"], r.n) for r in found.orderBy("_order").collect()] == [(5, None), (None, None), (None, None)]
    typed = readers.json_lines(spark, str(tmp_path / "l.json"), "a long, b struct<x:long,`y-z`:array<string>>, missing double, `it's` string").orderBy("_order").drop("_order").collect()
    assert [(r.a, r.b and (r.b.x, r.b["y-z"]), r.missing, r["it's"]) for r in typed] == [(1, (1, ["1", "2"]), None, "5"), (1, (2, None), None, None), (None, None, None, None)]
    assert readers.json_rejects(spark, str(tmp_path / "l.json")) == {"lines": 10, "blank": 1, "no_object": 6}
    (tmp_path / "none.json").write_text("")
    assert readers.json_lines(spark, str(tmp_path / "none.json")).count() == 0
    assert readers.json_lines(spark, str(tmp_path / "none.json"), "a long").count() == 0


def test_items_for_a_key_value_table(spark, tmp_path):
    from strandline.plans.catalogue import FileClient
    from tests.test_engine import beds

    engine, path = Engine(BEDS), str(tmp_path / "items")
    made = engine.blocks(beds(spark, FIRST), "seq")["visit"]
    store.write_items(made.coalesce(1), sinks.block_key(engine.stream.aggregate("visit")), lambda: FileClient(path), batch=2)
    items = [json.loads(x) for p in (tmp_path / "items").glob("*.json") for x in p.read_text().splitlines()]
    assert len(items) == 5 and {i["partition_key"] for i in items} == {"bed-1", "bed-2", "bed-3"}
    assert all(i["range_key"].startswith("visit//2021-05-03T") for i in items)
    assert [sorted(i) for i in items if i["partition_key"] == "bed-3"] == [["_end_time", "_identity", "_start_time", "partition_key", "range_key", "readings"]]


def test_decimals_in_block_lines(spark):
    from strandline.plans.catalogue import aggregate, stream

    df = spark.sql("select 'a' as _identity, cast(3 as decimal(10,2)) as x, cast(2.5 as decimal(10,2)) as y, cast(null as decimal(10,2)) as z")
    (line,) = sinks.block_lines(df, Engine(stream(aggregate("Identity", "s", [("x", "float", "1")]))).stream.aggregate("s")).collect()
    assert json.loads(line.value) == ["a/s//", {"_identity": "a", "x": 3, "y": 2.5, "z": None}] and '"x":3,' in line.value


def test_a_processor_of_ones_own(spark, folder, capsys):
    (folder / "ours.py").write_text("from strandline.sources import readers\n\n\ndef doubled(spark, paths):\n    df = readers.json_lines(spark, paths)\n    return df.unionByName(df)\n")
    assert cli.main(["transform", "--streaming", "s.yml", "--processor", "ours:doubled", str(folder / "raw.json")]) == 0
    assert '"readings":6' in capsys.readouterr().out
    assert cli.main(["transform", "--streaming", "s.yml", "--processor", "ours:nothing", str(folder / "raw.json")]) == 1
    assert cli.main(["transform", "--streaming", "s.yml", "--processor", "missing.module:f", str(folder / "raw.json")]) == 1


def test_intermediate_tables_are_released(spark):
    from strandline import session

    made = session.materialize(spark.range(5), "to-release")
    assert made.count() == 5 and session.release(spark) >= 1 and session.release(spark) == 0


def test_stream_of_sessions_in_append_mode(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("a", 0, 1.0), ("a", 10, 2.0), ("a", 21, 4.0), (" ", 5, 1.0), ("b", 500, 1.0)]
    spark.createDataFrame(rows, "u string, s long, v double").withColumn("t", F.timestamp_seconds("s")).write.parquet(str(src))
    df = spark.readStream.schema("u string, s long, v double, t timestamp").parquet(str(src))
    out = runs.sessions(df, F.col("u"), F.col("t"), 10, F.col("v"), "5 seconds")
    q = out.writeStream.outputMode("append").format("memory").queryName("appended").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.identity, int(r.start.timestamp()), int(r.end.timestamp()), r.n, r.total) for r in spark.table("appended").collect())
    assert got == [("a", 0, 10, 2, 3.0), ("a", 21, 21, 1, 4.0)]


def test_event_by_event_on_a_stream(spark, tmp_path):
    from strandline.streaming import stateful
    from tests.test_engine import beds

    src = tmp_path / "in"
    beds(spark, FIRST).drop("_id").coalesce(1).write.parquet(str(src))
    beds(spark, SECOND).drop("_id").coalesce(1).write.mode("append").parquet(str(src))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, stateful.PROVIDER)
    try:
        df = spark.readStream.schema("bed string, read_at string, crop string, seq long, s0 string").option("maxFilesPerTrigger", 1).parquet(str(src))
        got = {}

        def keep(batch, number):
            for r in batch.collect():
                got.setdefault((r.identity, r.aggregate), {})[json.loads(r.snapshot).get("_start_time")] = json.loads(r.snapshot)

        q = stateful.evaluate(df, Engine(BEDS), "seq").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(key, before)
    assert got["bed-1", "plot"][None] == {"crop": "kale", "zone": "dry", "_identity": "bed-1"}
    assert sorted(b["readings"] for b in got["bed-1", "visit"].values()) == [1, 4]
    assert sorted(b["readings"] for b in got["bed-3", "visit"].values()) == [1, 1]


def test_rejects_are_counted(spark):
    df = spark.createDataFrame([("a", "2018-03-07"), ("a", "2018-03-07T00:00:00"), ("a", "no"), ("", "2018-03-07T00:00:00"), (None, None), ("b", None)], "bed string, read_at string")
    assert Engine(BEDS).rejects(df) == {"identity": 2, "time": 2}
