"""Specs on small hand-made streams, with the values they must give, and the tiers held against each other."""

import datetime as dt
import random

import pytest

from strandline.plans.catalogue import aggregate, stream, window, windows
from strandline.plans.engine import Engine
from strandline.plans.online import Online
from strandline.sources import readers

UTC = dt.timezone.utc


def at(text):
    return dt.datetime.fromisoformat(text).replace(tzinfo=None)


BEDS = stream(
    aggregate("Variable", "vars", [("zone", "string", "'wet' if source.crop == 'rice' else 'dry'", "bool(source.crop)")]),
    aggregate("Identity", "plot", [("crop", "string", "source.crop"), ("zone", "string", "vars.zone", "bool(vars.zone)")]),
    aggregate("Activity", "visit", [("readings", "integer", "visit.readings + 1"), ("crop", "string", "source['crop']"), ("zone", "string", "vars['zone']", "bool(vars.zone)")], SeparateByInactiveSeconds=900),
    identity="source.bed", time="parse(source.read_at)",
)
BEDS_WINDOW = windows(
    window("before", "count", -1, [("readings", "integer", "source.readings[0]")], source="own.visit"),
    window("hours", "hour", -2, [("total", "integer", "hours.total + sum(source.readings)")], source="own.visit"),
    condition="own.visit.readings > 0 and own.plot.crop != ''", Max=1,
)
D = "2021-05-03T"
FIRST = [
    ("bed-1", f"{D}06:00:00+02:00", "rice"), ("bed-1", f"{D}05:00:00+00:00", "kale"), ("bed-1", f"{D}05:10:00+00:00", None), ("bed-2", f"{D}04:30:00+00:00", None), ("bed-2", f"{D}04:45:01+00:00", None), ("bed-3", f"{D}08:00:00+00:00", None),
    ("bed-1", f"{D}05:25:00+00:00", None),
]
SECOND = [("bed-1", f"{D}05:30:00+00:00", None), ("bed-3", f"{D}08:20:00+00:00", "flax")]


def beds(spark, rows):
    return spark.createDataFrame([(*r, i, 1, "x") for i, r in enumerate(rows)], "bed string, read_at string, crop string, seq long, _id int, s0 string")


def plain(df):
    return sorted(tuple(r) for r in df.collect())


def test_visits_of_beds(spark):
    made = Engine(BEDS).blocks(beds(spark, FIRST), "seq")
    assert plain(made["plot"]) == [("bed-1", "kale", "dry"), ("bed-2", "", ""), ("bed-3", "", "")]
    assert plain(made["visit"]) == [
        ("bed-1", at(f"{D}04:00:00"), at(f"{D}04:00:00"), 1, "rice", "wet"), ("bed-1", at(f"{D}05:00:00"), at(f"{D}05:25:00"), 3, "kale", "dry"),
        ("bed-2", at(f"{D}04:30:00"), at(f"{D}04:30:00"), 1, "", ""), ("bed-2", at(f"{D}04:45:01"), at(f"{D}04:45:01"), 1, "", ""), ("bed-3", at(f"{D}08:00:00"), at(f"{D}08:00:00"), 1, "", ""),
    ]


def test_features_of_beds(spark):
    got = Engine(BEDS, BEDS_WINDOW).features(beds(spark, FIRST), "seq").collect()
    assert [r.asDict() for r in got] == [{"_identity": "bed-1", "_start_time": at(f"{D}05:00:00"), "before.readings": 1, "hours.total": 1}]


@pytest.mark.parametrize("fold", [False, True])
def test_two_runs_equal_one(spark, fold):
    engine = Engine(BEDS)
    whole = engine.blocks(beds(spark, FIRST + SECOND), "seq")
    first = engine.blocks(beds(spark, FIRST), "seq", variables=True)
    then = engine.blocks(beds(spark, SECOND), "seq", first) if not fold else None
    for name in whole:
        if fold:
            assert plain(engine.blocks(beds(spark, FIRST + SECOND), "seq", fold=True)[name]) == plain(whole[name])
        else:
            assert plain(then[name]) == plain(whole[name])


def test_a_folded_identity_is_carried_on(spark):
    spec = stream(aggregate("Identity", "state", [("x", "float", "0.5 * state.x + source.v"), ("tags", "set", "state.tags.add(source.k)"), ("last", "list", "state.last.append(source.v).remove(source.v)")]), identity="source.u", time="source.t")
    rows = [(u, i, float(i % 7), f"k{i % 3}") for i in range(30) for u in ("a", "b")] + [("c", 1, 2.0, "k")]
    frame = lambda rs: spark.createDataFrame([(u, dt.datetime(2020, 1, 1) + dt.timedelta(minutes=i), v, k, i) for u, i, v, k in rs], "u string, t timestamp, v double, k string, seq long")
    engine = Engine(spec)
    whole = engine.blocks(frame(rows), "seq")["state"]
    first = engine.blocks(frame([r for r in rows if r[1] < 11]), "seq")
    then = engine.blocks(frame([r for r in rows if r[1] >= 11]), "seq", first)["state"]
    assert engine.tiers["state"] == "C"
    assert plain(then) == plain(whole)


LIBRARY = stream(
    aggregate("Variable", "vars", [("member", "boolean", "True", "source.kind == 'card_issued'"), ("shelf", "list", "source['shelf-mark'].split('-')")]),
    aggregate("Identity", "reader", [
        ("town", "string", "source.town"), ("age", "integer", "source['age']"), ("member", "boolean", "reader.member or vars.member"), ("hall", "string", "vars['shelf'][0]"),
        ("row", "string", "vars['shelf'][1]"), ("longest", "integer", "max(source.days, reader.longest)", "source.kind == 'returned' and source.late"), ("topics", "set", "reader.topics.add(source.topic)"),
        ("fines", "map", "reader.fines.increment(source.fine)", "source.kind == 'fined' and source.fine"),
        ("channel", "string", "'net' if 'web' in source.channel else 'desk'", "reader.age > 17 and reader.age < 65"),
    ]),
    aggregate("Block", "stay", [
        ("events", "integer", "stay.events + 1"), ("late", "integer", "stay.late + 1", "source.kind == 'returned' and source.late"), ("loans", "list", "stay.loans.append(source.days)", "source.kind == 'loan'"),
        ("topics", "map", "stay.topics.increment(source.topic)", "source.late is True"), ("first_pages", "integer", "source.pages", "time == stay._start_time"), ("last_pages", "integer", "source.pages", "time == stay._end_time"), ("seconds", "float", "(time - stay._start_time).total_seconds()", "source.kind != 'loan'"),
    ], [("stay_id", "string", "source.stay_id")]),
    identity="source.card", time="source.t",
)


def library_events(n=400, seed=5):
    r = random.Random(seed)
    out = []
    for i in range(n):
        out.append({
            "card": r.choice(["c1", "c2", "c3", None]), "t": dt.datetime(2021, 5, 3, tzinfo=UTC) + dt.timedelta(seconds=r.randint(0, 900)), "stay_id": r.choice(["s1", "s2", "s3", None]), "kind": r.choice(["entry", "loan", "returned", "fined", "card_issued"]),
            "town": r.choice([None, "Ulm", "Jena"]), "age": r.choice([None, 12, 30, 70]), "shelf-mark": r.choice([None, "north-7-b", "south"]), "days": r.choice([None, 1, 14, 21, 28]),
            "pages": r.choice([None, 0, 180, 570]), "topic": r.choice([None, "art", "law", "sea"]), "late": r.choice([None, True, False]), "channel": r.choice([None, "web form", "mail"]), "fine": r.choice([None, "", "torn", "lost"]), "seq": i,
        })
    return out


LIBRARY_SCHEMA = "card string, t timestamp, stay_id string, kind string, town string, age long, `shelf-mark` string, days long, pages long, topic string, late boolean, channel string, fine string, seq long"


def naive(v):
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


@pytest.mark.parametrize("seed", range(2))
def test_plans_equal_event_by_event_evaluation(spark, seed):
    events = library_events(seed=seed)
    df = spark.createDataFrame([tuple(e.values()) for e in events], LIBRARY_SCHEMA)
    engine = Engine(LIBRARY)
    want = {"reader": [], "stay": []}
    for who in ("c1", "c2", "c3"):
        online = Online(LIBRARY, who)
        for e in sorted(events, key=lambda e: (e["t"], e["seq"])):
            online.evaluate(e)
        for name, blocks in online.blocks().items():
            want[name] += [{k: naive(v) for k, v in b.items()} for b in blocks]
    for fold in (False, True):
        for name, made in engine.blocks(df, "seq", fold=fold).items():
            got = [r.asDict() for r in made.collect()]
            key = lambda b: (b["_identity"], b.get("stay_id") or "")
            assert sorted(got, key=key) == sorted(want[name], key=key), (name, fold)
        assert engine.tiers == ({"reader": "C", "stay": "C"} if fold else {"reader": "B", "stay": "A"})


@pytest.mark.parametrize("seed", range(2))
def test_values_at_the_start_and_since_it_are_carried_on(spark, seed):
    """In one run they are aggregates; onto earlier blocks they take the running form. Both give the same, late events apart."""
    events = sorted(library_events(seed=seed), key=lambda e: (e["t"], e["seq"]))
    frame = lambda es: spark.createDataFrame([tuple(e.values()) for e in es], LIBRARY_SCHEMA)
    spec = stream(*[a for a in LIBRARY["Aggregates"] if a["Name"] == "stay"], identity="source.card", time="source.t")
    engine = Engine(spec)
    whole = engine.blocks(frame(events), "seq")["stay"]
    first = engine.blocks(frame(events[:150]), "seq", variables=True)
    assert engine.tiers["stay"] == "A"
    then = engine.blocks(frame(events[150:]), "seq", first)["stay"]
    assert engine.tiers["stay"] == "B"
    by_key = lambda df: {(r._identity, r.stay_id): r.asDict() for r in df.collect()}
    assert by_key(then) == by_key(whole)


def test_block_sums_over_dimensions_out_of_order(spark):
    rows = [("m", "n", 5, 1), ("m", "d", 7, 2), ("m", "n", 6, 3), ("m", "p", 40, 9), ("m", "p", 2, 5)]
    df = spark.createDataFrame([(u, k, v, dt.datetime(2021, 5, 3) + dt.timedelta(hours=h)) for u, k, v, h in rows], "meter string, tariff string, v long, t timestamp")
    spec = stream(aggregate("Identity", "kept", [("sum", "integer", "kept.sum + source.v"), ("count", "integer", "kept.count + 1")], [("tariff", "string", "source.tariff"), ("code", "integer", "ord(source.tariff)")]), identity="source.meter", time="source.t")
    assert plain(Engine(spec).blocks(df)["kept"]) == [("m", 7, 1, "d", 100), ("m", 11, 2, "n", 110), ("m", 42, 2, "p", 112)]
    failing = stream(aggregate("Identity", "kept", [("sum", "integer", "kept.sum + source.v")], [("tariff", "string", "source.tariff if source.tariff == 'd' else source.gone + 1")]), identity="source.meter", time="source.t")
    assert plain(Engine(failing).blocks(df)["kept"]) == [("m", 7, "d")]


def test_activity_splits_only_after_more_than_the_gap(spark):
    base = dt.datetime(2021, 5, 3, 9)
    rows = [("u", v, base + dt.timedelta(seconds=s)) for v, s in ((3, 0), (5, 10), (7, 70), (11, 70 + 1200), (100, 7200), (1000, 86_400))]
    spec = stream(aggregate("Activity", "s", [("sum", "integer", "s.sum + source.v"), ("count", "integer", "s.count + 1")], SeparateByInactiveSeconds=1200), identity="source.id", time="source.t")
    got = Engine(spec).blocks(spark.createDataFrame(rows, "id string, v long, t timestamp"))["s"]
    assert sorted((r["sum"], r["count"]) for r in got.collect()) == [(26, 4), (100, 1), (1000, 1)]


def test_sessions_that_cross_midnight_are_one(spark):
    base = dt.datetime(2018, 1, 1, 23, 50)
    rows = [("u", i, base + dt.timedelta(minutes=10 * i), f"k{i % 2}") for i in range(200)]
    fields = [("n", "integer", "s.n + 1"), ("seen", "list", "s.seen.append(source.v)"), ("kinds", "map", "s.kinds.increment(source.k)"), ("last", "string", "source.k"), ("lasts", "map", "s.lasts.set(source.k, source.v)")]
    spec = stream(aggregate("Activity", "s", fields, SeparateByInactiveSeconds=600), identity="source.id", time="source.t")
    (r,) = Engine(spec).blocks(spark.createDataFrame(rows, "id string, v long, t timestamp, k string"))["s"].collect()
    assert (r.n, r.seen, r.kinds, r["last"], r.lasts) == (200, list(range(200)), {"k0": 100, "k1": 100}, "k1", {"k0": 198, "k1": 199})


BLOCKS = [("p", 1, f"{D}02:00:00"), ("p", 2, f"{D}05:00:00"), ("p", 3, f"{D}07:30:00"), ("p", 4, f"{D}08:45:00"), ("p", 5, "2021-05-04T07:30:00"), ("p", 6, "2021-05-04T09:00:00")]


@pytest.mark.parametrize("kind,value,want", [("day", 1, [4]), ("day", 2, [4, 5, 6]), ("day", -1, [1, 2]), ("hour", 1, None), ("hour", 2, [4]), ("hour", -3, [2]), ("hour", -6, [1, 2]), ("count", -1, [2]), ("count", 3, [4, 5, 6]), ("count", 4, None), ("count", -2, [1, 2])])
def test_window_views(spark, kind, value, want):
    df = spark.createDataFrame([(u, e, at(t)) for u, e, t in BLOCKS], "_identity string, events long, _start_time timestamp").selectExpr("_identity", "_start_time", "_start_time as _end_time", "events")
    spec = stream(aggregate("Activity", "session", [("events", "integer", "source.e")], SeparateByInactiveSeconds=1))
    engine = Engine(spec, windows(window("near", kind, value, [("list", "list", "source.events"), ("total", "integer", "sum(source.events)")]), condition="own.session.events == 3"))
    got = engine.windowed({"session": df}).collect()
    assert [r["near.list"] for r in got] == ([] if want is None else [want])
    assert [r["near.total"] for r in got] == ([] if want is None else [sum(want)])


def test_count_windows_do_not_see_blocks_of_the_same_start(spark):
    t = [at("2018-03-07T00:00:00") + dt.timedelta(hours=h) for h in (1, 2, 2, 3)]
    df = spark.createDataFrame([("u", t[i], t[i], i, f"d{i}") for i in range(4)], "_identity string, _start_time timestamp, _end_time timestamp, n long, d string")
    spec = stream(aggregate("Block", "b", [("n", "integer", "source.n")], [("d", "string", "source.d")]))
    for value, want in ((-1, {1: [0], 2: [0], 3: [2]}), (1, {0: [1], 1: [3], 2: [3]}), (-2, {3: [1, 2]})):
        got = Engine(spec, windows(window("w", "count", value, [("n", "list", "source.n"), ("own", "integer", "anchor.n")], source="own.b"), condition="own.b.n >= 0")).windowed({"b": df}).collect()
        assert {r["w.own"]: r["w.n"] for r in got} == want


@pytest.mark.parametrize("most,want", [(1, 2), (2, 3), (None, 5)])
def test_anchors_per_day(spark, most, want):
    df = spark.createDataFrame([(u, at(t), at(t), e) for u, e, t in BLOCKS], "_identity string, _start_time timestamp, _end_time timestamp, events long").filter("events <> 5")
    spec = stream(aggregate("Activity", "session", [("events", "integer", "source.e")], SeparateByInactiveSeconds=1))
    win = windows(aggregate("Variable", "v", [("e", "integer", "anchor.events")]), **({"Max": most} if most else {}))
    assert Engine(spec, win).windowed({"session": df}).count() == want


def test_empty_events_and_unknown_names(spark):
    empty = beds(spark, [])
    assert all(df.count() == 0 for df in Engine(BEDS).blocks(empty, "seq").values())
    assert Engine(BEDS, BEDS_WINDOW).features(empty, "seq").count() == 0
    from strandline.plans.expr import UnknownName

    bad = stream(aggregate("Identity", "state", [("x", "integer", "nowhere.x + 1")]), identity="source.bed", time="parse(source.read_at)")
    with pytest.raises(UnknownName):
        Engine(bad).blocks(empty)


def test_order_of_input_rows_does_not_matter(spark):
    rows = FIRST + SECOND
    df = beds(spark, rows)
    for name, made in Engine(BEDS).blocks(df.orderBy("crop", "bed"), "seq").items():
        assert plain(made) == plain(Engine(BEDS).blocks(df, "seq")[name])


def test_imports_are_looked_up_in_a_list(spark):
    from strandline.plans.imports import UnknownImport

    df = readers.records(spark, [{"u": "a", "t": dt.datetime(2020, 1, 1), "v": 5.5}], "u string, t timestamp, v double")
    fields = [("a", "integer", "math.floor(source.v)"), ("b", "float", "root(source.v - 1.5)"), ("c", "float", "mean([source.v, 1.5])"), ("d", "float", "math.hypot(3, 4)"), ("e", "float", "math.sqrt(-source.v)"), ("f", "datetime", "p('Mar 4 2018')"), ("g", "datetime", "datetime.datetime(2020, 1, 2)"), ("h", "integer", "s.h + math.ceil(source.v) + s.a")]
    spec = stream(aggregate("Identity", "s", fields), identity="source.u", time="source.t", Import=[{"Module": "math"}, {"Module": "math", "Identifiers": ["sqrt as root"]}, {"Module": "statistics", "Identifiers": ["mean"]}, {"Module": "dateutil.parser", "Identifiers": ["parse as p"]}, {"Module": "datetime"}])
    for fold in (False, True):
        r = Engine(spec).blocks(df, fold=fold)["s"].collect()[0]
        assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h) == (5, 2.0, 3.5, 5.0, 0.0, dt.datetime(2018, 3, 4), dt.datetime(2020, 1, 2), 11)
    for bad in ({"Module": "os"}, {"Module": "math", "Identifiers": ["nothing"]}, {"Module": "subprocess", "Identifiers": ["run"]}):
        with pytest.raises(UnknownImport):
            Engine(spec | {"Import": [bad]})
    dated = stream(aggregate("Identity", "s", [("a", "datetime", "D.strptime('3.4.2020', '%d.%m.%Y')"), ("b", "datetime", "d.datetime.fromtimestamp(5)"), ("c", "datetime", "D(2020, 1, 2)")]), identity="source.u", time="source.t", Import=[{"Module": "datetime", "Identifiers": ["datetime as D"]}, {"Module": "datetime as d"}])
    assert tuple(Engine(dated).blocks(df)["s"].collect()[0])[1:] == (dt.datetime(2020, 4, 3), dt.datetime(1970, 1, 1, 0, 0, 5), dt.datetime(2020, 1, 2))
    own = spec | {"Import": [{"Module": "our.own", "Identifiers": ["mean"]}, {"Module": "math"}, {"Module": "math", "Identifiers": ["sqrt as root"]}, {"Module": "dateutil.parser", "Identifiers": ["parse as p"]}, {"Module": "datetime"}]}
    assert Engine(own, python_functions={"mean": lambda x: -1.0}).blocks(df)["s"].collect()[0].c == -1.0


def test_events_are_keyed_once_if_asked(spark):
    df = beds(spark, FIRST + SECOND)
    engine = Engine(BEDS, once=True)
    made = engine.blocks(df, "seq")
    for name, plan in ((n, d._jdf.queryExecution().executedPlan().toString()) for n, d in made.items()):
        assert "keyed-events" in plan and "ExistingRDD" not in plan, name
        assert plain(made[name]) == plain(Engine(BEDS).blocks(df, "seq")[name])


@pytest.mark.parametrize("more", [False, True])
def test_sessions_and_identities_share_fragments(spark, more):
    r = random.Random(9)
    rows = [(r.choice("abc"), dt.datetime(2021, 5, 3) + dt.timedelta(minutes=r.randint(0, 5000)), r.choice([None, 1, 2, 3]), r.choice([None, "x", "y"]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "u string, t timestamp, v long, k string, seq long")
    fields = lambda a: [("n", "integer", f"{a}.n + 1"), ("total", "integer", f"{a}.total + source.v"), ("low", "integer", f"min(source.v, {a}.low)"), ("last", "string", "source.k"), ("all", "list", f"{a}.all.append(source.v)"), ("kinds", "set", f"{a}.kinds.add(source.k)"), ("per", "map", f"{a}.per.increment(source.k)"), ("lasts", "map", f"{a}.lasts.set(source.k, source.v)"), ("any", "boolean", f"{a}.any or source.v == 3")]
    extra = [aggregate("Block", "daily", [("n", "integer", "daily.n + 1")], [("day", "string", "str(time.date())")])] if more else []
    spec = stream(aggregate("Activity", "s", [*fields("s"), ("first", "string", "source.k", "time == s._start_time"), ("span", "float", "(time - s._start_time).total_seconds()")], SeparateByInactiveSeconds=1800), aggregate("Identity", "i", fields("i")), *extra, identity="source.u", time="source.t")
    made, want = Engine(spec, once=True).blocks(df, "seq"), Engine(spec).blocks(df, "seq")
    for name in want:
        by_key = lambda d: sorted((r.asDict() for r in d.collect()), key=lambda r: (r["_identity"], str(r.get("_start_time"))))
        assert by_key(made[name]) == by_key(want[name])
        plan = made[name]._jdf.queryExecution().executedPlan().toString()
        assert "ExistingRDD" not in plan and ("fragments" in plan) == (name != "daily")


def test_time_since_a_start_in_its_several_forms(spark):
    rows = [("a", 0, 1), ("a", 90_000, 2), ("a", 200_000, None), ("b", 5, None)]
    df = spark.createDataFrame([(u, dt.datetime(2021, 5, 3) + dt.timedelta(seconds=s), v, i) for i, (u, s, v) in enumerate(rows)], "u string, t timestamp, v long, seq long")
    forms = {"days": "(time - b._start_time).days", "whole": "int((time - b._start_time).total_seconds() / 3600)", "back": "abs((b._start_time - time).total_seconds())", "hour": "time.hour - b._start_time.hour", "mixed": "(time - b._start_time).days + source.v", "late": "(time - b._start_time).days"}
    fields = [(n, "float", x, *(["source.v"] if n == "late" else [])) for n, x in forms.items()]
    spec = stream(aggregate("Block", "b", fields, [("u", "string", "source.u")]), identity="source.u", time="source.t")
    for fold in (False, True):
        got = {r._identity: tuple(r[n] for n in forms) for r in Engine(spec).blocks(df, "seq", fold=fold)["b"].collect()}
        assert got == {"a": (2.0, 55.0, 200_000.0, 7.0, 3.0, 1.0), "b": (0.0,) * 6}, fold


def test_values_at_a_start_need_no_window(spark):
    plan = Engine(LIBRARY).blocks(spark.createDataFrame([], LIBRARY_SCHEMA), "seq")["stay"]._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_failed_values_are_counted(spark):
    rows = [("a", "7"), ("a", "x"), ("b", None), ("b", "")]
    df = spark.createDataFrame([(u, dt.datetime(2021, 5, 3), v) for u, v in rows], "u string, t timestamp, v string")
    spec = stream(aggregate("Identity", "s", [("n", "integer", "s.n + 1"), ("v", "integer", "source.v"), ("w", "integer", "int(source.v)", "source.v"), ("x", "float", "0.5 * s.x + 1"), ("y", "string", "'{}'.format(source.v.upper())")]), identity="source.u", time="source.t")
    assert Engine(spec).failures(df) == {"s.n": 0, "s.v": 3, "s.w": 1, "s.y": 1}
    assert Engine(spec).failures(df.limit(0)) == {"s.n": 0, "s.v": 0, "s.w": 0, "s.y": 0}


def test_window_fields_without_a_column_form(spark):
    df = spark.createDataFrame([(u, at(t), at(t), e) for u, e, t in BLOCKS], "_identity string, _start_time timestamp, _end_time timestamp, events long")
    spec = stream(aggregate("Activity", "session", [("events", "integer", "source.e")], SeparateByInactiveSeconds=1))
    fields = [("mean", "float", "round(sum(source.events) / 3, 2)"), ("text", "string", "'{:02d}'.format(max(source.events))"), ("odd", "boolean", "any(e % 2 for e in source.events)"), ("peak", "integer", "sorted(source.events, reverse=True)[0] * anchor.events")]
    got = Engine(spec, windows(window("w", "count", -3, fields), condition="own.session.events == 6")).windowed({"session": df}).collect()
    assert [tuple(r)[2:] for r in got] == [(4.0, "05", True, 30)]
    from strandline.plans.expr import UnknownName, Unsupported

    for bad in ("source.events.encode()", "nowhere(source.events)"):
        with pytest.raises((Unsupported, UnknownName)):
            Engine(spec, windows(window("w", "count", -3, [("x", "integer", bad)]), condition="own.session.events == 6")).windowed({"session": df})


def test_imported_functions(spark):
    from pyspark.sql import functions as F

    from strandline.plans.expr import V

    spec = stream(aggregate("Identity", "state", [("x", "integer", "twice(source.v)")]), identity="source.u", time="source.t")
    df = readers.records(spark, [{"u": "a", "t": dt.datetime(2020, 1, 1), "v": 4}], "u string, t timestamp, v long")
    assert Engine(spec, functions={"twice": lambda v: V(v.col * F.lit(2), "int", err=v.err)}).blocks(df)["state"].collect()[0].x == 8


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo", "Asia/Tokyo"])
def test_times_without_a_zone_are_utc(spark, zone):
    from pyspark.sql import functions as F

    spec = stream(aggregate("Block", "b", [("n", "integer", "b.n + 1"), ("same", "boolean", "source.n == parse(source.s)")], [("u", "string", "source.u")]), identity="source.u", time="source.n")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([("a", "2020-06-01 10:00:00"), ("a", "2020-06-01 11:30:00")], "u string, s string").withColumn("n", F.col("s").cast("timestamp_ntz"))
        r = Engine(spec).blocks(df)["b"].select(F.unix_micros("_start_time").alias("st"), F.unix_micros("_end_time").alias("et"), "n", "same").collect()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert (r.st, r.et, r.n, r.same) == (1591005600000000, 1591011000000000, 2, True)
