import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import packing
from strandline.llm.tokens import token_count

WORDS = "river stone cloud matrix vector sample learning curve batch café größe данные 数据 分割".split()
SCHEMA = "doc_id long, text string, repo string, shard int, terms string, tokens int"


def documents(n=300, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        topic = r.sample(WORDS, 4)
        text = " ".join(r.choice(topic) for _ in range(r.choice([0, 1, 5, 20, 60, 400])))
        rows.append((i, text, "hot" if r.random() < 0.4 else f"r{r.randint(0, 20)}"))
    return [*rows, (n, None, "hot"), (n + 1, "", None), (n + 2, "x" * 5000, None), (n + 3, "same text", "hot"), (n + 3, "same text", "hot"), (None, "no id", "hot")]


def packed(spark, rows, capacities=(64, 1000), shard_tokens=8_000):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    bins = spark.createDataFrame([(f"b{c}", c) for c in capacities], "bin_name string, capacity_tokens long")
    return packing.pack(df, bins, F.col("doc_id"), F.col("text"), F.col("repo"), shard_tokens=shard_tokens)


@pytest.fixture(scope="module")
def placed(spark):
    return packed(spark, documents()).collect()


def test_every_piece_is_placed_once_and_nothing_overflows(placed):
    size = Counter()
    for i, t, _ in documents():
        size[i, len((t or "").encode())] += 1
    want = Counter()
    for (i, n), times in size.items():
        for c in (64, 1000):
            for p in range(max(1, math.ceil(n / c))):
                want[f"b{c}", i, p, p * c, min(c, n - p * c)] += times
    assert Counter((r.bin_name, r.doc_id, r.piece, r.piece_start, r.piece_tokens) for r in placed) == want
    boxes = defaultdict(list)
    for r in placed:
        boxes[r.bin_name, r.shard, r.container].append(r)
    for rs in boxes.values():
        assert sum(r.piece_tokens for r in rs) <= rs[0].capacity
        assert sorted(r.slot for r in rs) == list(range(len(rs)))


def test_several_shards_and_little_space_is_left(spark, placed):
    assert len({r.shard for r in placed}) > 3 and min(r.shard for r in placed) < 0
    report = packing.container_report(packed(spark, documents(), shard_tokens=10**9)).collect()
    assert {r.bin_name: r.filled > 0.97 for r in report} == {"b64": True, "b1000": True}


def test_cut_documents(spark, placed):
    got = {tuple(r) for r in packing.cut_documents(packed(spark, documents())).collect()}
    assert got == {(f"b{c}", i) for i, t, _ in documents() for c in (64, 1000) if len((t or "").encode()) > c}


def test_a_document_of_exactly_the_capacity_is_whole(spark):
    got = packed(spark, [(1, "a" * 64, "r"), (2, "a" * 128, "r"), (3, "a" * 65, "r")], (64,)).collect()
    assert sorted((r.doc_id, r.piece, r.piece_tokens) for r in got) == [(1, 0, 64), (2, 0, 64), (2, 1, 64), (3, 0, 64), (3, 1, 1)]


def test_empty_table_and_bad_capacities(spark):
    assert packed(spark, []).count() == 0
    with pytest.raises(ValueError):
        packed(spark, documents(3), (0,))


def plain_terms(text):
    """Letter runs of two bytes or more in lower case, ideographs and kana each on their own."""
    sign = "[぀-鿿]"
    ascii_lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return [w for w in re.findall(f"{sign}|(?:(?!{sign})[a-z\u0080-\U0010ffff])+", ascii_lower) if len(w.encode()) > 1]


@pytest.mark.parametrize("texts", [["Big river, big STONE", "a bc x9y zz", "", "café数据café b"], ["", "", ""], ["数", "x", "é"], ["word" * 50 + " end"]])
def test_terms_are_those_of_the_words(texts):
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    keys = packing.term_keys(np.frombuffer(data, np.uint8), offsets)
    got = defaultdict(list)
    for k in keys:
        got[int(k) >> packing.TERM_BITS].append(int(k) & ((1 << packing.TERM_BITS) - 1))
    alone = lambda w: int(packing.term_keys(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0])
    for d, t in enumerate(texts):
        assert Counter(got[d]) == Counter(alone(w) for w in plain_terms(t))


def test_scores_are_bm25_by_brute_force():
    r = random.Random(4)
    docs = [[r.randint(0, 30) for _ in range(r.randint(0, 40))] for _ in range(60)]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    idf = np.array([math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in range(31)], np.float32)
    terms = [np.array(sorted(set(d)), np.int32) for d in docs]
    counts = [np.array([d.count(t) for t in ts], np.int32) for d, ts in zip(docs, terms)]
    index = packing.Index(terms, counts, np.array([len(d) for d in docs], np.int64), idf, mean)
    for q in range(n):
        want = []
        for d in docs:
            norm = packing.K1 * (1 - packing.B + packing.B * len(d) / mean)
            want.append(sum(idf[t] * d.count(t) * (packing.K1 + 1) / (d.count(t) + norm) for t in set(docs[q])))
        assert np.allclose(index.scores(q), want, rtol=1e-4)


def test_nearest_are_the_highest_scores_in_order():
    r = np.random.default_rng(2)
    for n, most in ((50, 10), (5, 10), (200, 200)):
        scores = r.integers(0, 12, n).astype(float)
        got = packing.best_first(scores, most)
        assert sorted(scores[got], reverse=True) == list(scores[got]) == sorted(scores, reverse=True)[:most]


@pytest.mark.parametrize("seed", range(3))
def test_a_kept_ranking_changes_nothing_but_the_work(seed):
    """With a ranking as long as the shard, filling goes as it would by the scores alone."""
    r = np.random.default_rng(seed)
    sizes, score = r.integers(1, 60, 150), r.random((150, 150))
    plain = packing.fill(sizes, 200, lambda i: score[i])
    assert packing.fill(sizes, 200, lambda i: score[i], lambda i: packing.best_first(score[i], 150)) == plain


def test_loose_containers_are_packed_again_by_their_neighbours(spark):
    """Topics of two documents each, alone in their shards: what is left of all shards must meet by topic."""
    topics = ["aaa bbb ccc", "ddd eee fff", "ggg hhh iii", "jjj kkk lll"]
    rows = [(i, " ".join([topics[i % 4]] * 40)[:450], f"host{i}") for i in range(8)]
    got = packed(spark, rows, (1000,), 8_000)
    assert {r.shard < 0 for r in got.collect()} == {True}
    boxes = defaultdict(set)
    for r in got.collect():
        boxes[r.shard, r.container].add(r.doc_id % 4)
    assert all(len(b) == 1 for b in boxes.values()) and len(boxes) == 4


def test_capacity_must_be_small_beside_a_shard(spark):
    with pytest.raises(ValueError, match="shard_tokens"):
        packed(spark, documents(3), (64, 2000), 8_000)


def test_the_check_finds_what_is_wrong(spark):
    df = spark.createDataFrame([(1, "a" * 10), (2, "b" * 30), (3, None)], "doc_id long, text string")
    schema = "bin_name string, capacity long, shard long, container int, slot int, doc_id long, piece int, piece_start long, piece_tokens long"
    check = lambda rows: packing.packing_check(df, spark.createDataFrame(rows, schema), F.col("doc_id"), F.col("text")).collect()[0]
    good = [("b", 20, 0, 0, 0, 1, 0, 0, 10), ("b", 20, 0, 0, 1, 2, 1, 20, 10), ("b", 20, 0, 1, 0, 2, 0, 0, 20), ("b", 20, 0, 0, 2, 3, 0, 0, 0)]
    assert tuple(check(good).asDict()[c] for c in ("n_pieces", "tokens", "n_overfull", "n_uncalled_cuts", "n_misplaced")) == (4, 40, 0, 0, 0)
    bad = [("b", 20, 0, 0, 0, 1, 0, 0, 5), ("b", 20, 0, 0, 1, 1, 1, 5, 5), ("b", 20, 0, 0, 2, 2, 0, 0, 20), ("b", 20, 0, 1, 0, 3, 0, 0, 1)]
    assert tuple(check(bad).asDict()[c] for c in ("n_overfull", "n_uncalled_cuts", "n_misplaced")) == (1, 1, 2)


def test_a_host_with_a_third_of_all_tokens_is_split(spark):
    rows = [(7, "word " * 60, "hot")] * 100 + [(i, "text " * 30, f"h{i}") for i in range(300)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).withColumn("row", F.monotonically_increasing_id())
    vectors = df.select(F.col("doc_id").alias("id"), F.xxhash64("repo").alias("host"), F.length("text").cast("long").alias("tokens"), "row")
    per_shard = [r["sum(tokens)"] for r in packing._sharded(vectors, 8_000).groupBy("shard").agg(F.sum("tokens")).collect()]
    assert sum(per_shard) == sum(len(t) for _, t, _ in rows) and max(per_shard) < 2 * 8_000


def test_neighbours_share_a_container():
    """Three topics of four items each, and containers of four: every container holds one topic."""
    topic = np.repeat([0, 1, 2], 4)
    boxes = packing.fill(np.full(12, 25), 100, lambda i: (topic == topic[i]).astype(float))
    assert sorted(sorted(topic[b].tolist()) for b in boxes) == [[0] * 4, [1] * 4, [2] * 4]


@pytest.mark.parametrize("seed", range(5))
def test_fill_places_each_item_once(seed):
    r = np.random.default_rng(seed)
    sizes = r.integers(0, 50, 200)
    boxes = packing.fill(sizes, 64, lambda i: r.random(200))
    assert sorted(i for b in boxes for i in b) == list(range(200))
    assert all(sizes[b].sum() <= 64 for b in boxes)
    assert sizes.sum() / (64 * len(boxes)) > 0.9


def test_sizes_by_several_tokenizers(spark):
    P = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([("héllo <|endoftext|>",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(token_count(F.col("t"))).collect()] == [20, 0, 0]
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        first, *rest = [r[0] for r in df.select(token_count(F.col("t"), P.path(name))).collect()]
        assert 3 < first < 20 and rest == [0, 0]
    with pytest.raises(Exception, match="unknown kind"):
        df.select(token_count(F.col("t"), "/no/such.kind")).collect()
