"""Documents packed into containers of fixed capacity, each beside lexically close ones.

The corpus is cut into shards of bounded size: documents of one host stay together, hosts that outgrow a shard are
split. Every shard has a BM25 inverted index of its documents. The largest unused document opens a container, the
index returns its neighbours by score, and the unused ones fill the container greedily; what they leave is filled by
the largest documents that fit. Containers of a shard that stay loose, mostly its last ones, are emptied and packed
in the same way once more, together with those of other shards. Document frequencies and lengths in the scores are
those of the whole corpus.

Terms are letter sequences (single characters for ideographs and kana), hashed into 2**18 numbers, so the table of
document frequencies has a fixed size. Whole texts are read; terms are found by array operations on their bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.tokens import token_count
from strandline.session import materialize
from strandline.tables import bounded_rows

TERM_BITS = 18
#: Tokens in a shard at most, somewhat more if a split host falls unluckily. Many times the largest capacity, and little enough for a task.
SHARD_TOKENS = 8_000_000
#: Documents in a shard at most, in the same way, where they are tiny.
SHARD_DOCS = 100_000
K1, B = 1.2, 0.75
MOST_BINS = 50
#: A shard must hold at least so many of the largest container, or its last, loose ones would be most of it.
LEAST_CONTAINERS = 8
#: Neighbours that are kept ranked for each document that opens a container; beyond them its scores are computed again.
NEAREST = 1024
_KEPT_RANKINGS = 16_384
_SLICE = 1 << 21

_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_CLASS[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_CLASS[128:] = np.arange(128, 256)
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def term_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """document << TERM_BITS | term, for each term of the UTF-8 bytes ``data`` of the documents cut at ``offsets``."""
    v = _CLASS[data]
    letter = v > 0
    if not letter.any():
        return np.zeros(0, np.int64)
    sign = (data >= 0xE3) & (data <= 0xE9)  # lead bytes of kana and ideographs, three bytes each
    begin = letter.copy()
    begin[1:] &= ~letter[:-1] | sign[1:]
    begin[3:] |= letter[3:] & sign[:-3]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    begin[inner] = letter[inner]
    where = np.flatnonzero(letter)
    first = np.flatnonzero(begin[where])
    length = np.diff(np.append(first, len(where)))
    place = np.arange(len(where)) - np.repeat(first, length)
    part = (v[where].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 63]
    h = np.add.reduceat(part, first)
    h ^= h >> np.uint64(29)
    term = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - TERM_BITS)).astype(np.int64)
    doc = np.searchsorted(offsets, where[first], side="right") - 1
    return (doc[length > 1] << TERM_BITS) | term[length > 1]


_VECTOR = "id bigint, host long, tokens long, row long, length long, terms binary, counts binary"


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _VECTOR.split(", ")]
    for b in batches:
        text = b.column(4).cast(pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        start = 0
        while start < len(text):
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + _SLICE, side="right")) - 1)
            lo, hi = offsets[start], offsets[stop]
            keys, counts = np.unique(term_keys(data[lo:hi], offsets[start : stop + 1] - lo), return_counts=True)
            cut = np.searchsorted(keys, np.arange(stop - start + 1) << TERM_BITS)
            terms, counts = (keys & ((1 << TERM_BITS) - 1)).astype("<i4"), counts.astype("<i4")
            total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            piece = b.slice(start, stop - start)
            sliced = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), piece.column(1).cast(pa.int64()), piece.column(2).cast(pa.int64()), piece.column(3).cast(pa.int64()), pa.array(total[cut[1:]] - total[cut[:-1]]), sliced(terms), sliced(counts)], names=names)
            start = stop


def _term_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(1 << TERM_BITS, np.int64)
    for b in batches:
        joined = b"".join(x for x in b.column(0).to_pylist() if x)
        df += np.bincount(np.frombuffer(joined, "<i4"), minlength=len(df))
    seen = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(df[seen])], names=["term", "df"])


class Index:
    """BM25 inverted index over the documents of one shard."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], lengths: np.ndarray, idf: np.ndarray, mean_length: float):
        self.terms, self.n = terms, len(terms)
        doc = np.repeat(np.arange(self.n, dtype=np.int32), [len(t) for t in terms])
        term = np.concatenate(terms) if self.n else np.zeros(0, np.int32)
        tf = np.concatenate(counts).astype(np.float32) if self.n else np.zeros(0, np.float32)
        norm = (K1 * (1 - B + B * lengths / max(mean_length, 1e-9))).astype(np.float32)
        weight = idf[term] * tf * np.float32(K1 + 1) / (tf + norm[doc])
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.present, begin = np.unique(term[order], return_index=True)
        self.begin = np.append(begin, len(order))
        self.rankings: dict[int, np.ndarray] = {}
        self.last: tuple[int, np.ndarray] = (-1, np.zeros(0))

    def scores(self, d: int) -> np.ndarray:
        """BM25 scores of all documents of the shard for the terms of document ``d``; the last ones are kept."""
        if self.last[0] != d:
            self.last = d, self._scores(d)
        return self.last[1]

    def _scores(self, d: int) -> np.ndarray:
        spot = np.searchsorted(self.present, self.terms[d])
        lo, hi = self.begin[spot], self.begin[spot + 1]
        size = hi - lo
        total = int(size.sum())
        if not total:
            return np.zeros(self.n)
        at = np.arange(total) + np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        return np.bincount(self.doc[at], self.weight[at], minlength=self.n)

    def nearest(self, d: int) -> np.ndarray:
        """The documents with the highest scores for ``d``, NEAREST at most, best first; ranked once for all kinds of container."""
        found = self.rankings.get(d)
        if found is None:
            found = best_first(self.scores(d), NEAREST).astype(np.int32)
            if len(self.rankings) < _KEPT_RANKINGS:
                self.rankings[d] = found
        return found


def best_first(scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores, highest first and equal ones in order."""
    near = np.arange(len(scores)) if len(scores) <= most else np.sort(np.argpartition(-scores, most - 1)[:most])
    return near[np.argsort(-scores[near], kind="stable")]


class _Unused:
    """The items not yet placed, by falling size: the largest that fits a space, and the smallest of all."""

    def __init__(self, sizes: np.ndarray):
        self.order = np.lexsort((np.arange(len(sizes)), -sizes))
        self.falling = -sizes[self.order]
        self.place = np.empty(len(sizes), np.int64)
        self.place[self.order] = np.arange(len(sizes))
        self.unused = np.ones(len(sizes), bool)
        self.skip = np.arange(len(sizes) + 1)  # the next unused place, found by following it
        self.end = len(sizes)

    def take(self, items) -> None:
        self.unused[items] = False
        at = self.place[items]
        self.skip[at] = at + 1

    def fitting(self, left: int) -> int:
        """The largest unused item of at most ``left``, or -1."""
        p = int(np.searchsorted(self.falling, -left))
        root = p
        while self.skip[root] != root:
            root = int(self.skip[root])
        while self.skip[p] != root and p != root:
            self.skip[p], p = root, int(self.skip[p])
        return int(self.order[root]) if root < len(self.order) else -1

    def smallest(self) -> int | None:
        while self.end and not self.unused[self.order[self.end - 1]]:
            self.end -= 1
        return int(-self.falling[self.end - 1]) if self.end else None


def fill(sizes: np.ndarray, capacity: int, scores, nearest=None) -> list[list[int]]:
    """Items of ``sizes`` <= ``capacity``, each in exactly one container.

    ``scores(i)`` scores all items as neighbours of i; ``nearest(i)``, where given, has the best of them ranked. The
    largest unused item opens a container. Its neighbours follow by falling score as long as they fit. Once the next
    of them would leave too little for any unused item, the largest that fits closes the container. Items of size 0
    go with the first container.
    """
    rest = _Unused(sizes)
    out: list[list[int]] = []

    def follow(ranked: np.ndarray, items: list[int], left: int) -> int:
        """Takes ranked items in turn while each leaves room for another one; what is left then."""
        ranked = ranked[rest.unused[ranked] & (sizes[ranked] <= left)]
        while len(ranked):
            upto = np.cumsum(sizes[ranked])
            sure = int(np.searchsorted(upto, left, side="right")) - 1  # all that fit one after another, but for the last
            if sure > 0:
                rest.take(ranked[:sure])
                items.extend(ranked[:sure].tolist())
                left -= int(upto[sure - 1])
            else:
                one, sure = int(ranked[0]), 1
                if left - int(sizes[one]) < rest.smallest():  # the last that comes in: the largest, and of these the nearest
                    largest = rest.fitting(left)
                    alike = ranked[sizes[ranked] == sizes[largest]]
                    one = int(alike[0]) if len(alike) else largest
                rest.take(one)
                items.append(one)
                left -= int(sizes[one])
                if one != ranked[0]:
                    break
            ranked = ranked[sure:]
            ranked = ranked[sizes[ranked] <= left]
        return left

    for seed in rest.order:
        if not rest.unused[seed]:
            continue
        rest.take(seed)
        items, left = [int(seed)], capacity - int(sizes[seed])
        least = rest.smallest()
        if least is not None and left >= least:
            if nearest is not None:
                left = follow(nearest(int(seed)), items, left)
            least = rest.smallest()
            if least is not None and left >= 2 * least and left >= least:
                near = np.flatnonzero(rest.unused & (sizes <= left))
                if len(near) > 1:
                    score = scores(int(seed))
                    left = follow(near[np.lexsort((near, -sizes[near], -score[near]))], items, left)
            while (last := rest.fitting(left)) >= 0:
                rest.take(last)
                items.append(last)
                left -= int(sizes[last])
        out.append(items)
    return out


_PLACED = "bin_name string, capacity long, shard long, container int, slot int, doc_id long, piece int, piece_start long, piece_tokens long"
_PLACED_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
_LOOSE = f"{_PLACED}, loose boolean, length long, terms binary, counts binary"
#: Containers filled less than this are emptied, and what was in them is packed again with that of other shards.
LOOSE = 0.97
_SUBS = 1 << 24


@dataclass(frozen=True)
class _Corpus:
    """What scores need to know of the whole corpus."""

    n_docs: int
    mean_length: float
    df: np.ndarray

    def index(self, table: pa.Table) -> Index:
        vectors = lambda c: [np.frombuffer(x, "<i4") for x in table.column(c).to_pylist()]
        idf = np.log1p((self.n_docs - self.df + 0.5) / (self.df + 0.5)).astype(np.float32)
        return Index(vectors("terms"), vectors("counts"), table.column("length").to_numpy(), idf, self.mean_length)


def _pack_shard(bins: list[tuple[str, int]], corpus: _Corpus):
    names = [c.split()[0] for c in _LOOSE.split(", ")]
    types = [*_PLACED_TYPES, pa.bool_(), pa.int64(), pa.binary(), pa.binary()]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("id", "ascending"), ("tokens", "descending"), ("row", "ascending")])
        ids, tokens, lengths = table.column("id").to_pylist(), table.column("tokens").to_numpy(), table.column("length").to_pylist()
        terms, counts = table.column("terms").to_pylist(), table.column("counts").to_pylist()
        index = corpus.index(table)
        shard = key[0].as_py()
        rows: list[list] = [[] for _ in types]

        def put(*values) -> None:
            for col, v in zip(rows, values):
                col.append(v)

        for name, capacity in bins:
            box = 0
            whole, rest = np.divmod(tokens, capacity)
            single = (whole > 0) & (rest == 0)
            for d in np.flatnonzero(whole):
                for p in range(int(whole[d])):
                    put(name, capacity, shard, box, 0, ids[d], p, p * capacity, capacity, False, None, None, None)
                    box += 1
            item = np.flatnonzero(~single)
            spot = np.full(len(tokens), -1)
            spot[item] = np.arange(len(item))
            near = lambda i: (found := spot[index.nearest(int(item[i]))])[found >= 0]  # noqa: E731, B023
            for held in fill(rest[item], capacity, lambda i: index.scores(int(item[i]))[item], near):  # noqa: B023
                loose = int(rest[item[held]].sum()) < LOOSE * capacity
                for slot, i in enumerate(held):
                    d = item[i]
                    vector = (lengths[d], terms[d], counts[d]) if loose else (None, None, None)
                    put(name, capacity, shard, box, slot, ids[d], int(whole[d]), int(whole[d]) * capacity, int(rest[d]), loose, *vector)
                box += 1
        return pa.Table.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], names=names)

    return run


def _pack_again(corpus: _Corpus):
    names = [c.split()[0] for c in _PLACED.split(", ")]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        """What was left in loose containers, by the index of just these; the shard is numbered below 0."""
        table = table.combine_chunks().sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("piece_tokens", "ascending"), ("shard", "ascending"), ("container", "ascending"), ("slot", "ascending")])
        sizes, index = table.column("piece_tokens").to_numpy(), corpus.index(table)
        container, slot = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int32)
        for box, held in enumerate(fill(sizes, table.column("capacity")[0].as_py(), index.scores, index.nearest)):
            container[held], slot[held] = box, np.arange(len(held))
        new = {"shard": pa.array(np.full(len(sizes), -1 - key[1].as_py(), np.int64)), "container": pa.array(container), "slot": pa.array(slot)}
        return pa.Table.from_arrays([new.get(c, table.column(c)) for c in names], names=names)

    return run


def _corpus(vectors: DataFrame) -> _Corpus:
    whole = vectors.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length")).first()
    df = np.zeros(1 << TERM_BITS, np.float32)
    counted = vectors.select("terms").mapInArrow(_term_frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    found = counted.toArrow()  # at most 2 ** TERM_BITS rows
    df[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return _Corpus(whole.n, (whole.length or 0) / max(1, whole.n), df)


def _parts(n_tokens: Column, n_docs: Column, shard_tokens: int) -> Column:
    """Parts of half a shard on average that hold so much."""
    return F.greatest(F.ceil(2 * n_tokens / shard_tokens), F.ceil(2 * n_docs / SHARD_DOCS), F.lit(1)).cast("long")


def _sharded(vectors: DataFrame, shard_tokens: int) -> DataFrame:
    """``vectors`` with ``shard``: a bucket of hosts, or a part of a bucket that outgrows a shard, which takes a large host.

    How many parts a bucket has is looked up in a table of the buckets that are split. It is written first, so that its
    size is known and decides how it is joined; it may have as many rows as half the shards.
    """
    n = vectors.agg(_parts(F.coalesce(F.sum("tokens"), F.lit(0)), F.count(F.lit(1)), shard_tokens)).first()[0]
    bucketed = vectors.withColumn("b", F.pmod(F.col("host"), F.lit(n)))
    load = F.greatest(F.sum("tokens") / shard_tokens, F.count(F.lit(1)) / SHARD_DOCS)
    split = materialize(bucketed.groupBy("b").agg(F.ceil(load).cast("long").alias("k")).filter("k > 1"), "pack-splits")
    sub = F.when(F.col("k").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("row"), F.coalesce("k", F.lit(1))))
    return bucketed.join(split, "b", "left").withColumn("shard", F.col("b") * F.lit(_SUBS) + sub).drop("b", "k")


def pack(docs: DataFrame, bins: DataFrame, doc_id: Column, text: Column, host: Column, tokenizer: str = "bytes", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Where each document goes in each kind of container of ``bins`` (bin_name, capacity_tokens; at most MOST_BINS rows).

    One row per document or piece: (bin_name, capacity, shard, container, slot, doc_id, piece, piece_start, piece_tokens);
    shard and container together name a container. A document is cut only if it exceeds the capacity, into full
    containers and a rest that is packed like a document. A null or empty text has size 0 and one row. Repeated ids are
    packed row by row. Null hosts are spread by row. Bins with a null or non-positive capacity are refused, and so are
    shards that hold fewer than LEAST_CONTAINERS of the largest.
    """
    kinds = [(r.bin_name, r.capacity_tokens) for r in bounded_rows(bins.select("bin_name", "capacity_tokens"), MOST_BINS, "the list of containers")]
    if any(c is None or c < 1 for _, c in kinds):
        raise ValueError("capacities must be positive")
    if kinds and LEAST_CONTAINERS * max(c for _, c in kinds) > shard_tokens:
        raise ValueError(f"a shard of {shard_tokens} tokens holds too few containers of {max(c for _, c in kinds)}: pass a larger shard_tokens")
    row = F.monotonically_increasing_id()
    numbered = docs.select(doc_id.cast("long").alias("id"), host.cast("string").alias("h"), text.alias("text"), row.alias("row"))
    place = F.when(F.col("h").isNull(), F.xxhash64("row")).otherwise(F.xxhash64("h"))
    narrow = numbered.select("id", place.alias("host"), token_count(F.col("text"), tokenizer).alias("tokens"), "row", F.coalesce("text", F.lit("")).alias("text"))
    vectors = materialize(narrow.mapInArrow(_vectors, _VECTOR), "pack-vectors")

    corpus = _corpus(vectors)
    sharded = _sharded(vectors, shard_tokens).select("shard", "id", "row", "tokens", "length", "terms", "counts")
    placed = materialize(sharded.groupBy("shard").applyInArrow(_pack_shard(kinds, corpus), _LOOSE), "pack-placed")

    loose = placed.filter("loose")
    lots = {r.bin_name: r.lots for r in loose.groupBy("bin_name").agg(_parts(F.sum("piece_tokens"), F.count(F.lit(1)), shard_tokens).alias("lots")).collect()}  # a row per kind
    n_lots = F.create_map(*(F.lit(x) for kv in lots.items() for x in kv))[F.col("bin_name")] if lots else F.lit(1)
    again = loose.groupBy("bin_name", F.pmod(F.xxhash64("shard"), n_lots).alias("lot")).applyInArrow(_pack_again(corpus), _PLACED)
    return placed.filter("not loose").select(*again.columns).unionByName(again)


def packing_check(docs: DataFrame, placed: DataFrame, doc_id: Column, text: Column, tokenizer: str = "bytes") -> DataFrame:
    """Per kind of container what must hold: (bin_name, n_pieces, tokens, n_overfull, n_uncalled_cuts, n_misplaced).

    ``n_overfull`` counts containers above capacity, ``n_uncalled_cuts`` documents in several pieces that would fit one
    container, ``n_misplaced`` documents whose pieces do not cover their text once from start to end. Ids must be unique.
    """
    boxes = placed.groupBy("bin_name", "capacity", "shard", "container").agg(F.sum("piece_tokens").alias("t"))
    over = boxes.groupBy("bin_name").agg(F.count_if(F.col("t") > F.col("capacity")).alias("n_overfull"))
    held = placed.groupBy("bin_name", "capacity", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.countDistinct("piece").alias("numbers"), F.sum("piece_tokens").alias("t"), F.max(F.col("piece_start") + F.col("piece_tokens")).alias("last"))
    sizes = docs.select(doc_id.cast("long").alias("doc_id"), token_count(text, tokenizer).alias("size"))
    cut = (F.col("pieces") > 1) & (F.col("size") <= F.col("capacity"))
    wrong = F.col("size").isNull() | (F.col("t") != F.col("size")) | (F.col("last") != F.col("size")) | (F.col("numbers") != F.col("pieces"))
    per_kind = held.join(sizes, "doc_id", "left").groupBy("bin_name").agg(F.sum("pieces").alias("n_pieces"), F.sum("t").alias("tokens"), F.count_if(cut).alias("n_uncalled_cuts"), F.count_if(wrong).alias("n_misplaced"))
    return per_kind.join(over, "bin_name")


def container_report(placed: DataFrame) -> DataFrame:
    """Per kind of container: containers, pieces, tokens, and the share of all space that is filled."""
    boxes = placed.groupBy("bin_name", "capacity", "shard", "container").agg(F.sum("piece_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    return boxes.groupBy("bin_name", "capacity").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("t").alias("tokens"), (F.sum("t") / (F.count(F.lit(1)) * F.first("capacity"))).alias("filled"))


def cut_documents(placed: DataFrame) -> DataFrame:
    """(bin_name, doc_id) of documents that were cut, or fill containers of their own, because they exceed the capacity."""
    return placed.filter("piece = 1").select("bin_name", "doc_id").distinct()
