"""Languages of documents and of their prose paragraphs, by fusing several kinds of evidence.

Text: every paragraph gets a log-likelihood per language from a character and word model trained on labelled
samples. The texts are read once; on the way the words of a bounded draw of labelled documents come out, on which the
model is refined, and those of paragraphs that it could not tell clearly, which are then judged again. Declarations: how often a declared label, or an ending of the document's address, goes with each
language is counted over the whole corpus. Host: the languages of the other documents of the same host, smoothed
towards its source and that towards the corpus. Bayes' rule joins them into a posterior per document, which in
turn is the prior of its paragraphs. A paragraph's text decides far more than any declaration: the declarations
tip the scales where the text is short, absent or torn between languages.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import skew
from strandline.session import materialize

#: Most labelled rows that the text model is fitted on.
MOST_SAMPLES = 100_000
#: Most labelled documents of each language that the text model is refined on.
MOST_LABELLED = 300
#: An ending of addresses counts on its own from this share of the documents on, so at most so many to one do; the others count together.
RARE_ENDING = 1e-3
#: A paragraph whose two likeliest languages differ by less than this, in log-likelihood, is judged again by the refined model.
CLEAR = 60.0
#: Share of a paragraph's vote that no text can take from the other languages.
VOTE_FLOOR = 1e-5
#: Prior odds that a paragraph is in its document's language.
SAME_LANGUAGE = 0.9
#: Documents that the next wider level counts for in a host's prior.
HOST_STRENGTH = 5.0
_CACHE_WORDS = 200_000

_CJK = "぀-ヿ㐀-鿿豈-﫿"
_WORD = re.compile(f"[{_CJK}]+|[^\\W\\d_{_CJK}]+")
_IS_CJK = re.compile(f"[{_CJK}]")
#: What has no language: images, code spans, formulas, addresses, quoted messages, tags.
_SILENT = re.compile(r"!\[[^\]]*\]\([^)]*\)|```.*?```|``.*?``|`[^`]*`|\$\$.*?\$\$|\$[^$\n]*\$|(?i:https?|ftp)://[^\s)>\]]+|(?i:www)\.[^\s)>\]]+|\"[^\"]*\"|“[^”]*”|<[a-zA-Z/][^>]*>", re.S)


def words_of(paragraph: str) -> list[str]:
    """The paragraph's words in lower case, without what has no language; runs of ideographs and kana as pairs."""
    out = []
    for w in _WORD.findall(_SILENT.sub(" ", paragraph).lower()):
        if _IS_CJK.match(w) and len(w) > 1:
            out += [w[i : i + 2] for i in range(len(w) - 1)]
        else:
            out.append(w)
    return out


def paragraphs_of(body: str) -> list[str]:
    """Runs of lines between lines that are empty or blank."""
    out, run = [], []
    for line in body.split("\n"):
        if line.strip():
            run.append(line)
        elif run:
            out.append("\n".join(run))
            run = []
    return [*out, "\n".join(run)] if run else out


def _unaccented(word: str) -> str:
    if not word or ord(word[0]) > 0x24F:
        return word
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)).replace("ł", "l").replace("ß", "ss")


@dataclass
class TextModel:
    """Per word a vector of log-probabilities: its frequency in each language mixed with a character trigram model."""

    langs: list[str]
    words: dict[str, np.ndarray] = field(default_factory=dict)
    grams: dict[str, np.ndarray] = field(default_factory=dict)
    unseen: float = 0.0

    @classmethod
    def fit(cls, samples: list[tuple[str, str]], more: Iterable[tuple[str, str, int]] = ()) -> TextModel:
        """From (language, text) pairs and (language, word, count). Words are also learnt without accents, at a tenth of their weight."""
        langs = sorted({lang for lang, text in samples if lang and text})
        if not langs:
            raise ValueError("no labelled samples")
        at = {lang: i for i, lang in enumerate(langs)}
        n = len(langs)
        words: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
        counted = ((lang, w, c) for lang, text in samples if lang and text for w, c in Counter(words_of(text)).items())
        for lang, w, c in chain(counted, more):
            words[w][at[lang]] += c
            if (plain := _unaccented(w)) != w:
                words[plain][at[lang]] += 0.1 * c
        counts: list[dict[str, np.ndarray]] = [defaultdict(lambda: np.zeros(n)) for _ in range(4)]
        for w, c in words.items():
            weight = np.sqrt(c)
            framed = f"^{w}$"
            for i in range(1, len(framed)):
                for k in (0, 1, 2):
                    if i - k >= 0:
                        counts[k + 1][framed[i - k : i + 1]] += weight
        total = sum(counts[1].values())
        vocabulary = len(counts[1]) + 1000
        context: list[dict[str, np.ndarray]] = [{}, {}, defaultdict(lambda: np.zeros(n)), defaultdict(lambda: np.zeros(n))]
        for k in (2, 3):
            for g, c in counts[k].items():
                context[k][g[:-1]] += c
        base = 0.01 / vocabulary
        model = cls(langs, unseen=math.log(base))
        for k in (1, 2, 3):
            for g in counts[k]:
                p = base + 0.09 * counts[1][g[-1]] / total
                for order, share in ((2, 0.3), (3, 0.6)):
                    if k >= order and (c := counts[order].get(g[-order:])) is not None:
                        p = p + share * c / np.maximum(context[order][g[-order:-1]], 1e-9)
                model.grams[g] = np.log(p)
        size = np.maximum(sum(words.values()), 1)
        model.words = {w: c / size for w, c in words.items()}
        return model

    def word(self, w: str) -> np.ndarray:
        framed = f"^{w}$"
        lp = np.zeros(len(self.langs))
        for i in range(1, len(framed)):
            for k in (2, 1, 0):
                if i - k >= 0 and (g := self.grams.get(framed[i - k : i + 1])) is not None:
                    lp = lp + g
                    break
            else:
                lp = lp + self.unseen
        known = self.words.get(w)
        return lp if known is None else np.log(0.5 * np.exp(lp) + 0.5 * known + 1e-300)


def _cells(text: Column) -> Column:
    """(i, body) of each markdown cell, i its number among all cells. Text before the first cell's mark is in no cell."""
    pieces = F.split(F.concat(F.lit("\n"), text), "\n# %% ", -1)
    numbered = F.transform(pieces, lambda x, i: F.struct((i - 1).alias("i"), x.alias("x")))
    return F.filter(numbered, lambda c: (c["i"] >= 0) & c["x"].startswith("[markdown]"))


_SCORED = "_id bigint, _label string, _suffix string, _host string, _source string, _first int, _votes binary, _cell binary, _para binary, _ll binary, _unclear array<string>, _teaching string"
_SCORED_TYPES = [pa.int64(), *[pa.string()] * 4, pa.int32(), *[pa.binary()] * 4, pa.list_(pa.string()), pa.string()]


class _Words:
    """Log-probabilities of words, computed once each as far as memory goes."""

    def __init__(self, model: TextModel):
        self.model, self.place, self.known = model, {}, np.zeros((1024, len(model.langs)))

    def spots(self, words: list[str]) -> list[int]:
        out = []
        for w in words:
            spot = self.place.get(w)
            if spot is None:
                spot = self.place[w] = len(self.place)
                if spot == len(self.known):
                    self.known = np.concatenate([self.known, np.zeros_like(self.known)])
                self.known[spot] = self.model.word(w)
            out.append(spot)
        return out

    def sums(self, at: list[int], length: list[int]) -> np.ndarray:
        """The likelihoods of runs of ``length`` words each."""
        ends = np.cumsum(length)
        return np.add.reduceat(self.known[np.array(at)], ends - np.array(length), axis=0)

    def trim(self) -> None:
        if len(self.place) > _CACHE_WORDS:
            self.place.clear()


def _softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def _votes(ll: np.ndarray, owner: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document the summed log-posteriors of its paragraphs, none of which can rule a language out."""
    n = ll.shape[1]
    votes = np.zeros((n_docs, n))
    np.add.at(votes, owner, np.log(_softmax(ll) * (1 - n * VOTE_FLOOR) + VOTE_FLOOR))
    return votes


def _pieces(x: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    return [x[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:])]


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a column of byte strings, and how many each row has."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind), np.array([len(r) // 4 for r in rows], int)


def _score(model: TextModel):
    n, langs = len(model.langs), model.langs
    names = [c.split()[0] for c in _SCORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_known = _Words(model)
        for b in batches:
            cells, drawn, labels = b.column(5).to_pylist(), b.column(6).to_pylist(), b.column(1).to_pylist()
            at, owner, cell_no, para_no, words_in = [], [], [], [], []
            for d, found in enumerate(cells):
                for c in found or ():
                    _, _, body = c["x"].partition("\n")
                    for j, paragraph in enumerate(paragraphs_of(body)):
                        words = words_of(paragraph)
                        if not words:
                            continue
                        at += words_known.spots(words)
                        owner.append(d)
                        cell_no.append(c["i"])
                        para_no.append(j)
                        words_in.append(words)
            who = np.array(owner, int)
            ll = words_known.sums(at, [len(w) for w in words_in]) if owner else np.zeros((0, n))
            votes = _votes(ll, who, len(cells))
            ordered = np.sort(ll, axis=1)
            unclear = ordered[:, -1] - ordered[:, -2] < CLEAR if n > 1 else np.zeros(len(ll), bool)
            top = ll.argmax(axis=1) if len(ll) else np.zeros(0, int)
            bounds = np.searchsorted(who, np.arange(len(cells) + 1))
            kept, teaching = [], []
            for d, (i, j) in enumerate(zip(bounds[:-1], bounds[1:])):
                kept.append([" ".join(words_in[k]) if unclear[k] else "" for k in range(i, j)])
                teaching.append(" ".join(w for k in range(i, j) if langs[top[k]] == labels[d] for w in words_in[k]) if drawn[d] else None)
            first = np.where(np.diff(bounds) > 0, votes.argmax(axis=1), -1)
            made = [first, [v.tobytes() for v in votes.astype("<f4")], _pieces(np.array(cell_no, "<i4"), bounds), _pieces(np.array(para_no, "<i4"), bounds), _pieces(ll.astype("<f4"), bounds), kept, teaching]
            arrays = [*(b.column(i) for i in range(5)), *map(pa.array, made)]
            yield pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(arrays, _SCORED_TYPES)], names=names)
            words_known.trim()

    return run


def _rescore(model: TextModel):
    """Paragraphs that were unclear, judged again; the words go."""
    n = len(model.langs)
    names = [c.split()[0] for c in _SCORED.split(", ")][:10]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_known = _Words(model)
        for b in batches:
            flat, sizes = _flat(b.column(9), "<f4")
            ll, counts = flat.reshape(-1, n).copy(), sizes // n
            texts = b.column(10).flatten().to_pylist()
            again = np.array([i for i, t in enumerate(texts) if t], int)
            first, votes = b.column(5), b.column(6)
            if len(again):
                words = [texts[i].split(" ") for i in again]
                ll[again] = words_known.sums([s for w in words for s in words_known.spots(w)], [len(w) for w in words])
                v = _votes(ll.astype(float), np.repeat(np.arange(b.num_rows), counts), b.num_rows)
                first, votes = pa.array(np.where(counts > 0, v.argmax(axis=1), -1), pa.int32()), pa.array([x.tobytes() for x in v.astype("<f4")])
            bounds = np.concatenate([[0], np.cumsum(counts)])
            arrays = [*(b.column(i) for i in range(5)), first, votes, b.column(7), b.column(8), pa.array(_pieces(ll, bounds))]
            yield pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(arrays, _SCORED_TYPES)], names=names)
            words_known.trim()

    return run


_JUDGED = "doc_id bigint, cell_no int, para_no int, lang_found string, confidence double, is_case boolean"


@dataclass(frozen=True)
class Declarations:
    """Log-probabilities, given the language, of each label and each ending, rare endings under None; and the languages' shares."""

    labels: dict[str, np.ndarray]
    endings: dict[str | None, np.ndarray]
    overall: np.ndarray


def _fuse(langs: list[str], declared: Declarations):
    n = len(langs)
    names = [c.split()[0] for c in _JUDGED.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stay = np.full((n, n), math.log((1 - SAME_LANGUAGE) / max(1, n - 1)))
        np.fill_diagonal(stay, math.log(SAME_LANGUAGE))
        other = declared.endings[None]
        for b in batches:
            if not b.num_rows:
                continue
            c = {k: b.column(i) for i, k in enumerate(b.schema.names)}
            labels, endings = c["_label"].to_pylist(), c["_suffix"].to_pylist()
            evidence = np.array([declared.labels[x] for x in labels]) + np.array([declared.endings.get(x, other) for x in endings])
            prior = np.array(c["_prior"].flatten().to_numpy(zero_copy_only=False)).reshape(-1, n)
            post = _softmax(_flat(c["_votes"], "<f4")[0].reshape(-1, n) + evidence + np.log(prior))
            best = post.argmax(axis=1)
            flat, sizes = _flat(c["_ll"], "<f4")
            ll, counts = flat.reshape(-1, n).astype(float), sizes // n
            owner = np.repeat(np.arange(b.num_rows), counts)
            each = _softmax(ll + stay[best[owner]])
            top = each.argmax(axis=1) if len(each) else np.zeros(0, int)
            out = np.flatnonzero(top != best[owner])
            name = np.array(langs, object)
            right = np.array([x == langs[k] for x, k in zip(labels, best)])
            columns = [
                np.concatenate([np.full(b.num_rows, -1), _flat(c["_cell"], "<i4")[0][out]]), np.concatenate([np.full(b.num_rows, -1), _flat(c["_para"], "<i4")[0][out]]),
                np.concatenate([name[best], name[top[out]]]), np.concatenate([post[np.arange(b.num_rows), best], each[out, top[out]]]), np.concatenate([(counts > 0) & ~right, np.ones(len(out), bool)]),
            ]
            ids = pa.concat_arrays([c["_id"], c["_id"].take(pa.array(owner[out]))])  # null or beyond what a float holds, too
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x).cast(t) for x, t in zip(columns, types[1:]))], names=names)

    return run


def label_code(label: Column, langs: list[str]) -> Column:
    """What precedes the first ``-`` or ``_`` of a label, in lower case; "other" for an unknown code, "none" for a blank label."""
    code = F.lower(F.regexp_extract(label, "^[^-_]*", 0))
    return F.when(F.coalesce(F.trim(label), F.lit("")) == "", "none").when(code.isin(langs), code).otherwise("other")


def labelled_samples(samples: DataFrame, most: int = MOST_SAMPLES) -> list[tuple[str, str]]:
    """(lang, sample_text) of the samples, about ``most`` of them chosen by hash if there are more; rows with a null in either are left out."""
    rows = samples.select("lang", "sample_text").filter("lang is not null and sample_text is not null")
    n = rows.count()
    if n > most:
        rows = rows.filter(_draw(F.xxhash64("lang", "sample_text")) < most / n)
    return [(r.lang, r.sample_text) for r in rows.collect()]


def _draw(h: Column) -> Column:
    """A number in [0, 1) out of a hash."""
    return F.pmod(h, F.lit(1 << 20)) / F.lit(float(1 << 20))


def identify(docs: DataFrame, samples: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", address: str = "nb_path", host: str = "repo", source: str = "source") -> DataFrame:
    """Languages of all documents: (doc_id, cell_no, para_no, lang_found, confidence, is_case).

    One row with cell_no and para_no -1 per document, and one per prose paragraph in another language than the
    document's. ``is_case`` marks paragraph rows, and document rows whose label is not that language's code although
    the document has prose. A null or empty text, or one without prose, gets the language that its declarations and host
    make likeliest. Null labels, addresses, hosts and sources are evidence of their own kind. Repeated ids are
    treated row by row. Texts are read whole, and once.
    """
    known = labelled_samples(samples)
    model = TextModel.fit(known)
    langs, n = model.langs, len(model.langs)
    scored = scored_paragraphs(docs, known, model, doc_id, text, label, address, host, source)

    spoken = scored.filter("_first >= 0")
    per_host = spoken.groupBy("_host", "_source", "_first").agg(F.count(F.lit(1)).alias("c"))
    declared = declarations(spoken, langs)

    counts = lambda df, key: df.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("_first", "c"))).alias("m"))
    dense = lambda m: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0)).cast("double"))
    smoothed = lambda own, wider: F.zip_with(own, wider, lambda a, w: (a + w * HOST_STRENGTH) / (F.aggregate(own, F.lit(0.0), lambda x, y: x + y) + HOST_STRENGTH))
    whole = F.array(*(F.lit(float(x)) for x in declared.overall))
    by_source = counts(per_host.groupBy("_source", "_first").agg(F.sum("c").alias("c")), ["_source"]).select("_source", smoothed(dense(F.col("m")), whole).alias("_wider"))
    by_host = counts(per_host, ["_host", "_source"]).join(by_source, "_source").select("_host", dense(F.col("m")).alias("_own"), "_wider")

    plan = skew.plan_for(scored, F.col("_host"), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    joined = skew.balanced_join(scored.drop("_source"), by_host, "_host", plan)
    zeros = F.array(*[F.lit(0.0)] * n)
    others = F.transform(F.coalesce("_own", zeros), lambda x, i: F.when(i == F.col("_first"), x - 1).otherwise(x))
    prior = smoothed(F.col("_others"), F.coalesce("_wider", whole))
    ready = joined.withColumn("_others", others).select("_id", "_label", "_suffix", "_votes", "_cell", "_para", "_ll", prior.alias("_prior"))
    return ready.mapInArrow(_fuse(langs, declared), _JUDGED)


def scored_paragraphs(docs: DataFrame, known: list[tuple[str, str]], model: TextModel, doc_id: str, text: str, label: str, address: str, host: str, source: str) -> DataFrame:
    """The likelihoods of all paragraphs, by a model fitted on the samples and refined on the corpus.

    About MOST_LABELLED documents of each label, drawn by hash, teach the refined model. Labels are not trusted: only
    paragraphs on which label and first model agree teach. It brings in the words of the corpus itself. What reaches the
    driver are the counts of their words.
    """
    langs = model.langs
    code = label_code(F.col(label), langs)
    shares = {r.k: MOST_LABELLED / r["count"] for r in docs.select(code.alias("k")).filter(F.col("k").isin(langs)).groupBy("k").count().collect()}
    share = F.create_map(*(x for k, v in shares.items() for x in (F.lit(k), F.lit(float(v)))))[F.col("_label")] if shares else F.lit(None).cast("double")
    ending = F.regexp_extract(F.coalesce(F.lower(F.col(address)), F.lit("")), r"((\.[^./]+){0,2})$", 1)
    plain = F.coalesce(F.trim(F.lower(F.col(source))), F.lit(""))
    narrow = docs.select(
        F.col(doc_id).cast("long").alias("_id"), code.alias("_label"), ending.alias("_suffix"), F.concat_ws("\u0001", plain, F.coalesce(F.col(host), F.lit("")), F.lit("")).alias("_host"), plain.alias("_source"), _cells(F.col(text)).alias("_cells"),
    )
    drawn = F.coalesce(_draw(F.xxhash64("_id", F.lit(7))) < share, F.lit(False))
    scored = materialize(narrow.withColumn("_drawn", drawn).mapInArrow(_score(model), _SCORED), "scored-paragraphs")
    words = scored.filter("_teaching <> ''").select("_label", F.explode(F.split("_teaching", " ", -1)).alias("w"))
    taught = [(r._label, r.w, r.c) for r in words.groupBy("_label", "w").agg(F.count(F.lit(1)).alias("c")).collect()]
    kept = ", ".join(_SCORED.split(", ")[:10])
    if not taught:
        return scored.drop("_unclear", "_teaching")
    return materialize(scored.mapInArrow(_rescore(TextModel.fit(known, taught)), kept), "judged-paragraphs")


def declarations(spoken: DataFrame, langs: list[str]) -> Declarations:
    """How labels and endings go with languages, counted over all documents that have prose.

    An ending on fewer than RARE_ENDING of the documents counts as rare, so that at most 1 / RARE_ENDING are told apart,
    whatever the number of documents.
    """
    n, kinds = len(langs), [*langs, "other", "none"]
    total = spoken.count()
    common = spoken.groupBy("_suffix").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= max(1.0, RARE_ENDING * total))
    endings = [r._suffix for r in common.select("_suffix").collect()]
    label_c = {k: np.full(n, 1.0) for k in kinds}
    ending_c: dict[str | None, np.ndarray] = {e: np.full(n, 1.0) for e in (*endings, None)}
    known = F.when(F.col("_suffix").isin(endings), F.col("_suffix"))
    for r in spoken.groupBy("_label", known.alias("e"), "_first").agg(F.count(F.lit(1)).alias("c")).collect():
        label_c[r._label][r._first] += r.c
        ending_c[r.e][r._first] += r.c
    spread = lambda counts: {k: np.log(v / sum(counts.values())) for k, v in counts.items()}
    overall = sum(label_c.values()) - len(kinds) + 1
    return Declarations(spread(label_c), spread(ending_c), overall / overall.sum())


def languages_check(judged: DataFrame, docs: DataFrame, samples: DataFrame, text: str = "text") -> DataFrame:
    """What must hold of all rows, as one: (n_docs, n_doc_rows, n_bad_confidence, n_unknown, n_no_paragraph, n_as_document).

    Documents, and rows of documents; confidences that are null or not in (0, 1]; languages that no sample has; rows of
    paragraphs in cells that are not prose; rows of paragraphs in the language of their document. Ids must be unique.
    """
    langs = sorted({lang for lang, _ in labelled_samples(samples)})
    whole = judged.filter("cell_no = -1").select("doc_id", F.col("lang_found").alias("of"))
    cells = docs.select("doc_id", F.transform(_cells(F.col(text)), lambda c: c["i"]).alias("prose"))
    part = judged.filter("cell_no >= 0").join(whole, "doc_id", "left").join(cells, "doc_id", "left")
    wrong = part.agg(F.count_if(~F.coalesce(F.array_contains("prose", F.col("cell_no")), F.lit(False)) | (F.col("para_no") < 0)).alias("n_no_paragraph"), F.count_if(F.col("of").eqNullSafe(F.col("lang_found"))).alias("n_as_document"))
    sure = F.coalesce((F.col("confidence") > 0) & (F.col("confidence") <= 1), F.lit(False))
    every = judged.agg(F.count_if(F.col("cell_no") == -1).alias("n_doc_rows"), F.count_if(~sure).alias("n_bad_confidence"), F.count_if(~F.coalesce(F.col("lang_found").isin(langs), F.lit(False))).alias("n_unknown"))
    n_docs = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    one = F.lit(1).alias("one")  # each is a single row
    return n_docs.select(one, "*").join(every.select(one, "*"), "one").join(wrong.select(one, "*"), "one").drop("one")
