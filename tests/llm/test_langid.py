import pytest
from pyspark.sql import functions as F

from strandline.llm import langid

SAMPLES = [
    ("en", "The sorted list needs the error rate before the data is split and after the second pass."), ("en", "However, the hidden layer returns most of the noise with a fixed seed for each of the groups."),
    ("fr", "La liste triée demande le taux d'erreur avant que les données soient coupées."), ("fr", "Cependant, la couche cachée renvoie la plus grande partie du bruit avec une graine fixe."),
    ("ja", "並べ替えた一覧はデータを分ける前に誤差の割合を必要とします。"), ("zh", "排序后的列表在数据分开之前需要错误率。"),
]
EN, FR = "The list needs the error rate.", "La couche cachée demande le taux d'erreur."
SCHEMA = "doc_id long, text string, lang string, nb_path string, repo string, source string, _label string, _id string, _first int, _cells string"


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([*SAMPLES, (None, "x"), ("en", None)], "lang string, sample_text string")


def run(spark, samples, rows):
    df = spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], SCHEMA)
    return {(r.doc_id, r.cell_no, r.para_no): r for r in langid.identify(df, samples).collect()}


def cells(*bodies):
    return "\n".join(f"# %% [markdown]\n{b}" if not b.startswith("!") else f"# %% In[1]\n{b[1:]}" for b in bodies)


def test_documents_paragraphs_and_cases(spark, samples):
    text = cells(f"{EN}\n\n{EN}", "!" + FR, f"{FR}\n \n\n# {EN}\n{EN}")
    rows = [(1, text, "en-US", "a/x.nb", "r/1", "s"), (2, text, "FR", None, None, None), (3, text, None, "a/x.nb", "r/1", "s"), (4, text, " ", "a", "", ""), (5, text, "EN_gb", "a", "r/1", "S ")]
    got = run(spark, samples, rows)
    for d in range(1, 6):
        assert got[d, -1, -1].lang_found == "en" and got[d, -1, -1].confidence > 0.99
        assert got[d, 2, 0].lang_found == "fr" and got[d, 2, 0].is_case
        assert got[d, -1, -1].is_case == (d in (2, 3, 4))
    assert len(got) == 10


def test_documents_without_prose_are_no_cases(spark, samples):
    silent = cells('`code` $x = 1$ https://a.example/b ("quoted words")', "!" + EN)
    rows = [(1, None, None, None, None, None), (2, "", "xx", "p", "r", "s"), (3, "no cell at all", "fr", "p", "r", "s"), (4, silent, None, "p", "r", "s"), (5, cells(FR), "fr", "p", "r", "s"), (6, "# %% [markdown]", None, "p", "r", "s")]
    got = run(spark, samples, rows)
    assert [got[d, -1, -1].is_case for d in range(1, 7)] == [False] * 6
    assert got[3, -1, -1].lang_found == "fr"  # by its label and its host
    assert all(0 < r.confidence <= 1 for r in got.values())


def test_host_and_label_decide_where_the_text_is_torn(spark, samples):
    torn = cells(f"{EN}\n\n{FR}")
    rows = [(i, cells(f"{FR}\n\n{FR}"), "fr", "p", "french/host", "s") for i in range(20)] + [(i, cells(EN), "en", "p", "english/host", "s") for i in range(20, 40)] + [(100, torn, None, "p", "french/host", "s"), (101, torn, None, "p", "english/host", "s"), (102, torn, "fr", "p", None, None)]
    got = run(spark, samples, rows)
    assert got[100, -1, -1].lang_found == "fr" and got[101, -1, -1].lang_found == "en" and got[102, -1, -1].lang_found == "fr"


def test_an_ending_alone_decides_where_nothing_else_speaks(spark, samples):
    """Documents without prose, label and host of their own: only the ending of the address tells them apart."""
    taught = [(i, cells(FR if i % 2 else EN), None, f"a/x{i}.{'fr' if i % 2 else 'en'}.nb", None, None) for i in range(40)]
    silent = [(100, cells("!x = 1"), None, "b/y.fr.nb", None, None), (101, None, None, "z.en.nb", None, None), (102, "", None, "q.zz.nb", None, None)]
    got = run(spark, samples, taught + silent)
    assert got[100, -1, -1].lang_found == "fr" and got[101, -1, -1].lang_found == "en"
    assert got[100, -1, -1].confidence > 0.8 > got[102, -1, -1].confidence and not got[100, -1, -1].is_case


def test_endings_are_told_apart_and_rare_ones_count_together(spark, monkeypatch):
    monkeypatch.setattr(langid, "RARE_ENDING", 0.1)
    rows = [("none", ".fr.nb", 1)] * 30 + [("none", ".en.nb", 0)] * 50 + [("none", f".r{i}.nb", 1) for i in range(8)]
    df = spark.createDataFrame(rows, "_label string, _suffix string, _first int")
    found = langid.declarations(df, ["en", "fr"])
    assert set(found.endings) == {".fr.nb", ".en.nb", None}
    assert found.endings[".fr.nb"][1] > found.endings[".fr.nb"][0] and found.endings[".en.nb"][0] > found.endings[".en.nb"][1]
    assert abs(found.overall.sum() - 1) < 1e-9 and found.endings[None][1] > found.endings[None][0]


def test_samples_beyond_the_bound_are_drawn_by_hash(spark):
    df = spark.createDataFrame([("en", f"text number {i}") for i in range(4000)], "lang string, sample_text string")
    some = langid.labelled_samples(df, 1000)
    assert 850 < len(some) < 1150 and sorted(some) == sorted(langid.labelled_samples(df.orderBy(F.desc("sample_text")), 1000))
    assert len(langid.labelled_samples(df, 4000)) == 4000


def test_texts_are_read_once(spark, samples, tmp_path):
    """Only one scan of the documents asks for their text."""
    at = str(tmp_path / "docs")
    spark.createDataFrame([(i, cells(EN), "en", "p", "h", "s", *["x", "y", 1, "z"]) for i in range(20)], SCHEMA).write.parquet(at)
    docs, scans, plain = spark.read.parquet(at), [], langid.materialize
    try:
        langid.materialize = lambda df, label: (scans.append(df._jdf.queryExecution().executedPlan().toString()), plain(df, label))[1]
        out = langid.identify(docs, samples)
        scans.append(out._jdf.queryExecution().executedPlan().toString())
    finally:
        langid.materialize = plain
    assert sum(line.count("text#") > 0 for s in scans for line in s.splitlines() if "FileScan" in line and at in line) == 1


def test_confidence_of_held_out_segments_is_calibrated(con):
    """Where the model is sure of short segments it was not fitted on, it is right that often: mean confidence and accuracy agree."""
    rows = con.sql("SELECT lang, sample_text FROM lang_samples ORDER BY sample_id").fetchall()
    model = langid.TextModel.fit([r for i, r in enumerate(rows) if i % 3])
    sure, right = [], []
    for lang, text in rows[::3]:
        words = langid.words_of(text)
        for i in range(0, len(words), 3):
            p = langid._softmax(sum((model.word(w) for w in words[i : i + 3]), start=0)[None])[0]
            sure.append(p.max())
            right.append(model.langs[int(p.argmax())] == lang)
    print(f"{len(sure)} segments of three words: mean confidence {sum(sure) / len(sure):.3f}, accuracy {sum(right) / len(right):.3f}")
    assert abs(sum(sure) / len(sure) - sum(right) / len(right)) < 0.05


def test_text_beats_a_wrong_label_and_host(spark, samples):
    rows = [(i, cells(FR), "fr", "p", "h", "s") for i in range(50)] + [(99, cells(EN), "fr", "p", "h", "s")]
    got = run(spark, samples, rows)
    assert got[99, -1, -1].lang_found == "en" and got[99, -1, -1].is_case


def test_empty_table_repeated_rows_and_a_very_long_text(spark, samples):
    assert run(spark, samples, []) == {}
    long = cells("\n\n".join([EN] * 20_000), "!" + "x" * 2_000_000, FR)
    df = [(1, long, "en", "p", "h", "s")] * 2
    frame = spark.createDataFrame([(*r, "x", "y", 1, "z") for r in df], SCHEMA)
    got = langid.identify(frame, samples).collect()
    assert sorted((r.cell_no, r.para_no, r.lang_found) for r in got) == [(-1, -1, "en")] * 2 + [(2, 0, "fr")] * 2


def test_ids_are_kept_as_they_are_beside_a_null_one(spark, samples):
    large = 2**60 + 1
    rows = [(large, cells(EN, FR), "en", "p", "h", "s"), (None, cells(f"{EN}\n\n{EN}", FR), "en", "p", "h", "s")]
    got = run(spark, samples, rows)
    assert set(got) == {(d, c, p) for d in (large, None) for c, p in ((-1, -1), (1, 0))}


def test_the_check_finds_what_is_wrong(spark, samples):
    docs = spark.createDataFrame([(1, cells(EN, "!x = 1", FR)), (2, None)], "doc_id long, text string")
    check = lambda rows: tuple(langid.languages_check(spark.createDataFrame(rows, langid._JUDGED), docs, samples).collect()[0])
    assert check([(1, -1, -1, "en", 0.9, True), (1, 2, 0, "fr", 1.0, True), (2, -1, -1, "en", 0.1, False)]) == (2, 2, 0, 0, 0, 0)
    assert check([(1, -1, -1, "en", 1.1, True), (1, 1, 0, "fr", None, True), (1, 2, 0, "en", 0.5, True), (1, 0, 0, "xx", 0.5, True)]) == (2, 1, 2, 1, 1, 1)


def test_paragraphs_and_words():
    assert langid.paragraphs_of("\n a\nb\n \n\t\nc\n") == [" a\nb", "c"]
    assert langid.paragraphs_of("") == []
    assert langid.words_of("ТАК (HTTPS://DATA39.EXAMPLE/RESAMPLE) WWW.x.example www") == ["так", "www"]
    assert langid.words_of("# A `b c` $d$ [link](https://e.example/f) \"g h\" 数据集 x9y") == ["a", "link", "数据", "据集", "x", "y"]


def test_no_samples_is_an_error(spark):
    with pytest.raises(ValueError):
        langid.TextModel.fit([])


def test_held_out_accuracy(con):
    """Trained on two samples in three, the model must name the language of the others."""
    rows = con.sql("SELECT lang, sample_text FROM lang_samples ORDER BY sample_id").fetchall()
    model = langid.TextModel.fit([r for i, r in enumerate(rows) if i % 3])
    held = rows[::3]
    right = sum(model.langs[int(sum((model.word(w) for w in langid.words_of(t)), start=0).argmax())] == lang for lang, t in held)
    assert right / len(held) >= 0.99
