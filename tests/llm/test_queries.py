"""Queries over documents against SQL where SQL can say it, and against plain Python over whole texts where not."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandline.llm import langid, queries
from tests.conftest import rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, con, small, name):
    got = entry.queries()[name](spark, small).toArrow()
    assert rows(got) == rows(con.sql(entry.oracle_sql()[name]).to_arrow_table())


def test_registered_only_with_the_package():
    assert set(queries.QUERIES) <= set(entry.queries())


def test_report_adds_up(spark, con, small):
    total = con.sql("SELECT sum(strlen(text)) FROM documents").fetchall()[0][0]
    for r in entry.queries()["p6_report"](spark, small).collect():
        assert r.tokens == total and 0 < r.filled <= 1


def test_found_languages_equal_a_vote_over_the_paragraphs(spark, con, small):
    """Each paragraph judged alone by the samples' model and the documents' majority, where that is clear, must agree."""
    model = langid.TextModel.fit(con.sql("SELECT lang, sample_text FROM lang_samples").fetchall())
    found = {(r.doc_id, r.cell_no, r.para_no): r.lang_found for r in entry.queries()["p8_found"](spark, small).collect()}
    checked = 0
    for doc, label, text in con.sql("SELECT doc_id, lang, text FROM documents WHERE text IS NOT NULL").fetchall():
        mine = {}
        for i, cell in enumerate(("\n" + text).split("\n# %% ")[1:]):
            if cell.startswith("[markdown]"):
                for j, p in enumerate(langid.paragraphs_of(cell.partition("\n")[2])):
                    ll = sum((model.word(w) for w in langid.words_of(p)), start=0)
                    low, top = sorted(ll)[-2:]
                    mine[i, j] = (model.langs[int(ll.argmax())], top - low)
        if not mine or min(m for _, m in mine.values()) < 10:
            continue
        (best, n), *rest = Counter(lang for lang, _ in mine.values()).most_common(2)
        if rest and rest[0][1] == n:
            continue
        checked += 1
        code = (label or "").split("-")[0].split("_")[0].lower()
        assert found.get((doc, -1, -1)) == (None if code == best else best)
        assert {k[1:]: v for k, v in found.items() if k[0] == doc and k[1] >= 0} == {k: lang for k, (lang, _) in mine.items() if lang != best}
    assert checked > 30


def test_languages_cover_every_document(spark, small):
    got = entry.queries()["p8_languages"](spark, small).filter(F.col("cell_no") == -1)
    assert got.count() == spark.read.parquet(f"{small}/documents.parquet").count()
    assert got.filter("confidence is null or confidence <= 0 or confidence > 1 or lang_found is null").count() == 0
