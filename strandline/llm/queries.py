"""Queries over documents, and the SQL they are held against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import langid, mixing, packing
from strandline.session import materialize
from strandline.tables import table


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), table(spark, folder, "pack_bins"), F.col("doc_id"), F.col("text"), F.col("repo"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return packing.cut_documents(_packed(spark, folder))


def p6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.container_report(_packed(spark, folder))


def p6_check(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packing_check(table(spark, folder, "documents"), _packed(spark, folder), F.col("doc_id"), F.col("text"))


def _mixed(spark: SparkSession, folder: str, total: str | None = None) -> mixing.Mixture:
    docs = table(spark, folder, "documents")
    return mixing.mix(docs, table(spark, folder, "mix_targets"), F.col("doc_id"), F.col("source"), F.col("text"), mixing.prose_weight(F.col("cell_kinds")), total_tokens=total)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder).report.filter("exhausted").select("source")


def p7_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The selection whose shares are the targets, as large as the scarcest source allows."""
    return _mixed(spark, folder, mixing.FIT).selection.withColumnRenamed("id", "doc_id")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """The shares reached with budgets out of the size of all documents."""
    return _mixed(spark, folder).report


def p7_fit_report(spark: SparkSession, folder: str) -> DataFrame:
    """The shares reached by p7_selection."""
    return _mixed(spark, folder, mixing.FIT).report


def _budgets(report: DataFrame) -> DataFrame:
    return report.select("source", "target_share", "max_repeats", "size", F.round("budget", 3).alias("budget"), "epochs", "exhausted")


def p7_budgets(spark: SparkSession, folder: str) -> DataFrame:
    return _budgets(_mixed(spark, folder).report)


def p7_fit_budgets(spark: SparkSession, folder: str) -> DataFrame:
    return _budgets(_mixed(spark, folder, mixing.FIT).report)


def p7_check(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of p7_selection."""
    m = _mixed(spark, folder, mixing.FIT)
    return mixing.selection_check(m.selection, table(spark, folder, "documents"), m.report, F.col("doc_id"), F.col("source"), F.col("text"))


def _identified(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"), table(spark, folder, "lang_samples"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _identified(spark, folder).filter("is_case").select("doc_id", "cell_no", "para_no", "lang_found")


def p8_languages(spark: SparkSession, folder: str) -> DataFrame:
    return _identified(spark, folder).select("doc_id", "cell_no", "para_no", "lang_found", F.round("confidence", 6).alias("confidence"))


_BUDGETS = """WITH sizes AS (SELECT lower(trim(source)) AS s, sum(strlen(text)) AS n FROM documents GROUP BY 1),
t AS (SELECT lower(trim(source)) AS source, sum(target_share) AS target_share, max(max_repeats) AS max_repeats FROM mix_targets GROUP BY 1),
z AS (SELECT t.*, CAST(coalesce(n, 0) AS BIGINT) AS size FROM t LEFT JOIN sizes ON s = source),
b AS (SELECT *, target_share * (SELECT {total}) AS budget FROM z),
e AS (SELECT *, CASE WHEN size = 0 THEN max_repeats ELSE least(max_repeats, CAST(floor(budget / size + 1e-9) AS INTEGER)) END AS epochs FROM b)
SELECT source, target_share, max_repeats, size, round(budget, 3) AS budget, epochs, size * max_repeats < budget AND ({ran_out}) AS exhausted FROM e"""

def p8_check(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of p8_languages."""
    judged = materialize(_identified(spark, folder), "judged-documents")
    return langid.languages_check(judged, table(spark, folder, "documents"), table(spark, folder, "lang_samples"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p6_found, p6_packing, p6_report, p6_check, p7_found, p7_selection, p7_report, p7_fit_report, p7_budgets, p7_fit_budgets, p7_check, p8_found, p8_languages, p8_check)}

ORACLE: dict[str, str] = {
    "p6_found": """SELECT b.bin_name, d.doc_id FROM documents d JOIN pack_bins b ON strlen(d.text) > b.capacity_tokens""",
    "p6_check": """SELECT b.bin_name, CAST(sum(greatest(1, ceil(coalesce(strlen(d.text), 0) / b.capacity_tokens))) AS BIGINT) AS n_pieces,
  CAST(sum(coalesce(strlen(d.text), 0)) AS BIGINT) AS tokens, 0::BIGINT AS n_overfull, 0::BIGINT AS n_uncalled_cuts, 0::BIGINT AS n_misplaced
FROM documents d, pack_bins b GROUP BY b.bin_name""",
    "p7_budgets": _BUDGETS.format(total="sum(strlen(text)) FROM documents", ran_out="true"),
    "p7_fit_budgets": _BUDGETS.format(total="min(size * max_repeats / target_share) FROM z WHERE size > 0 AND target_share > 0", ran_out="size = 0"),
    "p7_check": """SELECT lower(trim(source)) AS source, 0::BIGINT AS n_foreign, 0::BIGINT AS n_wrong_size, 0::BIGINT AS n_above_cap, 0::BIGINT AS n_uneven,
  0 AS off_budget, 0 AS off_share FROM mix_targets""",
    "p8_check": """SELECT count(*) AS n_docs, count(*) AS n_doc_rows, 0::BIGINT AS n_bad_confidence, 0::BIGINT AS n_unknown, 0::BIGINT AS n_no_paragraph,
  0::BIGINT AS n_as_document FROM documents""",
    "p7_found": """WITH sizes AS (SELECT lower(trim(source)) AS s, sum(strlen(text)) AS n FROM documents GROUP BY 1)
SELECT t.source FROM mix_targets t LEFT JOIN sizes z ON z.s = lower(trim(t.source))
WHERE coalesce(z.n, 0) * t.max_repeats < t.target_share * (SELECT sum(strlen(text)) FROM documents)""",
}
