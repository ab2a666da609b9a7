"""Queries of the problems on the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfathom.session import table, written

from . import leakage, lookalikes, markup, mixture, residue, splitting, subjects, terms

TEXT_COMMON, URL_COMMON = 0.05, 0.02


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.uniform_text(table(spark, sf_dir, "indexed_docs"), "row_id", "text", "title")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.look_alike_pairs(table(spark, sf_dir, "indexed_docs"), "row_id", "text", "title")


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.look_alike_rows(table(spark, sf_dir, "indexed_docs"), "row_id", "text", "title")


def p2_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "indexed_docs"), "row_id", "text", "title")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_residue(spark, sf_dir).select("row_id", "field_name")


def p3_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.frequencies(table(spark, sf_dir, "indexed_docs"), {"text": TEXT_COMMON}, {"url": URL_COMMON})


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_frequencies(spark, sf_dir).where(F.col("mark") != "kept").select("field_name", "term", "mark")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "indexed_docs"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_pieces(spark, sf_dir).where("piece_no = 0").select("row_id", "forced")


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.without_markup(table(spark, sf_dir, "indexed_docs"), "row_id", "text", "answer")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_clean(spark, sf_dir).where(F.size("markups") > 0).select("row_id", "field_name")


def p6_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = terms.distinctive_terms(table(spark, sf_dir, "indexed_docs"), "row_id", "title", "text")
    return scored.select("row_id", "term", "n", "term_rows", F.round("score", 4).alias("score"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = terms.distinctive_terms(table(spark, sf_dir, "indexed_docs"), "row_id", "title", "text", least=3)
    return scored.where("term_rows between 2 and 5").select("row_id", "term")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id", F.round("share", 4).alias("share"), F.round("changed", 4).alias("changed"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id")


def _sizes_and_budgets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = written(mixture.token_sizes(table(spark, sf_dir, "documents")))
    return sizes, mixture.source_budgets(sizes, table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources that the mixture leaves short although it holds all of them as often as it may."""
    return p8_shares(spark, sf_dir).where("short").select("source")


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture(*_sizes_and_budgets(spark, sf_dir))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, budgets = _sizes_and_budgets(spark, sf_dir)
    return mixture.reached_shares(budgets, mixture.mixture(sizes, budgets))


def p9_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = subjects.subjects_of(*(table(spark, sf_dir, x) for x in ("documents", "doc_labels", "subjects")))
    return found.select("doc_id", "subject", F.round("share", 4).alias("share"))


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_subjects(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("n_docs"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_subjects(spark, sf_dir).select("doc_id", "subject")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (p1_found, p1_forms, p1_classes, p2_found, p2_residue, p3_found, p3_frequencies, p4_found, p4_pieces, p5_found, p5_clean, p6_found, p6_scores, p7_found, p7_leaks, p8_found, p8_mixture, p8_shares, p9_found, p9_subjects, p9_composition)
    return {f.__name__: f for f in named}


_TERMS = "regexp_extract_all({}, '[0-9A-Za-zÀ-ÖØ-öø-ÿ]+')"
_FREQUENCIES = f"""
WITH rows AS (SELECT count(*) AS n FROM indexed_docs),
     t AS (SELECT row_id, unnest({_TERMS.format("text")}) AS term FROM indexed_docs),
     found AS (
       SELECT 'text' AS field_name, lower(term) AS term, count(*) AS occurrences, count(DISTINCT row_id) AS n_rows, 0.05 AS share
       FROM t WHERE length(term) BETWEEN 2 AND 40 GROUP BY lower(term)
       UNION ALL
       SELECT 'url', url, count(*), count(*), 0.02 FROM indexed_docs WHERE url IS NOT NULL GROUP BY url),
     marked AS (
       SELECT field_name, term, occurrences, n_rows, CASE WHEN n_rows = 1 THEN 'rare' WHEN n_rows > share * n THEN 'common' ELSE 'kept' END AS mark
       FROM found, rows)
"""
_JOINT = f"""
WITH t AS (SELECT row_id, lower(term) AS term FROM (
             SELECT row_id, unnest({_TERMS.format("concat_ws(chr(10), title, text)")}) AS term FROM indexed_docs)
           WHERE length(term) BETWEEN 2 AND 40),
     joint AS (SELECT row_id, term, count(*) AS n FROM t GROUP BY row_id, term),
     marginal AS (SELECT term, sum(n) AS term_n, count(*) AS term_rows FROM joint GROUP BY term),
     context AS (SELECT row_id, sum(n) AS row_terms FROM joint GROUP BY row_id),
     smooth AS (SELECT sum(pow(row_terms, 0.75)) AS s FROM context)
"""


def oracle_sql() -> dict[str, str]:
    brk = r"[^ \t\n.!?;,。！？；，、]"
    return {
        "p3_frequencies": _FREQUENCIES + "SELECT * FROM marked",
        "p3_found": _FREQUENCIES + "SELECT field_name, term, mark FROM marked WHERE mark <> 'kept'",
        "p4_found": f"""
            SELECT row_id, CAST(regexp_matches(text, '{brk}{{1000}}{brk}{{1000}}{brk}') AS INTEGER) AS forced
            FROM indexed_docs
            WHERE length(text) > 0 AND length(text) + coalesce(list_sum(list_transform(breadcrumbs, lambda x: coalesce(length(x), 0))), 0) > 2000""",
        "p6_scores": _JOINT + """
            SELECT joint.row_id, joint.term, joint.n, term_rows, round(greatest(0, ln(joint.n * s / (term_n * pow(row_terms, 0.75)))), 4) AS score
            FROM joint JOIN marginal USING (term) JOIN context USING (row_id), smooth""",
        "p6_found": _JOINT + "SELECT row_id, term FROM joint JOIN marginal USING (term) WHERE n >= 3 AND term_rows BETWEEN 2 AND 5",
    }
