"""Functions for SQL texts: registered on a session, they serve queries that are written as strings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import wordlists as W
from .tokenizer import weighted_terms

#: Expressions as SQL functions: name, arguments, result and body; the optimizer puts the bodies into the query.
EXPRESSIONS = (
    ("docfathom_page", "url STRING", "STRING", "substring_index(url, '#', 1)"),
    ("docfathom_idf", "n DOUBLE, df DOUBLE", "DOUBLE", "ln(1 + (n - df + 0.5) / (df + 0.5))"),
    ("docfathom_damped", "x DOUBLE", "DOUBLE", f"CASE WHEN x < {W.IDF_FLOOR} THEN x * (0.45 + 0.55 * x / {W.IDF_FLOOR}) ELSE x END"),
    ("docfathom_fused", "first_rank BIGINT, second_rank BIGINT", "DOUBLE", f"1D / ({W.RRF_K} + first_rank) + {W.LEXICAL_WEIGHT}D / ({W.RRF_K} + second_rank)"),
    ("docfathom_window", "x STRING, start INT, most INT", "STRING", "CASE WHEN start < length(x) THEN substring(x, start + 1, most) ELSE '' END"),
)


def register_functions(spark: SparkSession) -> list[str]:
    """Registers all functions on the session and gives their names: the expressions above, terms of a text, and Markdown of an HTML fragment."""
    from docfathom.sources.html_pages import markdown_of

    for name, args, kind, body in EXPRESSIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")

    def terms(x: pd.Series) -> pd.Series:
        return x.map(lambda t: sorted(weighted_terms(t)))

    spark.udf.register("docfathom_terms", F.pandas_udf(terms, "array<string>"))
    spark.udf.register("docfathom_markdown", markdown_of)
    return [x[0] for x in EXPRESSIONS] + ["docfathom_terms", "docfathom_markdown"]
