"""Pieces of the index-side text analysis as native column expressions; whole texts are analysed by ``tokenizer``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import wordlists as W

CJK_RUN = "[\\x{4e00}-\\x{9fff}]+"
#: A number and the word after it, both whole tokens, with only blanks between.
NUMBER_WORD = "(?<![0-9A-Za-z._-])([0-9]+)[ \\t]+([A-Za-z]{2,})(?![0-9A-Za-z._-])"


def number_terms(text: Column) -> Column:
    """``40 pin`` gives the term 40pin, beside its two tokens."""
    pairs = F.regexp_extract_all(text, F.lit(NUMBER_WORD), F.lit(0))
    return F.transform(pairs, lambda x: F.lower(F.regexp_replace(x, "[ \\t]+", "")))


def cjk_segments(text: Column) -> Column:
    """Pieces of at least two characters between the stop words and stop characters of each CJK run."""
    runs = F.regexp_extract_all(text, F.lit(CJK_RUN), F.lit(0))
    pieces = F.flatten(F.transform(runs, lambda x: F.split(x, W.CJK_BREAK, -1)))
    return F.filter(pieces, lambda x: F.length(x) >= 2)


def url_path(url: Column) -> Column:
    """The part of a url after its host; empty without one, the whole string without a scheme."""
    after = F.regexp_extract(url, "^[^:]*://[^/]*(/.*)?$", 1)
    return F.when(F.instr(url, "://") > 0, after).otherwise(F.coalesce(url, F.lit("")))


def body_text(snippet: Column, text: Column, breadcrumbs: Column) -> Column:
    """Snippet, text and breadcrumbs, empty ones left out, cut at the indexed length."""
    parts = F.concat_ws(" ", F.nullif(snippet, F.lit("")), F.nullif(text, F.lit("")), F.array_join(F.filter(F.coalesce(breadcrumbs, F.array().cast("array<string>")), lambda x: F.length(x) > 0), " "))
    return F.substring(F.rtrim(parts), 1, W.BODY_CAP)
