"""Joins with the vocabulary: terms that begin with a word and a number, terms one edit away, texts that hold a string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters on which prefixes join, terms kept for one, and the shortest word that is corrected.
PREFIX_LETTERS, MOST_LONGER, LEAST_LETTERS = 4, 16, 4


def longer_terms(words: DataFrame, vocabulary: DataFrame, most: int = MOST_LONGER) -> DataFrame:
    """(word, term, df) of terms that are a word followed by a number, the most frequent ones: an equi join on four letters.

    words: (word); vocabulary: (term, df). Words of 4 to 8 letters and digits that begin with a letter.
    """
    own = words.where(F.col("word").rlike("^[a-z][a-z0-9]{3,7}$")).select("word", F.substring("word", 1, PREFIX_LETTERS).alias("start")).distinct()
    rows = own.join(vocabulary.withColumn("start", F.substring("term", 1, PREFIX_LETTERS)), "start").where("startswith(term, word) and substring(term, length(word) + 1) rlike '^v?[0-9]'")
    nth = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("df"), "term"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= most).select("word", "term", "df")


def _shortened(x: Column) -> Column:
    """The string and all strings with one letter left out."""
    at = F.sequence(F.lit(1), F.length(x))
    return F.array_distinct(F.concat(F.array(x), F.transform(at, lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))))


def _swapped(a: Column, b: Column) -> Column:
    """Whether the strings differ by two neighbours that changed places."""
    at = F.sequence(F.lit(1), F.length(a) - 1)
    swap = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a)))
    return (F.length(a) == F.length(b)) & F.exists(at, lambda i: swap(i) == b)


def edited_terms(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, term, df) of other terms one edit from a word: a letter more, less or changed, or two neighbours swapped.

    Strings one edit apart share a form with at most one letter left out, so both sides meet in an equi join on these.
    """
    fit = lambda c: F.col(c).rlike(f"^[a-z0-9]{{{LEAST_LETTERS},12}}$")
    a = words.where(fit("word")).select("word").distinct().withColumn("key", F.explode(_shortened(F.col("word"))))
    b = vocabulary.where(F.col("term").rlike("^[a-z0-9]{3,13}$")).withColumn("key", F.explode(_shortened(F.col("term"))))
    pairs = a.join(b, "key").where("word <> term").select("word", "term", "df").distinct()
    return pairs.where((F.levenshtein("word", "term") <= 1) | _swapped(F.col("word"), F.col("term")))


def substring_counts(docs: DataFrame, needles: list[str]) -> DataFrame:
    """(needle, in_title, anywhere): documents that hold each string in the title, and in title or text, whatever the case."""
    title, whole = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.concat_ws("\n", "title", "text"))
    sums = docs.agg(*(F.count_if(F.contains(x, F.lit(n.lower()))).alias(f"{k}_{i}") for i, n in enumerate(needles) for k, x in (("t", title), ("a", whole))))
    rows = F.array(*(F.struct(F.lit(n).alias("needle"), F.col(f"t_{i}").alias("in_title"), F.col(f"a_{i}").alias("anywhere")) for i, n in enumerate(needles)))
    return sums.select(F.inline(rows))
