"""Distinct values and terms: how often each occurs, in how many rows, and how it marks its row (problems 3 and 6)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfathom.session import spread, written

#: The characters of a term and its length in characters.
TERM_RUN = "[0-9A-Za-zÀ-ÖØ-öø-ÿ]+"
TERM_MIN, TERM_MAX = 2, 40


def terms_of(text: str | None, find=re.compile(TERM_RUN).findall) -> list[str]:
    """Terms of a text in order, repeated ones included. Runs are cut in the stored text and lower-cased afterwards."""
    return [x.lower() for x in find(text) if TERM_MIN <= len(x) <= TERM_MAX] if text else []


def _counted(text: str) -> dict[str, int]:
    n: dict[str, int] = {}
    for x in terms_of(text):
        n[x] = n.get(x, 0) + 1
    return n


def _rows_of_batch(batch: pa.RecordBatch, first: int) -> Iterator[str]:
    """The texts of a row in the columns from ``first`` on as one text, kept apart by a line feed, which no term contains."""
    columns = [c.to_pylist() for c in batch.columns[first:]]
    if len(columns) == 1:
        yield from ((x or "") for x in columns[0])
    else:
        yield from ("\n".join(x for x in row if x) for row in zip(*columns))


def _partial_counts(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """Occurrences and rows of each term in this task, handed on whenever more than ``held`` terms are kept."""
    occurrences: dict[str, int] = {}
    rows: dict[str, int] = {}

    def out() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays(
            [pa.array(list(occurrences), pa.string()), pa.array(list(occurrences.values()), pa.int64()), pa.array(list(rows.values()), pa.int64())],
            names=["term", "occurrences", "n_rows"],
        )
        occurrences.clear()
        rows.clear()
        return done

    for batch in batches:
        for text in _rows_of_batch(batch, 0):
            for x, n in _counted(text).items():
                if x in rows:
                    occurrences[x] += n
                    rows[x] += 1
                else:
                    occurrences[x], rows[x] = n, 1
        if len(rows) > held:
            yield out()
    if rows:
        yield out()


def term_counts(df: DataFrame, *columns: str, held: int = 200_000) -> DataFrame:
    """(term, occurrences, n_rows) of every distinct term of the ``columns`` taken together.

    Each task counts per row, combines its rows in a hash table of about ``held`` terms and sends the sums on; the
    shuffle therefore carries distinct terms of tasks, never occurrences, and a term found in every row is no hot key.
    Null and empty texts have no terms; a repeated row counts as often as it is there; an empty table has no terms.
    """
    if not columns:
        raise ValueError("no column to take terms from")
    parts = spread(df.select(*(df[c] for c in columns))).mapInArrow(partial(_partial_counts, held=held), "term string, occurrences long, n_rows long")
    return parts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("n_rows").alias("n_rows"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(term, occurrences, n_rows) of every distinct stored value of ``column``; nulls are no value, empty strings are one.

    The aggregate combines in each task before it shuffles, so that a value held by a third of the rows is no hot key.
    """
    return df.select(df[column].alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("occurrences")).withColumn("n_rows", F.col("occurrences"))


def _mark(rows: int, common_share: float, rare_rows: int) -> Column:
    return F.when(F.col("n_rows") <= rare_rows, "rare").when(F.col("n_rows") > common_share * rows, "common").otherwise("kept")


def frequencies(df: DataFrame, texts: dict[str, float], values: dict[str, float], rare_rows: int = 1) -> DataFrame:
    """(field_name, term, occurrences, n_rows, mark) over all rows of ``df``.

    ``texts`` and ``values`` name the columns of terms and of whole values, each with the share of all rows above which
    an entry is too common. mark: 'rare' in at most ``rare_rows`` rows, 'common' above the share, else 'kept'. What is
    both, in a very small table, is 'rare'. Columns that are not named are not read and may have any name.
    """
    rows = df.count()
    parts = [term_counts(df, c).withColumn("mark", _mark(rows, share, rare_rows)).withColumn("field_name", F.lit(c)) for c, share in texts.items()]
    parts += [value_counts(df, c).withColumn("mark", _mark(rows, share, rare_rows)).withColumn("field_name", F.lit(c)) for c, share in values.items()]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.select("field_name", "term", "occurrences", "n_rows", "mark")


def _joint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, terms, counts, lengths, firsts = [], [], [], [], []
        for k, text in enumerate(_rows_of_batch(batch, 1)):
            own = _counted(text)
            if own:
                at += [k] * len(own)
                terms += own
                counts += own.values()
                lengths += [sum(own.values())] * len(own)
                firsts += [True] + [False] * (len(own) - 1)
        columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(terms, pa.string()), pa.array(counts, pa.int32()), pa.array(lengths, pa.int32()), pa.array(firsts, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "term", "n", "row_terms", "first"])


def distinctive_terms(df: DataFrame, id_column: str, *columns: str, exponent: float = 0.75, least: int = 1, hot_rows: int = 200) -> DataFrame:
    """(id, term, n, row_terms, term_n, term_rows, score): positive pointwise mutual information of term and row.

    score = max(0, ln(p(term, row) / (p(term) * p'(row)))) with p(term, row) = n / N, p(term) = term_n / N and the
    context's share smoothed, p'(row) = row_terms^exponent / sum of row_terms^exponent over all rows. ``least`` leaves
    out pairs with fewer occurrences from the result, not from the counts. Every physical row is a row of its own, also
    under a repeated or null id. Rows without terms have no line.

    Texts are read once: the joint counts are written to the shared folder, and the marginals, the context sum and the
    pairs are group-bys and joins of that table. A term in more than 1 of ``hot_rows`` rows would be a hot key; there
    are at most hot_rows times the mean number of distinct terms of a row of these, whatever the size of the table, so
    their marginals are handed to the tasks and the join by key meets the other terms only.
    """
    if not columns:
        raise ValueError("no column to take terms from")
    texts = df.select(df[id_column].alias("id"), *(df[c].alias(f"text_{i}") for i, c in enumerate(columns)))
    id_type = df.schema[id_column].dataType.simpleString()
    joint = written(spread(texts).mapInArrow(_joint, f"id {id_type}, term string, n int, row_terms int, first boolean"))
    sums = joint.where("first").agg(F.sum(F.pow("row_terms", F.lit(exponent))), F.count("*")).first()
    smoothed, rows = (sums[0] or 0.0), (sums[1] or 0)
    marginals = joint.groupBy("term").agg(F.sum("n").alias("term_n"), F.count("*").alias("term_rows"))
    limit = max(1000, rows // hot_rows)
    hot = F.broadcast(df.sparkSession.createDataFrame([tuple(r) for r in marginals.where(F.col("term_rows") > limit).collect()], "term string, term_n long, term_rows long"))
    pairs = joint.where(F.col("n") >= least).drop("first")
    # Pairs that are not asked for are left out before the join, and so are the marginals of their terms.
    both = pairs.join(hot, "term").unionByName(pairs.join(hot, "term", "left_anti").join(marginals.where(F.col("term_rows") <= limit), "term"))
    # n / N / (term_n / N * row_terms^a / S) = n * S / (term_n * row_terms^a)
    score = F.greatest(F.lit(0.0), F.log(F.col("n") * F.lit(float(smoothed)) / (F.col("term_n") * F.pow("row_terms", F.lit(exponent)))))
    return both.select(F.col("id").alias(id_column), "term", F.col("n").cast("long").alias("n"), F.col("row_terms").cast("long").alias("row_terms"), "term_n", "term_rows", score.alias("score"))
