"""What happens to ranked hits before they are shown: rules, pins, board preference, filling up, notes and compact form."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of a compact result in characters.
COMPACT_CHARS, SNIPPET_CHARS, SNIPPET_STEP, PIN_SCORE = 2000, 180, 20, 1000.0


@dataclass(frozen=True)
class PageRule:
    """A page that answers queries of a pattern, perhaps only for some boards or in some manuals."""

    pattern: str
    page: str
    boards: tuple[str, ...] = ()
    manuals: tuple[str, ...] = ()


def ruled_page(query: Column, board: Column, manual: Column, rules: Sequence[PageRule]) -> Column:
    """The page of the first rule that fits, or null. The ordered rules are one expression: no join with the queries."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        fits = F.coalesce(query, F.lit("")).rlike(f"(?i){rule.pattern}")
        if rule.boards:
            fits &= F.coalesce(board.isin(*rule.boards), F.lit(False))
        if rule.manuals:
            fits &= manual.isNull() | manual.isin(*rule.manuals)
        out = F.when(fits, rule.page).otherwise(out)
    return out


def pinned(hits: DataFrame, pins: DataFrame, pages: DataFrame) -> DataFrame:
    """Hits (query_id, page, score) with each query's pin (query_id, page) first, where that page is in the index (pages: page).

    The pinned page's own hit gives way. Result: (query_id, page, score, place).
    """
    good = pins.where("page is not null").join(pages, "page", "left_semi").select("query_id", "page").distinct().withColumn("score", F.lit(PIN_SCORE))
    rest = hits.select("query_id", "page", "score").join(good, ["query_id", "page"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "page"))
    return good.select("query_id", "page", "score").unionByName(rest).withColumn("place", place)


def board_first(hits: DataFrame, fits: Column) -> DataFrame:
    """Hits (query_id, place, ...) with those that fit the query's one board moved up, the order otherwise kept."""
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(~fits, "place")))


def filled_up(hits: DataFrame, more: DataFrame, limit: int) -> DataFrame:
    """Hits (query_id, page, place) and, up to ``limit``, further pages (query_id, page, rank from 0) that are not among them."""
    extra = more.join(hits, ["query_id", "page"], "left_anti")
    rows = hits.select("query_id", "page", F.lit(0).alias("part"), F.col("place").alias("ord")).unionByName(extra.select("query_id", "page", F.lit(1).alias("part"), F.col("rank").alias("ord")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("part", "ord", "page"))).where(F.col("place") <= limit).select("query_id", "page", "place")


def match_quality(n_hits: Column, weak: Column) -> Column:
    return F.when(n_hits == 0, "none").when(weak, "weak").otherwise("good")


def alias_note(query: Column, hay: Column, alias: Column) -> Column:
    """The alias by which a hit matched, where the query itself is not in its text; else null."""
    low = F.lower(hay)
    return F.when(~F.contains(low, F.lower(query)) & F.contains(low, F.lower(alias)), alias)


def compact_json(hits: list[dict], most: int = COMPACT_CHARS) -> str:
    """Hits as JSON of at most ``most`` characters: snippets are cut shorter step by step, then left out."""
    room = SNIPPET_CHARS
    while True:
        rows = []
        for h in hits:
            page, _, anchor = (h["url"] or "").partition("#")
            row = {"title": h["title"], "url": page} | ({"anchor": anchor} if anchor else {})
            if room > 0 and (snippet := " ".join((h["snippet"] or "").split())):
                row["snippet"] = snippet if len(snippet) <= room else snippet[: max(1, room - 1)].rstrip() + "…"
            rows.append(row)
        text = json.dumps(rows, ensure_ascii=False)
        if len(text) <= most or room <= 0:
            return text
        room -= SNIPPET_STEP


def _compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([compact_json(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["query_id", "result"])


def compact_results(hits: DataFrame, most_hits: int = 20) -> DataFrame:
    """(query_id, result): a query's hits (query_id, place, title, url, snippet) up to ``most_hits`` as compact JSON."""
    rows = hits.where(F.col("place") <= most_hits).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "title", "url", "snippet"))).alias("hits"))
    kind = hits.schema["query_id"].dataType.simpleString()
    return rows.select("query_id", "hits").mapInArrow(_compact, f"query_id {kind}, result string")
