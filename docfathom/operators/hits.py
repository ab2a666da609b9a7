"""What is decided about a query before and after its search: source, missing board, conflicts, a round of boards, the mix of sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolved_source(source: Column, manual: Column, forum_names: Sequence[str]) -> Column:
    """docs, forum or all as asked for; else forum for a manual that is one, and docs."""
    return F.when(source.isin("docs", "forum", "all"), source).when(F.lower(manual).isin(*forum_names), "forum").otherwise("docs")


def board_missing(query: Column, named: Column, manual: Column, board: Column, pattern: str) -> Column:
    """Whether a query is of a kind whose answer depends on the board, and none is named in it, by its manual or as an option."""
    return F.coalesce(query, F.lit("")).rlike(f"(?i){pattern}") & (F.size(named) == 0) & manual.isNull() & board.isNull()


def board_conflict(manual_boards: Column, board: Column) -> Column:
    """Whether the board asked for is none of those that the manual is about; a manual of no board fits all."""
    return F.coalesce((F.size(manual_boards) > 0) & ~F.array_contains(manual_boards, F.lower(board)), F.lit(False))


def first_of_each_board(hits: DataFrame) -> DataFrame:
    """Hits (query_id, place, board, ...) with the best of each board first, in their order, then the others; null is a board of its own."""
    head = F.row_number().over(Window.partitionBy("query_id", "board").orderBy("place")) == 1
    return hits.withColumn("head", head).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(~F.col("head"), "place"))).drop("head")


def source_mix(hits: DataFrame) -> DataFrame:
    """(query_id, n_docs, n_forum, n_boards) of hits (query_id, source, board)."""
    return hits.groupBy("query_id").agg(F.count_if(F.col("source") == "docs").alias("n_docs"), F.count_if(F.col("source") == "forum").alias("n_forum"), F.count_distinct("board").alias("n_boards"))
