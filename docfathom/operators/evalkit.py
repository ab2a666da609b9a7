"""Measures of retrieval: rank of the first expected hit, hit@k, mean reciprocal rank, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fits(url: Column, needles: Column) -> Column:
    """Whether a url contains any needle, whatever the case."""
    return F.exists(F.coalesce(needles, F.array().cast("array<string>")), lambda x: F.contains(F.lower(url), F.lower(x)))


def ranks(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """(item_id, rank, hit_at_1, hit_at_3, reciprocal_rank, covers_all): cases against hits (item_id, place, url) from 1 on.

    A case that expects no good match counts as rank 1 if its hits are none or weak (``weak`` on the hit) and else as a miss.
    """
    abstains = F.coalesce("expect_no_good_match", F.lit(False))
    rows = cases.select("item_id", abstains.alias("abstains"), "expect_url_includes").join(hits, "item_id", "left")
    good = F.when(fits(F.col("url"), F.col("expect_url_includes")), F.col("place"))
    needle_hits = F.when(F.col("place") <= 3, F.filter(F.coalesce("expect_url_includes", F.array().cast("array<string>")), lambda x: F.contains(F.lower(F.col("url")), F.lower(x))))
    found = rows.groupBy("item_id").agg(
        F.first("abstains").alias("abstains"), F.min(good).alias("first_good"), F.max(F.when(F.col("place").isNotNull() & ~F.coalesce("weak", F.lit(False)), 1).otherwise(0)).alias("strong"),
        F.max(F.size(F.coalesce("expect_url_includes", F.array().cast("array<string>")))).alias("n_needles"), F.size(F.array_distinct(F.flatten(F.collect_list(needle_hits)))).alias("n_met"),
    )
    rank = F.when(F.col("abstains"), F.when(F.col("strong") == 0, 1)).otherwise(F.col("first_good"))
    return found.select(
        "item_id", rank.alias("rank"), (F.coalesce(rank, F.lit(99)) <= 1).cast("int").alias("hit_at_1"), (F.coalesce(rank, F.lit(99)) <= 3).cast("int").alias("hit_at_3"),
        F.coalesce(1 / rank, F.lit(0.0)).alias("reciprocal_rank"), ((F.col("n_needles") > 0) & (F.col("n_met") >= F.col("n_needles"))).alias("covers_all"),
    )


def summary(scored: DataFrame) -> DataFrame:
    """One row: n, hit@1, hit@3 and the mean reciprocal rank, three decimals; zeros without cases."""
    share = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 3)
    return scored.agg(F.count("*").alias("n"), share("hit_at_1").alias("hit_at_1"), share("hit_at_3").alias("hit_at_3"), share("reciprocal_rank").alias("mrr"))


def nearest_rank(value: str, share: float) -> Column:
    """The percentile by nearest rank, ceil(share * n)."""
    return F.expr(f"percentile_disc({share}) within group (order by {value})")


def facts_met(text: Column, groups: Column) -> Column:
    """Whether a text has at least one string of every group, whatever the case; true without groups."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.forall(F.coalesce(groups, F.array().cast("array<array<string>>")), lambda g: F.exists(g, lambda x: F.contains(low, F.lower(x))))


def ablation(engine, queries: list, cases: DataFrame, stages: list[str]) -> DataFrame:
    """(stage, n, hit_at_1, hit_at_3, mrr) of the search as it is ('none') and with each stage left out; the index is shared."""
    out = None
    for stage in ["none", *stages]:
        own = engine if stage == "none" else type(engine)(engine.docs, engine.manual_table, engine.boards, engine.synonyms, {*engine.without, stage}, engine.kept)
        hits = own.search(queries).select(F.col("query_id").alias("item_id"), "place", F.col("page").alias("url"), (F.col("quality") == "weak").alias("weak"))
        row = summary(ranks(cases, hits)).select(F.lit(stage).alias("stage"), "n", "hit_at_1", "hit_at_3", "mrr")
        out = row if out is None else out.unionByName(row)
    return out
