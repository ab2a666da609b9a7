"""Joins and checks that keep an index in order: mirrors, language copies, dead links, snapshot diffs and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfathom.functions import text as T
from docfathom.functions import urls as U


def probe_verdicts(probes: DataFrame) -> DataFrame:
    """(url, verdict): alive if any probe succeeded, dead if none did and at least two found nothing (404, 410), else unchecked.

    The probes are those of one check: give the rows of the check that is to decide, not those of years.
    Aggregates of fixed size per url, so that a url probed very often is no hot key.
    """
    gone, fine = F.col("status").isin(404, 410), F.col("status").between(200, 399)
    sums = probes.where("url is not null").groupBy("url").agg(F.count_if(gone).alias("gone"), F.count_if(fine).alias("fine"))
    return sums.select("url", F.when(F.col("fine") > 0, "alive").when(F.col("gone") >= 2, "dead").otherwise("unchecked").alias("verdict"))


def dead_pages(verdicts: DataFrame) -> DataFrame:
    """Urls that are dead and whose variant with or without a slash is not alive."""
    alive = verdicts.where("verdict = 'alive'").select(F.col("url").alias("variant"))
    return verdicts.where("verdict = 'dead'").withColumn("variant", U.slash_variant(F.col("url"))).join(alive, "variant", "left_anti").select("url")


def without_pages(docs: DataFrame, dead: DataFrame) -> DataFrame:
    """All chunks of the pages that are not dead."""
    return docs.withColumn("page", U.page_url(F.col("url"))).join(dead.select(F.col("url").alias("page")), "page", "left_anti").drop("page")


def mirror_pages(docs: DataFrame, least: int = 8) -> DataFrame:
    """(doc_id, kept_id) of pages whose trimmed text is that of a page at a shorter path, of which theirs is an extension.

    Pages are grouped by a hash of the text; per text only the shortest path is kept beside the groups, so a text that
    very many pages share is no group held by one task. A path extends another if that is a subsequence of its segments.
    """
    pages = docs.where((F.col("kind") == "page") & (F.length(T.trimmed(F.col("text"))) >= least))
    rows = pages.select("doc_id", "manual_id", F.sha2(T.trimmed(F.col("text")), 256).alias("same"), F.filter(F.split(U.document_path(F.col("url")), "/", -1), lambda x: F.length(x) > 0).alias("path"), "url")
    order = F.struct(F.size("path").alias("n"), F.length("url").alias("l"), F.col("url"), F.col("doc_id"))
    first = rows.groupBy("manual_id", "same").agg(F.min_by(F.struct(F.col("doc_id").alias("kept_id"), F.col("path").alias("kept_path")), order).alias("k"), F.count("*").alias("n")).where("n > 1")
    both = rows.join(first.select("manual_id", "same", "k.*"), ["manual_id", "same"]).where("doc_id <> kept_id")
    # A fold over the longer path: how many segments of the kept path are met in order.
    met = F.aggregate("path", F.lit(0), lambda n, x: F.when(F.get("kept_path", n) == x, n + 1).otherwise(n))
    return both.where(met == F.size("kept_path")).select("doc_id", "kept_id")


def without_language_copies(docs: DataFrame, mark: str = "/en/") -> DataFrame:
    """Documents less those under ``mark`` whose page exists without it too."""
    key = lambda c: F.replace(c, F.lit(mark), F.lit("/"))
    originals = docs.where(~F.contains("url", F.lit(mark))).select(F.col("url").alias("key")).distinct()
    copies = docs.where(F.contains("url", F.lit(mark))).withColumn("key", key(F.col("url"))).join(originals, "key", "left_semi").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti")


def page_counts(prior: DataFrame, loaded: DataFrame, gate: float = 0.02) -> DataFrame:
    """(manual_id, before, after, lost, fails): pages of a snapshot that the next one lacks, and whether too many are."""
    pages = lambda df: df.select("manual_id", U.page_url(F.col("url")).alias("page")).distinct()
    old = pages(prior)
    kept = old.join(pages(loaded), ["manual_id", "page"], "left_semi").groupBy("manual_id").agg(F.count("*").alias("kept"))
    rows = old.groupBy("manual_id").agg(F.count("*").alias("before")).join(kept, "manual_id", "left").fillna(0, ["kept"])
    rows = rows.join(pages(loaded).groupBy("manual_id").agg(F.count("*").alias("after")), "manual_id", "left").fillna(0, ["after"])
    return rows.select("manual_id", "before", "after", (F.col("before") - F.col("kept")).alias("lost"), ((F.col("before") - F.col("kept")) > gate * F.col("before")).alias("fails"))


def identity(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns)), 256)


def snapshot_diff(prior: DataFrame, loaded: DataFrame) -> DataFrame:
    """(manual_id, id, n_prior, n_loaded, change): a multiset comparison of (manual_id, id) rows.

    change: 'kept', 'added', 'removed', or 'recounted' where both have it in different numbers.
    """
    count = lambda df, name: df.groupBy("manual_id", "id").agg(F.count("*").alias(name))
    both = count(prior, "n_prior").join(count(loaded, "n_loaded"), ["manual_id", "id"], "full").fillna(0, ["n_prior", "n_loaded"])
    change = F.when(F.col("n_prior") == 0, "added").when(F.col("n_loaded") == 0, "removed").when(F.col("n_prior") == F.col("n_loaded"), "kept").otherwise("recounted")
    return both.withColumn("change", change)


def merged_order(prior: DataFrame, loaded: DataFrame) -> DataFrame:
    """Loaded rows with their place: rows equal to prior ones first in the prior order, the others after them by url.

    prior: (manual_id, id, ord); loaded: (manual_id, id, url, n), n telling equal rows apart from 1 on.
    """
    nth = prior.withColumn("n", F.row_number().over(Window.partitionBy("manual_id", "id").orderBy("ord")))
    rows = loaded.join(nth.select("manual_id", "id", "n", "ord"), ["manual_id", "id", "n"], "left")
    place = F.row_number().over(Window.partitionBy("manual_id").orderBy(F.col("ord").isNull(), "ord", "url", "id", "n"))
    return rows.withColumn("place", place - 1).drop("ord")


def index_health(docs: DataFrame, manuals: DataFrame, baseline: DataFrame, now: Column, stale_days: int = 14) -> DataFrame:
    """(manual_id, n_docs, baseline, age_days, health): no rows or under 0.8 of the baseline fail, old ones warn."""
    now_of = docs.groupBy("manual_id").agg(F.count("*").alias("n_docs"), F.max("ingested_at").alias("built"))
    rows = manuals.where("searchable").select("manual_id").join(now_of, "manual_id", "left").join(baseline.select("manual_id", F.col("n_docs").alias("baseline")), "manual_id", "left").fillna(0, ["n_docs"])
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp("built")) / 86400)
    health = F.when(F.col("n_docs") == 0, "fail").when(F.col("n_docs") < 0.8 * F.col("baseline"), "fail").when(age > stale_days, "warn").otherwise("ok")
    return rows.select("manual_id", "n_docs", "baseline", age.cast("long").alias("age_days"), health.alias("health"))
