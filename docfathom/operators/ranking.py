"""Ranking of batches of queries: fielded BM25, multipliers, title score, rank fusion, chunks to pages, abstention.

Queries are tables, never one job each: (query_id, term, qtf) and per-query options. Every stage adds columns, so that
each can be left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfathom.functions import wordlists as W


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def damped(x: Column) -> Column:
    """Generic terms count less: below the floor, an idf falls towards 0.45 of itself."""
    return F.when(x < W.IDF_FLOOR, x * (0.45 + 0.55 * x / W.IDF_FLOOR)).otherwise(x)


def saturated(tf: Column, length: Column, mean: Column) -> Column:
    length, mean = F.when(length == 0, 1.0).otherwise(length), F.when(mean == 0, 1.0).otherwise(mean)
    return F.when(tf > 0, tf * (W.K1 + 1) / (tf + W.K1 * (1 - W.B + W.B * length / mean))).otherwise(0.0)


def term_scores(query_terms: DataFrame, post: DataFrame, sums: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(query_id, manual_id, doc_id, term, idf, score) of each query term in each document that has it.

    Statistics are those of the corpus given: filter all tables to the same manuals first. Postings have the lengths of
    their document. Query terms are few and handed to all tasks by Spark where their size allows; postings are read by term.
    """
    stats = sums.agg(F.sum("n_docs").alias("n"), *(F.sum(f"sum_{x}").alias(f"all_{x}") for x in ("title", "url", "body"))).withColumn("one", F.lit(1))
    df = frequencies.groupBy("term").agg(F.sum("df").alias("df"))
    wanted = query_terms.join(df, "term").withColumn("one", F.lit(1)).join(F.broadcast(stats), "one").drop("one")
    rows = post.join(wanted, "term")
    raw = idf(F.col("n"), F.col("df"))
    fields = sum(w * saturated(F.col(f"tf_{x}"), F.col(f"len_{x}"), F.col(f"all_{x}") / F.col("n")) for x, w in (("title", W.TITLE_WEIGHT), ("url", W.URL_WEIGHT), ("body", W.BODY_WEIGHT)))
    return rows.select("query_id", "manual_id", "doc_id", "term", raw.alias("idf"), (fields * damped(raw) * F.col("qtf")).alias("score"))


def bm25(scores: DataFrame, digits: int = 9) -> DataFrame:
    """(query_id, manual_id, doc_id, raw): sums rounded, as their order varies."""
    return scores.groupBy("query_id", "manual_id", "doc_id").agg(F.round(F.sum("score"), digits).alias("raw"))


def by_rank(score: str, *ties: str, query: str = "query_id") -> Window:
    return Window.partitionBy(query).orderBy(F.desc(score), *ties)


def candidate_pool(raw: DataFrame, most: int = W.POOL) -> DataFrame:
    """The ``most`` best of each query with their rank from 0; the limit goes below the shuffle."""
    return raw.withColumn("bm25_rank", F.row_number().over(by_rank("raw", "manual_id", "doc_id")) - 1).where(F.col("bm25_rank") < most)


def breadth_scale(text: Column, body_length: Column, mean_body: Column) -> Column:
    """Long texts of many topics: at least 0.72."""
    text = F.coalesce(text, F.lit(""))
    topics = 1 + F.length(F.regexp_replace(text, "[^?？]", ""))
    ratio = body_length / F.when(mean_body == 0, 1.0).otherwise(mean_body)
    narrow = (ratio <= 2.2) & (topics < 6) & (F.length(text) < 900)
    scale = 1 / (1 + 0.1 * F.greatest(F.lit(0.0), ratio - 2.2) + 0.05 * F.greatest(F.lit(0), topics - 5))
    return F.when(narrow, 1.0).otherwise(F.greatest(F.lit(0.72), scale))


STEP = "(?:^|\\n)\\s*\\d+[.、)]|第[0-9一二三四五六七八九十]{1,3}步"
CODE = "```|`[^`\\n]{2,}`"
GUIDE_TITLE = "(?i)^(?:\\d+\\.)+\\d*\\s+\\S|指南|教程|步骤|示例|howto|(?<![A-Za-z0-9_])(?:tutorial|guide)(?![A-Za-z0-9_])"


def structure_scale(title: Column, text: Column) -> Column:
    """Guides: numbered steps, code marks and a guide's title."""
    text = F.coalesce(text, F.lit(""))
    steps, code = F.regexp_count(text, F.lit(STEP)), F.regexp_count(text, F.lit(CODE))
    guide = F.coalesce(F.trim(title), F.lit("")).rlike(GUIDE_TITLE)
    return F.when((steps >= 2) | (code >= 2), F.when(guide, 1.22).otherwise(1.15)).when((steps == 1) | (code == 1) | guide, 1.08).otherwise(1.0)


def thin_landing(title: Column, text: Column, answer: Column) -> Column:
    """A short label without procedure text: at most three short tokens and less than 80 characters."""
    body = F.trim(F.concat_ws(" ", F.coalesce(text, F.lit("")), F.coalesce(answer, F.lit(""))))
    tokens = F.filter(F.split(F.trim(F.coalesce(title, F.lit(""))), "[\\s/|:_-]+", -1), lambda x: F.length(x) > 0)
    words = F.exists(tokens, lambda x: x.rlike("[\\x{4e00}-\\x{9fff}]{2,}|[A-Za-z]{5,}"))
    return (structure_scale(title, text) <= 1) & (F.length(body) < 80) & F.size(tokens).between(1, 3) & ~words


def phrase_scale(needles: Column, title: Column, snippet: Column, text: Column, answer: Column) -> Column:
    """Quoted phrases found in the title or the first characters of the body."""
    cut = lambda c: F.substring(F.lower(F.coalesce(c, F.lit(""))), 1, W.SCAN_CAP)
    hay = F.concat_ws("\n", F.lower(F.coalesce(title, F.lit(""))), cut(snippet), cut(text), cut(answer))
    hits = F.size(F.filter(needles, lambda x: F.contains(hay, F.lower(x))))
    return F.when(hits > 0, F.least(F.lit(1.7), 1.28 + 0.14 * (hits - 1))).otherwise(1.0)


def coverage_blend(raw: Column, coverage: Column) -> Column:
    return raw * (0.15 + 0.85 * coverage)


def confidence(raw: Column, idf_mass: Column, hit: Column, available: Column) -> Column:
    """Three decimals: from the score by the query's idf mass, blended with the share of distinctive concepts hit."""
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw / F.when(idf_mass > 0, idf_mass).otherwise(1.0) / 2.2))
    return F.floor(F.when(available > 0, 0.75 * hit / available + 0.25 * part).otherwise(part) * 1000 + 0.5) / 1000


def concept_hits(concepts: DataFrame, post: DataFrame) -> DataFrame:
    """(query_id, concept_id, doc_id) where a document has at least min_hits of a concept's terms.

    concepts: (query_id, concept_id, min_hits, term).
    """
    rows = post.select("doc_id", "term").join(concepts, "term")
    found = rows.groupBy("query_id", "concept_id", "doc_id").agg(F.count_distinct("term").alias("n"), F.first("min_hits").alias("min_hits"))
    return found.where("n >= min_hits").select("query_id", "concept_id", "doc_id")


def coverage(concepts: DataFrame, post: DataFrame) -> DataFrame:
    """(query_id, doc_id, coverage): the share of a query's concepts that a document has."""
    n = concepts.groupBy("query_id").agg(F.count_distinct("concept_id").alias("n_concepts"))
    hits = concept_hits(concepts, post).groupBy("query_id", "doc_id").agg(F.count("*").alias("hits"))
    return hits.join(n, "query_id").select("query_id", "doc_id", (F.col("hits") / F.col("n_concepts")).alias("coverage"))


def distinctive_concepts(known: DataFrame) -> DataFrame:
    """(query_id, concept_id) of the concepts with a content term of the corpus in less than 2 % of its documents.

    known: (query_id, concept_id, term, content, df, n).
    """
    return known.where(F.col("content") & (F.col("df") / F.col("n") < W.RARE_DF)).select("query_id", "concept_id").distinct()


def useful_terms(known: DataFrame) -> DataFrame:
    """The rows of (query_id, concept_id, term, df, n) that show a concept: terms in less than 8 % of the documents, or all where it has none."""
    rare = F.col("df") / F.col("n") < W.COMMON_DF
    any_rare = F.max(rare).over(Window.partitionBy("query_id", "concept_id"))
    return known.withColumn("any_rare", any_rare).where(rare | ~F.col("any_rare")).drop("any_rare")


def common_title_terms(wanted: DataFrame, least: int = 800) -> DataFrame:
    """The terms of (query_id, term, df, n) that titles do not count for: in 8 % of the documents of a large corpus or more."""
    return wanted.where((F.col("n") >= least) & (F.col("df") / F.col("n") >= W.COMMON_DF))


def matcher_pattern(token: Column) -> Column:
    """A CJK token anywhere; a short ASCII one not beside letters, a longer one not after a letter or digit."""
    quoted = F.regexp_replace(token, "([\\\\.^$|?*+()\\[\\]{}-])", "\\\\$1")
    short = F.concat(F.lit("(?<![a-z])"), quoted, F.lit("(?![a-z])"))
    long = F.concat(F.lit("(?<![a-z0-9])"), quoted)
    return F.when(token.rlike("^[\\x00-\\x7f]+$"), F.when(F.length(token) <= 3, short).otherwise(long)).otherwise(quoted)


def lexical_fields(docs: DataFrame) -> DataFrame:
    """(doc_id, title, extra, answer, kind): what the title score looks at, lower-cased and cut at the scanned length."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    crumbs = F.array_join(F.filter(F.coalesce("breadcrumbs", F.array().cast("array<string>")), lambda x: F.length(x) > 0), " ")
    extra = F.substring(F.lower(F.concat_ws(" ", F.nullif("snippet", F.lit("")), F.nullif("text", F.lit("")), F.nullif(crumbs, F.lit("")))), 1, W.SCAN_CAP)
    return docs.select("doc_id", low(F.col("title")).alias("title"), extra.alias("extra"), F.substring(low(F.col("answer")), 1, W.SCAN_CAP).alias("answer"), "kind")


def lexical_scores(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """(query_id, doc_id, lexical) of candidates against the tokens of their query.

    docs: (query_id, doc_id, title, extra, answer, kind), see ``lexical_fields``; tokens: (query_id, token, common).
    """
    rows = docs.join(tokens.withColumn("pattern", matcher_pattern(F.col("token"))), "query_id")
    # A pattern that differs by row is compiled for each; most rows already fail the plain test.
    in_title, in_extra, in_answer = (F.contains(x, F.col("token")) & F.regexp_like(x, F.col("pattern")) for x in ("title", "extra", "answer"))
    weak = F.col("token").isin(W.WEAK_TITLE) | F.col("common")
    title_hit = ~weak & ((F.col("title") == F.col("token")) | in_title)
    points = F.when(weak, F.when(in_extra | in_answer, 1).otherwise(0)).otherwise(
        F.when(F.col("title") == F.col("token"), 14).when(in_title, 10).otherwise(0) + F.when(in_extra, 3).when(in_answer, 1).otherwise(0) + F.when((F.col("kind") == "page") & in_title, 2).otherwise(0)
    )
    hit = F.when(weak, in_extra | in_answer).otherwise(title_hit | in_extra | in_answer)
    sums = rows.groupBy("query_id", "doc_id").agg(F.sum(points).alias("points"), F.count_if(hit).alias("matched"), F.count_if(title_hit).alias("titles"), F.count("*").alias("n"))
    full = F.col("points") + F.when(F.col("n") > 1, F.floor(12 * F.col("matched") / F.col("n") + 0.5)).otherwise(0)
    capped = F.when((F.col("n") >= 4) & (F.col("matched") == 1) & (F.col("titles") == 0), F.least(full, F.lit(4))).otherwise(full)
    return sums.select("query_id", "doc_id", capped.cast("long").alias("lexical"))


def fused(bm25_rank: Column, lexical_rank: Column, weight: float = W.LEXICAL_WEIGHT) -> Column:
    return 1 / (W.RRF_K + bm25_rank) + weight / (W.RRF_K + lexical_rank)


def page_key(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def pages_of_chunks(chunks: DataFrame, digits: int = 9) -> DataFrame:
    """(query_id, page, score, doc_id, n_chunks) from (query_id, page, doc_id, score): the best chunk and a share of the others.

    The k-th best chunk adds 0.3 of its score by k - 1; the page is shown by its best chunk. Parts are summed as whole
    numbers of 1e-12, so that the sum does not depend on their order.
    """
    k = F.row_number().over(Window.partitionBy("query_id", "page").orderBy(F.desc("score"), "doc_id"))
    rows = chunks.withColumn("k", k)
    part = F.when(F.col("k") == 1, F.col("score")).otherwise(W.PAGE_REST * F.col("score") / (F.col("k") - 1))
    unit = 10 ** (12 - digits)
    total = F.floor((F.sum(F.round(part * 1e12).cast("long")) + unit // 2) / F.lit(float(unit))) / F.lit(10.0**digits)
    return rows.groupBy("query_id", "page").agg(total.alias("score"), F.max(F.when(F.col("k") == 1, F.col("doc_id"))).alias("doc_id"), F.count("*").alias("n_chunks"))


def fuse_lists(lists: DataFrame, k: int = W.RRF_K, digits: int = 9) -> DataFrame:
    """(query_id, page, score) from ranked lists (query_id, list_id, page, rank): the first place of a page in each list counts."""
    first = lists.groupBy("query_id", "list_id", "page").agg(F.min("rank").alias("rank"))
    return first.groupBy("query_id", "page").agg(F.round(F.sum(1 / (k + F.col("rank"))), digits).alias("score"))


def merged_with_quota(docs: DataFrame, forum: DataFrame, limit: int) -> DataFrame:
    """(query_id, url, source, place): documents first, up to a quarter forum hits, the rest filled up with documents.

    docs, forum: (query_id, url, rank) from 0. A url counts once, at its first place.
    """
    n_forum = forum.groupBy("query_id").agg(F.count("*").alias("n_forum"))
    quota = F.when(F.col("n_forum") > 0, F.least("n_forum", F.greatest(F.lit(1), F.lit(limit // 4)))).otherwise(0)
    both = docs.withColumn("source", F.lit("docs")).unionByName(forum.withColumn("source", F.lit("forum"))).join(n_forum, "query_id", "left").fillna(0, ["n_forum"]).withColumn("quota", quota)
    first = F.when((F.col("source") == "docs") & (F.col("rank") < limit - F.col("quota")), 0).when((F.col("source") == "forum") & (F.col("rank") < F.col("quota")), 1).when(F.col("source") == "docs", 2)
    rows = both.withColumn("part", first).where("part is not null")
    once = rows.withColumn("again", F.row_number().over(Window.partitionBy("query_id", "url").orderBy("part", "rank"))).where("again = 1")
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("part", "rank", "url")))
    return placed.where(F.col("place") <= limit).select("query_id", "url", "source", "place")
