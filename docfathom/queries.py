"""Queries of the core's operators on the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docfathom.functions import analysis, boards, urls
from docfathom.functions import text as T
from docfathom.functions import wordlists as W
from docfathom.operators import curation, evalkit, index, ranking
from docfathom.session import spread, table, written

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from docfathom import more_queries, record_queries  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from docfathom import more_queries, record_queries  # noqa: F401

    return dict(_SQL)


# --- Documents and the index ----------------------------------------------------------------------------------------


def docs(spark: SparkSession, d: str) -> DataFrame:
    return index.latest_documents(table(spark, d, "indexed_docs")).withColumn("doc_id", F.col("row_id"))


def posts(spark: SparkSession, d: str) -> DataFrame:
    return index.postings(docs(spark, d))


def _in(words) -> str:
    return "(" + ", ".join(f"'{x}'" for x in sorted(set(words))) + ")"


DOCS = """docs AS (SELECT * EXCLUDE (nth), row_id AS doc_id FROM (
  SELECT *, row_number() OVER (PARTITION BY manual_id, doc_ord ORDER BY ingested_at DESC, row_id DESC) AS nth FROM indexed_docs) WHERE nth = 1)"""
_EDGE = "[^0-9A-Za-z._-]"


def terms_sql(source: str, keys: str) -> str:
    """CTEs that analyse column x of ``source`` (columns ``keys``, f, s, x) into analysed(keys, f, term, w)."""
    return rf"""
tok AS (SELECT {keys}, f, s, unnest(regexp_extract_all(x, '[0-9A-Za-z._-]+')) AS raw FROM {source}),
num AS (SELECT {keys}, f, s, unnest(regexp_extract_all(regexp_replace(x, '({_EDGE})', '\1\1', 'g'), '(?:^|{_EDGE})([0-9]+[ \t]+[A-Za-z]{{2,}})(?:$|{_EDGE})', 1)) AS raw FROM {source}),
run AS (SELECT {keys}, f, s, unnest(regexp_extract_all(x, '[\x{{4e00}}-\x{{9fff}}]+')) AS raw FROM {source}),
seg AS (SELECT {keys}, f, s, piece FROM (SELECT {keys}, f, s, unnest(regexp_split_to_array(raw, '{W.CJK_BREAK}')) AS piece FROM run) WHERE length(piece) >= 2),
every AS (
  SELECT {keys}, f, lower(raw) AS term, s AS w FROM tok
  UNION ALL SELECT {keys}, f, regexp_replace(lower(raw), '[-_.]', '', 'g'), s FROM tok WHERE regexp_matches(raw, '[._-]') AND length(regexp_replace(raw, '[-_.]', '', 'g')) >= 6
  UNION ALL SELECT {keys}, f, unnest(regexp_split_to_array(lower(raw), '[-_.]+')), 0.5 * s FROM tok WHERE regexp_matches(raw, '[._-]')
  UNION ALL SELECT {keys}, f, lower(regexp_replace(raw, '[ \t]+', '')), s FROM num
  UNION ALL SELECT {keys}, f, piece, s FROM seg WHERE length(piece) BETWEEN 3 AND 8
  UNION ALL SELECT {keys}, f, substring(piece, i, 2), s FROM (SELECT {keys}, f, s, piece, unnest(range(1, length(piece))) AS i FROM seg)),
analysed AS (SELECT * FROM every WHERE length(term) >= 2 AND term NOT IN {_in(W.EN_STOP)} AND (w >= 1 OR term NOT IN {_in(W.FRAGMENT_SKIP)}))"""


URL_PATH_SQL = "CASE WHEN instr(url, '://') > 0 THEN regexp_extract(url, '^[^:]*://[^/]*(/.*)?$', 1) ELSE coalesce(url, '') END"
BODY_SQL = f"left(rtrim(concat_ws(' ', nullif(snippet, ''), nullif(text, ''), array_to_string(list_filter(coalesce(breadcrumbs, []), lambda c: length(c) > 0), ' '))), {W.BODY_CAP})"
POSTINGS = f"""WITH {DOCS},
fields AS (
  SELECT doc_id, manual_id, 't' AS f, 1.0::DOUBLE AS s, coalesce(title, '') AS x FROM docs
  UNION ALL SELECT doc_id, manual_id, 'u', 1.0, {URL_PATH_SQL} FROM docs
  UNION ALL SELECT doc_id, manual_id, 'b', 1.0, {BODY_SQL} FROM docs
  UNION ALL SELECT doc_id, manual_id, 'a', 0.5, left(coalesce(answer, ''), {W.BODY_CAP}) FROM docs),
{terms_sql("fields", "doc_id, manual_id")},
summed AS (SELECT doc_id, manual_id, term, sum(CASE f WHEN 't' THEN w ELSE 0 END) AS tf_title, sum(CASE f WHEN 'u' THEN w ELSE 0 END) AS tf_url,
    sum(CASE f WHEN 'b' THEN w ELSE 0 END) AS own, sum(CASE f WHEN 'a' THEN w ELSE 0 END) AS answers FROM analysed GROUP BY ALL),
post AS MATERIALIZED (SELECT doc_id, manual_id, term, tf_title::DOUBLE AS tf_title, tf_url::DOUBLE AS tf_url, (CASE WHEN own >= 0.5 THEN own ELSE least(0.5, own + answers) END)::DOUBLE AS tf_body FROM summed),
lengths AS (SELECT manual_id, doc_id, sum(tf_title) AS len_title, sum(tf_url) AS len_url, sum(tf_body) AS len_body FROM post GROUP BY ALL),
frequencies AS (SELECT manual_id, term, count(*) AS df, count(*) FILTER (WHERE tf_title > 0 OR tf_url > 0 OR tf_body > 0.5) AS df_outside_answers FROM post GROUP BY ALL),
sums AS (SELECT manual_id, n_docs, coalesce(sum_title, 0) AS sum_title, coalesce(sum_url, 0) AS sum_url, coalesce(sum_body, 0) AS sum_body
  FROM (SELECT manual_id, count(*) AS n_docs FROM docs GROUP BY ALL)
  LEFT JOIN (SELECT manual_id, sum(len_title) AS sum_title, sum(len_url) AS sum_url, sum(len_body) AS sum_body FROM lengths GROUP BY ALL) USING (manual_id))
"""


@query(f"WITH {DOCS} SELECT manual_id, doc_ord, row_id, title, url, kind FROM docs")
def latest_documents(spark, d):
    return docs(spark, d).select("manual_id", "doc_ord", "row_id", "title", "url", "kind")


@query(f"WITH src AS (SELECT row_id, 't' AS f, 1.0 AS s, coalesce(text, '') AS x FROM indexed_docs), {terms_sql('src', 'row_id')} SELECT row_id, term, sum(w)::DOUBLE AS weight FROM analysed GROUP BY ALL")
def analysed_terms(spark, d):
    return index.analysed(table(spark, d, "indexed_docs"), "row_id", "text").withColumnRenamed("id", "row_id")


@query(f"WITH src AS (SELECT row_id, 't' AS f, 1.0 AS s, coalesce(text, '') AS x FROM indexed_docs), {terms_sql('src', 'row_id')} SELECT row_id, term FROM (SELECT row_id, lower(regexp_replace(raw, '[ \\t]+', '')) AS term FROM num)")
def number_terms(spark, d):
    return table(spark, d, "indexed_docs").select("row_id", F.explode(analysis.number_terms(F.col("text"))).alias("term"))


@query(f"WITH src AS (SELECT row_id, 't' AS f, 1.0 AS s, coalesce(text, '') AS x FROM indexed_docs), {terms_sql('src', 'row_id')} SELECT row_id, piece FROM seg")
def cjk_segments(spark, d):
    return table(spark, d, "indexed_docs").select("row_id", F.explode(analysis.cjk_segments(F.coalesce("text", F.lit("")))).alias("piece"))


@query(POSTINGS + "SELECT * FROM post")
def postings(spark, d):
    return posts(spark, d)


@query(POSTINGS + "SELECT * FROM lengths")
def document_lengths(spark, d):
    return index.document_lengths(posts(spark, d))


@query(POSTINGS + "SELECT * FROM sums")
def corpus_sums(spark, d):
    return index.corpus_sums(docs(spark, d), index.document_lengths(posts(spark, d)))


@query(POSTINGS + "SELECT * FROM frequencies")
def document_frequencies(spark, d):
    return index.document_frequencies(posts(spark, d))


@query(POSTINGS + "SELECT term, sum(df)::BIGINT AS df, round(CASE WHEN x < 3.2 THEN x * (0.45 + 0.55 * x / 3.2) ELSE x END, 6) AS damped_idf FROM (SELECT term, sum(df) AS df, ln(1 + (n - sum(df) + 0.5) / (sum(df) + 0.5)) AS x FROM frequencies, (SELECT sum(n_docs) AS n FROM sums) GROUP BY term, n) GROUP BY term, x")
def damped_idf(spark, d):
    rows = docs(spark, d)
    n = rows.count()
    df = index.document_frequencies(index.postings(rows)).groupBy("term").agg(F.sum("df").alias("df"))
    return df.select("term", "df", F.round(ranking.damped(ranking.idf(F.lit(float(n)), F.col("df"))), 6).alias("damped_idf"))


# --- Batch search ---------------------------------------------------------------------------------------------------

QUERY_TERMS = f"""qsrc AS (SELECT item_id AS query_id, 'q' AS f, 1.0 AS s, lower(coalesce(query, '')) AS x FROM eval_items),
{terms_sql("qsrc", "query_id").replace("tok AS", "qtok AS").replace("num AS", "qnum AS").replace("run AS", "qrun AS").replace("seg AS", "qseg AS").replace("every AS", "qevery AS").replace("analysed AS", "qanalysed AS").replace("FROM tok", "FROM qtok").replace("FROM num", "FROM qnum").replace("FROM run", "FROM qrun").replace("FROM seg", "FROM qseg").replace("FROM every", "FROM qevery")},
query_terms AS (SELECT query_id, term, 1.0::DOUBLE AS qtf FROM qanalysed GROUP BY query_id, term HAVING sum(w) >= 1)"""
_SAT = "CASE WHEN tf_{0} > 0 THEN tf_{0} * 2.2 / (tf_{0} + 1.2 * (0.25 + 0.75 * (CASE WHEN len_{0} = 0 THEN 1 ELSE len_{0} END) / (CASE WHEN all_{0} = 0 THEN 1 ELSE all_{0} / n END))) ELSE 0 END"
SCORES = POSTINGS + f""", {QUERY_TERMS},
stats AS (SELECT sum(n_docs)::DOUBLE AS n, sum(sum_title) AS all_title, sum(sum_url) AS all_url, sum(sum_body) AS all_body FROM sums),
wanted AS (SELECT query_id, term, qtf, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM query_terms JOIN (SELECT term, sum(df) AS df FROM frequencies GROUP BY term) USING (term), stats),
scored AS (SELECT query_id, post.manual_id, post.doc_id, term, idf,
    (3 * {_SAT.format("title")} + 1.6 * {_SAT.format("url")} + {_SAT.format("body")}) * (CASE WHEN idf < 3.2 THEN idf * (0.45 + 0.55 * idf / 3.2) ELSE idf END) * qtf AS score
  FROM post JOIN wanted USING (term) JOIN lengths USING (manual_id, doc_id), stats),
raw AS (SELECT query_id, manual_id, doc_id, round(sum(score), 6) AS raw FROM scored GROUP BY ALL),
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, manual_id, doc_id) - 1 AS bm25_rank FROM raw QUALIFY bm25_rank < {W.POOL})
"""


def literal_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = index.analysed(table(spark, d, "eval_items").withColumn("query", F.lower("query")), "item_id", "query")
    return rows.where("weight >= 1").select(F.col("id").alias("query_id"), "term", F.lit(1.0).alias("qtf"))


class Searched:
    """The kept index of a data folder and the BM25 pool of its evaluation queries."""

    def __init__(self, spark: SparkSession, d: str) -> None:
        self.docs = docs(spark, d)
        kept = index.kept_index(self.docs)
        self.post, self.lengths, self.sums, self.frequencies = kept.post, kept.lengths, kept.sums, kept.frequencies
        self.terms = written(literal_terms(spark, d))
        self.scores = ranking.term_scores(self.terms, self.post, self.sums, self.frequencies)
        self.raw = ranking.bm25(self.scores, 6)

    @cached_property
    def ranked(self) -> DataFrame:
        """The pool written once: at most W.POOL rows of each query."""
        return written(ranking.candidate_pool(self.raw))

    def pool(self) -> DataFrame:
        return self.ranked


@query(SCORES + "SELECT query_id, manual_id, doc_id, raw FROM raw")
def bm25_literal(spark, d):
    return Searched(spark, d).raw


@query(SCORES + "SELECT query_id, manual_id, doc_id, raw, bm25_rank FROM pool")
def candidate_pool(spark, d):
    return Searched(spark, d).pool()


@query(SCORES + ", best AS (SELECT DISTINCT manual_id FROM manuals WHERE searchable AND NOT no_board) SELECT query_id, count(*) AS n, max(raw) AS raw FROM pool WHERE manual_id IN (FROM best) GROUP BY ALL")
def pool_by_manual_flags(spark, d):
    kept = table(spark, d, "manuals").where("searchable and not no_board").select("manual_id")
    return Searched(spark, d).pool().join(kept, "manual_id", "left_semi").groupBy("query_id").agg(F.count("*").alias("n"), F.max("raw").alias("raw"))


@query(SCORES + """, mass AS (SELECT query_id, round(sum(idf * qtf), 6) AS idf_mass FROM wanted GROUP BY ALL) SELECT * FROM mass""")
def query_idf_mass(spark, d):
    s = Searched(spark, d)
    n = s.docs.count()
    df = s.frequencies.groupBy("term").agg(F.sum("df").alias("df"))
    return s.terms.join(df, "term").groupBy("query_id").agg(F.round(F.sum(ranking.idf(F.lit(float(n)), F.col("df")) * F.col("qtf")), 6).alias("idf_mass"))


@query(SCORES + """, hits AS (SELECT query_id, doc_id, count(DISTINCT term) AS hits FROM post JOIN query_terms USING (term) GROUP BY ALL), n AS (SELECT query_id, count(DISTINCT term) AS n FROM query_terms GROUP BY ALL)
SELECT query_id, doc_id, round(hits / n, 6) AS coverage FROM hits JOIN n USING (query_id)""")
def concept_coverage(spark, d):
    s = Searched(spark, d)
    concepts = s.terms.select("query_id", F.col("term").alias("concept_id"), F.lit(1).alias("min_hits"), "term")
    return ranking.coverage(concepts, s.post).select("query_id", "doc_id", F.round("coverage", 6).alias("coverage"))


_LEX_TOKENS = "lex AS (SELECT DISTINCT query_id, term AS token, false AS common FROM query_terms)"
_PAT = r"""CASE WHEN regexp_matches(token, '^[\x00-\x7f]+$') THEN CASE WHEN length(token) <= 3 THEN '(?:^|[^a-z])' || q || '(?:$|[^a-z])' ELSE '(?:^|[^a-z0-9])' || q END ELSE q END"""
LEXICAL = SCORES + f""", {_LEX_TOKENS},
cand AS (SELECT query_id, doc_id, lower(coalesce(title, '')) AS title, kind, left(lower(coalesce(answer, '')), {W.SCAN_CAP}) AS answer,
    left(lower(concat_ws(' ', nullif(snippet, ''), nullif(text, ''), nullif(array_to_string(list_filter(coalesce(breadcrumbs, []), lambda c: length(c) > 0), ' '), ''))), {W.SCAN_CAP}) AS extra
  FROM pool JOIN docs USING (doc_id)),
pat AS (SELECT query_id, token, token IN {_in(W.WEAK_TITLE)} AS weak, {_PAT} AS p FROM (SELECT *, regexp_replace(token, '([\\\\.^$|?*+()\\[\\]{{}}-])', '\\\\\\1', 'g') AS q FROM lex)),
test AS (SELECT cand.query_id, doc_id, kind, token, weak, title, regexp_matches(title, p) AS it, regexp_matches(extra, p) AS ie, regexp_matches(answer, p) AS ia FROM cand JOIN pat USING (query_id)),
pts AS (SELECT query_id, doc_id, CASE WHEN weak THEN CASE WHEN ie OR ia THEN 1 ELSE 0 END ELSE (CASE WHEN title = token THEN 14 WHEN it THEN 10 ELSE 0 END) + (CASE WHEN ie THEN 3 WHEN ia THEN 1 ELSE 0 END) + (CASE WHEN kind = 'page' AND it THEN 2 ELSE 0 END) END AS pt,
    CASE WHEN weak THEN ie OR ia ELSE title = token OR it OR ie OR ia END AS hit, NOT weak AND (title = token OR it) AS th FROM test),
agg AS (SELECT query_id, doc_id, sum(pt) AS pt, count(*) FILTER (WHERE hit) AS m, count(*) FILTER (WHERE th) AS th, count(*) AS n FROM pts GROUP BY ALL),
lexical AS (SELECT query_id, doc_id, CAST(CASE WHEN n >= 4 AND m = 1 AND th = 0 THEN least(f, 4) ELSE f END AS BIGINT) AS lexical FROM (SELECT *, pt + CASE WHEN n > 1 THEN floor(12.0 * m / n + 0.5) ELSE 0 END AS f FROM agg))
"""


def _lexical(s: Searched) -> tuple[DataFrame, DataFrame]:
    pool = s.pool()
    cand = pool.select("query_id", "doc_id").join(spread(ranking.lexical_fields(s.docs)), "doc_id")
    return pool, ranking.lexical_scores(cand, s.terms.select("query_id", F.col("term").alias("token"), F.lit(False).alias("common")))


@query(LEXICAL + "SELECT * FROM lexical")
def lexical_scores(spark, d):
    return _lexical(Searched(spark, d))[1]


FUSED = LEXICAL + f""", ranked AS (SELECT query_id, doc_id, bm25_rank, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, bm25_rank) - 1 AS lexical_rank FROM pool JOIN lexical USING (query_id, doc_id)),
fused AS (SELECT query_id, doc_id, bm25_rank, lexical_rank, 1.0::DOUBLE / (10 + bm25_rank) + 0.22::DOUBLE / (10 + lexical_rank) AS score FROM ranked)
"""


def fused_hits(s: Searched) -> DataFrame:
    pool, lexical = _lexical(s)
    rows = pool.select("query_id", "doc_id", "bm25_rank").join(lexical, ["query_id", "doc_id"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lexical"), "bm25_rank")) - 1
    rows = rows.withColumn("lexical_rank", rank)
    return rows.select("query_id", "doc_id", "bm25_rank", "lexical_rank", ranking.fused(F.col("bm25_rank"), F.col("lexical_rank")).alias("score"))


@query(FUSED + "SELECT * EXCLUDE (score), round(score, 9) AS score FROM fused")
def rank_fusion(spark, d):
    return fused_hits(Searched(spark, d)).withColumn("score", F.round("score", 9))


PAGES = FUSED + """, chunk AS (SELECT query_id, split_part(url, '#', 1) AS page, doc_id, score FROM fused JOIN docs USING (doc_id)),
nth AS (SELECT *, row_number() OVER (PARTITION BY query_id, page ORDER BY score DESC, doc_id) AS k FROM chunk),
pages AS (SELECT query_id, page, (floor((sum(CAST(round(1e12 * (CASE WHEN k = 1 THEN score ELSE 0.3 * score / (k - 1) END)) AS BIGINT)) + 500000) / 1e6) / 1e6)::DOUBLE AS score, max(CASE WHEN k = 1 THEN doc_id END) AS doc_id, count(*) AS n_chunks FROM nth GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page) AS place FROM pages)
"""


def page_hits(s: Searched) -> DataFrame:
    chunks = fused_hits(s).join(s.docs.select("doc_id", urls.page_url(F.col("url")).alias("page")), "doc_id").select("query_id", "page", "doc_id", "score")
    pages = ranking.pages_of_chunks(chunks, 6)
    return pages.withColumn("place", F.row_number().over(ranking.by_rank("score", "page")))


@query(PAGES + "SELECT * FROM placed")
def page_aggregation(spark, d):
    return page_hits(Searched(spark, d))


CASES = PAGES + """, scored_cases AS (
  SELECT item_id, coalesce(any_value(expect_no_good_match), false) AS abstains, min(place) FILTER (WHERE len(list_filter(coalesce(expect_url_includes, []), lambda x: contains(lower(page), lower(x)))) > 0) AS good, count(place) AS n
  FROM eval_items LEFT JOIN (SELECT * FROM placed WHERE place <= 20) p ON item_id = query_id GROUP BY item_id),
ranks AS (SELECT item_id, CASE WHEN abstains THEN CASE WHEN n = 0 THEN 1 END ELSE good END AS rank FROM scored_cases)
"""


def case_ranks(spark: SparkSession, d: str) -> DataFrame:
    hits = page_hits(Searched(spark, d)).where("place <= 20").select(F.col("query_id").alias("item_id"), "place", F.col("page").alias("url"), F.lit(False).alias("weak"))
    return evalkit.ranks(table(spark, d, "eval_items"), hits)


@query(CASES + "SELECT item_id, coalesce(rank, 0) AS rank, (coalesce(rank, 99) <= 1)::INT AS hit_at_1, (coalesce(rank, 99) <= 3)::INT AS hit_at_3, round(coalesce(1.0 / rank, 0), 6) AS reciprocal_rank FROM ranks")
def retrieval_ranks(spark, d):
    return case_ranks(spark, d).select("item_id", F.coalesce("rank", F.lit(0)).alias("rank"), "hit_at_1", "hit_at_3", F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


@query(CASES + "SELECT count(*) AS n, round(avg((coalesce(rank, 99) <= 1)::INT), 3) AS hit_at_1, round(avg((coalesce(rank, 99) <= 3)::INT), 3) AS hit_at_3, round(avg(coalesce(1.0 / rank, 0)), 3) AS mrr FROM ranks")
def retrieval_summary(spark, d):
    return evalkit.summary(case_ranks(spark, d))


# --- Scales of single documents -------------------------------------------------------------------------------------


@query(f"WITH {DOCS} " + r"""SELECT doc_id, CASE WHEN steps >= 2 OR code >= 2 THEN CASE WHEN guide THEN 1.22 ELSE 1.15 END WHEN steps = 1 OR code = 1 OR guide THEN 1.08 ELSE 1.0 END::DOUBLE AS scale FROM (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '(?:^|\n)\s*\d+[.、)]|第[0-9一二三四五六七八九十]{1,3}步')) AS steps, len(regexp_extract_all(coalesce(text, ''), '```|`[^`\n]{2,}`')) AS code,
    regexp_matches(trim(coalesce(title, '')), '^(?:\d+\.)+\d*\s+\S|(?i:指南|教程|步骤|示例|howto)|(?:^|[^A-Za-z0-9_])(?i:tutorial|guide)(?:$|[^A-Za-z0-9_])') AS guide FROM docs)""")
def structure_scale(spark, d):
    return docs(spark, d).select("doc_id", ranking.structure_scale(F.col("title"), F.col("text")).alias("scale"))


@query(POSTINGS + """SELECT doc_id, round(CASE WHEN r <= 2.2 AND topics < 6 AND length(text) < 900 THEN 1.0 ELSE greatest(0.72, 1 / (1 + 0.1 * greatest(0, r - 2.2) + 0.05 * greatest(0, topics - 5))) END, 6) AS scale
FROM (SELECT doc_id, coalesce(text, '') AS text, 1 + length(regexp_replace(coalesce(text, ''), '[^?？]', '', 'g')) AS topics, len_body / mean AS r FROM docs JOIN lengths USING (manual_id, doc_id), (SELECT sum(sum_body) / sum(n_docs) AS mean FROM sums))""")
def breadth_scale(spark, d):
    rows = docs(spark, d)
    lengths = index.kept_index(rows).lengths
    mean = lengths.agg(F.sum("len_body")).first()[0] / max(1, rows.count())
    scale = ranking.breadth_scale(F.col("text"), F.col("len_body"), F.lit(float(mean)))
    return rows.join(lengths, ["manual_id", "doc_id"]).select("doc_id", F.round(scale, 6).alias("scale"))


@query(f"WITH {DOCS} " + """SELECT doc_id, least(1.7, 1.28 + 0.14 * (h - 1))::DOUBLE AS scale FROM (SELECT doc_id, (contains(hay, 'recovery partition'))::INT + (contains(hay, 'changes in'))::INT + (contains(hay, '推理引擎'))::INT AS h FROM (
  SELECT doc_id, concat_ws(chr(10), lower(coalesce(title, '')), left(lower(coalesce(snippet, '')), 280), left(lower(coalesce(text, '')), 280), left(lower(coalesce(answer, '')), 280)) AS hay FROM docs)) WHERE h > 0""")
def phrase_scale(spark, d):
    needles = F.array(*map(F.lit, ("recovery partition", "Changes in", "推理引擎")))
    scale = ranking.phrase_scale(needles, *map(F.col, ("title", "snippet", "text", "answer")))
    return docs(spark, d).select("doc_id", F.round(scale, 6).alias("scale")).where("scale > 1")


@query(r"""SELECT row_id, list_filter([CASE WHEN regexp_matches(x, '(?:^|[^a-z0-9_])t5(?:$|[^a-z0-9_])|tavrix[\s_-]*t[\s_-]*5(?:$|[^0-9])') THEN 't5' END, CASE WHEN regexp_matches(x, '(?:^|[^a-z0-9_])t2(?:$|[^a-z0-9_])|tavrix[\s_-]*t[\s_-]*2(?:$|[^0-9])') THEN 't2' END,
  CASE WHEN regexp_matches(x, '(?:^|[^a-z0-9_])s6(?:$|[^a-z0-9_])|orlo[\s_-]*s[\s_-]*6(?:$|[^0-9])') THEN 's6' END, CASE WHEN regexp_matches(x, '(?:^|[^a-z0-9_])s1(?:$|[^a-z0-9_])|orlo[\s_-]*s[\s_-]*1(?:$|[^0-9])') THEN 's1' END], lambda b: b IS NOT NULL) AS boards
FROM (SELECT row_id, lower(coalesce(title, '')) || chr(10) || regexp_replace(lower(coalesce(title, '')), '[、，,;；]+|[_./#+-]+', ' ', 'g') AS x FROM indexed_docs)""")
def mentioned_boards(spark, d):
    return table(spark, d, "indexed_docs").select("row_id", boards.mentioned_boards(F.col("title")).alias("boards"))
