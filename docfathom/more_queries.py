"""Queries of curation, urls, texts, forum, evaluation and catalogue operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docfathom.functions import text as T
from docfathom.functions import urls
from docfathom.operators import curation, evalkit, ranking
from docfathom.queries import DOCS, PAGES, Searched, docs, page_hits, query
from docfathom.session import table

# --- Urls and texts -------------------------------------------------------------------------------------------------

_PATH = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(split_part(url, '#', 1), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '[?].*$', ''), '/index\.html$', ''), '\.html$', ''), '/+$', '')"
_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1))"


@query(f"SELECT row_id, split_part(url, '#', 1) AS page, {_HOST} AS host, {_PATH} AS path, coalesce(regexp_extract(url, '#(.*)$', 1), '') AS anchor FROM indexed_docs")
def url_parts(spark, d):
    url = F.col("url")
    return table(spark, d, "indexed_docs").select("row_id", urls.page_url(url).alias("page"), urls.host(url).alias("host"), urls.document_path(url).alias("path"), F.coalesce(urls.anchor(url), F.lit("")).alias("anchor"))


@query(f"SELECT {_HOST} AS host, count(*) AS n FROM indexed_docs WHERE regexp_matches(url, '^(?i)https?://') AND {_HOST} IN ('docs.tavrix.example', 'wiki.orlo.example') GROUP BY ALL")
def allowed_hosts(spark, d):
    rows = table(spark, d, "indexed_docs").where(urls.allowed(F.col("url"), ("docs.tavrix.example", "wiki.orlo.example")))
    return rows.groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query("SELECT row_id, CASE WHEN starts_with(url, 'https://wiki.orlo.example/') THEN 'https://docs.tavrix.example/orlo/' || substring(url, 27) ELSE url END AS url FROM indexed_docs")
def canonical_urls(spark, d):
    moved = {"https://wiki.orlo.example/": "https://docs.tavrix.example/orlo/"}
    return table(spark, d, "indexed_docs").select("row_id", urls.canonical(F.col("url"), moved).alias("url"))


@query(r"""SELECT row_id, CASE WHEN length(x) > 280 THEN left(x, 280) || '…' ELSE x END AS excerpt FROM (SELECT row_id,
  regexp_replace(regexp_replace(regexp_replace(text, '(?m)^#{1,6}[ \t\n\f\r\v]+', '', 'g'), '[ \t\n\f\r\v]+', ' ', 'g'), '^[\s\x{00a0}\x{2000}-\x{200a}\x{202f}\x{3000}\x{feff}]+|[\s\x{00a0}\x{2000}-\x{200a}\x{202f}\x{3000}\x{feff}]+$', '', 'g') AS x FROM indexed_docs WHERE text IS NOT NULL)""")
def excerpts(spark, d):
    return table(spark, d, "indexed_docs").where("text is not null").select("row_id", T.excerpt(F.col("text")).alias("excerpt"))


@query("SELECT doc_id, CASE WHEN 500 < length(text) THEN substring(text, 501, 400) ELSE '' END AS chunk, length(text) AS total_chars, sha256(text) AS content_hash, 900 < length(text) AS truncated, coalesce(CASE WHEN 900 < length(text) THEN 900 END, -1) AS next_offset FROM documents WHERE text IS NOT NULL")
def content_windows(spark, d):
    w = T.window(F.col("text"), F.lit(500), F.lit(400)).alias("w")
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", w)
    return rows.select("doc_id", "w.chunk", F.col("w.total_chars").cast("long").alias("total_chars"), "w.content_hash", "w.truncated", F.coalesce("w.next_offset", F.lit(-1)).alias("next_offset"))


@query(f"""SELECT row_id, left(coalesce(nullif(snippet, ''), nullif(left(answer, 180), ''), nullif(left(text, 180), ''), nullif(array_to_string(breadcrumbs, ' / '), ''), list_extract(string_split(regexp_replace({_PATH}, '/+$', ''), '/'), -1)), 240) AS snippet FROM indexed_docs""")
def hit_snippets(spark, d):
    shown = T.hit_snippet(*map(F.col, ("snippet", "answer", "text", "breadcrumbs", "url")))
    return table(spark, d, "indexed_docs").select("row_id", shown.alias("snippet"))


# --- Curation -------------------------------------------------------------------------------------------------------

VERDICTS = """verdicts AS (SELECT url, CASE WHEN count(*) FILTER (WHERE status BETWEEN 200 AND 399) > 0 THEN 'alive' WHEN count(*) FILTER (WHERE status IN (404, 410)) >= 2 THEN 'dead' ELSE 'unchecked' END AS verdict FROM link_probes WHERE url IS NOT NULL GROUP BY url),
dead AS (SELECT url FROM verdicts v WHERE verdict = 'dead' AND NOT EXISTS (SELECT 1 FROM verdicts a WHERE a.verdict = 'alive' AND a.url = CASE WHEN v.url LIKE '%/' THEN regexp_replace(v.url, '/+$', '') ELSE v.url || '/' END))"""


@query(f"WITH {VERDICTS} SELECT * FROM verdicts")
def probe_verdicts(spark, d):
    return curation.probe_verdicts(table(spark, d, "link_probes"))


@query(f"WITH {VERDICTS} SELECT url FROM dead")
def dead_pages(spark, d):
    return curation.dead_pages(curation.probe_verdicts(table(spark, d, "link_probes")))


@query(f"WITH {VERDICTS} SELECT row_id FROM indexed_docs WHERE split_part(url, '#', 1) NOT IN (SELECT url FROM dead)")
def without_dead_pages(spark, d):
    dead = curation.dead_pages(curation.probe_verdicts(table(spark, d, "link_probes")))
    return curation.without_pages(table(spark, d, "indexed_docs"), dead).select("row_id")


@query(f"WITH {DOCS} SELECT doc_id FROM docs x WHERE NOT (contains(url, '/software/') AND EXISTS (SELECT 1 FROM docs y WHERE NOT contains(y.url, '/software/') AND y.url = replace(x.url, '/software/', '/')))")
def language_copies(spark, d):
    return curation.without_language_copies(docs(spark, d), "/software/").select("doc_id")


_OLD = "prior AS (SELECT * FROM indexed_docs WHERE ingested_at < (SELECT to_timestamp(avg(epoch(ingested_at))) FROM indexed_docs))"


def _prior(spark, d):
    rows = table(spark, d, "indexed_docs")
    middle = rows.agg(F.avg(F.unix_micros("ingested_at") / 1e6)).first()[0]
    return rows, rows.where(F.unix_micros("ingested_at") / 1e6 < F.lit(middle))


@query("WITH m AS (SELECT avg(epoch_us(ingested_at) / 1e6) AS m FROM indexed_docs), prior AS (SELECT * FROM indexed_docs, m WHERE epoch_us(ingested_at) / 1e6 < m), loaded AS (SELECT * FROM indexed_docs WHERE kind <> 'snippet'), "
       "o AS (SELECT DISTINCT manual_id, split_part(url, '#', 1) AS page FROM prior), n AS (SELECT DISTINCT manual_id, split_part(url, '#', 1) AS page FROM loaded), b AS (SELECT manual_id, count(*) AS before FROM o GROUP BY ALL), "
       "k AS (SELECT manual_id, count(*) AS kept FROM o SEMI JOIN n USING (manual_id, page) GROUP BY ALL), a AS (SELECT manual_id, count(*) AS after FROM n GROUP BY ALL) "
       "SELECT manual_id, before, coalesce(after, 0) AS after, before - coalesce(kept, 0) AS lost, before - coalesce(kept, 0) > 0.02 * before AS fails FROM b LEFT JOIN k USING (manual_id) LEFT JOIN a USING (manual_id)")  # fmt: skip
def drop_gate(spark, d):
    rows, prior = _prior(spark, d)
    return curation.page_counts(prior, rows.where("kind <> 'snippet'"))


@query("WITH a AS (SELECT manual_id, url AS id, count(*) AS n_prior FROM indexed_docs WHERE kind <> 'heading' GROUP BY ALL), b AS (SELECT manual_id, url AS id, count(*) AS n_loaded FROM indexed_docs WHERE kind <> 'snippet' GROUP BY ALL) "
       "SELECT manual_id, id, coalesce(n_prior, 0) AS n_prior, coalesce(n_loaded, 0) AS n_loaded, CASE WHEN n_prior IS NULL THEN 'added' WHEN n_loaded IS NULL THEN 'removed' WHEN n_prior = n_loaded THEN 'kept' ELSE 'recounted' END AS change FROM a FULL JOIN b USING (manual_id, id)")  # fmt: skip
def snapshot_diff(spark, d):
    rows = table(spark, d, "indexed_docs").select("manual_id", F.col("url").alias("id"), "kind")
    return curation.snapshot_diff(rows.where("kind <> 'heading'"), rows.where("kind <> 'snippet'"))


_NOW = "TIMESTAMP '2026-11-01 00:00:00'"


@query(f"""WITH n AS (SELECT manual_id, count(*) AS n_docs, max(ingested_at) AS built FROM indexed_docs GROUP BY ALL), b AS (SELECT manual_id, count(*) AS baseline FROM indexed_docs WHERE kind <> 'snippet' GROUP BY ALL),
j AS (SELECT m.manual_id, coalesce(n_docs, 0) AS n_docs, baseline, floor((epoch({_NOW}) - floor(epoch(built))) / 86400)::BIGINT AS age FROM manuals m LEFT JOIN n USING (manual_id) LEFT JOIN b USING (manual_id) WHERE searchable)
SELECT manual_id, n_docs, coalesce(baseline, 0) AS baseline, coalesce(age, -1) AS age_days, CASE WHEN n_docs = 0 OR n_docs < 0.8 * baseline THEN 'fail' WHEN age > 14 THEN 'warn' ELSE 'ok' END AS health FROM j""")
def index_health(spark, d):
    rows = table(spark, d, "indexed_docs")
    base = rows.where("kind <> 'snippet'").groupBy("manual_id").agg(F.count("*").alias("n_docs"))
    health = curation.index_health(rows, table(spark, d, "manuals"), base, F.lit("2026-11-01 00:00:00").cast("timestamp"))
    return health.select("manual_id", "n_docs", F.coalesce("baseline", F.lit(0)).alias("baseline"), F.coalesce("age_days", F.lit(-1)).alias("age_days"), "health")


@query(f"WITH {DOCS} SELECT manual_id, split_part(url, '#', 1) AS url, title FROM docs WHERE kind = 'page' AND contains(lower(title), 'working')")
def toc_filter(spark, d):
    rows = docs(spark, d).where((F.col("kind") == "page") & F.contains(F.lower("title"), F.lit("working")))
    return rows.select("manual_id", urls.page_url(F.col("url")).alias("url"), "title")


@query("SELECT manual_id, lower(alias) AS alias FROM (SELECT manual_id, unnest(coalesce(aliases, [])) AS alias, rowid AS ord FROM (SELECT *, row_number() OVER (ORDER BY manual_id) AS rowid FROM manuals)) WHERE alias IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(alias) ORDER BY ord) = 1")
def manual_aliases(spark, d):
    rows = table(spark, d, "manuals").select("manual_id", F.explode("aliases").alias("alias")).where("alias is not null")
    return rows.groupBy(F.lower("alias").alias("alias")).agg(F.min("manual_id").alias("manual_id"))


# --- Forum ----------------------------------------------------------------------------------------------------------


@query("SELECT topic_id, arg_min(struct_pack(title, username, cooked), (post_number, coalesce(username, ''), coalesce(cooked, ''), title)).title AS title, min(post_number) AS first_post, count(*) AS n_posts FROM forum_posts GROUP BY topic_id")
def topic_first_posts(spark, d):
    from docfathom.sources import forum

    return forum.first_posts(table(spark, d, "forum_posts")).select("topic_id", "title", "first_post", "n_posts")


@query()
def topic_markdown(spark, d):
    from docfathom.sources import forum

    return forum.topics_to_markdown(table(spark, d, "forum_posts"))


@query("SELECT DISTINCT topic_id, slug FROM forum_posts WHERE contains(lower(title), 'motion') OR len(list_filter(coalesce(tags, []), lambda t: contains(lower(t), 'motion'))) > 0 OR contains(lower(title), 'servo')")
def forum_toc(spark, d):
    from docfathom.sources import forum

    rows = table(spark, d, "forum_posts")
    return forum.listing(rows, "motion").unionByName(forum.listing(rows.where(F.contains(F.lower("title"), F.lit("servo"))), None)).select("topic_id", "slug").distinct()


_FORUM = """topics AS (SELECT DISTINCT topic_id, string_split(lower(title), ' ') AS w FROM forum_posts WHERE title IS NOT NULL),
word_pairs AS (SELECT DISTINCT topic_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pair FROM topics),
asked AS (SELECT item_id AS query_id, split_part(lower(query), ' ', 1) || ' ' || split_part(lower(query), ' ', 2) AS pair FROM eval_items),
forum AS (SELECT query_id, url, row_number() OVER (PARTITION BY query_id ORDER BY url) - 1 AS rank FROM (SELECT DISTINCT query_id, 'https://forum.example/t/' || topic_id AS url FROM asked JOIN word_pairs USING (pair)) QUALIFY rank < 20)"""


@query(PAGES + f""", {_FORUM}, nf AS (SELECT query_id, count(*) AS n_forum FROM forum GROUP BY ALL),
d AS (SELECT query_id, page AS url, place - 1 AS rank, 'docs' AS source FROM placed), united AS (SELECT *, coalesce(least(n_forum, greatest(1, 8 // 4)), 0) AS quota FROM (FROM d UNION ALL BY NAME SELECT query_id, url, rank, 'forum' AS source FROM forum) LEFT JOIN nf USING (query_id)),
parted AS (SELECT *, CASE WHEN source = 'docs' AND rank < 8 - quota THEN 0 WHEN source = 'forum' AND rank < quota THEN 1 WHEN source = 'docs' THEN 2 END AS part FROM united),
once AS (SELECT * FROM parted WHERE part IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY part, rank) = 1)
SELECT query_id, url, source, row_number() OVER (PARTITION BY query_id ORDER BY part, rank, url) AS place FROM once QUALIFY place <= 8""")
def docs_forum_merge(spark, d):
    docs_hits = page_hits(Searched(spark, d)).select("query_id", F.col("page").alias("url"), (F.col("place") - 1).alias("rank"))
    words = lambda c: F.split(F.lower(c), " ", -1)
    items = table(spark, d, "eval_items").withColumn("w", words("query")).select(F.col("item_id").alias("query_id"), F.concat(F.get("w", F.lit(0)), F.lit(" "), F.coalesce(F.get("w", F.lit(1)), F.lit(""))).alias("pair"))
    topics = table(spark, d, "forum_posts").select("topic_id", words("title").alias("w")).where("size(w) > 1").distinct()
    # Titles and queries meet on pairs of neighbouring words, an equi join.
    pairs = topics.select("topic_id", F.explode(F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))).alias("pair")).distinct()
    forum = items.join(pairs, "pair").select("query_id", F.concat(F.lit("https://forum.example/t/"), F.col("topic_id").cast("string")).alias("url")).distinct()
    forum = forum.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("url")) - 1).where("rank < 20")
    return ranking.merged_with_quota(docs_hits, forum, 8)


# --- Evaluation and freshness ---------------------------------------------------------------------------------------


@query(PAGES + """, lists AS (SELECT query_id, 'page' AS list_id, page, place AS rank FROM placed UNION ALL SELECT query_id, 'chunk', split_part(url, '#', 1), bm25_rank + 1 FROM pool JOIN docs USING (doc_id)),
firsts AS (SELECT query_id, list_id, page, min(rank) AS rank FROM lists GROUP BY ALL) SELECT query_id, page, round(sum(1.0 / (10 + rank)), 6) AS score FROM firsts GROUP BY ALL""")
def alternate_query_fusion(spark, d):
    s = Searched(spark, d)
    pages = page_hits(s).select("query_id", F.lit("page").alias("list_id"), "page", F.col("place").alias("rank"))
    chunks = s.pool().join(s.docs.select("doc_id", urls.page_url(F.col("url")).alias("page")), "doc_id")
    lists = pages.unionByName(chunks.select("query_id", F.lit("chunk").alias("list_id"), "page", (F.col("bm25_rank") + 1).alias("rank")))
    return ranking.fuse_lists(lists, digits=6)


@query("SELECT event_type, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, count(*) AS n FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(evalkit.nearest_rank("value", 0.95).alias("p95"), F.count("*").alias("n"))


@query("SELECT manual_id, count(*) FILTER (WHERE ingested_at + INTERVAL 15 MINUTE > TIMESTAMPTZ '2026-10-01 00:00:00+00') AS fresh, count(*) AS n FROM indexed_docs GROUP BY manual_id")
def ttl_freshness(spark, d):
    from docfathom.sources import cache

    fresh = cache.is_fresh(F.col("ingested_at"), F.lit(15 * 60), F.lit("2026-10-01 00:00:00").cast("timestamp"))
    return table(spark, d, "indexed_docs").groupBy("manual_id").agg(F.count_if(fresh).alias("fresh"), F.count("*").alias("n"))


@query(PAGES + ", b AS (SELECT query_id, split_part(regexp_replace(page, '^[a-zA-Z]+://[^/]*/', ''), '/', 1) AS grp, min(place) AS first_place, count(*) AS n FROM placed WHERE place <= 8 GROUP BY ALL) SELECT query_id, grp, first_place, n FROM b")
def group_hits(spark, d):
    hits = page_hits(Searched(spark, d)).where("place <= 8")
    grp = F.substring_index(F.regexp_replace("page", "^[a-zA-Z]+://[^/]*/", ""), "/", 1)
    return hits.groupBy("query_id", grp.alias("grp")).agg(F.min("place").alias("first_place"), F.count("*").alias("n"))


# --- Catalogue, sections and pages ----------------------------------------------------------------------------------


@query("""SELECT 'unknown manual' AS issue, manual_id AS key, count(*) AS n FROM indexed_docs WHERE manual_id NOT IN (SELECT manual_id FROM manuals) GROUP BY ALL
UNION ALL SELECT 'repeated place', manual_id || ':' || doc_ord, count(*) FROM indexed_docs GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'probe of no page', url, count(*) FROM link_probes WHERE url NOT IN (SELECT split_part(url, '#', 1) FROM indexed_docs) GROUP BY ALL""")
def catalog_integrity(spark, d):
    from docfathom.operators import catalog

    rows = table(spark, d, "indexed_docs")
    pages = rows.select(urls.page_url(F.col("url")).alias("page")).distinct()
    return catalog.integrity(
        catalog.missing_references(rows, "manual_id", table(spark, d, "manuals"), "manual_id", "unknown manual"),
        catalog.duplicates(rows.withColumn("place", F.concat("manual_id", F.lit(":"), F.col("doc_ord").cast("string"))), "place", "repeated place"),
        catalog.missing_references(table(spark, d, "link_probes"), "url", pages, "page", "probe of no page"),
    )


@query(r"SELECT manual_id, regexp_full_match(manual_id, '[A-Za-z0-9_][A-Za-z0-9._-]*') AS good_name, base_path IS NOT NULL AND regexp_matches(ltrim(base_path, '/'), '^[^\s%\\\x00-\x1f\x7f]+$') AND NOT regexp_matches(rtrim(ltrim(base_path, '/'), '/'), '(^|/)(\.{0,2})(/|$)') AS good_path FROM manuals")
def record_shapes(spark, d):
    from docfathom.operators import catalog

    path = F.regexp_replace("base_path", "^/+|/+$", "")
    return table(spark, d, "manuals").select("manual_id", F.col("manual_id").rlike(catalog.NAME).alias("good_name"), catalog.safe_path(path).alias("good_path"))


@query("SELECT row_id, 4 * ((contains(lower(title), 'boot'))::INT + (contains(lower(title), 'image'))::INT) + 2 * ((contains(x, 'boot'))::INT + (contains(x, 'image'))::INT) AS score FROM (SELECT row_id, title, lower(concat_ws(' ', title, snippet)) AS x FROM indexed_docs WHERE title IS NOT NULL) WHERE score > 0")
def catalog_text_scores(spark, d):
    from docfathom.operators import catalog

    score = catalog.text_score(F.col("title"), F.col("snippet"), F.array(F.lit("boot"), F.lit("image")))
    return table(spark, d, "indexed_docs").where("title is not null").select("row_id", score.alias("score")).where("score > 0")


@query(r"""SELECT row_id, unnest(regexp_extract_all(text, '(?m)^(#{1,6}[ \t]+.+)$', 1)) AS heading FROM indexed_docs""")
def heading_lines(spark, d):
    from docfathom.operators import sections

    return table(spark, d, "indexed_docs").where("text is not null").select("row_id", F.explode(sections.headings(F.col("text"))).alias("heading"))


@query()
def section_pieces(spark, d):
    from docfathom.operators import sections

    return sections.page_pieces(table(spark, d, "indexed_docs"), "row_id", "text").withColumnRenamed("page_id", "row_id")


@query()
def html_pages(spark, d):
    from docfathom.sources import html_pages as H

    posts = table(spark, d, "forum_posts").withColumn("post", F.concat_ws("/", F.col("topic_id").cast("string"), F.col("post_number").cast("string"))).withColumn("url", F.concat(F.lit("https://forum.example/t/"), F.col("post")))
    return H.read_pages(posts.withColumn("page", F.concat(F.lit("<body>"), "cooked", F.lit("</body>"))), "post", "url", "page")


@query()
def planned_search(spark, d):
    """All evaluation queries through the planner and every ranking stage."""
    from docfathom.engine import Engine

    asked = table(spark, d, "eval_items").orderBy("item_id").collect()  # the stated query set
    engine = Engine(docs(spark, d), table(spark, d, "manuals"))
    return engine.search([{"query_id": r.item_id, "query": r.query, "manual": r.manual, "board": r.board, "limit": r.max_hits} for r in asked])


# --- Results --------------------------------------------------------------------------------------------------------

from docfathom.operators import results  # noqa: E402

RULES = (
    results.PageRule("battery|akku", "https://hub.tavrix.example/rule/battery", boards=("t5",)),
    results.PageRule("build cache|构建缓存", "https://hub.tavrix.example/rule/cache"),
    results.PageRule("cache", "https://hub.tavrix.example/rule/other"),
)
_RULE_SQL = "CASE WHEN regexp_matches(lower(query), 'battery|akku') AND coalesce(board = 't5', false) THEN 'https://hub.tavrix.example/rule/battery' WHEN regexp_matches(lower(query), 'build cache|构建缓存') THEN 'https://hub.tavrix.example/rule/cache' WHEN regexp_matches(lower(query), 'cache') THEN 'https://hub.tavrix.example/rule/other' END"


@query(f"SELECT item_id, {_RULE_SQL} AS page FROM eval_items WHERE {_RULE_SQL} IS NOT NULL")
def ruled_pages(spark, d):
    page = results.ruled_page(F.col("query"), F.col("board"), F.col("manual"), RULES)
    return table(spark, d, "eval_items").select("item_id", page.alias("page")).where("page is not null")


_PINS = "pins AS (SELECT item_id AS query_id, (SELECT min(split_part(url, '#', 1)) FROM docs WHERE contains(url, '/software/')) AS page FROM eval_items WHERE contains(lower(query), 'cache'))"


@query(PAGES + f""", {_PINS}, merged AS (SELECT query_id, page, 1000.0::DOUBLE AS score FROM pins WHERE page IS NOT NULL UNION ALL SELECT query_id, page, score FROM placed ANTI JOIN pins USING (query_id, page))
SELECT query_id, page, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page) AS place FROM merged""")
def pinned_hits(spark, d):
    s = Searched(spark, d)
    pages = s.docs.select(urls.page_url(F.col("url")).alias("page")).distinct()
    first = pages.where(F.contains("page", F.lit("/software/"))).agg(F.min("page").alias("page")).withColumn("one", F.lit(1))
    pins = table(spark, d, "eval_items").where(F.contains(F.lower("query"), F.lit("cache"))).select(F.col("item_id").alias("query_id"), F.lit(1).alias("one")).join(F.broadcast(first), "one")
    return results.pinned(page_hits(s), pins, pages)


@query(PAGES + "SELECT query_id, page, row_number() OVER (PARTITION BY query_id ORDER BY NOT contains(page, 't5'), place) AS place FROM placed")
def board_preference(spark, d):
    return results.board_first(page_hits(Searched(spark, d)), F.contains("page", F.lit("t5"))).select("query_id", "page", "place")


@query(PAGES + """, h AS (SELECT query_id, page, place FROM placed WHERE place <= 3), m AS (SELECT query_id, split_part(url, '#', 1) AS page, min(bm25_rank) AS rank FROM pool JOIN docs USING (doc_id) GROUP BY ALL),
u AS (SELECT query_id, page, 0 AS part, place AS ord FROM h UNION ALL SELECT query_id, page, 1, rank FROM m ANTI JOIN h USING (query_id, page))
SELECT query_id, page, row_number() OVER (PARTITION BY query_id ORDER BY part, ord, page) AS place FROM u QUALIFY place <= 8""")
def filled_hits(spark, d):
    s = Searched(spark, d)
    hits = page_hits(s).where("place <= 3").select("query_id", "page", "place")
    more = s.pool().join(s.docs.select("doc_id", urls.page_url(F.col("url")).alias("page")), "doc_id").groupBy("query_id", "page").agg(F.min("bm25_rank").alias("rank"))
    return results.filled_up(hits, more, 8)


@query()
def compact_results(spark, d):
    s = Searched(spark, d)
    shown = T.hit_snippet(*map(F.col, ("snippet", "answer", "text", "breadcrumbs", "url")))
    hits = page_hits(s).where("place <= 5").select("query_id", "place", "doc_id").join(s.docs.select("doc_id", "title", "url", shown.alias("snippet")), "doc_id")
    return results.compact_results(hits)


# --- Vocabulary -----------------------------------------------------------------------------------------------------

from docfathom.operators import index, vocabulary  # noqa: E402
from docfathom.queries import POSTINGS, posts  # noqa: E402

_VOCABULARY = POSTINGS + ", vocabulary AS (SELECT term, count(*) AS df FROM post GROUP BY term), words AS (SELECT DISTINCT lower(unnest(regexp_extract_all(query, '[A-Za-z0-9]+'))) AS word FROM eval_items)"


def _words_and_vocabulary(spark, d):
    words = table(spark, d, "eval_items").select(F.explode(F.regexp_extract_all("query", F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("word")).select(F.lower("word").alias("word")).distinct()
    return words, index.document_frequencies(posts(spark, d)).groupBy("term").agg(F.sum("df").alias("df"))


@query(_VOCABULARY + " SELECT word, term, df FROM words JOIN vocabulary ON starts_with(term, word) AND regexp_matches(substring(term, length(word) + 1), '^v?[0-9]') WHERE regexp_matches(word, '^[a-z][a-z0-9]{3,7}$') QUALIFY row_number() OVER (PARTITION BY word ORDER BY df DESC, term) <= 16")
def prefix_terms(spark, d):
    return vocabulary.longer_terms(*_words_and_vocabulary(spark, d))


@query(_VOCABULARY + " SELECT word, term, df FROM words JOIN vocabulary ON damerau_levenshtein(word, term) = 1 WHERE regexp_matches(word, '^[a-z0-9]{4,12}$') AND regexp_matches(term, '^[a-z0-9]{3,13}$')")
def edited_terms(spark, d):
    return vocabulary.edited_terms(*_words_and_vocabulary(spark, d))


@query("SELECT n AS needle, count(*) FILTER (WHERE contains(lower(coalesce(title, '')), n)) AS in_title, count(*) FILTER (WHERE contains(lower(concat_ws(chr(10), title, text)), n)) AS anywhere FROM indexed_docs, (VALUES ('boot'), ('电池组'), ('nothing of it')) v(n) GROUP BY n")
def substring_frequencies(spark, d):
    return vocabulary.substring_counts(table(spark, d, "indexed_docs"), ["boot", "电池组", "nothing of it"])
