"""Queries of the operators on records, sources, text expressions and hits, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docfathom.functions import boards, urls
from docfathom.functions import text as T
from docfathom.more_queries import _PATH
from docfathom.operators import catalog, curation, evalkit, hits, records, results
from docfathom.queries import DOCS, PAGES, Searched, docs, page_hits, query, terms_sql
from docfathom.session import table
from docfathom.sources import cache, index_formats

# --- Text expressions -----------------------------------------------------------------------------------------------

_BLANK = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


@query(rf"SELECT doc_id, {_trim(r'''regexp_replace(regexp_replace(regexp_replace(text, '[\x00\x{200b}]', '', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')''')} AS text FROM documents WHERE text IS NOT NULL")
def cleaned_texts(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.cleaned(F.col("text")).alias("text"))


@query(rf"SELECT row_id, length({_trim(r'''regexp_replace(regexp_replace(regexp_replace(text, '(?m)^#{1,6}\s.*$', '', 'g'), '!?\[[^\]]*\]\([^)]*\)', '', 'g'), '[\s\pP]+', ' ', 'g')''')}) >= 1 AS prose FROM indexed_docs WHERE text IS NOT NULL")
def prose_flags(spark, d):
    return table(spark, d, "indexed_docs").where("text is not null").select("row_id", T.has_prose(F.col("text")).alias("prose"))


@query("SELECT row_id, chr(39) || replace(title, chr(39), chr(39) || '\"' || chr(39) || '\"' || chr(39)) || chr(39) AS quoted FROM indexed_docs WHERE title IS NOT NULL")
def shell_quoted(spark, d):
    return table(spark, d, "indexed_docs").where("title is not null").select("row_id", T.shell_quoted(F.col("title")).alias("quoted"))


@query(rf"""SELECT row_id, coalesce(nullif({_trim("title")}, ''), nullif({_trim("list_extract(breadcrumbs, -1)")}, ''), nullif({_trim(f"list_extract(string_split({_PATH}, '/'), -1)")}, ''), url) AS title FROM indexed_docs""")
def shown_titles(spark, d):
    shown = T.title_or_fallback(F.lit(None).cast("string"), F.col("title"), F.col("breadcrumbs"), F.col("url"))
    return table(spark, d, "indexed_docs").select("row_id", shown.alias("title"))


@query("SELECT row_id, regexp_replace('__SKILL_' || manual_id || '-__' || kind, '^__SKILL_(.+?)-__(.+)$', '\\1-\\2') AS shown FROM indexed_docs")
def display_names(spark, d):
    name = F.concat(F.lit("__SKILL_"), "manual_id", F.lit("-__"), "kind")
    return table(spark, d, "indexed_docs").select("row_id", catalog.display_name(name).alias("shown"))


@query("""SELECT DISTINCT url, CASE WHEN regexp_matches(url, '(?i)(search-index|searchindex|search_index)[^/]*[.](json|js)([?]|$)') THEN 900 WHEN contains(lower(url), 'wiki.orlo.example') AND regexp_matches(url, '/(search|latest)([.]json|[?]|/|$)') THEN 900
  WHEN contains(lower(url), 'wiki.orlo.example') THEN 3600 ELSE 86400 END AS ttl FROM indexed_docs WHERE url IS NOT NULL""")
def times_to_live(spark, d):
    rows = table(spark, d, "indexed_docs").where("url is not null").select("url").distinct()
    return rows.select("url", cache.ttl_of(F.col("url"), "wiki.orlo.example").alias("ttl"))


@query("SELECT item_id, regexp_matches(lower(coalesce(passage, '')), 'board|tavrix') AND regexp_matches(lower(coalesce(passage, '')), 'firmware|channel') AS met FROM eval_items")
def facts_met(spark, d):
    groups = F.array(F.array(F.lit("Board"), F.lit("tavrix")), F.array(F.lit("firmware"), F.lit("CHANNEL")))
    return table(spark, d, "eval_items").select("item_id", evalkit.facts_met(F.col("passage"), groups).alias("met"))


@query("SELECT row_id, CASE WHEN NOT contains(x, 'boot image') AND contains(x, 'audio') THEN 'Audio' END AS note FROM (SELECT row_id, lower(concat_ws(' ', title, snippet, text)) AS x FROM indexed_docs) WHERE contains(x, 'audio')")
def alias_notes(spark, d):
    hay = F.concat_ws(" ", "title", "snippet", "text")
    return table(spark, d, "indexed_docs").where(F.contains(F.lower(hay), F.lit("audio"))).select("row_id", results.alias_note(F.lit("boot image"), hay, F.lit("Audio")).alias("note"))


# --- Boards and hits ------------------------------------------------------------------------------------------------

_BOARDS = r"""named AS (SELECT row_id, list_filter([CASE WHEN regexp_matches(x, '(?:^|[^a-z0-9_])t5(?:$|[^a-z0-9_])|tavrix[\s_-]*t[\s_-]*5(?:$|[^0-9])') THEN 't5' END, CASE WHEN regexp_matches(x, '(?:^|[^a-z0-9_])t2(?:$|[^a-z0-9_])|tavrix[\s_-]*t[\s_-]*2(?:$|[^0-9])') THEN 't2' END,
  CASE WHEN regexp_matches(x, '(?:^|[^a-z0-9_])s6(?:$|[^a-z0-9_])|orlo[\s_-]*s[\s_-]*6(?:$|[^0-9])') THEN 's6' END, CASE WHEN regexp_matches(x, '(?:^|[^a-z0-9_])s1(?:$|[^a-z0-9_])|orlo[\s_-]*s[\s_-]*1(?:$|[^0-9])') THEN 's1' END], lambda b: b IS NOT NULL) AS boards
FROM (SELECT row_id, lower(coalesce(title, '')) || chr(10) || regexp_replace(lower(coalesce(title, '')), '[、，,;；]+|[_./#+-]+', ' ', 'g') AS x FROM indexed_docs))"""


@query(f"WITH {_BOARDS} SELECT row_id, CASE WHEN len(boards) = 1 THEN boards[1] END AS sole, CASE WHEN len(boards) = 1 THEN boards[1] WHEN len(boards) > 1 THEN 'multiple' END AS shown FROM named WHERE len(boards) > 0")
def title_boards(spark, d):
    named = table(spark, d, "indexed_docs").select("row_id", boards.sole_board(F.col("title")).alias("sole"), boards.hit_board(F.col("title")).alias("shown"))
    return named.where("shown is not null")


@query("SELECT row_id, regexp_matches(lower(url) || chr(10) || regexp_replace(lower(url), '[_./#+-]+', ' ', 'g'), '(?:^|[^a-z0-9_])t5(?:$|[^a-z0-9_])|/t5[_/-]|/t5$') AS t5 FROM indexed_docs WHERE url IS NOT NULL")
def board_urls(spark, d):
    return table(spark, d, "indexed_docs").where("url is not null").select("row_id", boards.url_of_board(F.col("url"), "t5").alias("t5"))


@query("SELECT row_id FROM indexed_docs WHERE regexp_matches(url, '/(software|audio)/')")
def included_paths(spark, d):
    return table(spark, d, "indexed_docs").where(urls.included(F.col("url"), "/(software|audio)/")).select("row_id")


@query("""SELECT item_id, CASE WHEN manual IS NOT NULL THEN 'docs' ELSE 'docs' END AS source, regexp_matches(coalesce(query, ''), '(?i)install|image|firmware|驱动|安装') AND manual IS NULL AND board IS NULL AS board_missing FROM eval_items""")
def query_defaults(spark, d):
    rows = table(spark, d, "eval_items")
    missing = hits.board_missing(F.col("query"), F.array().cast("array<string>"), F.col("manual"), F.col("board"), "install|image|firmware|驱动|安装")
    return rows.select("item_id", hits.resolved_source(F.lit(None).cast("string"), F.col("manual"), ("forum",)).alias("source"), missing.alias("board_missing"))


@query(PAGES + "SELECT item_id, CASE WHEN count(page) = 0 THEN 'none' WHEN count(page) < 4 THEN 'weak' ELSE 'good' END AS quality FROM eval_items LEFT JOIN placed ON item_id = query_id GROUP BY item_id")
def match_qualities(spark, d):
    n = page_hits(Searched(spark, d)).groupBy("query_id").agg(F.count("*").alias("n"))
    rows = table(spark, d, "eval_items").select("item_id").join(n, F.col("item_id") == F.col("query_id"), "left").fillna(0, ["n"])
    return rows.select("item_id", results.match_quality(F.col("n"), F.col("n") < 4).alias("quality"))


@query(PAGES + """, g AS (SELECT query_id, page, place, score, coalesce(nullif(regexp_extract(page, '(t5|t2|s6|s1)', 1), ''), 'agnostic') AS board FROM placed WHERE place <= 8),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, board ORDER BY place) = 1 AS head FROM g)
SELECT query_id, page, row_number() OVER (PARTITION BY query_id ORDER BY NOT head, place) AS place FROM f""")
def board_round(spark, d):
    rows = page_hits(Searched(spark, d)).where("place <= 8")
    board = F.nullif(F.regexp_extract("page", "(t5|t2|s6|s1)", 1), F.lit(""))
    return hits.first_of_each_board(rows.withColumn("board", board)).select("query_id", "page", "place")


@query("""WITH h AS (SELECT topic_id AS query_id, CASE WHEN post_number = 1 THEN 'docs' ELSE 'forum' END AS source, username AS board FROM forum_posts)
SELECT query_id, count(*) FILTER (WHERE source = 'docs') AS n_docs, count(*) FILTER (WHERE source = 'forum') AS n_forum, count(DISTINCT board) AS n_boards FROM h GROUP BY ALL""")
def source_mix(spark, d):
    rows = table(spark, d, "forum_posts").select(F.col("topic_id").alias("query_id"), F.when(F.col("post_number") == 1, "docs").otherwise("forum").alias("source"), F.col("username").alias("board"))
    return hits.source_mix(rows)


# --- Order and mirrors of snapshots ---------------------------------------------------------------------------------


@query("""WITH p AS (SELECT manual_id, url AS id, doc_ord AS ord, row_number() OVER (PARTITION BY manual_id, url ORDER BY doc_ord, row_id) AS n FROM indexed_docs WHERE kind <> 'snippet' AND manual_id IS NOT NULL AND url IS NOT NULL),
l AS (SELECT manual_id, url AS id, url, row_number() OVER (PARTITION BY manual_id, url ORDER BY doc_ord, row_id) AS n FROM indexed_docs WHERE kind <> 'heading' AND manual_id IS NOT NULL AND url IS NOT NULL)
SELECT manual_id, id, n, row_number() OVER (PARTITION BY manual_id ORDER BY ord IS NULL, ord, url, id, n) - 1 AS place FROM l LEFT JOIN p USING (manual_id, id, n)""")
def snapshot_order(spark, d):
    rows = table(spark, d, "indexed_docs").where("manual_id is not null and url is not null").withColumn("id", F.col("url"))
    nth = F.row_number().over(Window.partitionBy("manual_id", "id").orderBy("doc_ord", "row_id"))
    prior = rows.where("kind <> 'snippet'").withColumn("n", nth).select("manual_id", "id", F.struct("doc_ord", "n").alias("ord"))
    loaded = rows.where("kind <> 'heading'").withColumn("n", nth).select("manual_id", "id", "url", "n")
    return curation.merged_order(prior, loaded).select("manual_id", "id", "n", "place")


_SEGMENTS = f"list_filter(string_split({_PATH}, '/'), lambda x: length(x) > 0)"


@query(rf"""WITH {DOCS}, p AS (SELECT doc_id, manual_id, url, {_trim("text")} AS same, {_SEGMENTS} AS path FROM docs WHERE kind = 'page' AND length({_trim("text")}) >= 8),
k AS (SELECT *, row_number() OVER (PARTITION BY manual_id, same ORDER BY len(path), length(url), url, doc_id) AS nth FROM p),
b AS (SELECT x.doc_id, y.doc_id AS kept_id, x.path AS long, y.path AS short FROM k x JOIN k y ON x.manual_id = y.manual_id AND x.same = y.same AND y.nth = 1 AND x.doc_id <> y.doc_id)
SELECT doc_id, kept_id FROM b WHERE len(short) = 0 OR regexp_matches('/' || array_to_string(long, '/') || '/', '/' || array_to_string(list_transform(short, lambda s: regexp_replace(s, '([^A-Za-z0-9])', '\\\1', 'g')), '/(?:.*/)?') || '/')""")
def mirror_pages(spark, d):
    return curation.mirror_pages(docs(spark, d))


# --- Source formats -------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT manual_id, title, url, text, breadcrumbs, row_number() OVER (PARTITION BY manual_id ORDER BY row_id) - 1 AS pos FROM indexed_docs WHERE kind = 'page' AND length(url) > 0 AND manual_id IS NOT NULL AND title IS NOT NULL AND text IS NOT NULL),
h AS (SELECT *, unnest(coalesce(breadcrumbs, [])) AS head, generate_subscripts(coalesce(breadcrumbs, []), 1) AS n FROM p)
SELECT manual_id, pos * 1000000000 AS doc_ord, title, url, 'page' AS kind, length(text) AS size FROM p
UNION ALL SELECT manual_id, pos * 1000000000 + n, head, url || '#' || n, 'heading', 0 FROM h""")
def page_index(spark, d):
    """Page indexes written as JSON from the pages of each manual, one body a manual, and read again."""
    good = table(spark, d, "indexed_docs").where("kind = 'page' and length(url) > 0 and manual_id is not null and title is not null and text is not null")
    toc = F.transform(F.coalesce("breadcrumbs", F.array().cast("array<string>")), lambda x, i: F.struct(x.alias("text"), (i + 1).cast("string").alias("id")))
    page = F.struct("row_id", "title", F.col("text").alias("content"), F.col("url").alias("routePath"), toc.alias("toc"))
    bodies = good.groupBy("manual_id").agg(F.to_json(F.array_sort(F.collect_list(page))).alias("body"))
    rows = index_formats.read_page_index(bodies, "https://docs.tavrix.example")
    return rows.select("manual_id", "doc_ord", "title", "url", "kind", F.coalesce(F.length("text"), F.lit(0)).alias("size"))


@query("""WITH r AS (SELECT manual_id, url, text, row_number() OVER (PARTITION BY manual_id ORDER BY row_id) - 1 AS n FROM indexed_docs WHERE kind = 'page' AND length(url) > 0 AND NOT contains(url, '#') AND manual_id IS NOT NULL AND length(trim(text)) > 0)
SELECT manual_id, (n % 5) * 1000000000 + n // 5 AS doc_ord, url, CASE WHEN n % 5 = 0 THEN 'page' ELSE 'snippet' END AS kind FROM r QUALIFY n % 5 > 0 OR row_number() OVER (PARTITION BY manual_id, url, n % 5 = 0 ORDER BY n DESC) = 1""")
def shard_index(spark, d):
    """Sharded indexes of five shards written as JSON from the pages of each manual, and read again."""
    good = table(spark, d, "indexed_docs").where("kind = 'page' and length(url) > 0 and not contains(url, '#') and manual_id is not null and length(trim(text)) > 0")
    n = F.row_number().over(Window.partitionBy("manual_id").orderBy("row_id")) - 1
    shard = good.withColumn("n", n).groupBy("manual_id", (F.col("n") % 5).alias("shard")).agg(F.array_sort(F.collect_list(F.struct("n", F.col("text").alias("t"), F.col("url").alias("u")))).alias("documents"))
    bodies = shard.groupBy("manual_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("shard", "documents"))), lambda x: F.struct(x["documents"].alias("documents")))).alias("body"))
    return index_formats.read_shards(bodies, "https://docs.tavrix.example").select("manual_id", "doc_ord", "url", "kind")


# --- Records --------------------------------------------------------------------------------------------------------

_TASK = "CASE WHEN searchable THEN ['search'] ELSE ['read'] END"


def _records(spark, d):
    rows = table(spark, d, "manuals")
    return rows.select(
        F.col("manual_id").alias("name"), F.col("base_path").alias("path"), F.col("category").alias("pack"), "description", F.when(F.col("searchable"), F.array(F.lit("search"))).otherwise(F.array(F.lit("read"))).alias("tasks"),
        F.when(~F.col("no_board"), F.array(F.lit("t5"), F.lit("s6"))).alias("platforms"), F.when(F.col("index_kind").isNull(), F.lit(None)).otherwise(F.when(F.length("manual_id") % 2 == 0, "entry").otherwise("workflow")).alias("role"),
    )


@query("SELECT manual_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(description, ''), '(\\.)\\s+', '\\1\x01', 'g'), '[。；;！？!?\\n]', '\x01', 'g'), '\x01'), lambda x: trim(x)), lambda x: length(x) > 0 AND NOT regexp_matches(x, '(?i)(?:^|[^a-z0-9_])not(?:$|[^a-z0-9_])|do not|don''t|排除|不支持')), chr(10)) AS positive FROM manuals")
def positive_sentences(spark, d):
    return table(spark, d, "manuals").select("manual_id", records.positive_text(F.col("description")).alias("positive"))


_QUESTIONS = ((1, "boot image audio"), (2, "calibration of the camera"), (3, "tavrix t5"), (4, "t5-guide"))
_RECORD_HITS = """q(query_id, query, token, model) AS (VALUES (1, 'boot image audio', 'boot', false), (1, 'boot image audio', 'image', false), (1, 'boot image audio', 'audio', false), (2, 'calibration of the camera', 'calibration', false), (2, 'calibration of the camera', 'of', false), (2, 'calibration of the camera', 'the', false),
  (2, 'calibration of the camera', 'camera', false), (3, 'tavrix t5', 'tavrix', true), (3, 'tavrix t5', 't5', true), (4, 't5-guide', 't5-guide', false), (4, 't5-guide', '5guide', false)),
r AS (SELECT manual_id AS name, lower(manual_id) AS n, lower(coalesce(base_path, '')) AS p, lower(coalesce(category, '')) AS k, lower(coalesce(description, '')) AS t FROM manuals),
m AS (SELECT *, CASE WHEN length(token) <= 3 THEN '(?:^|[^a-z])' || token || '(?:$|[^a-z])' ELSE '(?:^|[^a-z0-9])' || token END AS x FROM q, r),
h AS (SELECT *, regexp_matches(n, x) AS a, regexp_matches(p, x) AS b, regexp_matches(k, x) AS c, regexp_matches(t, x) AS e FROM m),
s AS (SELECT query_id, name, any_value(query) AS query, sum(CASE WHEN model THEN 4 * a::INT + 3 * b::INT + e::INT ELSE 12 * a::INT + 7 * b::INT + 3 * c::INT + 2 * e::INT END) AS points, count(*) FILTER (WHERE NOT model AND (a OR b OR c OR e)) AS task, count(*) FILTER (WHERE model AND (a OR b OR e)) AS models,
  count(*) FILTER (WHERE NOT model) AS n_task, count(*) FILTER (WHERE model) AS n_model FROM h GROUP BY ALL),
scores AS (SELECT query_id, name, (points + CASE WHEN n_task > 0 THEN floor(10.0 * task / n_task + 0.5) ELSE 0 END + CASE WHEN n_model > 0 AND models = n_model THEN 3 ELSE 0 END + CASE WHEN lower(query) = lower(name) THEN 1000 ELSE 0 END)::BIGINT AS score, task + models AS matched FROM s WHERE (n_task > 0 AND task > 0) OR (n_task = 0 AND models > 0))"""


@query(f"WITH {_RECORD_HITS} SELECT * FROM scores")
def record_scores(spark, d):
    return records.record_scores(_records(spark, d), _QUESTIONS, ("t5", "tavrix"))


@query(f"WITH {_RECORD_HITS} SELECT query_id, name, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS place FROM scores WHERE score > 0 QUALIFY place <= 5")
def best_records(spark, d):
    return records.best_records(records.record_scores(_records(spark, d), _QUESTIONS, ("t5", "tavrix"))).select("query_id", "name", "score", "place")


_ELIGIBLE = "e AS (SELECT *, CASE WHEN index_kind IS NULL THEN NULL WHEN length(manual_id) % 2 = 0 THEN 'entry' ELSE 'workflow' END AS role, lower(concat_ws(' ', manual_id, description)) AS whole FROM manuals WHERE searchable)"
_STRUCTURED = f"{_ELIGIBLE}, st AS (SELECT 1 AS query_id, manual_id AS name, role, (CASE WHEN lower(manual_id) = 'guide audio' THEN 100 ELSE 0 END + CASE role WHEN 'entry' THEN 3 WHEN 'workflow' THEN 2 ELSE 0 END + 2 * (contains(whole, 'guide')::INT + contains(whole, 'audio')::INT) + 4 * (contains(lower(manual_id), 'guide')::INT + contains(lower(manual_id), 'audio')::INT)) AS score FROM e)"


def _structured(spark, d):
    rows = _records(spark, d).where(records.eligible("search", every=("t5", "s6", "s1"), excluded=("s1",)))
    return rows.select(F.lit(1).alias("query_id"), "name", "role", records.structured_score("guide audio", ("guide", "audio")).alias("score"))


@query(f"WITH {_STRUCTURED} SELECT query_id, name, score FROM st")
def structured_records(spark, d):
    return _structured(spark, d).select("query_id", "name", "score")


@query(f"WITH {_STRUCTURED} SELECT query_id, name, CASE WHEN role = 'workflow' THEN score - greatest(0, coalesce(max(score) FILTER (WHERE role = 'workflow') OVER () - min(score) FILTER (WHERE role IS DISTINCT FROM 'workflow') OVER () + 1, 0)) ELSE score END AS score FROM st")
def records_put_behind(spark, d):
    return records.put_behind(_structured(spark, d), F.col("role").eqNullSafe("workflow")).select("query_id", "name", "score")


def _reviewed(spark, d):
    rows = table(spark, d, "manuals").select(F.col("manual_id").alias("name"), "description", F.col("base_path").alias("catalog_path"), "searchable", "no_board", F.when(F.col("category") == "audio", F.array(F.lit("own"))).alias("tasks"))
    own = rows.withColumn("own_print", catalog.fingerprint("name", "description"))
    overlay = own.where("searchable").select("name", F.when(F.col("no_board"), "changed").otherwise(F.col("own_print")).alias("fingerprint"), F.concat("catalog_path", F.lit("/SKILL.md")).alias("source"), F.array(F.lit("seen")).alias("tasks"))
    return rows, own, overlay


_STATUS = "s AS (SELECT manual_id AS name, CASE WHEN category = 'audio' THEN 'classified' WHEN NOT searchable THEN 'missing' WHEN no_board THEN 'stale' WHEN base_path IS NULL THEN NULL ELSE 'classified' END AS status, CASE WHEN category = 'audio' THEN 'catalog' WHEN searchable THEN 'reviewed' END AS origin FROM manuals)"


@query(f"WITH {_STATUS} SELECT name, coalesce(status, 'classified') AS status, origin FROM s")
def resolved_metadata(spark, d):
    rows, _, overlay = _reviewed(spark, d)
    return catalog.resolved_metadata(rows.drop("searchable", "no_board"), overlay, "name", "description").select("name", "status", "origin")


@query(f"WITH {_STATUS} SELECT count(*) AS total, count(*) FILTER (WHERE coalesce(status, 'classified') = 'classified') AS classified, count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'stale') AS stale, 0::BIGINT AS invalid FROM s")
def metadata_health(spark, d):
    rows, _, overlay = _reviewed(spark, d)
    return catalog.metadata_health(catalog.resolved_metadata(rows.drop("searchable", "no_board"), overlay, "name", "description"))


@query("SELECT manual_id AS name, CASE WHEN base_path IS NULL THEN 'source mismatch' ELSE 'stale fingerprint' END AS issue FROM manuals WHERE searchable AND (no_board OR base_path IS NULL) UNION ALL VALUES ('of no record', 'missing record'), ('of no record', 'missing record'), ('of no record', 'duplicate')")
def overlay_issues(spark, d):
    _, own, overlay = _reviewed(spark, d)
    strange = spark.createDataFrame([("of no record", "x", "y/SKILL.md")] * 2, "name string, fingerprint string, source string")
    return records.overlay_issues(own, overlay.drop("tasks").unionByName(strange))


@query("SELECT manual_id, CASE WHEN length(manual_id) % 3 = 0 THEN 'invalid_catalog' WHEN length(manual_id) % 3 = 1 THEN 'ok' ELSE 'unsupported_schema' END AS verdict FROM manuals")
def schema_verdicts(spark, d):
    version = F.nullif(F.length("manual_id") % 3, F.lit(0))
    return table(spark, d, "manuals").select("manual_id", records.schema_verdict(version).alias("verdict"))


@query("SELECT manual_id, CASE WHEN lower(manual_id) = 't5-guide' THEN ['t5'] WHEN suffix(lower(manual_id), 'guide') THEN ['s6', 's1'] WHEN suffix(lower(manual_id), 'mirror') THEN ['t2'] END AS families FROM manuals")
def pack_families(spark, d):
    families = records.families_of(F.col("manual_id"), {"t5-guide": ("t5",)}, {"guide": ("s6", "s1"), "mirror": ("t2",)})
    return table(spark, d, "manuals").select("manual_id", families.alias("families"))


# --- Functions in SQL texts -----------------------------------------------------------------------------------------


@query("WITH src AS (SELECT row_id, 't' AS f, 1.0 AS s, coalesce(title, '') AS x FROM indexed_docs), " + terms_sql("src", "row_id") + """, own AS (SELECT row_id, list_sort(list(DISTINCT term)) AS terms FROM analysed GROUP BY ALL)
SELECT row_id, split_part(url, '#', 1) AS page, array_to_string(coalesce(terms, []), ' ') AS terms, round(CASE WHEN x < 3.2 THEN x * (0.45 + 0.55 * x / 3.2) ELSE x END, 6) AS idf FROM (SELECT row_id, url, ln(1 + (1000 - 10 + 0.5) / (10 + 0.5)) AS x FROM indexed_docs) LEFT JOIN own USING (row_id)""")
def sql_functions(spark, d):
    """A query written in SQL, with the engine's functions registered on the session."""
    from docfathom.functions.sql import register_functions

    register_functions(spark)
    return spark.sql("SELECT row_id, docfathom_page(url) AS page, array_join(docfathom_terms(title), ' ') AS terms, round(docfathom_damped(docfathom_idf(1000, 10)), 6) AS idf FROM {rows}", rows=table(spark, d, "indexed_docs"))
