from pyspark.sql import functions as F

from docfathom.operators import catalog, curation, evalkit, index
from docfathom.sources import cache
from docfathom.streaming import reindex

SCHEMA = "doc_id long, manual_id string, kind string, url string, text string"


def test_mirror_pages_keep_the_shortest_path(spark):
    rows = [(1, "m", "page", "https://d.e/a/c", "same text here"), (2, "m", "page", "https://d.e/a/b/c", " same text here\n"), (3, "m", "page", "https://d.e/x/y/z", "same text here"), (4, "n", "page", "https://d.e/a/b/c", "same text here"), (5, "m", "page", "https://d.e/a/b/c/d", None), (6, "m", "heading", "https://d.e/a/q/c", "same text here"), (7, "m", "page", "https://d.e/q/c", "short")]
    got = {tuple(r) for r in curation.mirror_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(2, 1)}
    assert curation.mirror_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_dead_pages_and_their_slash_variants(spark):
    rows = [("u/a", 1, 404), ("u/a", 2, 410), ("u/b", 1, 404), ("u/b", 2, 404), ("u/b/", 1, 200), ("u/c", 1, 404), ("u/d", 1, None), ("u/d", 2, 0), (None, 1, 404)]
    verdicts = curation.probe_verdicts(spark.createDataFrame(rows, "url string, probe_no int, status int"))
    assert {r.url: r.verdict for r in verdicts.collect()} == {"u/a": "dead", "u/b": "dead", "u/b/": "alive", "u/c": "unchecked", "u/d": "unchecked"}
    dead = curation.dead_pages(verdicts)
    assert [r.url for r in dead.collect()] == ["u/a"]
    docs = spark.createDataFrame([(1, "u/a#x"), (2, "u/b"), (3, None)], "doc_id long, url string")
    assert {r.doc_id for r in curation.without_pages(docs, dead).collect()} == {2, 3}


def test_language_copies(spark):
    docs = spark.createDataFrame([(1, "d/en/a"), (2, "d/a"), (3, "d/en/b"), (4, "d/c")], "doc_id long, url string")
    assert {r.doc_id for r in curation.without_language_copies(docs).collect()} == {2, 3, 4}


def test_snapshots(spark):
    prior = spark.createDataFrame([("m", "a", 0), ("m", "b", 1), ("m", "a", 2)], "manual_id string, id string, ord long")
    loaded = spark.createDataFrame([("m", "c", "u1", 1), ("m", "b", "u2", 1), ("m", "a", "u3", 1)], "manual_id string, id string, url string, n int")
    order = {r.id: r.place for r in curation.merged_order(prior, loaded).collect()}
    assert order == {"a": 0, "b": 1, "c": 2}
    change = {r.id: r.change for r in curation.snapshot_diff(prior, loaded).collect()}
    assert change == {"a": "recounted", "b": "kept", "c": "added"}


def test_measures(spark):
    cases = spark.createDataFrame([(1, ["/A"], None), (2, ["/z"], None), (3, None, True), (4, ["/c", "/d"], False), (5, None, None)], "item_id long, expect_url_includes array<string>, expect_no_good_match boolean")
    hits = spark.createDataFrame([(1, 1, "d/x", False), (1, 2, "d/a", False), (2, 1, "d/x", False), (3, 1, "d/x", True), (4, 1, "d/c", False), (4, 3, "d/d", False)], "item_id long, place int, url string, weak boolean")
    got = {r.item_id: r for r in evalkit.ranks(cases, hits).collect()}
    assert [got[k].rank for k in (1, 2, 3, 4, 5)] == [2, None, 1, 1, None]
    assert got[4].covers_all and not got[1].hit_at_1 and got[1].hit_at_3 and not got[2].covers_all
    total = evalkit.summary(evalkit.ranks(cases, hits)).first()
    assert (total.n, total.hit_at_1, total.mrr) == (5, 0.4, 0.5)
    assert evalkit.summary(evalkit.ranks(cases.limit(0), hits)).first().n == 0
    values = spark.createDataFrame([(float(x),) for x in range(1, 21)], "v double")
    assert values.agg(evalkit.nearest_rank("v", 0.95)).first()[0] == 19.0


def test_catalogue(spark):
    records = spark.createDataFrame([("ok-1", "d", "p", "o/r", "skills/a/b", "flat", ["t"]), ("-bad", "", "p", "o/r", "skills/../b", "odd", None), ("ok-2", "d", "p", "o/r", "skills/c", "flat", None), ("ok-3", "d", "p", "o/r", "skills/d", "flat", None)], "name string, description string, pack string, repo string, catalog_path string, install_type string, tasks array<string>")
    issues = {(r.name, r.issue) for r in catalog.record_issues(records).collect()}
    assert issues == {("-bad", x) for x in ("name", "description", "catalog_path", "install_type")}
    fields = ("name", "description", "catalog_path")
    prints = {r.name: r.p for r in records.select("name", catalog.fingerprint(*fields).alias("p")).collect()}
    overlay = spark.createDataFrame([("ok-2", prints["ok-2"], "https://h/skills/c/SKILL.md", ["x"]), ("ok-3", "old", "https://h/skills/d/SKILL.md", ["x"])], "name string, fingerprint string, source string, tasks array<string>")
    resolved = catalog.resolved_metadata(records, overlay, *fields)
    assert {r.name: r.status for r in resolved.collect()} == {"ok-1": "classified", "-bad": "missing", "ok-2": "classified", "ok-3": "stale"}
    health = catalog.metadata_health(resolved).first()
    assert (health.total, health.classified, health.missing, health.stale, health.invalid) == (4, 2, 1, 1, 0)
    assert spark.range(1).select(catalog.display_name(F.lit("__SKILL_a-__b"))).first()[0] == "a-b"


def test_freshness(spark):
    df = spark.createDataFrame([("https://f.e/latest.json",), ("https://f.e/t/1",), ("https://d.e/search-index-1.json",), ("https://d.e/p",)], "url string")
    assert [r[0] for r in df.select(cache.ttl_of(F.col("url"), "f.e")).collect()] == [cache.LATEST_TTL, cache.FORUM_TTL, cache.INDEX_TTL, cache.PAGE_TTL]
    now = F.lit("2026-01-01 00:10:00").cast("timestamp")
    fresh = lambda ttl: spark.range(1).select(cache.is_fresh(F.lit("2026-01-01 00:00:00").cast("timestamp"), F.lit(ttl), now)).first()[0]
    assert fresh(601) and not fresh(600) and not fresh(0)


def test_index_tables_and_stream(spark, tmp_path):
    schema = "row_id long, manual_id string, doc_ord long, title string, url string, snippet string, text string, answer string, breadcrumbs array<string>, kind string, ingested_at timestamp"
    row = lambda k, manual, ord_, title, at: (k, manual, ord_, title, "https://d.e/p", None, "body text", "answer only", ["crumb"], "page", at)
    from datetime import datetime

    first = spark.createDataFrame([row(1, "m", 1, "old title", datetime(2026, 1, 1)), row(2, "n", 1, "other", datetime(2026, 1, 1))], schema)
    late = spark.createDataFrame([row(3, "m", 1, "new title", datetime(2026, 1, 2))], schema)
    docs = index.latest_documents(first.unionByName(late)).withColumn("doc_id", F.col("row_id"))
    assert {r.doc_id for r in docs.collect()} == {2, 3}
    index.write_index(docs, str(tmp_path / "index"))
    post = {(r.manual_id, r.term): r for r in spark.read.parquet(str(tmp_path / "index/postings")).collect()}
    assert post["m", "new"].tf_title == 1 and post["m", "answer"].tf_body == 0.5 and ("m", "old") not in post and post["m", "crumb"].tf_body == 1
    sums = {r.manual_id: r for r in spark.read.parquet(str(tmp_path / "index/sums")).collect()}
    assert sums["m"].n_docs == 1 and sums["m"].sum_title == 2

    source, out = tmp_path / "in", tmp_path / "out"
    first.write.parquet(str(source / "a"))
    read = lambda: spark.read.schema(schema).parquet(str(source / "*"))
    run = lambda: reindex.follow_snapshots(spark, str(source / "*"), str(out), str(tmp_path / "check"), read, schema).awaitTermination()
    run()
    assert {r.term for r in spark.read.parquet(str(out / "postings")).where("manual_id = 'm'").collect()} >= {"old", "title"}
    late.write.parquet(str(source / "b"))
    run()
    terms = {(r.manual_id, r.term) for r in spark.read.parquet(str(out / "postings")).collect()}
    assert ("m", "new") in terms and ("m", "old") not in terms and ("n", "other") in terms


def test_gate(spark):
    prior = spark.createDataFrame([("m", f"u{k}") for k in range(100)] + [("n", "u")], "manual_id string, url string")
    loaded = spark.createDataFrame([("m", f"u{k}#x") for k in range(3, 100)], "manual_id string, url string")
    got = {r.manual_id: (r.before, r.after, r.lost, r.fails) for r in curation.page_counts(prior, loaded).collect()}
    assert got == {"m": (100, 97, 3, True), "n": (1, 0, 1, True)}


def test_vocabulary(spark):
    from docfathom.operators import vocabulary as V

    words = spark.createDataFrame([("yolo",), ("wifi",), ("abcd",), ("a",), (None,)], "word string")
    terms = spark.createDataFrame([("yolov5", 2), ("yolo8x", 3), ("yolor", 9), ("wfii", 1), ("wiki", 1), ("wif", 1), ("xwifi", 1), ("wifi", 5), ("abdce", 1), ("badc", 1)], "term string, df long")
    assert [(r.word, r.term) for r in V.longer_terms(words, terms).orderBy("df").collect()] == [("yolo", "yolov5"), ("yolo", "yolo8x")]
    assert {(r.word, r.term) for r in V.edited_terms(words, terms).collect()} == {("wifi", x) for x in ("wfii", "wiki", "wif", "xwifi")} | {("yolo", "yolor")}


def test_fact_groups(spark):
    text, groups = F.lit("Use the Boot image"), F.array(F.array(F.lit("boot"), F.lit("x")), F.array(F.lit("IMAGE")))
    assert spark.range(1).select(evalkit.facts_met(text, groups)).first()[0]
    assert not spark.range(1).select(evalkit.facts_met(F.lit(None).cast("string"), groups)).first()[0]
