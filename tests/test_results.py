from pyspark.sql import functions as F

from docfathom.operators import results as R


def test_rules_in_order(spark):
    rules = (R.PageRule("boot", "p1", boards=("t5",)), R.PageRule("boot", "p2", manuals=("m",)), R.PageRule(".", "p3"))
    df = spark.createDataFrame([("Boot it", "t5", None), ("boot", None, "m"), ("boot", None, "n"), ("x", None, None), (None, None, None)], "q string, b string, m string")
    assert [r[0] for r in df.select(R.ruled_page(F.col("q"), F.col("b"), F.col("m"), rules)).collect()] == ["p1", "p2", "p3", "p3", None]


def test_pins_and_filling(spark):
    hits = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.5), (2, "a", 0.1)], "query_id long, page string, score double")
    pins = spark.createDataFrame([(1, "b"), (2, "gone"), (3, None)], "query_id long, page string")
    pages = spark.createDataFrame([("a",), ("b",)], "page string")
    got = sorted((r.query_id, r.place, r.page) for r in R.pinned(hits, pins, pages).collect())
    assert got == [(1, 1, "b"), (1, 2, "a"), (2, 1, "a")]
    more = spark.createDataFrame([(1, "a", 0), (1, "c", 1), (1, "d", 2), (4, "e", 0)], "query_id long, page string, rank long")
    placed = hits.where("query_id = 1").withColumn("place", F.when(F.col("page") == "a", 1).otherwise(2)).select("query_id", "page", "place")
    assert sorted((r.query_id, r.place, r.page) for r in R.filled_up(placed, more, 3).collect()) == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (4, 1, "e")]


def test_compact_json_keeps_within_its_bound():
    hits = [{"title": f"T{k}", "url": f"https://d.e/{k}#x", "snippet": "word " * 100} for k in range(12)]
    text = R.compact_json(hits)
    assert len(text) <= R.COMPACT_CHARS and '"anchor": "x"' in text and "…" in text
    assert R.compact_json([]) == "[]" and R.compact_json([{"title": None, "url": None, "snippet": None}]) == '[{"title": null, "url": ""}]'


def test_notes_and_quality(spark):
    df = spark.createDataFrame([("wifi", "Wi-Fi setup", "wi-fi"), ("wifi", "wifi", "wi-fi")], "q string, h string, a string")
    assert [r[0] for r in df.select(R.alias_note(F.col("q"), F.col("h"), F.col("a"))).collect()] == ["wi-fi", None]
    assert df.select(R.match_quality(F.lit(0), F.lit(False))).first()[0] == "none"
