"""A page of many rows is read whole: length, hash and windows reach its last row."""

import hashlib

from docfathom.engine import Engine

SCHEMA = "doc_id long, doc_ord long, kind string, title string, url string, text string, answer string, snippet string"


def page_of(spark, texts):
    engine = Engine.__new__(Engine)  # only the documents are read
    engine.docs = spark.createDataFrame([(k, k, "page", "Long", "https://d.e/long#" + str(k), x, None, None) for k, x in enumerate(texts)], SCHEMA)
    return engine


def test_all_rows_count(spark):
    texts = [f"row {k}" for k in range(2050)]
    whole = "\n\n".join(["# Long", *texts])
    engine = page_of(spark, texts)
    got = engine.page("https://d.e/long", full=True, most=100)
    assert got["total_chars"] == len(whole) and got["content_hash"] == hashlib.sha256(whole.encode()).hexdigest()
    assert got["text"] == whole[:100] and got["next_offset"] == 100 and got["truncated"]
    at = len(whole) - 50
    last = engine.page("https://d.e/long", offset=at, expected_hash=got["content_hash"])
    assert last["text"] == whole[at:] and last["text"].endswith("row 2049") and last["next_offset"] is None and not last["truncated"]
    changed = page_of(spark, [*texts[:-1], "row changed"]).page("https://d.e/long", full=True)
    assert changed["content_hash"] != got["content_hash"]
