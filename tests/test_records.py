import pytest
from pyspark.sql import functions as F

from docfathom.operators import hits, records

RECORDS = [
    ("ptq-runner", "skills/ptq", "oe", "Quantize a model. Do not use for training.", ["convert"], ["x5"], "workflow"), ("router", "skills/r", "oe", "Entry for quantization.", ["convert"], None, "entry"),
    ("cam", "skills/cam", "ros", None, ["camera"], ["s6"], "workflow"), ("odd", None, None, "", None, [], None),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(RECORDS, "name string, path string, pack string, description string, tasks array<string>, platforms array<string>, role string").withColumn("token", F.lit("clash"))


def test_tokens():
    assert records.record_tokens("How to Deploying 40 pin 量化怎么部署 12", {"量化": ["quantize"]}) == ["how", "to", "deploy", "pin", "40pin", "量化", "部署", "quant"]
    assert records.record_tokens("  12 34 ") == records.record_tokens("") == []


def test_denials():
    assert records.is_denied("use x5 not ptq but qat", "ptq") and not records.is_denied("use x5 not ptq but qat", "qat")
    assert not records.is_denied("有没有ptq", "ptq") and records.is_denied("不要ptq", "ptq") and not records.is_denied("anything", "ptq")
    assert not records.is_denied("not ptq, or ptq", "ptq")


def test_scores_leave_out_what_a_record_is_not_for(table):
    got = {(r.query_id, r.name): r.score for r in records.record_scores(table, [(1, "quantization"), (2, "training"), (3, "ROUTER"), (4, "x9"), (5, "not quantization")], ("x9",)).collect()}
    assert {n for q, n in got if q == 1} == {"ptq-runner", "router"} and not any(q in (2, 4, 5) for q, _ in got) and got[3, "router"] >= records.EXACT
    assert [r.name for r in records.best_records(records.record_scores(table, [(1, "quantization")]), 1).collect()] == ["ptq-runner"]
    assert records.record_scores(table.limit(0), [(1, "a b")]).count() == records.record_scores(table, []).count() == 0


def test_eligible_records(table):
    own = lambda **k: {r.name for r in table.where(records.eligible(k.pop("task"), **k)).collect()}
    assert own(task="convert", every=("x5", "s6")) == {"ptq-runner", "router"} == own(task="convert", platform=F.lit("x5"))
    assert own(task="convert", platform=F.lit("s6")) == {"router"} and own(task="convert", every=("x5",), excluded=("x5",)) == set()
    assert own(task="camera", every=("s6",), role="entry") == set() and own(task="camera", every=("s6",), pack=" ROS ") == {"cam"}


def test_put_behind(spark):
    df = spark.createDataFrame([(1, "a", 9), (1, "b", 5), (1, "c", 2), (2, "a", 4)], "query_id int, name string, score int")
    got = {(r.query_id, r.name): r.score for r in records.put_behind(df, F.col("name") == "a").collect()}
    assert got == {(1, "a"): 1, (1, "b"): 5, (1, "c"): 2, (2, "a"): 4}


def test_hit_decisions(spark):
    df = spark.createDataFrame([(1, 1, "t5"), (1, 2, "t5"), (1, 3, None), (1, 4, "s6")], "query_id int, place int, board string").withColumn("page", F.col("place"))
    assert [r.page for r in hits.first_of_each_board(df).orderBy("place").collect()] == [1, 3, 4, 2]
    one = spark.range(1)
    assert one.select(hits.board_conflict(F.array(F.lit("t5")), F.lit("S6"))).first()[0] and not one.select(hits.board_conflict(F.array().cast("array<string>"), F.lit("s6"))).first()[0]
    assert one.select(hits.resolved_source(F.lit("all"), F.lit(None).cast("string"), ("forum",))).first()[0] == "all" and one.select(hits.resolved_source(F.lit(None).cast("string"), F.lit("Forum"), ("forum",))).first()[0] == "forum"


def test_many_shards(spark):
    import json

    from docfathom.sources.index_formats import read_shards

    body = json.dumps([{"documents": [{"i": 1, "t": f"text {k}", "u": f"/p{k}"}]} for k in range(7)])
    rows = read_shards(spark.createDataFrame([("m", body)], "manual_id string, body string"), "https://d.e").collect()
    assert {r.doc_ord for r in rows} == {k * 1_000_000_000 for k in range(7)}
