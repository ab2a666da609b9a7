"""Common title terms, aliases with a typing error, abstention outside answers and distinctive concepts."""

import pytest

from docfathom.engine import Engine
from docfathom.operators import ranking
from docfathom.plans import planner as P
from tests.test_search import SCHEMA


def engine_of(spark, docs, aliases=None):
    manuals = [("m1", "One", "c", None, "https://d.e/", "/", aliases, True, "x", False)]
    rows = [(k, "m1", k, title, f"https://d.e/p{k}", None, text, answer, None, "page") for k, (title, text, answer) in enumerate(docs)]
    return Engine(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(manuals, "manual_id string, title string, category string, description string, home_url string, base_path string, aliases array<string>, searchable boolean, index_kind string, no_board boolean"))


@pytest.fixture(scope="module")
def engine(spark):
    filling = [("kernel tree", f"page number p{k}", None) for k in range(900)]
    return engine_of(spark, [*filling, ("Panel", "the zircon panel", "use the espresso9 tool"), ("m1 start", "start with it", None)], ["handbuch"])


def test_common_title_terms(spark):
    rows = spark.createDataFrame([(1, "kernel", 72, 900), (1, "panel", 71, 900), (2, "kernel", 90, 700)], "query_id long, term string, df long, n long")
    assert [(r.query_id, r.term) for r in ranking.common_title_terms(rows).collect()] == [(1, "kernel")]


def test_an_alias_with_a_typing_error_names_its_manual(engine):
    assert engine.plan([{"query": "handbuhc"}])[0].terms["m1"] == P.ALIAS_EDIT
    assert P.named_by_edit("handbook", {"handbuch": "m1"}) == []


def test_terms_of_answers_only_do_not_stop_abstention(engine):
    assert {r.quality for r in engine.search([{"query_id": 1, "query": "espresso9"}]).collect()} == {"weak"}
    assert {r.quality for r in engine.search([{"query_id": 1, "query": "zircon"}]).collect()} == {"good"}


def test_confidence_counts_distinctive_concepts(engine):
    # kernel is in nearly all documents and is no concept to be sure by: one of one distinctive concept is hit.
    hit = engine.search([{"query_id": 1, "query": "kernel zircon"}]).where("title = 'Panel'").first()
    assert hit.coverage == 0.5 and hit.confidence >= 0.75


def test_corrections_keep_the_tail_and_the_edit():
    df = {"firmware": 9, "frimwa": 2, "board": 50, "device": 7, "phone": 9, "guide": 9, "kernel": 5, "wifi": 3, "static": 9}
    assert P._corrections("frimware", df, {}) == [("frimwa", P.TAIL), ("firmware", P.EDIT)]
    assert P._corrections("devicee", df, {}) == [("device", P.TAIL)] and P._corrections("boardd", df, {}) == []  # a fragment of names
    assert P._corrections("iphone", df, {}) == [] and P._corrections("giude", df, {}) == []
    assert P._corrections("kernl", df, {"kernel": ["x"]}) == [("kernel", P.EDIT)] and P._corrections("kernl", df, {}) == []
    assert P._corrections("wfii", df, {}) == [("wifi", P.EDIT)] and P._corrections("statc", df, {"static": ["x"]}) == []  # a generic word


def test_titles_leave_out_synonyms_of_the_index():
    assert "量化" not in P.lexical_tokens("ptq error") and "无线" in P.lexical_tokens("wifi")
