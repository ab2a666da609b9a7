import pytest

from docfathom.engine import Engine
from docfathom.operators import sections
from docfathom.plans import planner as P

SCHEMA = "doc_id long, manual_id string, doc_ord long, title string, url string, snippet string, text string, answer string, breadcrumbs array<string>, kind string"


@pytest.fixture(scope="module")
def engine(spark):
    row = lambda k, title, text, url, manual="m1", kind="page", answer=None: (k, manual, k, title, url, None, text, answer, None, kind)
    docs = [
        row(1, "Overview", "recovery recovery recovery recovery partition notes", "https://d.e/a"), row(2, "Recovery partition", "Steps follow.", "https://d.e/b"), row(3, "Use cam_tool now", "How to run it.", "https://d.e/c"),
        row(4, "yolov5 sample", "Run the sample.", "https://d.e/d"), row(5, "Firmware", "The firmware update.", "https://d.e/e", "m2"), row(6, "Firmware notes", "More firmware.", "https://d.e/e#notes", "m2", "heading"),
        row(7, None, None, "https://d.e/f"), row(8, "Tavrix T5 wiring", "wiring of boards", "https://d.e/t5"), row(9, "Orlo S1 wiring", "wiring of boards", "https://d.e/s1"), row(10, "烧录系统镜像", "烧录步骤", "https://d.e/zh"), row(11, "", "", "https://d.e/g"),
    ]
    manuals = [("m1", "One", "c", None, "https://d.e/", "/", ["first-manual"], True, "x", False), ("m2", "Two", "c", None, "https://d.e/", "/", None, True, "x", True)]
    return Engine(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(manuals, "manual_id string, title string, category string, description string, home_url string, base_path string, aliases array<string>, searchable boolean, index_kind string, no_board boolean"))


def pages(engine, query, **options):
    return [r for r in engine.search([{"query_id": 1, "query": query, **options}]).orderBy("place").collect()]


def test_title_before_body(engine):
    hits = pages(engine, "recovery partition")
    assert [h.page for h in hits][:2] == ["https://d.e/b", "https://d.e/a"] and hits[0].quality == "good" and 0 <= hits[0].confidence <= 1


def test_identifiers_prefixes_and_typos(engine):
    assert pages(engine, "camtool")[0].page == "https://d.e/c"
    assert pages(engine, "yolo")[0].page == "https://d.e/d"
    assert pages(engine, "frimware")[0].page == "https://d.e/e"


def test_chunks_gather_to_pages(engine):
    hit = pages(engine, "firmware")[0]
    assert hit.page == "https://d.e/e" and hit.n_chunks == 2 and hit.manual_id == "m2"


def test_filters_and_limits(engine):
    assert {h.manual_id for h in pages(engine, "firmware wiring", manual="First-Manual")} == {"m1"}
    assert {h.manual_id for h in pages(engine, "firmware wiring", board="t5")} == {"m1"}
    assert len(pages(engine, "wiring", limit=1)) == 1 and pages(engine, "  ") == []
    assert pages(engine, "t5 wiring")[0].page == "https://d.e/t5" and pages(engine, "s1 wiring")[0].page == "https://d.e/s1"


def test_uncovered_queries_are_weak(engine):
    assert all(h.quality == "weak" for h in pages(engine, "zzqq9000 espresso"))


def test_cjk_and_alternates(engine):
    assert pages(engine, "如何烧录镜像")[0].page == "https://d.e/zh"
    fused = engine.search_alternates(7, "recovery", ["partition", "recovery", " ", "x" * 400]).orderBy("place").collect()
    assert fused[0].page in ("https://d.e/a", "https://d.e/b") and {r.query_id for r in fused} == {7}


def test_stages_can_be_left_out(engine, spark):
    plain = Engine(engine.docs, engine.manual_table, without=("fusion", "coverage", "structure", "board"), kept=engine.kept)
    assert pages(plain, "recovery partition")[0].page == "https://d.e/b"


def test_pages_toc_and_status(engine):
    assert engine.status()["documents"] == 11 and engine.toc("m2").count() == 1 and engine.resolve_manual("nobody") is None
    whole = engine.page("https://d.e/e#notes", full=True, most=10)
    assert whole["next_offset"] == 10
    with pytest.raises(ValueError):
        engine.page("https://d.e/e", offset=10)
    assert engine.page("https://d.e/e", offset=10, expected_hash=whole["content_hash"])["text"]
    with pytest.raises(LookupError):
        engine.page("https://d.e/none")
    assert "More firmware" in engine.page("https://d.e/e", section="firmware notes")["text"]


def test_answers_pin_prefer_boards_and_mix_the_forum(engine, spark):
    from docfathom.operators.results import PageRule

    forum = spark.createDataFrame([(1, "https://f.e/t/1", 0), (1, "https://f.e/t/2", 1), (2, "https://f.e/t/1", 0), (3, "https://f.e/t/1", 0)], "query_id long, page string, rank int")
    asked = [{"query_id": 1, "query": "wiring", "board": "s1", "limit": 4}, {"query_id": 2, "query": "firmware", "manual": "m2"}, {"query_id": 3, "query": "firmware install", "source": "forum"}, {"query_id": 4, "query": "t5 wiring", "board": "s1", "source": "docs"}]
    got = {}
    for r in engine.answers(asked, forum, [PageRule("^firmware$", "https://d.e/c")], "install").orderBy("place").collect():
        got.setdefault(r.query_id, []).append(r)
    assert [(r.page, r.source) for r in got[1]] == [("https://d.e/s1", "docs"), ("https://d.e/t5", "docs"), ("https://f.e/t/1", "forum"), ("https://f.e/t/2", "forum")]
    assert [r.page for r in got[2]] == ["https://d.e/c", "https://d.e/e"] and {r.source for r in got[2]} == {"docs"}
    assert [r.page for r in got[3]] == ["https://f.e/t/1"] and got[3][0].warning == "board missing"
    assert {r.warning for r in got[4]} == {"board conflict"} and [r.place for r in got[1]] == [1, 2, 3, 4]


def test_long_queries_are_refused(engine):
    with pytest.raises(ValueError):
        engine.search([{"query_id": 1, "query": "x" * 501}])


def test_planner():
    p = P.analyse('how to flash "no such device" on wifi 40 pin')
    assert p.terms["flash"] == 1 and p.terms["烧录"] == P.SYNONYM and p.terms["40pin"] == 1 and p.needles == ["no such device"] and "how" not in p.terms
    assert "ab" in P.edits("ba") and "abc" in P.edits("ab") and "a" in P.edits("ab")
    kept, warned = P.distinct_alternates("a", ["a ", "b", "B", "c", "d", "e"])
    assert kept == ["b", "c", "d"] and len(warned) == 1


MD = "lead\n\n# A\n\nalpha text\n\n## B [](#bee)\n\nbeta text\n\n# C\n\n" + "long " * 100


def test_sections():
    assert [(p.title, p.level) for p in sections.pieces_of(MD)] == [("", 0), ("A", 1), ("B", 2), ("C", 1)]
    assert sections.select_section(MD, section="a")[0].endswith("beta text")
    assert sections.select_section(MD, anchor="bee")[:2] == ("## B [](#bee)\n\nbeta text", "B")
    assert sections.select_section(MD, query="alpha")[1] == "A" and not sections.select_section(MD, query="zz")[2]
    text, title, matched, truncated = sections.pack_sections(MD, "u", "beta", 200)
    assert title == "B" and matched and truncated and text.startswith("Source: u\n\n## B") and "omitted sections: A, C" in text
    assert "Section index:\n- A\n- B\n- C" in sections.pack_sections(MD, "u", "zzz", 400)[0]
    assert len(sections.omitted_line(["t" * 50] * 100)) <= sections.OMITTED_CAP
    assert sections.image_notes("40pin\n![](a.png)") == ["a.png"] and sections.image_notes("40pin\n![](a.png)\n|a|\n|-|\n") == []
    assert sections.pieces_of("") == []
