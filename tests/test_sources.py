import io
import json
import zipfile

from docfathom.sources import archives, forum
from docfathom.sources import html_pages as H
from docfathom.sources import index_formats as X


def frame(spark, body):
    return spark.createDataFrame([("m", body)], "manual_id string, body string")


def test_shards(spark):
    doc = lambda **x: {"i": 1, "t": "", "u": "/a", "b": [], "h": "", "s": "", "p": 0} | x
    raw = [
        {"documents": [doc(t="Page A", b=["Top"]), doc(u="", t="no url")]},
        {"documents": [doc(h="one", s="One", t="text x"), doc(h="one", s="One more", t="text"), doc(h="one", s="One", t="other"), doc(h="two", s="Two")]},
        {"documents": [doc(t="first"), doc(t="second", u="/a#one")]},
    ]
    rows = {(r.kind, r.url): r for r in X.read_shards(frame(spark, json.dumps(raw)), "https://d.e").collect()}
    page = rows["page", "https://d.e/a"]
    assert page.title == "Page A" and page.text == "first\nsecond"
    one, two = rows["heading", "https://d.e/a#one"], rows["heading", "https://d.e/a#two"]
    assert one.title == "One more" and one.answer == "text x\nother" and one.snippet is None
    assert two.snippet == "Page A" and two.answer is None
    assert X.read_shards(frame(spark, "no json"), "https://d.e").count() == 0 == X.read_shards(frame(spark, None), "https://d.e").count()


def test_page_index_and_versions(spark):
    raw = json.dumps([{"title": "T", "content": "# T\n\nabc", "routePath": "/t", "lang": "en", "toc": [{"text": "H", "id": "h"}]}])
    rows = X.read_page_index(frame(spark, raw), "https://d.e").orderBy("doc_ord").collect()
    assert [(r.kind, r.url, r.snippet) for r in rows] == [("page", "https://d.e/t", "T abc"), ("heading", "https://d.e/t#h", "T")]
    groups = spark.createDataFrame([('x={"1.9.0###en":"aa1","1.10.0###en":"bb2"}',)], "b string").select(X.index_groups(__import__("pyspark.sql.functions", fromlist=["col"]).col("b")).alias("g"))
    rows = groups.selectExpr("inline(g)")
    assert [(r.version, r.hash) for r in X.newest_versions(rows).collect()] == [("1.10.0", "bb2")]
    assert X.newest_versions(rows.selectExpr("'next' AS version", "lang", "hash").unionByName(rows)).count() == 4


def test_term_index(spark):
    source = 'Search.setIndex({docnames:["index","b/c"],titles:{"index":"Home","b/c":"C"},terms:{my_tool:1,short:0,averylongterm:[0,1],"x9ab":[1]}})'
    rows = X.read_term_index(frame(spark, source), "https://d.e/m/").orderBy("doc_ord").collect()
    assert [(r.title, r.url) for r in rows] == [("Home", "https://d.e/m/"), ("C", "https://d.e/m/b/c.html")]
    assert rows[1].text.split() == ["my_tool", "averylongterm", "x9ab"] and rows[0].text == "averylongterm"
    assert X.read_term_index(frame(spark, "broken({"), "https://d.e").count() == 0


def test_html_to_markdown():
    html = "<html><head><title>Tab</title><style>x</style></head><body><nav>skip</nav><article><h1>Title</h1><p>One <b>two</b><p>Three <a href='/x'>link</a> <a href='javascript:1'>no</a><ul><li>a<li>b</ul><table><tr><th>k<th>v<tr><td>1<td>2</table><pre><code>x\n  y</code></pre><h5>small</h5><img src='i.png' alt='i'></article></body></html>"
    title, text = H.html_to_markdown(html, "https://d.e/p")
    assert title == "Title"
    assert text.startswith("# Title\n\nOne two\n\nThree [link](https://d.e/x) no\n\n- a\n- b")
    assert "| k | v |\n| --- | --- |\n| 1 | 2 |" in text and "```\nx\n  y\n```" in text and "![i](https://d.e/i.png)" in text and "skip" not in text
    assert H.html_to_markdown(None, "u") == ("u", "") and H.html_to_markdown("<p>a", fragment=True)[1] == "a"


def test_shells():
    assert H.is_shell("<div id=__docusaurus></div>", "") and not H.is_shell("<div id=__docusaurus></div>", "# T\n\nbody") and not H.is_shell("<p>", "")


def test_forum(spark):
    body = json.dumps({"topics": [{"id": 7, "title": "T", "slug": "t", "tags": ["a"], "pinned": False, "excerpt": "<b>x</b>"}, {"id": 8, "title": "P", "pinned": True}], "posts": [{"topic_id": 7, "username": "u", "blurb": "first"}, {"topic_id": 7, "username": "v", "blurb": "second"}]})
    df = spark.createDataFrame([(body,), ("nothing",), (None,)], "body string")
    rows = {r.url: r for r in forum.read_search(df, "https://f.e").collect()}
    assert rows["https://f.e/t/7"].snippet == "first" and rows["https://f.e/t/8"].breadcrumbs == []
    assert [(r.snippet, r.breadcrumbs) for r in forum.read_listing(df, "https://f.e", "board").collect()] == [("x", ["board", "a"])]
    posts = spark.createDataFrame([(1, 2, "T", ["a"], "u", "<p>two</p>"), (1, 1, "T", ["a"], None, "<p>one</p>"), (1, 1, "T", ["a"], None, "<p>one</p>"), (2, 1, "N", None, "u", None)], "topic_id long, post_number long, title string, tags array<string>, username string, cooked string")
    assert [r.markdown for r in forum.topics_to_markdown(posts).collect()] == ["# T\n\nTags: a\n\n## @?\n\none\n\n## @u\n\ntwo"]


def test_archives(spark):
    def packed(*members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in members:
                z.writestr(name, data)
        return out.getvalue()

    good = packed(("a/SKILL.md", "x"))
    cases = {"good": good, "none": packed(("a.md", "x")), "two": packed(("SKILL.md", "x"), ("b/SKILL.md", "y")), "up": packed(("../SKILL.md", "x")), "cut": good[:-8], "empty": b""}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "path string, content binary")
    got = {r.path: r.issue for r in archives.inspect_archives(df).collect()}
    assert got == {"good": None, "none": "needs one SKILL.md", "two": "needs one SKILL.md", "up": "unsafe name", "cut": "broken", "empty": "empty"}
    assert archives.image_kind(b"\x89PNG\r\n\x1a\nrest") == "png" and archives.image_kind(None) is None
