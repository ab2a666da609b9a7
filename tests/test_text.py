import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docfathom.functions import boards, urls
from docfathom.functions import text as T
from docfathom.functions.tokenizer import weighted_terms


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_weighted_terms():
    assert weighted_terms("Use my_tool-x inter. 40 pin") == {"use": 1, "my_tool-x": 1, "mytoolx": 1, "my": 0.5, "tool": 0.5, "inter.": 1, "inter": 0.5, "40": 1, "pin": 1, "40pin": 1}
    assert weighted_terms("烧录系统的镜像") == {"烧录系统": 1, "烧录": 1, "录系": 1, "系统": 1, "镜像": 1}
    assert weighted_terms("如何烧录") == {"烧录": 1}
    assert weighted_terms("40,pin") == {"40": 1, "pin": 1} and weighted_terms(None) == {}
    assert "docs" not in weighted_terms("a-docs", 1.0) and "docs" in weighted_terms("docs")


@settings(deadline=None, max_examples=100)
@given(st.text(max_size=200))
def test_any_text_has_clean_terms(x):
    assert all(len(t) >= 2 and n > 0 for t, n in weighted_terms(x).items())


def test_boards(spark):
    find = lambda x: one(spark, boards.mentioned_boards, x)
    assert find("Tavrix T5 and orlo-s1") == ["t5", "s1"]
    assert find("driver_development_t5") == ["t5"]
    assert find("TavrixT2、s6") == ["t2", "s6"]
    assert find("t55 at5") == [] == find(None)


def test_urls(spark):
    assert one(spark, urls.document_path, "https://a.b/c/d/index.html?x#y") == "/c/d"
    assert one(spark, urls.slash_variant, "https://a/b/") == "https://a/b" and one(spark, urls.slash_variant, "https://a/b") == "https://a/b/"
    assert one(spark, lambda c: urls.allowed(c, ("a.b",)), "https://A.b/c") and not one(spark, lambda c: urls.allowed(c, ("a.b",)), None)
    assert one(spark, lambda c: urls.resolved(c, "https://a.b"), "/c") == "https://a.b/c"


@pytest.mark.parametrize("text,want", [("# T\n\nabc  d", "T abc d"), ("x" * 300, "x" * 280 + "…"), ("　 a ", "a"), ("", "")])
def test_excerpt(spark, text, want):
    assert one(spark, T.excerpt, text) == want


def test_windows_join_to_the_text(spark):
    text = "abc é" * 100
    parts, at = [], 0
    while at is not None:
        w = one(spark, lambda c, at=at: T.window(c, F.lit(at), F.lit(170)), text)
        parts.append(w.chunk)
        at = w.next_offset
    assert "".join(parts) == text and one(spark, T.cleaned, "a​  \n\n\n\nb ") == "a\n\nb"
    assert one(spark, T.shell_quoted, "it's") == "'it'\"'\"'s'"
