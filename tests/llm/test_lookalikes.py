from pyspark.sql import functions as F

from docfathom.llm import lookalikes as L

DOCS = "row_id long, title string, text string, form string, field_name string"


def rules_for(*texts):
    n = {}
    for t in texts:
        for ch in t:
            n[ch] = n.get(ch, 0) + 1
    return L.rewrite_rules(n)


def test_forms_agree_where_texts_look_alike():
    plain = "Café Å fi x KB-10 été;"
    odd = "Cafe\u0301 \u212b \ufb01 \u0445 \uff2b\uff22\u201010 \u200be\u0301t\u200be\u0301\u037e"
    rewrite = L.Rewriter(rules_for(plain * 5, odd))
    assert rewrite(odd) == rewrite(plain) == plain


def test_visible_differences_stay():
    texts = ["Cafe", "Café", "cafe", "Cafe!", "Cafe 1", "Cafe  1", "Cafе1x"]
    rewrite = L.Rewriter(rules_for(*texts))
    assert len({rewrite(t) for t in texts}) == len(texts)


def test_classes_are_transitive_and_the_most_frequent_member_stands_for_them():
    classes = L.look_alike_classes("\uff21A\u0410\u0391")
    assert len({classes.find(x) for x in "\uff21A\u0410\u0391"}) == 1
    assert set(L.rewrite_rules({"\u0410": 9, "A": 2}).items()) >= {("A", "\u0410")}


def test_accent_after_widthless_sign():
    rewrite = L.Rewriter(rules_for("é" * 3, "e\u200b\u0301"))
    assert rewrite("e\u200b\u0301") == "é"


def brute(rows):
    texts = [t for r in rows for t in r[1:3] if t]
    rewrite = L.Rewriter(rules_for(*texts))
    out = set()
    for k, field in ((1, "title"), (2, "text")):
        for a in rows:
            for b in rows:
                if a[0] < b[0] and a[k] is not None and b[k] is not None and a[k] != b[k] and rewrite(a[k]) == rewrite(b[k]):
                    out.add((field, a[0], b[0]))
    return out


def test_pairs_equal_brute_force_with_nulls_copies_and_clashing_columns(spark):
    base = [(1, "Ab c", None), (2, "\uff21b c", "x"), (3, "Ab\u00a0c", "\u0445"), (4, "Ab c", ""), (5, None, "\u200b"), (6, "ab c", "x" * 5000), (7, "Ab c", "x" * 4999 + "\uff58")]
    rows = base + [(k, "hot", "hot\u200b" if k % 10 == 0 else "hot") for k in range(100, 160)]
    df = spark.createDataFrame([(*r, "f", "n") for r in rows], DOCS)
    got = {tuple(r) for r in L.look_alike_pairs(df, "row_id", "title", "text", hot_rows=7).collect()}
    assert got == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert L.look_alike_pairs(df, "row_id", "text", "title").count() == 0
    assert L.uniform_text(df, "row_id", "text").count() == 0


def test_uniform_text_keeps_rows_and_nulls(spark):
    df = spark.createDataFrame([(1, None, "\uff41", "f", "n"), (1, "", "a" * 100_000, "f", "n"), (None, "t", None, "f", "n")], DOCS)
    got = sorted((str(r[0]), r[1], r[2]) for r in L.uniform_text(df, "row_id", "text", "title").collect())
    assert got == sorted([("1", "a", None), ("1", "a" * 100_000, ""), ("None", None, "t")])


def test_classes_have_a_line_a_row_and_count_the_links(spark):
    rows = [(1, "a\u0301b"), (2, "\u00e1b"), (3, "\u00e1b"), (4, "other"), (5, None), (6, "\uff41\u0301b"), (7, "other"), (8, "")]
    df = spark.createDataFrame(rows, "row_id long, text string").withColumn("n", F.lit("clash")).withColumn("own", F.lit(1))
    got = {r.row_id: (r.n_rows, r.n_links) for r in L.look_alike_rows(df, "row_id", "text").collect()}
    assert got == {1: (4, 3), 2: (4, 2), 3: (4, 2), 6: (4, 3)}
    pairs = {(r.row_id_a, r.row_id_b) for r in L.look_alike_pairs(df, "row_id", "text").collect()}
    assert pairs == {(1, 2), (1, 3), (1, 6), (2, 6), (3, 6)}
    assert sum(links for _, links in got.values()) == 2 * len(pairs)


def test_rewriting_goes_on_until_nothing_changes():
    rewriter = L.Rewriter(L.rewrite_rules(L.Counter("e\u0301\u200b\u00e9\u00e9")))
    text = "e" + "\u200b" * 40 + "\u0301"
    assert rewriter(text) == "\u00e9" == rewriter(rewriter(text))
