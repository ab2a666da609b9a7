import math
from collections import Counter

from docfathom.llm import terms as T

ROWS = [(1, "The PIN table", "a pin, the Pin"), (2, None, "x" * 41 + " ok"), (2, "", None), (None, "été ok", "the the"), (5, "\u212a9", "pin 7")]
SCHEMA = "row_id long, title string, text string"


def test_terms_of_cuts_before_lowering():
    assert T.terms_of("ab\u212acd Éa x 12") == ["ab", "cd", "éa", "12"]
    assert T.terms_of(None) == T.terms_of("") == []


def test_counts_equal_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumnRenamed("row_id", "n_rows")
    want, rows = Counter(), Counter()
    for r in ROWS:
        own = T.terms_of(r[1]) + T.terms_of(r[2])
        want.update(own)
        rows.update(set(own))
    got = {r.term: (r.occurrences, r.n_rows) for r in T.term_counts(df, "title", "text", held=2).collect()}
    assert got == {x: (n, rows[x]) for x, n in want.items()}


def test_marks(spark):
    df = spark.createDataFrame([("aa bb", "u1")] * 3 + [("aa cc", "u2")] + [(None, None)] * 6, "text string, url string")
    got = {(r.field_name, r.term): (r.occurrences, r.n_rows, r.mark) for r in T.frequencies(df, {"text": 0.35}, {"url": 0.25}).collect()}
    assert got == {("text", "aa"): (4, 4, "common"), ("text", "bb"): (3, 3, "kept"), ("text", "cc"): (1, 1, "rare"), ("url", "u1"): (3, 3, "common"), ("url", "u2"): (1, 1, "rare")}
    assert T.frequencies(df.limit(0), {"text": 0.1}, {"url": 0.1}).count() == 0


def test_scores_equal_brute_force_also_for_hot_terms(spark):
    rows = [(k, "hot common", f"hot term{k % 5} term{k % 5}") for k in range(1200)] + ROWS
    own = [T.terms_of(r[1]) + T.terms_of(r[2]) for r in rows]
    all_n, total = Counter(x for o in own for x in o), sum(map(len, own))
    n_rows = Counter(x for o in own for x in set(o))
    smooth = sum(len(o) ** 0.75 for o in own if o)
    want = Counter()
    for r, o in zip(rows, own):
        for x, n in Counter(o).items():
            score = max(0.0, math.log((n / total) / (all_n[x] / total * len(o) ** 0.75 / smooth)))
            want[str(r[0]), x, n, len(o), all_n[x], n_rows[x], round(score, 6)] += 1
    df = spark.createDataFrame(rows, SCHEMA)
    got = Counter((str(r.row_id), r.term, r.n, r.row_terms, r.term_n, r.term_rows, round(r.score, 6)) for r in T.distinctive_terms(df, "row_id", "title", "text").collect())
    assert got == want
    assert T.distinctive_terms(df.limit(0), "row_id", "text").count() == 0
