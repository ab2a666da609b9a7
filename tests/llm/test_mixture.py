import itertools

import numpy as np
import pytest

from docfathom.llm import mixture as M


def test_knapsack_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(60):
        lengths = rng.choice(np.arange(1, 40), size=4, replace=False)
        counts = rng.integers(0, 4, 4)
        budget = int(rng.integers(0, 120))
        best = max(s for take in itertools.product(*(range(c + 1) for c in counts)) if (s := int(np.dot(take, lengths))) <= budget)
        taken = M.fill_budget(lengths, counts, budget)
        assert int(np.dot(taken, lengths)) == best and (taken <= counts).all() and (taken >= 0).all()


def test_large_budgets_take_lengths_in_proportion():
    lengths, counts = np.arange(1, 2001), np.ones(2000, dtype=np.int64)
    taken = M.fill_budget(lengths, counts, 1_000_000)
    assert 1_000_000 - int(np.dot(taken, lengths)) == 0
    assert abs(taken[:1000].mean() - taken[1000:].mean()) < 0.1


@pytest.fixture(scope="module")
def sizes(spark):
    rows = [(k, "a", 10) for k in range(300)] + [(1000 + k, "b", k % 7) for k in range(70)] + [(2000, None, 5), (2001, "other", 9), (2002, "c", 0)]
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long")


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 3), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")


def test_budgets_and_shortfalls(sizes, targets):
    rows = {r.source: r for r in M.source_budgets(sizes, targets).collect()}
    total = (3000 + 210) / 2
    assert rows["a"].budget == total * 0.5 and rows["a"].reachable and rows["a"].full_passes == 0
    assert not rows["b"].reachable and rows["b"].full_passes == 2 and rows["b"].rest == 0
    assert not rows["c"].reachable and not rows["none"].reachable


def test_mixture_reaches_budgets_and_is_seeded(sizes, targets):
    budgets = M.source_budgets(sizes, targets)
    mixed = M.mixture(sizes, budgets, seed=1)
    rows = mixed.collect()
    assert sum(r.tokens * r.repeats for r in rows if r.source == "a") == 800
    assert all(r.repeats == 2 for r in rows if r.source == "b") and sum(r.source == "b" for r in rows) == 60
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.mixture(sizes, budgets, seed=1).collect()))
    assert {r.doc_id for r in rows} != {r.doc_id for r in M.mixture(sizes, budgets, seed=2).collect()}
    shares = {r.source: r for r in M.reached_shares(budgets, mixed).collect()}
    assert shares["a"].reached_share == round(800 / (800 + 420), 6) and shares["none"].mixed_docs == 0


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "hello world", "a", 3), (2, None, None, 3), (3, "", "a", 3), (4, "x" * 30_000, "b", 3)], "doc_id long, text string, source string, tokens int")
    got = {r.doc_id: r.tokens for r in M.token_sizes(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1000
    empty = M.token_sizes(df.limit(0))
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    budgets = M.source_budgets(empty, targets)
    assert budgets.count() == 1 and M.mixture(empty, budgets).count() == 0


def test_knapsack_is_never_left_more_than_it_holds():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = np.unique(rng.integers(1, 40_000, 300))
        counts = rng.integers(1, 50, len(lengths))
        budget = int(rng.integers(20_000, int((lengths * counts).sum())))
        taken = M.fill_budget(lengths, counts, budget)
        assert 0 <= budget - int(np.dot(taken, lengths)) <= 2 and (taken <= counts).all() and (taken >= 0).all()


def test_unbroken_texts_are_counted_whole(spark):
    texts = ["\u4e2d\u6587" * 6500, "ab" * 20_000, "word " * 3000]
    own = M.load_tokenizer(M.TOKENIZER).encode_ordinary
    df = spark.createDataFrame([(k, t, "a") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    assert {r.doc_id: r.tokens for r in M.token_sizes(df).collect()} == {k: len(own(t)) for k, t in enumerate(texts)}


def test_shortfall_of_the_mixture_equals_sql_over_sizes(spark, sizes, targets):
    import duckdb

    budgets = M.source_budgets(sizes, targets)
    got = {r.source for r in M.reached_shares(budgets, M.mixture(sizes, budgets)).where("short").collect()}
    con = duckdb.connect()
    con.register("sizes", sizes.toPandas())
    con.register("targets", targets.toPandas())
    want = con.execute("""WITH h AS (SELECT source, sum(tokens) AS n FROM sizes GROUP BY source), t AS (SELECT sum(n) AS total FROM h SEMI JOIN targets USING (source))
        SELECT source FROM targets LEFT JOIN h USING (source), t WHERE coalesce(n, 0) * max_repeats < target_share * total / 2""").fetchall()
    assert got == {r[0] for r in want} == {"b", "c", "none"}
