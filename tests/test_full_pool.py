"""The title score, rank fusion and pages run over the whole pool, not over its first ranks."""

from pathlib import Path

import duckdb
import pytest

from docfathom import queries as Q

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
CUT = "FROM pool JOIN docs USING (doc_id) WHERE bm25_rank < 20)"


@pytest.mark.parametrize("name", ["lexical_scores", "rank_fusion", "page_aggregation"])
def test_whole_pool(spark, name):
    """The rows of the registered SQL with its cut at 20 candidates taken out, counted over all 450."""
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    sql = Q.oracle_sql()[name].replace(CUT, "FROM pool JOIN docs USING (doc_id))")
    assert "bm25_rank < 20" not in sql
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    row = lambda r: repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r))
    theirs = sorted(map(row, want.fetchall()))
    assert sorted(row(r[c] for c in names) for r in Q.queries()[name](spark, str(DATA)).collect()) == theirs
    assert len(theirs) > 0
