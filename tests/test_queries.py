"""Every query that has SQL gives the rows of that SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from docfathom import queries as Q

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
SQL = Q.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, (list, tuple)) or hasattr(x, "tolist") and getattr(x, "shape", ()) != ():
        return tuple(map(plain, x))
    return x.item() if hasattr(x, "item") else x


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got = Q.queries()[name](spark, str(DATA))
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    ours = sorted(repr(tuple(plain(r[c]) for c in sorted(names))) for r in got.collect())
    order = [names.index(c) for c in sorted(names)]
    theirs = sorted(repr(tuple(plain(r[k]) for k in order)) for r in want.fetchall())
    assert ours == theirs
