"""Every query of the operators, and its SQL where there is one, over the smallest tables."""

import duckdb
import pytest

from verbatlas.queries import ORACLES, QUERIES

D = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v != v:
        return "-"
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.8g}" if isinstance(v, (int, float)) else str(list(v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"):
        c.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, D)
    got = sorted(tuple(map(plain, r)) for r in df.collect())
    if name in ORACLES:
        q = con.sql(ORACLES[name])
        assert sorted(q.columns) == sorted(df.columns)
        at = [q.columns.index(n) for n in df.columns]
        assert got == sorted(tuple(plain(r[k]) for k in at) for r in q.fetchall())
    else:
        assert got or name in ("ols_three_predictors",)


def test_entry_without_the_llm_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['verbatlas.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__file__.rsplit("/", 2)[0], check=True).stdout.split()
    assert int(said[0]) == len(QUERIES) and said[1] == "False"
