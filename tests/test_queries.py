"""Every query with SQL gives DuckDB's rows; the others run."""

import glob
import math
import os

import duckdb
import pytest

from evbench.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        g = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{g}'")
    return c


def plain(rows):
    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v + 0.0:.6f}"
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return repr(v)
        return f"{float(v):.6f}"

    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    if name not in registry.ORACLE_SQL:
        assert got
        return
    want = duck.execute(f"SELECT * FROM ({registry.ORACLE_SQL[name]})")
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert plain(got) == plain([tuple(r[i] for i in at) for r in want.fetchall()])
