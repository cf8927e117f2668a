"""Every registered query of the library's own operators against its SQL in DuckDB, on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from clauseloom.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(x):
    x = x.tolist() if hasattr(x, "tolist") else x
    if isinstance(x, float):
        return None if math.isnan(x) else int(x) if x.is_integer() else round(x, 9)
    return x if x is None or isinstance(x, int) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(*cols).collect())
    assert got
    if name in catalog.ORACLE:
        cur = duck.execute(catalog.ORACLE[name])
        names = [x[0] for x in cur.description]
        assert sorted(names) == cols
        assert got == Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
