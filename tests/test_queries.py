"""Each registered query of the library proper against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidemark.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Numbers may differ by one in the fourth place, to which most queries round. Trained models are in test_models.
NAMES = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{FOLDER}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(float(value), 6) + 0.0 if isinstance(value, (int, float)) else str(value)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, FOLDER)
    columns = sorted(found.columns)
    want = duck.sql(registry.oracle_sql()[name])
    assert columns == sorted(want.columns)
    rows = sorted((tuple(_plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    other = sorted((tuple(_plain(x) for x in r) for r in duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({registry.oracle_sql()[name]})").fetchall()), key=repr)
    assert len(rows) == len(other)
    for a, b in zip(rows, other):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= max(1.1e-4, 1e-8 * abs(x)) for x, y in zip(a, b)), (a, b)
