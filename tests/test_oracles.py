"""Every core query that has SQL, against DuckDB on the smallest tables."""

import datetime
import math
from pathlib import Path

import pytest

from lexiloom import plans

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    x = float(v)
    return None if math.isnan(x) else round(x, 5)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, str(DATA))
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    answer = duck.execute(plans.ORACLE_SQL[name])
    at = [x[0] for x in answer.description]
    assert sorted(at) == names
    assert got == sorted((tuple(plain(r[at.index(c)]) for c in names) for r in answer.fetchall()), key=repr)
