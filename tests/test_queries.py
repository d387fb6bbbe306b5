"""Every registered query against its SQL twin at the small scale."""

import math

import duckdb
import pytest

from refspark.plans import registry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 5) + 0.0
    return str(v) if v is not None else None


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cur = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    assert len(got) == len(want) and len(got) > 0
    differ = [(a, b) for a, b in zip(got, want, strict=True) if a != b and not all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1, abs(x))) for x, y in zip(a, b, strict=True))]
    assert not differ, (len(differ), differ[:3])


def test_names_agree():
    assert registry.oracle_sql().keys() <= registry.queries().keys()
