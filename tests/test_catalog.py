"""Every registered query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import decimal
import math

import duckdb
import pytest

from gleanery.plans import catalog

TINY = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
WITHOUT = sorted(set(catalog.queries()) - set(catalog.oracle_sql()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 6) + 0.0
    return [plain(x) for x in v] if isinstance(v, list) else int(v) if isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, TINY)
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr([plain(r[names.index(c)]) for c in df.columns]) for r in cur.fetchall())
    assert sorted(repr([plain(v) for v in r]) for r in df.collect()) == want


@pytest.mark.parametrize("name", WITHOUT)
def test_runs(spark, name):
    rows = catalog.queries()[name](spark, TINY).limit(1000).collect()
    assert rows or name == "extract_claims"
