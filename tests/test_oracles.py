"""Every query of the lineage library against its SQL oracle on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from lineagrid import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _rows(rows):
    return Counter(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in rows)


def test_every_query_has_an_oracle():
    assert registry.queries().keys() == registry.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rel = duck.sql(registry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    got = _rows(tuple(r[c] for c in cols) for r in df.collect())
    at = [rel.columns.index(c) for c in cols]
    assert got == _rows(tuple(r[i] for i in at) for r in rel.fetchall())
