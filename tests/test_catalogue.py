import duckdb
import pytest

from folioguard.plans import agreement, decks, extracts, files, near, planted, rules  # noqa: F401 (they register their queries)
from folioguard.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)
    assert got
    if name in ORACLES:
        rel = duck.sql(ORACLES[name])
        at = [rel.columns.index(n) for n in names]
        assert sorted(rel.columns) == names
        want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)
        assert len(got) == len(want)
        assert [g for g, w in zip(got, want) if g != w][:3] == [w for g, w in zip(got, want) if g != w][:3]
