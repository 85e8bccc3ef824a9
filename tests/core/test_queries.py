import duckdb
import pytest

from railspan.plans import details, files, registry, reports, stores, streams, tails  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_oracle(spark, data, duck, name):
    got = registry.QUERIES[name](spark, data)
    want = duck.execute(registry.ORACLES[name])
    cols = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(cols)
    rows = sorted((tuple(map(plain, r)) for r in got.select(*cols).collect()), key=repr)
    assert rows == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)
    if "hold_rec" not in name:
        assert rows


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0
