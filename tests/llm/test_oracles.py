import duckdb
import pytest

from railspan.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_oracle(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    want = con.execute(queries.ORACLES[name])
    cols = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, data)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want.fetchall())
