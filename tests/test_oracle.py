"""Registered queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from wellspring.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name, tmp_path):
    df = catalog.QUERIES[name](spark, SF)
    df.write.parquet(str(tmp_path / "out"))
    got = f"SELECT {', '.join(sorted(df.columns))} FROM read_parquet('{tmp_path}/out/*.parquet')"
    if name not in catalog.ORACLE:
        assert con.execute(f"SELECT count(*) FROM ({got})").fetchall()[0][0] > 0
        return
    want = f"SELECT {', '.join(sorted(df.columns))} FROM ({catalog.ORACLE[name]})"
    for a, b in ((got, want), (want, got)):
        assert con.execute(f"SELECT count(*) FROM (({a}) EXCEPT ALL ({b}))").fetchall()[0][0] == 0
