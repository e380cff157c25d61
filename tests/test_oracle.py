"""Every registered query with SQL gives DuckDB's rows."""

from __future__ import annotations

import os

import pytest

from quarryline import showcase

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def norm(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(showcase.QUERIES))
def test_equal(spark, duck, name):
    df = showcase.queries()[name](spark, DATA)
    got = sorted(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    found = duck.execute(showcase.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    assert got == sorted(tuple(norm(r[k]) for k in at) for r in found.fetchall())


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_tied_page_in_order(spark, duck, tmp_path, threshold):
    """Row for row, in the order of the SQL, whether joins broadcast or not; with orders whose customers are missing."""
    for name in ("orders", "lineitem"):
        os.symlink(f"{DATA}/{name}.parquet", tmp_path / f"{name}.parquet")
    own = duck.cursor()
    own.execute(f"copy (select * from '{DATA}/customer.parquet' where c_custkey % 3 = 0) to '{tmp_path}/customer.parquet' (format parquet)")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        df = showcase.queries()["with_tied_page"](spark, str(tmp_path))
        found = own.execute(showcase.oracle_sql()["with_tied_page"])
        assert df.columns == [d[0] for d in found.description]
        assert list(map(tuple, df.collect())) == found.fetchall()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
