"""Every query with SQL gives the SQL's rows; the others give rows."""

import glob
import os

import duckdb
import pytest

from epochal.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(names, got):
    order = sorted(range(len(names)), key=lambda k: names[k])
    clean = lambda v: v + 0.0 if isinstance(v, float) else v  # noqa: E731  no negative zero
    return sorted(([clean(r[k]) for k in order] for r in got), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    assert got
    if name in SQL:
        want = con.execute(SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nearest_rows_of_equal_balances(spark, tmp_path):
    """More rows of one balance than are asked for: those of the smallest keys are the nearest; a null is the farthest from all."""
    con, path = duckdb.connect(), tmp_path / "supplier.parquet"
    con.execute("CREATE TABLE supplier AS SELECT k::BIGINT AS s_suppkey, b::DOUBLE AS s_acctbal FROM (VALUES (7, NULL), (3, 5.0), (9, 5.0), (1, 5.0), (12, 5.01), (4, 5.01), (6, -2.5), (20, NULL), (5, 4.99)) t(k, b)")
    con.execute("INSERT INTO supplier SELECT 300000 * r + k, b FROM (SELECT 30 + n AS k, 1000.0 + n / 100 AS b FROM range(20) t(n)), range(6) u(r)")  # keys that outweigh a difference of cents
    con.execute(f"COPY supplier TO '{path}' (FORMAT parquet)")
    df, want = QUERIES["nearest_rows"](spark, str(tmp_path)), con.execute(SQL["nearest_rows"])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in want.description], want.fetchall())
