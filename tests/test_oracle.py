"""Every query with SQL against DuckDB on the smallest tables, as the driver does on larger ones."""

import os

import duckdb
import pytest

from pagelattice.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, db, name):
    got = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    if name not in catalogue.ORACLE:
        assert len(got)
        return
    want = db.sql(catalogue.ORACLE[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (want, got))
    assert len(a) and a.equals(b)


def test_equal_totals(spark, tmp_path):
    """Two readings of a box whose totals are equal but for the last bits: the confidence decides, not the rounding of the sums."""
    path = f"{tmp_path}/orders.parquet"
    duckdb.sql(f"copy (select * from (values (1400655, 1, 'P', '2-HIGH'), (1437940, 1, 'O', '3-MEDIUM'), (2566030, 2, 'F', '2-HIGH'), (2699830, 2, 'O', '2-HIGH')) t(o_orderkey, o_custkey, o_orderstatus, o_orderpriority)) to '{path}' (format parquet)")
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{path}'")
    rows = catalogue.QUERIES["best_ocr_candidate"](spark, str(tmp_path)).orderBy("box").collect()
    assert [tuple(r) for r in rows] == con.sql(f"select * from ({catalogue.ORACLE['best_ocr_candidate']}) order by box").fetchall()
    assert [r["cand_seq"] for r in rows] == [1400655, 2566030]
