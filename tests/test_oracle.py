"""Every registered query against its SQL twin on the smallest test data."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import TABLES, rows

SF = "/root/testdata/sf0.001"
ONE_ROW_A_DOCUMENT = {"op1", "op2", "op3", "op5", "op7", "op8", "op10", "op12"}
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test data not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, duck, name):
    got = queries()[name](spark, SF).toArrow()
    sql = oracle_sql().get(name)
    if sql is None:  # tested against plain versions elsewhere
        assert len(set(got.column_names)) == len(got.column_names) and got.num_rows > 0
        if name.split("_")[0] in ONE_ROW_A_DOCUMENT:
            assert got.num_rows == duck.execute("SELECT count(*) FROM documents").fetchone()[0]
            assert sorted(got["doc_id"].to_pylist()) == [r[0] for r in duck.execute("SELECT doc_id FROM documents ORDER BY 1").fetchall()]
        return
    want = duck.execute(sql).to_arrow_table()
    assert rows(got) == rows(want)


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_runs(spark):
    df = entry(spark)
    assert df.count() > 0 and "rd_pct_vs_country" in df.columns


def test_headline_queries_are_registered():
    from bench import HEADLINE

    assert set(HEADLINE) <= set(queries())
