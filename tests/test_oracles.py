"""Every query with an oracle gives DuckDB's rows on the small tables."""

import glob
import os

import duckdb
import pytest

from assay.plans import registry as plans

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([repr(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_oracle(spark, duck, name):
    got = plans.QUERIES[name](spark, SF_DIR)
    want = duck.sql(plans.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())


def test_entry_has_nine_pairs_or_fewer_valid(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert {"pair_id", "axis", "winner_id", "loser_id"} <= set(rows.columns)
    assert rows.count() > 0
