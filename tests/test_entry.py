"""The registered queries against their SQL, on the smallest tables."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["mdd", "wasserstein", "column_fidelity_bars", "column_entropy", "kl_privacy", "attribute_disclosure", "column_utility", "pad_length", "uniqueness", "static_series_join", "column_fidelity_shared", "series_overlay", "series_overlay_shared", "union_scaled_matrix", "performance_summary", "legacy_diversity", "legacy_privacy", "column_table", "business_figures", "tree_conditional", "tree_unconditional", "tree_summary", "tree_variants", "tree_missing_series", "newest_results"]
TABLES = ("customer", "orders", "lineitem", "events", "embeddings")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sql, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = sql.execute(entry.oracle_sql()[name]).df()
    names = sorted(want.columns)
    assert sorted(got.columns) == names and len(got) == len(want)
    frames = [x[names].round(6).sort_values(names).reset_index(drop=True) for x in (got, want)]
    for c in names:
        if "f" in (frames[0][c].dtype.kind, frames[1][c].dtype.kind):
            assert np.allclose(frames[0][c].astype(float), frames[1][c].astype(float), atol=1e-5, equal_nan=True), c
        else:
            assert (frames[0][c].astype(str) == frames[1][c].astype(str)).all(), c


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 1
