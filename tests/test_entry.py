"""The contract with the driver, and a sample of queries against DuckDB on the small tables.

All queries are compared when DOSSIERLAKE_ALL_ORACLES=1.
"""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from dossierlake.plans.adapters import TABLES

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "facility_pattern", "page_merge", "file_conflicts", "gap_analysis", "or_search", "area_blocks", "eval_summary", "word_search", "index_refresh",
    "run_difference", "duplicate_classes", "validate_briefs", "feasibility_sites", "backfill_apply", "nested_pages", "cell_grid", "submission_vs_cohort",
]
NAMES = sorted(contract.oracle_sql()) if os.environ.get("DOSSIERLAKE_ALL_ORACLES") == "1" else SAMPLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    cursor = duck.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(columns, cursor.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
