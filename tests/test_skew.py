"""One report holds a third of all lines: results stay whole and equal to brute force."""

import shutil

import duckdb
import pytest

from countwatch.operators import live
from countwatch.plans.registry import ORACLES, QUERIES
from oracle import TABLES, connect, difference


@pytest.fixture(scope="module")
def hot_dir(tmp_path_factory, sf_small):
    out = str(tmp_path_factory.mktemp("hot"))
    for t in TABLES:
        if t != "lineitem":
            shutil.copy(f"{sf_small}/{t}.parquet", f"{out}/{t}.parquet")
    duckdb.sql(
        f"""COPY (SELECT * REPLACE (CASE WHEN l_partkey % 3 = 0 THEN 7 ELSE l_orderkey END AS l_orderkey)
            FROM read_parquet('{sf_small}/lineitem.parquet')) TO '{out}/lineitem.parquet' (FORMAT parquet)"""
    )
    return out


@pytest.mark.parametrize(
    "name", ["m01_monthly_count", "record_first_seen", "exclusion_receipt", "recall_timeline", "record_facts", "quarantine", "capacity_windows"]
)
def test_hot_report(spark, hot_dir, name):
    assert difference(QUERIES[name](spark, hot_dir), connect(hot_dir), ORACLES[name]) is None


def test_every_revised_month_is_a_row(spark):
    rows = spark.range(1000).selectExpr("'A' product_code", "cast(id as int) + 24000 mi", "100L frozen", "1L live", "cast(null as bigint) listed_frozen", "'material' verdict")
    assert live.variance_summary(rows).first().material_downward == 1000 == live.revised_months(rows).count()
