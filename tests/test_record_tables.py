"""The bucketed record tables: written once, joined and grouped by their key without a shuffle."""

import re

import pytest
from pyspark.sql import functions as F

from countwatch.plans import record_queries
from countwatch.plans.star_plan import StarPlan
from countwatch.sources import record_tables as rt
from countwatch.sources import star
from countwatch.sources.sinks import write_record_table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    """What each exchange deals by."""
    return re.findall(r"Exchange (\w+\([^)]*\)|\w+)", plan(df))


@pytest.fixture
def no_broadcast(spark):
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(key, "-1")
    yield
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.unset(key)


@pytest.mark.parametrize("name", ["m01_monthly_count", "m02_lag_matched", "distinct_totals", "lag_summary", "record_facts", "event_type_mix"])
def test_measures_do_not_shuffle_by_the_report(spark, sf_small, no_broadcast, name):
    df = record_queries.QUERIES[name](spark, sf_small)
    assert not [s for s in shuffles(df) if "report_key" in s or "orderkey" in s], plan(df)
    assert "lineitem" not in plan(df)


def test_join_and_grouping_by_the_key_read_buckets(spark, sf_small, no_broadcast):
    p = StarPlan(spark, sf_small)
    assert shuffles(p.members) == []
    assert shuffles(p.bridge.groupBy("report_key").count()) == []
    assert shuffles(p.reports.drop("codes").join(p.bridge.repartition(5), "report_key")) != []


def test_written_once_and_refreshed(spark, sf_small):
    first, again = StarPlan(spark, sf_small).reports, StarPlan(spark, sf_small + "/").reports
    assert sorted(first.inputFiles()) == sorted(again.inputFiles())
    assert StarPlan(spark, sf_small, code="upper(p_brand)").bridge.inputFiles() != StarPlan(spark, sf_small).bridge.inputFiles()
    rt.refresh(spark)
    anew = StarPlan(spark, sf_small).reports
    assert not set(anew.inputFiles()) & set(first.inputFiles())


def test_bridge_holds_every_pair_once(spark, sf_small):
    p = StarPlan(spark, sf_small)
    line = spark.read.parquet(f"{sf_small}/lineitem.parquet")
    part = spark.read.parquet(f"{sf_small}/part.parquet")
    pairs = line.join(part, line.l_partkey == part.p_partkey).select(F.col("l_orderkey").alias("report_key"), F.col("p_type").alias("product_code")).distinct()
    assert p.bridge.exceptAll(pairs).count() == pairs.exceptAll(p.bridge).count() == 0


def test_one_file_a_bucket(spark, tmp_path):
    df = spark.range(1000).selectExpr("id % 300 as report_key", "id as v").repartition(7)
    made = write_record_table(df, "bucket_files", "report_key", 8, str(tmp_path / "t"))
    assert len(made.inputFiles()) == 8 and made.count() == 1000
    spark.sql("DROP TABLE bucket_files")


@pytest.mark.parametrize(("size", "want"), [(0, 8), (8 << 28, 8), (9 << 28, 16), (100 << 40, 16_384), (100 << 30, 512)])
def test_buckets_follow_the_source(size, want):
    assert rt.buckets_for(size) == want


def test_buckets_follow_the_rows_not_the_packed_files(spark, tmp_path, monkeypatch):
    """A file of few bytes may hold many rows, and rows are what a task has to hold."""
    monkeypatch.setattr(rt, "BUCKET_BYTES", 1 << 18)
    path = str(tmp_path / "packed")
    spark.range(100_000).selectExpr("id % 10 as report_key", "'same' as text").repartition(1).write.parquet(path)
    source = spark.read.parquet(path)
    reports, bridge = rt.record_tables(spark, "packed", [source], lambda: source, lambda made: made.select("report_key"))
    described = lambda df: spark.sql(f"DESCRIBE EXTENDED {df}").where("col_name = 'Num Buckets'").first().data_type
    names = rt._held(spark).popitem()[1]
    assert [int(described(n)) for n in names] == [16, 16] and reports.count() == bridge.count() == 100_000
    assert len(bridge.inputFiles()) <= 16
    for n in names:
        spark.sql(f"DROP TABLE {n}")


@pytest.mark.parametrize("n_codes", [3, 63, 64, 130])
def test_codes_gathered_as_bits_equal_the_set(spark, tmp_path, n_codes):
    """Same reports by numbers as by a set per report, which is no longer built: null codes, repeats, more codes than a long has bits."""
    codes = [None if i % 7 == 3 else "" if i % 13 == 5 else f"C{i % n_codes:03d}" for i in range(400)]
    part = spark.createDataFrame([(i, c, "red anvil" if i % 50 == 0 else "x") for i, c in enumerate(codes)], "p_partkey long, p_type string, p_name string")
    line = spark.range(1200).selectExpr("id % 150 as l_orderkey", "if(id % 150 = 9, 3L, id % 410) as l_partkey", "id % 5 as l_suppkey", "if(id % 4 = 0, null, timestamp_ntz'1995-02-01' + make_dt_interval(cast(id as int))) as l_shipdate")
    supplier = spark.createDataFrame([(1, "Supplier#000000001"), (2, "Supplier#000000002")], "s_suppkey long, s_name string")
    for name, df in (("part", part), ("lineitem", line), ("supplier", supplier)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    listed = star.short_list(star.code_list(spark, str(tmp_path)))
    by_set = star.report_rollup(star.devices(spark, str(tmp_path)))
    by_bits = star.report_rollup(star.devices(spark, str(tmp_path), listed=listed), listed)
    assert by_bits.dtypes == by_set.dtypes and by_set.count() == 150
    assert by_bits.exceptAll(by_set).isEmpty() and by_set.exceptAll(by_bits).isEmpty()
    assert "ObjectHashAggregate" in plan(by_set) and "ObjectHashAggregate" not in plan(by_bits) and "SortAggregate" not in plan(by_bits)
    assert by_bits.where("report_key = 9").first().codes == []


def test_a_long_code_list_is_left_to_the_set(spark):
    codes = spark.range(star.WORD * star.WORDS + 1).selectExpr("cast(id as string) as product_code")
    assert star.short_list(codes) is None and len(star.short_list(codes.limit(252).unionByName(codes.limit(0)))) == 252


def test_no_pattern_runs_per_recalled_line(spark, sf_small, no_broadcast):
    """Code and name are read once per part: above the join to lines stands no regular expression."""
    text = plan(star.recall_records(spark, sf_small))
    above = text[: text.index("Join")]
    assert "regexp_replace" not in above and "RLIKE" not in above.upper(), above
    assert "regexp_replace" in text
