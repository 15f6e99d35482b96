"""What a cluster asks for: workers that get the package, a shared folder, plans that stand a hot key."""

import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from countwatch import session
from countwatch.operators import ets, measures, recall, records
from countwatch.config import STAR
from countwatch.sources import star
from countwatch.plans.star_plan import StarPlan

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_workers_import_the_package_from_a_foreign_folder(tmp_path):
    code = f"""
        import sys; sys.path.insert(0, {ROOT!r})
        from countwatch.session import build_session
        from countwatch.operators import ets
        spark = build_session("foreign", "local[2]", **{{"spark.sql.shuffle.partitions": "2"}})
        rows = [("A", 24000 + i, 10 + i % 12) for i in range(30)]
        print("FITS", ets.fits(spark.createDataFrame(rows, "product_code string, mi int, y bigint")).count())
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "FITS 30" in out.stdout, out.stderr[-2000:]


class Context:
    """A stand-in for a context on a master that is no single machine."""

    master, applicationId = "spark://host:7077", "app"

    def getConf(self):
        return {}

    def getCheckpointDir(self):
        return None


class Conf:
    def get(self, key, default):
        return default


class Session:
    sparkContext, conf = Context(), Conf()


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session(), "x")


def test_staged_tables_lie_in_the_applications_own_folder(spark):
    path = session.shared_folder(spark, "x")
    assert spark.sparkContext.applicationId in path and path.startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    spark.range(3).write.parquet(path)
    session.remove(spark, path)
    assert not os.path.exists(path.removeprefix("file://"))


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_rolled_up_before_they_meet_orders(spark, sf_small, no_broadcast):
    """Below every join with ``orders`` there is an aggregate of the lines, so a hot order is one row."""
    for df in (recall.timeline(star.recall_records(spark, sf_small), star.enforcement(spark, sf_small), None, "1995-01-01", "2001-07-31", star.recall_dates(spark, sf_small)), star.daily_series(spark, sf_small), star.page_records(spark, sf_small, records.first_copies)):
        lines = plan(df).split("\n")
        scan = next(i for i, x in enumerate(lines) if "l_orderkey" in x and "FileScan" in x)
        depth = len(lines[scan]) - len(lines[scan].lstrip(" :+-*()0123456789"))
        above = [x for x in lines[:scan] if len(x) - len(x.lstrip(" :+-*()0123456789")) < depth]
        joins = [i for i, x in enumerate(above) if "Join" in x and ("l_orderkey" in x or "event_number" in x or "mdr_report_key" in x)]
        sums = [i for i, x in enumerate(above) if "Aggregate" in x and "Final" not in x]
        assert joins and sums and max(joins) < max(sums)


def test_daily_series_shuffles_lines_once_by_order(spark, sf_small, no_broadcast):
    text = plan(star.daily_series(spark, sf_small))
    assert text.count("hashpartitioning(l_orderkey") == 1 and "l_orderkey#" in text


def test_first_copies_equal_first_seen(spark, sf_small):
    wide = records.first_seen(star.page_records(spark, sf_small))
    narrow = star.page_records(spark, sf_small, records.first_copies).drop("position")
    columns = sorted(wide.columns)
    assert sorted(narrow.columns) == columns
    assert wide.select(columns).exceptAll(narrow.select(columns)).isEmpty() and wide.count() == narrow.count()


def test_off_grid_counts_are_told(spark):
    counts = spark.createDataFrame([("A", 24000, 1), ("B", 23945, 2), ("A", 1, 3), ("A", None, 4)], "product_code string, mi int, n int")
    codes = spark.createDataFrame([("A",)], "product_code string")
    got = {(r.product_code, r.n): r.reason for r in measures.off_grid(codes, counts, STAR).collect()}
    assert got == {("B", 2): "code not listed", ("A", 3): "month outside the window", ("A", 4): "no month"}


def test_a_missing_month_is_a_failed_fit_not_a_shift(spark):
    values = {24000 + i: 20 + (i * 5) % 12 + i for i in range(60)}
    rows = [("A", mi, y) for mi, y in values.items() if mi != 24040] + [("B", mi, y) for mi, y in values.items()]
    got = {(r.product_code, r.origin_mi): r for r in ets.fits(spark.createDataFrame(rows, "product_code string, mi int, y bigint")).collect()}
    assert len(got) == 2 * 60
    for mi in values:
        a, b = got["A", mi], got["B", mi]
        if mi < 24040:
            assert (a.fit_error, a.level, a.n_obs) == (b.fit_error, b.level, b.n_obs)
        else:
            assert (a.fit_error, a.level, a.n_obs) == ("missing month", None, 40)


def test_brands_reach_the_rules(spark):
    """The brand queries meet what the part types do not: queue, gated and ungated episodes, a promoted candidate."""
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        p = StarPlan(spark, sf, code=star.BRANDS)
        assert p.queue.count() > 0
        assert p.promotion.filter("model_in_use = 'candidate'").count() > 0
        totals = recall.pre_registered_count(p.class_one_months, p.queue, p.evaluated_span, STAR).first()
        assert all(v > 0 for v in totals)


def test_pairs_that_come_twice_fail_the_bridge_gate(spark):
    from countwatch.operators import gates

    report = spark.createDataFrame([(1, ["A", "A"]), (2, ["B"])], "report_key long, codes array<string>")
    bridge = report.select("report_key", F.explode("codes").alias("product_code"))
    rows = {r.check: r.passed for r in gates.bridge_gate(bridge, report).collect()}
    assert rows["bridge pairs are unique"] is False
