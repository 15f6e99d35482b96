"""The stage store: what may run again, what runs once, and hashes that tell a change."""

import pytest
from pyspark.sql import functions as F

from countwatch.sources.stage_store import DEVELOPMENT, LOCKED, Refused, StageStore, content_hash

SCHEMA = (
    "product_code string, model string, origin string, target string, horizon long, issue_date string, period string,"
    "point double, lower50 double, upper50 double, lower80 double, upper80 double, calibration_n long"
)


@pytest.fixture
def rows(spark):
    out = [
        (c, "baseline_a", f"{1999 + m // 12}-{m % 12 + 1:02d}", "t", h, "d", "p", 10.0 + m + h / 3, None if m < 2 else 9.5, 11.0, 8.0, 12.0, m)
        for c in ("A", "B") for m in range(20) for h in (1, 3)
    ]
    return spark.createDataFrame(out, SCHEMA)


@pytest.fixture
def store(spark, tmp_path):
    return StageStore(spark, str(tmp_path / "store"), "2000-01")


def decisions(spark, *codes):
    return spark.createDataFrame([(c, "baseline_a") for c in codes], "product_code string, model_in_use string")


def test_order_of_stages(spark, store, rows):
    store.develop("v1", rows)
    with pytest.raises(Refused, match="no decision"):
        store.lock("v1", rows)
    store.decide(decisions(spark, "A", "B"))
    with pytest.raises(Refused, match="not revisited"):
        store.decide(decisions(spark, "A"))
    assert store.decisions().count() == 2
    store.lock("v1", rows)
    before = store.locked_versions().collect()
    with pytest.raises(Refused, match="runs once"):
        store.lock("v1", rows.where("horizon = 1"))
    with pytest.raises(Refused, match="runs once"):
        store.lock("v2", rows)
    assert store.locked_versions().collect() == before


def test_a_code_without_a_decision(spark, store, rows):
    store.decide(decisions(spark, "A"))
    with pytest.raises(Refused, match="no decision"):
        store.lock("v1", rows)


def test_development_replaces_only_itself(spark, store, rows):
    store.develop("v1", rows)
    store.decide(decisions(spark, "A", "B"))
    store.lock("v1", rows)
    store.develop("v2", rows)
    store.develop("v1", rows.where("horizon = 1"))
    got = {(r.version, r.stage): r["count"] for r in store.rows().groupBy("version", "stage").count().collect()}
    assert got == {("v1", DEVELOPMENT): 24, ("v2", DEVELOPMENT): 48, ("v1", LOCKED): 32}


def test_a_run_that_died_before_its_commit_runs_again(spark, store, rows):
    store.decide(decisions(spark, "A", "B"))
    store._write("v1", LOCKED, rows.where("origin >= '2000-01' and horizon = 3"))  # died here
    store.lock("v1", rows)
    assert store.rows(LOCKED).count() == 32 and store.same_as_committed().isEmpty()


def test_a_commit_that_died_is_written_again(spark, store, rows, tmp_path):
    (tmp_path / "store" / "decision").mkdir(parents=True)
    assert store.decisions() is None
    store.decide(decisions(spark, "A", "B"))
    assert store.decisions().count() == 2


def test_a_changed_row_shows_two_hashes(spark, store, rows):
    store.decide(decisions(spark, "A", "B"))
    store.lock("v1", rows)
    store.republish("v2", "v1")
    assert store.locked_versions().select("content_hash").distinct().count() == 1
    one = (F.col("product_code") == "A") & (F.col("origin") == "2000-03") & (F.col("horizon") == 1)
    store.republish("v3", "v2", {"upper80": F.when(one, F.col("upper80") + 2e-6).otherwise(F.col("upper80"))})
    assert store.locked_versions().select("content_hash").distinct().count() == 2
    assert [r.version for r in store.same_as_committed().collect()] == ["v3"]


def test_hash_counts_repeats_and_ignores_order(spark, rows):
    one = rows.withColumn("version", F.lit("x"))
    h = lambda df: content_hash(df, "version").first()
    assert h(one) == h(one.orderBy(F.desc("point")).repartition(5))
    assert h(one) != h(one.unionByName(one.limit(1))) and h(one.withColumn("lower50", F.lit(None).cast("double"))) != h(one)
