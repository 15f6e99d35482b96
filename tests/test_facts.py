"""Published figures hold against their re-derivation, and every corrupted mart is told; the outlook's gate tells a dropped row."""

import pytest
from pyspark.sql import functions as F

from countwatch.operators import facts, forecast, marts
from countwatch.plans import facts as registry
from countwatch.plans.forecast_queries import LEAD
from countwatch.plans.second_path import SecondPath
from countwatch.plans.star_plan import StarPlan
from countwatch.sources import star

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def plan(spark):
    return StarPlan(spark, SF, code=star.BRANDS)


@pytest.fixture(scope="module")
def both(spark, plan):
    first = {k: df.cache() for k, df in registry.published(plan).items()}
    second = {k: df.cache() for k, df in registry.rederived(spark, SecondPath(spark, SF, plan.harness, star.BRANDS)).items()}
    return first, second


def broken(rows):
    return {(r.mart, r.figure) for r in rows.where("not holds").collect()}


def test_every_figure_holds(both):
    rows = registry.held(*both)
    assert {r.mart for r in rows.select("mart").distinct().collect()} == set(registry.REGISTRY)
    assert not broken(rows) and not both[0]["lanes"].where("ungated_episodes > 0").isEmpty()


CORRUPTIONS = [
    ("lanes", "flagged_list", lambda d: d.withColumn("flagged_list", F.regexp_replace("flagged_list", "2000-", "1999-"))),
    ("lanes", "ungated_episodes", lambda d: d.withColumn("ungated_episodes", F.col("ungated_episodes") + 1)),
    ("lanes", "rule_enabled", lambda d: d.withColumn("rule_enabled", ~F.col("rule_enabled"))),
    ("coverage_by_code", "inside", lambda d: d.withColumn("inside", F.col("inside") - 1)),
    ("headline_code", "product_code", lambda d: d.withColumn("product_code", F.lit("another"))),
    ("headline_code", "last_12_months", lambda d: d.limit(0)),
    ("queue", "episodes", lambda d: d.withColumn("episodes", F.col("episodes") + 1)),
    ("reports", "multi_code_reports", lambda d: d.withColumn("multi_code_reports", F.lit(0))),
    ("reports", "memberships", lambda d: d.union(d)),
]


@pytest.mark.parametrize(("mart", "figure", "corrupt"), CORRUPTIONS)
def test_a_corrupted_mart_is_told(both, mart, figure, corrupt):
    first, second = both
    found = broken(registry.held({**first, mart: corrupt(first[mart])}, second))
    assert (mart, figure) in found and {m for m, _ in found} == {mart}


def test_nulls_agree_only_with_nulls(spark):
    rows = spark.createDataFrame([("a", 1.0, None), ("b", None, "x")], "k string, n double, w string")
    again = spark.createDataFrame([("a", None, None), ("b", None, "x")], "k string, n double, w string")
    told = lambda d: facts.told("m", d, "k", ("n",), ("w",))
    assert {(r.key, r.figure) for r in facts.held(told(rows), told(again)).where("not holds").collect()} == {("a", "n")}
    assert facts.held(told(rows.limit(0)), told(again.limit(0))).isEmpty()


@pytest.fixture(scope="module")
def drawn(plan):
    h, promoted = plan.harness, plan.promotion
    own = promoted.select("product_code", F.col("model_in_use").alias("model"))
    at_lead = plan.forecast.filter((F.col("origin_mi") == h.end_mi) & (F.col("horizon") == LEAD)).join(own, ["product_code", "model"])
    parts = {
        "lead": marts.outlook_lead(plan.forecast, promoted, plan.cells, h, LEAD), "evidence": marts.outlook_evidence(plan.forecast, promoted, LEAD),
        "dots": forecast.dots(at_lead, h), "history": marts.outlook_history(plan.series, plan.forecast, promoted), "series": plan.series,
    }
    return {k: v.cache() for k, v in parts.items()}


def failing(drawn, harness, **changed):
    rows = marts.outlook_gate(**{**drawn, **changed}, harness=harness)
    return {(r.product_code, r.check) for r in rows.where("not passed").collect()}


def test_the_outlook_passes_its_gate(plan, drawn):
    codes = drawn["lead"].count()
    assert codes > 1 and marts.outlook_gate(**drawn, harness=plan.harness).count() == 7 * codes
    assert not failing(drawn, plan.harness)


def test_a_dropped_row_fails_the_gate(plan, drawn):
    one = drawn["evidence"].agg(F.min("product_code")).first()[0]
    gone = lambda part, where: {part: drawn[part].where(~((F.col("product_code") == one) & F.expr(where)))}
    checks = lambda found: {c for code, c in found if code == one}
    assert "evidence rows" in checks(failing(drawn, plan.harness, **gone("evidence", "target = '2000-05'")))
    assert {"evidence rows", "evidence inside", "evidence mean miss"} <= checks(failing(drawn, plan.harness, **gone("evidence", "true")))
    assert checks(failing(drawn, plan.harness, **gone("dots", "dot = 7"))) == {"dots"}
    assert "months" in checks(failing(drawn, plan.harness, **gone("history", "month = '1998-02'")))
    whole = failing(drawn, plan.harness, **gone("lead", "true"))
    assert {"evidence rows", "errors behind the dots"} <= checks(whole) and {c for c, _ in whole} == {one}
    moved = drawn["evidence"].withColumn("miss", F.col("miss") + 0.01)
    assert {c for _, c in failing(drawn, plan.harness, evidence=moved)} == {"evidence mean miss"}
