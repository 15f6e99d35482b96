"""The second path agrees with the first, and tells every corrupted copy; SQL functions are expressions, not Python."""

import re

import pytest
from pyspark.sql import functions as F

from countwatch.functions import intervals, sql_functions, text
from countwatch.plans import second_path as sp
from countwatch.plans.star_plan import StarPlan
from countwatch.sources import star


@pytest.fixture(scope="module")
def both(spark):
    p = StarPlan(spark, "/root/testdata/sf0.01", code=star.BRANDS)
    first = {k: df.cache() for k, df in sp.published(p).items()}
    return first, sp.SecondPath(spark, "/root/testdata/sf0.01", p.harness, star.BRANDS)


def wrong(rows):
    return {(r.measure, r.column) for r in rows.collect() if r.differing or r.one_sided}


def test_clean_tables_agree(both):
    rows = sp.compared(*both).collect()
    assert {r.measure for r in rows} == {"M-01", "M-02", "M-03", "M-04", "M-05"} and all(r.cells > 0 for r in rows)
    assert not [r for r in rows if r.differing or r.one_sided]


def bump(column, by, where):
    return lambda d: d.withColumn(column, F.when(F.expr(where), F.col(column) + by).otherwise(F.col(column)))


CORRUPTIONS = [
    ("M-01", "excluded_reports", bump("excluded_reports", 1, "mi % 17 = 0")),
    ("M-01", "raw_reports", lambda d: d.filter("mi <> 24000")),
    ("M-02", "within_6", bump("within_6", 1, "event_month = '1999-05'")),
    ("M-03", "point", bump("point", 0.01, "model = 'baseline_b' and horizon = 3")),
    ("M-03", "lower80", bump("lower80", 0.2, "period = 'locked'")),
    ("M-03", "calibration_n", bump("calibration_n", -1, "calibration_n = 36")),
    ("M-04", "wis", bump("wis", 0.01, "model = 'candidate'")),
    ("M-05", "months_in_episode", lambda d: d.limit(0)),
    ("M-05", "max_excess_over_point", bump("max_excess_over_point", 0.5, "true")),
]


@pytest.mark.parametrize(("measure", "column", "corrupt"), CORRUPTIONS)
def test_corrupted_copies_are_told(both, measure, column, corrupt):
    first, second = both
    found = wrong(sp.compared({**first, measure: corrupt(first[measure])}, second))
    assert (measure, column) in found and {m for m, _ in found} == {measure}


def test_functions_equal_the_columns_and_run_no_python(spark, sf_small):
    names = sql_functions.register(spark, star.STAR_TOKENS)
    assert len(names) == len(set(names)) == 10
    part = star.table(spark, sf_small, "part")
    got = part.select(F.expr("cw_brand_token(p_name)").alias("a"), text.brand_token("p_name", star.STAR_TOKENS).alias("b"))
    assert got.where("NOT a <=> b").isEmpty() and not got.where("a is not null").isEmpty()
    firm = star.table(spark, sf_small, "supplier").select(F.expr("cw_firm_token(s_name)").alias("a"), text.firm_token("s_name", star.STAR_TOKENS).alias("b"))
    assert firm.where("NOT a <=> b").isEmpty() and not firm.where("a is not null").isEmpty()
    y, m, a, b, c, d = (F.lit(float(v)) for v in (7, 5, 4, 6, 1, 6.5))
    row = spark.range(1).select(F.expr("cw_wis(7D, 5D, 4D, 6D, 1D, 6.5D)").alias("s"), intervals.weighted_interval_score(y, m, a, b, c, d).alias("c")).first()
    assert row.s == pytest.approx(row.c)
    assert not re.search("Python|Pandas|Arrow", sp.sql_functions_check(spark, sf_small)._jdf.queryExecution().toString())


def test_a_quote_cannot_leave_its_literal(spark):
    with pytest.raises(ValueError, match="quote"):
        sql_functions.definitions(text.TokenLists(("o'brien",), ("x",), ("y",)))
