"""The fact registry: every figure that a mart publishes, and the SQL that derives it again from the second path."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countwatch.operators import facts, marts, measures, review
from countwatch.plans.second_path import SecondPath
from countwatch.plans.star_plan import StarPlan
from countwatch.sources import star


@dataclass(frozen=True)
class Mart:
    """What a mart publishes under a key, and the text that tells the same columns from the second path's tables."""

    published: Callable[[StarPlan], DataFrame]
    derived: str
    key: str
    numbers: tuple[str, ...] = ()
    words: tuple[str, ...] = ()


def _queue_totals(p: StarPlan) -> DataFrame:
    """The queue's length as published, beside the rule run with and without its gate."""
    drawn = review.diagnostic(p.episodes, p.code_state).agg(
        F.coalesce(F.sum("ungated_episodes"), F.lit(0)).alias("ungated"), F.sum("evaluated_months").alias("months"),
        F.coalesce(F.sum(F.when(F.col("rule_enabled"), F.col("evaluated_months"))), F.lit(0)).alias("enabled_months"),
    )
    return p.queue.agg(F.count(F.lit(1)).alias("episodes")).crossJoin(drawn).withColumn("scope", F.lit("all"))  # one row each


REGISTRY = {
    "lanes": Mart(
        lambda p: marts.lanes(p.evaluated, p.episodes, p.code_state, p.class_one_months),
        """
        SELECT c.product_code, c.model AS model_in_use, enabled AS rule_enabled, flagged AS flagged_months, coalesce(f.listed, '') AS flagged_list,
          if(enabled, coalesce(e.n, 0), 0) AS gated_episodes, coalesce(e.n, 0) AS ungated_episodes, coalesce(e.listed, '') AS ungated_list
        FROM {codes} c
        LEFT JOIN (SELECT product_code, array_join(sort_array(collect_list(cw_month_label(target_mi))), ' ') AS listed FROM {evaluated} WHERE flagged GROUP BY product_code) f
          ON f.product_code = c.product_code
        LEFT JOIN (SELECT product_code, count(*) AS n, array_join(sort_array(collect_list(cw_month_label(s) || '..' || cw_month_label(e))), ' ') AS listed FROM {episodes} GROUP BY product_code) e
          ON e.product_code = c.product_code
        """,
        "product_code", ("flagged_months", "gated_episodes", "ungated_episodes"), ("model_in_use", "rule_enabled", "flagged_list", "ungated_list"),
    ),
    "coverage_by_code": Mart(
        lambda p: marts.coverage_by_code(p.cells, p.code_state, p.harness),
        """
        SELECT product_code, model AS model_in_use, enabled AS rule_enabled, locked AS n, inside, inside / locked AS coverage80, inside / locked BETWEEN {low} AND {high} AS in_band
        FROM {{codes}} WHERE locked > 0
        """,
        "product_code", ("n", "inside", "coverage80"), ("model_in_use", "rule_enabled", "in_band"),
    ),
    "headline_code": Mart(
        lambda p: marts.headline_code(p.series, p.code_state, p.harness).withColumn("scope", F.lit("all")),
        """
        WITH volume AS (SELECT product_code, sum(y) AS last_12_months FROM {{series}} WHERE mi > {last} - 12 GROUP BY product_code),
        ranked AS (
          SELECT v.product_code, c.model AS model_in_use, last_12_months,
            row_number() OVER (ORDER BY int(enabled) + int(enabled AND c.model = 'candidate') DESC, last_12_months DESC, v.product_code DESC) AS place
          FROM volume v JOIN {{codes}} c ON c.product_code = v.product_code)
        SELECT 'all' AS scope, product_code, model_in_use, last_12_months FROM ranked WHERE place = 1
        """,
        "scope", ("last_12_months",), ("product_code", "model_in_use"),
    ),
    "queue": Mart(
        _queue_totals,
        """
        SELECT 'all' AS scope, count(CASE WHEN enabled THEN e.product_code END) AS episodes, count(e.product_code) AS ungated, (SELECT sum(months) FROM {codes}) AS months,
          (SELECT coalesce(sum(months), 0) FROM {codes} WHERE enabled) AS enabled_months
        FROM {codes} c LEFT JOIN {episodes} e ON e.product_code = c.product_code
        """,
        "scope", ("episodes", "ungated", "months", "enabled_months"),
    ),
    "reports": Mart(
        lambda p: measures.distinct_totals(p.reports).withColumn("scope", F.lit("all")),
        """
        SELECT 'all' AS scope, count(*) AS distinct_raw, count(CASE WHEN NOT ex THEN 1 END) AS distinct_eligible, coalesce(sum(n), 0) AS memberships, count(CASE WHEN n > 1 THEN 1 END) AS multi_code_reports
        FROM (SELECT k, count(*) AS n, bool_or(excluded) AS ex FROM {members} GROUP BY k)
        """,
        "scope", ("distinct_raw", "distinct_eligible", "memberships", "multi_code_reports"),
    ),
}

TABLES = ("members", "series", "evaluated", "episodes", "codes")


def published(p: StarPlan) -> dict[str, DataFrame]:
    return {name: m.published(p) for name, m in REGISTRY.items()}


def rederived(spark: SparkSession, second: SecondPath) -> dict[str, DataFrame]:
    h = second.harness
    out = {}
    for name, m in REGISTRY.items():
        text = m.derived.format(low=h.coverage_band[0], high=h.coverage_band[1], last=h.end_mi) if "{{" in m.derived else m.derived
        used = {t: getattr(second, t) for t in TABLES if f"{{{t}}}" in text}
        out[name] = spark.sql(text, **used)
    return out


def held(first: dict[str, DataFrame], second: dict[str, DataFrame]) -> DataFrame:
    told = lambda side: reduce(DataFrame.unionByName, (facts.told(name, side[name], m.key, m.numbers, m.words) for name, m in REGISTRY.items()))
    return facts.held(told(first), told(second))


def published_facts(spark: SparkSession, sf_dir: str, code: str = star.CODE) -> DataFrame:
    """Each published figure beside the same figure derived again, and whether it holds."""
    p = StarPlan(spark, sf_dir, code=code)
    rows = held(published(p), rederived(spark, SecondPath(spark, sf_dir, p.harness, code)))
    return rows.select("mart", "key", "figure", F.round("published", 4).alias("number"), F.col("published_words").alias("words"), "holds")


def brand_published_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over 25 brands, whose lanes hold episodes."""
    return published_facts(spark, sf_dir, star.BRANDS)


QUERIES = {f.__name__: f for f in (published_facts, brand_published_facts)}
