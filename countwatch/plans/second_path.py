"""A second path for M-01 to M-05, written in Spark SQL over the source tables alone (M13, O).

Nothing of the first path's operators is used except the smoothing filter itself: members come from lines without the record
tables, baselines from equi-joins instead of frames, calibration errors from a range join cut to the newest 36 instead of
array frames, quantiles from ``percentile``, scores from plain averages, and episodes from the difference of two row
numbers. Scalar rules are the SQL functions of ``sql_functions``. ``compared`` holds both sides together, cell by cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countwatch.config import Harness, mi_of
from countwatch.functions import sql_functions
from countwatch.operators import compare, ets, measures, scoring
from countwatch.plans.star_plan import StarPlan
from countwatch.session import stage
from countwatch.sources import star

TOLERANCE, RANGE_TOLERANCE = 1e-4, 1e-3
FORECAST_KEYS = ("product_code", "model", "origin_mi", "target_mi", "horizon")
BOUNDS = ("lower50", "upper50", "lower80", "upper80")
CELL_KEYS = ("product_code", "model", "horizon", "period")
CELL_VALUES = ("n", "mae", "coverage50", "coverage80", "width50", "width80", "wis")
QUEUE_KEYS = ("product_code", "model_in_use", "episode_start", "episode_end", "status")

MEMBERS = """
WITH part_codes AS (SELECT p_partkey, {code} AS code, cw_brand_token(p_name) IS NOT NULL AS hit FROM {{part}}),
firms AS (SELECT s_suppkey, cw_firm_token(s_name) IS NOT NULL AS hit FROM {{supplier}}),
lines AS (
  SELECT l_orderkey AS k, code, l_shipdate AS ship, p.hit OR f.hit AS hit
  FROM {{lineitem}} JOIN part_codes p ON p_partkey = l_partkey JOIN firms f ON s_suppkey = l_suppkey),
pairs AS (SELECT k, code FROM lines GROUP BY k, code),
reports AS (SELECT k, min(ship) AS event, bool_or(hit) AS excluded FROM lines GROUP BY k)
SELECT k, code AS product_code, cw_month(o_orderdate) AS receipt_mi, cw_month(event) AS event_mi, excluded
FROM pairs JOIN reports USING (k) JOIN {{orders}} ON o_orderkey = k
WHERE date_format(o_orderdate, 'yyyyMMdd') BETWEEN '{start}' AND '{end}'
"""

MONTHLY = """
SELECT product_code, receipt_mi AS mi, count(*) AS raw_reports, count(CASE WHEN excluded THEN 1 END) AS excluded_reports,
  count(CASE WHEN NOT excluded THEN 1 END) AS eligible_reports
FROM {members} GROUP BY product_code, receipt_mi
"""

LAGS = """
SELECT product_code, cw_month_label(event_mi) AS event_month, count(*) AS reports_with_event_month,
  sum(if(receipt_mi - event_mi BETWEEN 0 AND 3, 1, 0)) AS within_3, sum(if(receipt_mi - event_mi BETWEEN 0 AND 6, 1, 0)) AS within_6,
  sum(if(receipt_mi - event_mi BETWEEN 0 AND 12, 1, 0)) AS within_12, sum(if(receipt_mi < event_mi, 1, 0)) AS negative_lag
FROM {{members}} WHERE NOT excluded AND event_mi BETWEEN {first} AND {last} GROUP BY product_code, event_mi
"""

SERIES = """
WITH grid AS (SELECT product_code, explode(sequence({first}, {last})) AS mi FROM (SELECT DISTINCT {code} AS product_code FROM {{part}})),
dense AS (SELECT g.product_code, g.mi, coalesce(raw_reports, 0) AS raw, coalesce(eligible_reports, 0) AS y FROM grid g LEFT JOIN {{monthly}} m ON m.product_code = g.product_code AND m.mi = g.mi),
passed AS (
  SELECT product_code FROM dense WHERE mi <= {train} GROUP BY product_code
  HAVING count(CASE WHEN raw > 0 THEN 1 END) >= {months} AND sum(y) >= {reports})
SELECT d.product_code, d.mi, d.y FROM dense d JOIN passed USING (product_code)
"""

STATES = """
WITH chosen AS (
  SELECT product_code, origin_mi, min_by(struct(level, trend, phi, season), struct(sse, pid)) AS s FROM {paths} GROUP BY product_code, origin_mi),
varied AS (
  SELECT product_code, mi, min(y) OVER w < max(y) OVER w AS varies FROM {series}
  WINDOW w AS (PARTITION BY product_code ORDER BY mi ROWS UNBOUNDED PRECEDING))
SELECT c.product_code, origin_mi, s.* FROM chosen c JOIN varied v ON v.product_code = c.product_code AND v.mi = origin_mi WHERE varies
"""

POINTS = """
WITH origins AS (SELECT product_code, mi AS o, h FROM {{series}} LATERAL VIEW explode(array({horizons})) AS h),
points AS (
  SELECT o.product_code, 'baseline_a' AS model, o, h, cw_baseline_a(a.y, b.y, c.y) AS point FROM origins o
    LEFT JOIN {{series}} a ON a.product_code = o.product_code AND a.mi = o
    LEFT JOIN {{series}} b ON b.product_code = o.product_code AND b.mi = o - 1
    LEFT JOIN {{series}} c ON c.product_code = o.product_code AND c.mi = o - 2
  UNION ALL
  SELECT o.product_code, 'baseline_b', o, h, CAST(a.y AS DOUBLE) FROM origins o LEFT JOIN {{series}} a ON a.product_code = o.product_code AND a.mi = o + h - 12
  UNION ALL
  SELECT o.product_code, 'candidate', o, h, cw_ets_point(level, trend, phi, season, h) FROM origins o
    LEFT JOIN {{states}} s ON s.product_code = o.product_code AND s.origin_mi = o)
SELECT p.*, o + h AS target, CAST(y.y AS DOUBLE) AS actual FROM points p LEFT JOIN {{series}} y ON y.product_code = p.product_code AND y.mi = o + h
WHERE o BETWEEN {first} AND {last}
"""

FORECAST = """
WITH errors AS (SELECT product_code, model, h, target, actual - point AS e FROM {{points}} WHERE actual IS NOT NULL AND point IS NOT NULL),
known AS (
  SELECT t.product_code, t.model, t.h, t.o, e, row_number() OVER (PARTITION BY t.product_code, t.model, t.h, t.o ORDER BY e.target DESC) AS newest
  FROM {{points}} t JOIN errors e ON e.product_code = t.product_code AND e.model = t.model AND e.h = t.h AND e.target <= t.o),
ranges AS (
  SELECT product_code, model, h, o, count(*) AS n, percentile(e, array({levels})) AS q FROM known WHERE newest <= {window} GROUP BY product_code, model, h, o),
ranged AS (SELECT *, point IS NOT NULL AND n >= {least} AS enough FROM {{points}} LEFT JOIN ranges USING (product_code, model, h, o))
SELECT product_code, model, o AS origin_mi, target AS target_mi, h AS horizon, point, actual, coalesce(n, 0) AS calibration_n,
  if(enough, round(greatest(0, point + q[0]), 6), NULL) AS lower50, if(enough, round(greatest(0, point + q[1]), 6), NULL) AS upper50,
  if(enough, round(greatest(0, point + q[2]), 6), NULL) AS lower80, if(enough, round(greatest(0, point + q[3]), 6), NULL) AS upper80,
  CASE WHEN target > {last} THEN 'outlook'
       WHEN target >= {recent} THEN if(o >= {recent_origin}, 'recent', 'unscored')
       WHEN target >= {locked} THEN if(o >= {locked_origin}, 'locked', 'unscored')
       WHEN target >= {development} THEN 'development' WHEN target >= {warmup} THEN 'warmup' ELSE 'unscored' END AS period
FROM ranged
"""

SCORED = """
SELECT product_code, model, horizon, period, target_mi, actual, round(point, 6) AS point, upper80,
  abs(actual - round(point, 6)) AS ae, actual >= lower50 AND actual <= upper50 AS in50, actual >= lower80 AND actual <= upper80 AS in80,
  upper50 - lower50 AS w50, upper80 - lower80 AS w80, cw_wis(actual, round(point, 6), lower50, upper50, lower80, upper80) AS wis
FROM {forecast} WHERE period IN ('development', 'locked', 'recent') AND point IS NOT NULL AND lower80 IS NOT NULL AND actual IS NOT NULL
"""

CELLS = """
SELECT product_code, model, horizon, period, count(*) AS n, round(avg(ae), 6) AS mae, round(avg(int(in50)), 6) AS coverage50, round(avg(int(in80)), 6) AS coverage80,
  round(avg(w50), 6) AS width50, round(avg(w80), 6) AS width80, round(avg(wis), 6) AS wis
FROM {scored} GROUP BY product_code, model, horizon, period
"""

EVALUATED = """
WITH dev AS (
  SELECT product_code, first(mae) FILTER (WHERE model = 'baseline_a') AS ma, first(mae) FILTER (WHERE model = 'baseline_b') AS mb,
    first(mae) FILTER (WHERE model = 'candidate') AS mc, first(wis) FILTER (WHERE model = 'baseline_a') AS wa,
    first(wis) FILTER (WHERE model = 'baseline_b') AS wb, first(wis) FILTER (WHERE model = 'candidate') AS wc
  FROM {{cells}} WHERE period = 'development' AND horizon = 1 GROUP BY product_code),
used AS (
  SELECT product_code, CASE WHEN ma IS NULL OR mb IS NULL OR mc IS NULL THEN 'baseline_a'
    WHEN mc <= {improvement} * least(ma, mb) AND wc <= if(ma <= mb, wa, wb) THEN 'candidate' WHEN ma <= mb THEN 'baseline_a' ELSE 'baseline_b' END AS model FROM dev)
SELECT s.*, actual > upper80 AND actual - point >= {excess} AS flagged FROM {{scored}} s JOIN used u ON u.product_code = s.product_code AND u.model = s.model
WHERE horizon = 1 AND period IN ('locked', 'recent')
"""

EPISODES = """
WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY product_code ORDER BY target_mi) AS place FROM {{evaluated}}),
islands AS (
  SELECT *, place - row_number() OVER (PARTITION BY product_code ORDER BY target_mi) AS island FROM numbered WHERE flagged)
SELECT product_code, min(target_mi) AS s, max(target_mi) AS e, count(*) AS n, max(actual - point) AS over FROM islands GROUP BY product_code, island HAVING count(*) >= {run}
"""

CODES = """
SELECT product_code, model, max(target_mi) AS last, count(*) AS months, count(CASE WHEN flagged THEN 1 END) AS flagged,
  count(CASE WHEN period = 'locked' THEN 1 END) AS locked, count(CASE WHEN period = 'locked' AND in80 THEN 1 END) AS inside,
  coalesce(round(avg(int(in80)) FILTER (WHERE period = 'locked'), 6) >= {floor}, false) AS enabled
FROM {{evaluated}} GROUP BY product_code, model
"""

QUEUE = """
SELECT e.product_code, model AS model_in_use, cw_month_label(s) AS episode_start, cw_month_label(e) AS episode_end,
  if(e < last, 'closed', 'open at the freeze') AS status, n AS months_in_episode, round(over, 1) AS max_excess_over_point
FROM {episodes} e JOIN {codes} c ON c.product_code = e.product_code WHERE enabled
"""


class SecondPath:
    """The five measures' tables, each staged once where the next reads it."""

    def __init__(self, spark: SparkSession, sf_dir: str, harness: Harness, code: str = star.CODE):
        h = self.harness = harness
        sql_functions.register(spark, star.STAR_TOKENS)
        tables = {t: star.table(spark, sf_dir, t) for t in ("lineitem", "orders", "part", "supplier")}
        self.members = stage(spark.sql(MEMBERS.format(code=code, start=h.window_start, end=h.as_of), **tables), "second-members")
        self.monthly = stage(spark.sql(MONTHLY, members=self.members), "second-monthly")
        self.lags = spark.sql(LAGS.format(first=h.start_mi, last=h.end_mi), members=self.members)
        series = SERIES.format(
            code=code, first=h.start_mi, last=h.end_mi, train=mi_of(h.train_end), months=h.min_complete_months, reports=h.min_eligible_training
        )
        self.series = stage(spark.sql(series, part=tables["part"], monthly=self.monthly), "second-series")
        self.states = spark.sql(STATES, paths=ets.filter_paths(self.series), series=self.series)
        points = POINTS.format(horizons=", ".join(map(str, h.horizons)), first=mi_of(h.first_origin), last=h.end_mi)
        self.points = stage(spark.sql(points, series=self.series, states=self.states), "second-points")
        told = FORECAST.format(
            levels=", ".join(map(str, h.levels)), window=h.calibration_window, least=h.min_calibration, last=h.end_mi,
            recent=mi_of(h.recent[0]), recent_origin=mi_of(h.recent_min_origin), locked=mi_of(h.locked[0]), locked_origin=mi_of(h.locked_min_origin),
            development=mi_of(h.development[0]), warmup=mi_of(h.warmup[0]),
        )
        self.forecast = stage(spark.sql(told, points=self.points), "second-forecast")
        self.scored = spark.sql(SCORED, forecast=self.forecast)
        self.cells = stage(spark.sql(CELLS, scored=self.scored), "second-cells")
        self.evaluated = stage(spark.sql(EVALUATED.format(improvement=h.improvement, excess=h.min_excess), cells=self.cells, scored=self.scored), "second-evaluated")
        self.episodes = spark.sql(EPISODES.format(run=h.min_run), evaluated=self.evaluated)
        self.codes = spark.sql(CODES.format(floor=h.coverage_floor), evaluated=self.evaluated)
        self.queue = spark.sql(QUEUE, episodes=self.episodes, codes=self.codes)


def published(p: StarPlan) -> dict[str, DataFrame]:
    """The first path's tables by measure."""
    return {
        "M-01": measures.monthly_counts(p.members), "M-02": measures.lag_matched(p.eligible, p.harness), "M-03": p.forecast,
        "M-04": scoring.cells(p.scored), "M-05": p.queue,
    }


def compared(first: dict[str, DataFrame], second: SecondPath) -> DataFrame:
    """(measure, column, cells, differing, one_sided) over all five measures."""
    parts = [
        ("M-01", second.monthly, ("product_code", "mi"), ("raw_reports", "excluded_reports", "eligible_reports"), TOLERANCE),
        ("M-02", second.lags, ("product_code", "event_month"), ("reports_with_event_month", "within_3", "within_6", "within_12", "negative_lag"), TOLERANCE),
        ("M-03", second.forecast, FORECAST_KEYS, ("point", "calibration_n"), TOLERANCE),
        ("M-03", second.forecast, FORECAST_KEYS, BOUNDS, RANGE_TOLERANCE),
        ("M-04", second.cells, CELL_KEYS, CELL_VALUES, TOLERANCE),
        ("M-05", second.queue, QUEUE_KEYS, ("months_in_episode", "max_excess_over_point"), TOLERANCE),
    ]
    out = None
    for measure, derived, keys, values, tolerance in parts:
        one = compare.compare_cells(first[measure], derived, keys, values, tolerance).select(F.lit(measure).alias("measure"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def second_path(spark: SparkSession, sf_dir: str, code: str = star.CODE) -> DataFrame:
    p = StarPlan(spark, sf_dir, code=code)
    return compared(published(p), SecondPath(spark, sf_dir, p.harness, code))


def brand_second_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over 25 brands, whose queue has episodes and whose candidate is promoted."""
    return second_path(spark, sf_dir, star.BRANDS)


def sql_functions_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O: one query in Spark SQL with the functions: token hits by brand and month of the first order behind a line."""
    sql_functions.register(spark, star.STAR_TOKENS)
    tables = {t: star.table(spark, sf_dir, t) for t in ("lineitem", "orders", "part", "supplier")}
    return spark.sql(
        """
        SELECT cw_month_label(cw_month(o_orderdate)) AS month, count(cw_brand_token(p_name)) AS brand_lines, count(cw_firm_token(s_name)) AS firm_lines,
          round(sum(cw_wis(l_quantity, 25D, 20D, 30D, 10D, 40D)), 4) AS quantity_wis, round(avg(cw_baseline_a(l_quantity, 1D, 2D)), 6) AS quantity_mean
        FROM {lineitem} JOIN {part} ON p_partkey = l_partkey JOIN {supplier} ON s_suppkey = l_suppkey JOIN {orders} ON o_orderkey = l_orderkey
        GROUP BY cw_month(o_orderdate)
        """,
        **tables,
    )


QUERIES = {f.__name__: f for f in (second_path, brand_second_path, sql_functions_check)}
