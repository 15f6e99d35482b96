"""Registered queries over forecasts, scores, the review queue, recalls and marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from countwatch.config import STAR
from countwatch.functions import months
from countwatch.operators import ets, ets_refine, forecast, gates, marts, measures, recall, review, scoring
from countwatch.plans.star_plan import StarPlan
from countwatch.session import shared_folder, stage
from countwatch.sources import star
from countwatch.sources.stage_store import DEVELOPMENT, LOCKED, Refused, StageStore


def baselines(spark, sf_dir):
    rows = forecast.baselines(StarPlan(spark, sf_dir).series, STAR.horizons)
    return rows.filter(F.col("point").isNotNull()).select(
        "product_code", months.label("origin_mi").alias("origin"), F.col("horizon").cast("long").alias("horizon"),
        "model", F.round("point", 6).alias("point"), F.col("actual").cast("long").alias("actual"),
    )


def ranges(spark, sf_dir):
    """The two baselines with their ranges; no fit needed."""
    return forecast.published(forecast.forecast(StarPlan(spark, sf_dir).series, STAR, with_candidate=False))


def _seasons():
    return [F.round(F.element_at("season", i), 6).alias(f"s{i}") for i in range(1, 13)]


def ets_filter(spark, sf_dir):
    six = lambda c: F.round(c, 6).alias(c)
    return ets.filter_paths(StarPlan(spark, sf_dir).series).select(
        "product_code", F.col("pid").cast("long").alias("pid"), months.label("origin_mi").alias("origin"),
        F.col("n_obs").cast("long").alias("n_obs"), six("level"), six("trend"), six("sse"), *_seasons(),
    )


def ets_fit(spark, sf_dir):
    six = lambda c: F.round(c, 6).alias(c)
    told = [F.round(c, 6).alias(name) for c, name in zip(ets_refine.likelihood(F.lit(ets_refine.K_FIXED)), ("log_likelihood", "aic"), strict=True)]
    return ets.fits(StarPlan(spark, sf_dir).series).select(
        "product_code", months.label("origin_mi").alias("origin"), "n_obs", "alpha", "beta", "gamma", "phi",
        six("level"), six("trend"), six("sse"), *_seasons(), *told, F.coalesce("fit_error", F.lit("")).alias("fit_error"),
    )


def ets_refined(spark, sf_dir):
    """The state table of the refined fit; no text, as its optimum is found by steps (``ets_refined_check`` has one)."""
    rows = ets_refine.refined(StarPlan(spark, sf_dir).series)
    six = lambda c: F.round(c, 6).alias(c)
    return rows.select(
        "product_code", months.label("origin_mi").alias("origin"), "n_obs", *[six(c) for c in ("alpha", "beta", "gamma", "phi", "level", "trend", "sse", "grid_sse")],
        *_seasons(), six("log_likelihood"), six("aic"), F.coalesce("export_mismatch", F.lit("")).alias("export_mismatch"), F.coalesce("fit_error", F.lit("")).alias("fit_error"),
    )


def ets_refined_check(spark, sf_dir):
    """Per code: origins with and without a refined fit, sums of squares above the grid's, mismatched exports, months without a likelihood."""
    rows = ets_refine.refined(StarPlan(spark, sf_dir).series)
    ok = F.col("fit_error").isNull()
    return rows.groupBy("product_code").agg(
        F.count_if(ok).alias("fitted"), F.count_if(~ok).alias("failed"), F.count_if(F.col("sse") > F.col("grid_sse")).alias("above_grid"),
        F.count_if(F.col("export_mismatch").isNotNull()).alias("mismatched"), F.count_if(ok & (F.col("sse") > 0) & F.col("aic").isNull()).alias("without_aic"),
    )


def ets_points(spark, sf_dir):
    rows = ets.points(ets.fits(StarPlan(spark, sf_dir).series), (1, 3, 6, 12))
    return rows.select(
        "product_code", months.label("origin_mi").alias("origin"), F.col("horizon").cast("long").alias("horizon"),
        F.round("point", 6).alias("point"),
    )


def forecast_table(spark, sf_dir):
    return forecast.published(StarPlan(spark, sf_dir).forecast_lazy())


def scored(spark, sf_dir):
    p = StarPlan(spark, sf_dir)
    return scoring.published(scoring.scored(p.forecast_lazy(), STAR))


def score_cells(spark, sf_dir):
    cells = scoring.scaled(StarPlan(spark, sf_dir).cells)
    return cells.withColumn("horizon", F.col("horizon").cast("long"))


def promotion(spark, sf_dir, code=star.CODE):
    return StarPlan(spark, sf_dir, code=code).promotion


def review_queue(spark, sf_dir, code=star.CODE):
    return StarPlan(spark, sf_dir, code=code).queue


def review_workload(spark, sf_dir):
    return StarPlan(spark, sf_dir).workload


def queue_diagnostic(spark, sf_dir, code=star.CODE):
    p = StarPlan(spark, sf_dir, code=code)
    return review.diagnostic(p.episodes, p.code_state)


# Bands stated before the figures were known.
BANDS = (
    ("evaluated_months", 12.0, 10000.0), ("flagged_months", 0.0, 1000.0), ("gated_episodes", 0.0, 12.0),
    ("ungated_episodes", 1.0, 40.0), ("chance_episodes", 0.0, 5.0),
)


def numbers_gate(spark, sf_dir):
    p = StarPlan(spark, sf_dir)
    bands = spark.createDataFrame(list(BANDS), "figure string, low double, high double")
    return gates.numbers_gate(marts.figures(review.diagnostic(p.episodes, p.code_state)), bands)


def headline_code(spark, sf_dir):
    p = StarPlan(spark, sf_dir)
    return marts.headline_code(p.series, p.code_state, STAR)


def outlook_dots(spark, sf_dir):
    p = StarPlan(spark, sf_dir)
    at_origin = p.forecast.filter(F.col("origin_mi") == STAR.end_mi)
    return forecast.dots(at_origin, STAR).select(
        "product_code", "model", months.label("origin_mi").alias("origin"), months.label("target_mi").alias("target"),
        F.col("horizon").cast("long").alias("horizon"), "dot", "value",
    )


def outlook(spark, sf_dir):
    p = StarPlan(spark, sf_dir)
    return marts.outlook(p.forecast, p.promotion, STAR.end_mi)


#: The horizon at which the outlook is drawn.
LEAD = max(STAR.horizons)


def outlook_history(spark, sf_dir):
    p = StarPlan(spark, sf_dir)
    return marts.outlook_history(p.series, p.forecast, p.promotion)


def outlook_evidence(spark, sf_dir):
    p = StarPlan(spark, sf_dir)
    return marts.outlook_evidence(p.forecast, p.promotion, LEAD)


def outlook_lead(spark, sf_dir):
    p = StarPlan(spark, sf_dir)
    return marts.outlook_lead(p.forecast, p.promotion, p.cells, STAR, LEAD)


def outlook_gate(spark, sf_dir):
    """The outlook's marts held against what is published."""
    p = StarPlan(spark, sf_dir)
    promoted = p.promotion
    lead = marts.outlook_lead(p.forecast, promoted, p.cells, STAR, LEAD)
    own = promoted.select("product_code", F.col("model_in_use").alias("model"))
    dotted = forecast.dots(p.forecast.filter((F.col("origin_mi") == STAR.end_mi) & (F.col("horizon") == LEAD)).join(own, ["product_code", "model"]), STAR)
    return marts.outlook_gate(
        lead, marts.outlook_evidence(p.forecast, promoted, LEAD), dotted, marts.outlook_history(p.series, p.forecast, promoted), p.series, STAR
    )


def locked_test(spark, sf_dir):
    p = StarPlan(spark, sf_dir)
    return marts.locked_test(p.forecast, p.promotion)


def largest_episode(spark, sf_dir, code=star.CODE):
    p = StarPlan(spark, sf_dir, code=code)
    return marts.largest_episode(p.evaluated, p.queue)


def coverage_by_code(spark, sf_dir):
    p = StarPlan(spark, sf_dir)
    return marts.coverage_by_code(p.cells, p.code_state, STAR)


def lanes(spark, sf_dir):
    p = StarPlan(spark, sf_dir)
    return marts.lanes(p.evaluated, p.episodes, p.code_state, p.class_one_months)


def cohort_facts(spark, sf_dir):
    size = F.col("p_size")
    part = star.table(spark, sf_dir, "part").select(
        F.col("p_type").alias("product_code"),
        F.when(size <= 15, "1").when(size <= 35, "2").otherwise("3").alias("device_class"),
        (F.col("p_retailprice") > 2000).alias("eligible"),
    )
    return marts.cohort_facts(part)


def recall_timeline(spark, sf_dir):
    return recall.published(StarPlan(spark, sf_dir).recall_timeline)


def recall_meta(spark, sf_dir):
    return recall.meta(star.recall_records(spark, sf_dir), StarPlan(spark, sf_dir).recall_timeline)


def recall_count(spark, sf_dir, code=star.CODE):
    p = StarPlan(spark, sf_dir, code=code)
    return recall.pre_registered_count(p.class_one_months, p.queue, p.evaluated_span, STAR)


def _looked_back(p: StarPlan):
    return recall.looked_back(p.class_one_months, p.queue, p.evaluated_span, p.harness)


def recall_initiations(spark, sf_dir, code=star.CODE):
    """K3: the initiations that the pre-registered count counts, listed."""
    p = StarPlan(spark, sf_dir, code=code)
    return recall.initiation_list(recall.class_one(p.recall_timeline, p.gate.filter("forecast"), p.evaluated_span), _looked_back(p))


def recall_workload(spark, sf_dir, code=star.CODE):
    """Initiations and episodes by code, with their rates per evaluated month."""
    p = StarPlan(spark, sf_dir, code=code)
    return recall.code_workload(_looked_back(p), p.queue, p.workload, p.harness)


def known_event_recovery(spark, sf_dir):
    """K5: each code's dearest urgent open order with a returned line must come back from the timeline."""
    order = star.table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'O'").select(
        "o_orderkey", "o_totalprice", "o_orderdate"
    )
    line = star.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_partkey")
    part = star.table(spark, sf_dir, "part").select("p_partkey", "p_type")
    expected = (
        line.join(part, line.l_partkey == part.p_partkey)
        .join(order, line.l_orderkey == order.o_orderkey)
        .groupBy(F.col("p_type").alias("product_code"))
        .agg(F.max_by(F.struct("o_orderkey", "o_orderdate"), F.struct("o_totalprice", "o_orderkey")).alias("o"))
        .select(
            F.col("o.o_orderkey").alias("event_number"), "product_code",
            F.col("o.o_orderdate").cast("date").cast("string").alias("initiated"), F.lit("Class I").alias("classification"),
        )
    )
    return recall.known_events(expected, StarPlan(spark, sf_dir).recall_timeline)


def forecast_gates(spark, sf_dir, code=star.CODE):
    p = StarPlan(spark, sf_dir, code=code)
    gated = p.gate.filter("forecast").select("product_code")
    return gates.forecast_gate(p.forecast, gated, STAR).unionByName(gates.queue_gate(p.queue, p.evaluated))


def _store(spark, sf_dir):
    p = StarPlan(spark, sf_dir)
    rows = stage(forecast.published(p.forecast), "published")
    return p, rows, StageStore(spark, shared_folder(spark, "stages"), p.harness.locked_min_origin)


def locked_versions(spark, sf_dir):
    """M8: the locked result as committed, as a later version republishes it, and with one figure of one code changed."""
    p, rows, store = _store(spark, sf_dir)
    store.develop("r1", rows)
    store.decide(p.promotion)
    store.lock("r1", rows)
    store.republish("r2", "r1")
    first = (F.col("product_code") == "ECONOMY") & (F.col("model") == "baseline_a") & (F.col("horizon") == 1) & (F.col("target") == p.harness.locked[0])
    store.republish("r3", "r2", {"point": F.when(first, F.col("point") + 0.001).otherwise(F.col("point"))})
    changed = store.same_as_committed().select("version", F.lit(True).alias("changed"))
    return store.locked_versions().join(changed, "version", "left").select("version", "rows", "content_hash", F.coalesce("changed", F.lit(False)).alias("changed"))


def stage_order(spark, sf_dir):
    """Each step in turn, whether the store took it, and the rows of each stage after it."""
    p, rows, store = _store(spark, sf_dir)
    fewer = rows.where(F.col("horizon") == 1)
    steps = [
        ("development", lambda: store.develop("r1", rows)), ("locked without a decision", lambda: store.lock("r1", rows)),
        ("decision", lambda: store.decide(p.promotion)), ("second decision", lambda: store.decide(p.promotion)),
        ("locked", lambda: store.lock("r1", rows)), ("second locked", lambda: store.lock("r1", fewer)), ("development again", lambda: store.develop("r1", fewer)),
    ]
    told = []
    for n, (step, act) in enumerate(steps):
        try:
            act()
            outcome = "taken"
        except Refused:
            outcome = "refused"
        held = {r.stage: r["count"] for r in store.rows().groupBy("stage").count().collect()}  # two stages
        told.append((n, step, outcome, held.get(DEVELOPMENT, 0), held.get(LOCKED, 0)))
    return spark.createDataFrame(told, "step long, name string, outcome string, development_rows long, locked_rows long")


def by_brand(query):
    """A query over 25 brands: series sparse enough for episodes, promotions and recalls before them to occur."""
    return lambda spark, sf_dir: query(spark, sf_dir, code=star.BRANDS)


#: Registered a second time with ``brand_`` before the name; their texts read the brand where the others read the type.
BRANDED = (promotion, review_queue, queue_diagnostic, largest_episode, recall_count, recall_initiations, recall_workload, forecast_gates)

QUERIES = {
    ("forecast" if f is forecast_table else f.__name__): f
    for f in (
        baselines, ranges, ets_filter, ets_fit, ets_refined, ets_refined_check, ets_points, forecast_table, scored, score_cells, promotion,
        review_queue, review_workload, queue_diagnostic, numbers_gate, headline_code, outlook_dots, outlook,
        outlook_history, outlook_evidence, outlook_lead, outlook_gate,
        locked_test, largest_episode, coverage_by_code, lanes, cohort_facts, recall_timeline, recall_meta,
        recall_count, recall_initiations, recall_workload, known_event_recovery, forecast_gates, locked_versions, stage_order,
    )
}
QUERIES |= {f"brand_{f.__name__}": by_brand(f) for f in BRANDED}
