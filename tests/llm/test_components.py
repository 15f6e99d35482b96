"""Components: a hub's edges are dealt over tasks, rounds free what they no longer read, and answers equal brute force."""

import os

import numpy as np
from pyspark.sql import functions as F

import brute
from countwatch.llm import components
from countwatch.session import stage, unstage


def test_a_hub_is_dealt_over_tasks_without_adaptive_splitting(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for key, value in zip(kept, ("false", "-1", "16"), strict=True):
            spark.conf.set(key, value)
        hub = spark.range(1, 40_001).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
        rows = components.with_smallest(hub).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.min("m").alias("low"), F.max("m").alias("high")).collect()
        assert sum(r.n for r in rows) == 40_000 and {(r.low, r.high) for r in rows} == {(1, 1)}
        assert len(rows) == 16 and max(r.n for r in rows) < 2 * 40_000 / 16
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)


def test_random_graphs_equal_brute_force_at_every_number_of_parts(spark, monkeypatch):
    drawn = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in drawn.integers(0, 400, (300, 2))] + [(7, int(x)) for x in drawn.integers(400, 900, 200)]
    roots = brute.components(900, pairs)
    for parts in (1, 3, 256):
        monkeypatch.setattr(components.with_smallest, "__defaults__", (parts,))
        rows = components.components(spark.createDataFrame([*pairs, (5, 5), *pairs[:20]], "a long, b long")).collect()
        got = {r.node: r.component for r in rows}
        assert len(got) == len(rows)
        assert set(got) == {x for a, b in pairs if a != b for x in (a, b)}
        assert all(got[a] == got[b] == min(x for x in got if roots[x] == roots[a]) for a, b in pairs if a != b)


def test_null_ends_are_ignored(spark):
    rows = components.components(spark.createDataFrame([(None, 1), (2, None), (4, 3), (3, 4)], "a long, b long")).collect()
    assert {(r.node, r.component) for r in rows} == {(3, 3), (4, 3)}


def test_an_unstaged_table_is_gone(spark):
    staged = stage(spark.range(3).toDF("x"), "gone")
    place = staged.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(place)
    unstage(staged)
    assert not os.path.exists(place)
    unstage(spark.range(3))  # nothing was written: nothing happens
