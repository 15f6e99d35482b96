"""Places and running sums over an order that no single task sees whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countwatch.llm.common import stage

#: ``monotonically_increasing_id`` keeps the partition above these bits and the row within it below.
PART_BITS = 33


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, found by exact name, else by the first that differs in case only.

    Columns are taken by position, so further columns may repeat a name or clash with one in another case.
    """
    lower = [c.lower() for c in df.columns]
    places = [df.columns.index(n) if n in df.columns else lower.index(n.lower()) for n in names]
    flat = df.toDF(*[f"c{i}" for i in range(len(lower))])
    return flat.select([F.col(f"c{i}").alias(n) for i, n in zip(places, names, strict=True)])


def in_order(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """``df`` staged in the order of ``keys`` with ``at``, a number that rises along that order.

    Rows are dealt by ranges of the keys and sorted within them; a last key tells equal rows apart, so that rows
    repeated any number of times still spread. Which of two rows with equal keys comes first is not told: callers
    give keys that leave only interchangeable rows equal. Ranges are sampled in a pass of their own, so rows that are costly to make
    should be staged before.
    """
    tied = df.withColumn("at", F.monotonically_increasing_id())
    order = [*keys, F.col("at")]
    dealt = tied.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(dealt.withColumn("at", F.monotonically_increasing_id()), name)


def same(a: DataFrame, b: DataFrame, on: list[str]) -> Column:
    """Null-safe equality on ``on``, whose columns are called ``<name>_`` in ``b``."""
    out = F.lit(True)
    for c in on:
        out = out & a[c].eqNullSafe(b[f"{c}_"])
    return out


def _spans(rows: DataFrame, group: list[str], sums: dict[str, Column]) -> DataFrame:
    """Per group and part of a table of ``in_order``: its first ``at``, and for each sum what earlier parts and the whole group hold."""
    parts = rows.groupBy(*group, F.shiftright("at", PART_BITS).alias("part")).agg(
        F.min("at").alias("first"), *[F.sum(c).alias(f"{name}_here") for name, c in sums.items()]
    )
    of = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    earlier = of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    told = []
    for name in sums:
        told += [F.coalesce(F.sum(f"{name}_here").over(earlier), F.lit(0)).alias(f"{name}_before"), F.sum(f"{name}_here").over(of).alias(f"{name}_whole")]
    return parts.select(*[F.col(c).alias(f"{c}_") for c in group], F.col("part").alias("part_"), "first", *told)


def places(rows: DataFrame, group: list[str]) -> DataFrame:
    """Rows of ``in_order`` (sorted by ``group`` first) with ``pos``, the place within the group from 0, and ``n``, its size.

    What is windowed is one row per group and part of the order, never the rows themselves.
    """
    rows = rows.withColumn("part", F.shiftright("at", PART_BITS))
    spans = _spans(rows, group, {"rows": F.lit(1)})
    pos = F.col("at") - F.col("first") + F.col("rows_before")
    return rows.join(spans, same(rows, spans, [*group, "part"])).select(
        *[rows[c] for c in rows.columns if c not in ("at", "part")], pos.alias("pos"), F.col("rows_whole").alias("n")
    )


def running(rows: DataFrame, group: list[str], *values: str) -> DataFrame:
    """Rows of ``in_order`` (sorted by ``group`` first) with ``<value>_before``: each value's sum over earlier rows of the group.

    A group is summed part by part, so one that holds a third of all rows is as many windows as it has parts.
    """
    rows = rows.withColumn("part", F.shiftright("at", PART_BITS))
    spans = _spans(rows, group, {v: F.col(v) for v in values})
    within = Window.partitionBy(*group, "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumns({f"{v}_inner": F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values})
    return summed.join(spans, same(summed, spans, [*group, "part"])).select(
        *[summed[c] for c in rows.columns if c not in ("at", "part")],
        *[(F.col(f"{v}_before") + F.col(f"{v}_inner")).alias(f"{v}_before") for v in values],
    )
