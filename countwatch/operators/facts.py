"""Published figures beside their re-derivation (M17, J11): long rows (mart, key, figure, number, words)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countwatch.operators import compare

FACT = ("mart", "key", "figure")


def told(mart: str, rows: DataFrame, key: str, numbers: Sequence[str] = (), words: Sequence[str] = ()) -> DataFrame:
    """A row per figure of a mart: numbers as doubles, texts and booleans as words, a null as neither."""
    nothing = {True: F.lit(None).cast("double"), False: F.lit(None).cast("string")}
    cells = [F.struct(F.lit(c).alias("figure"), F.col(c).cast("double").alias("number"), nothing[False].alias("words")) for c in numbers]
    cells += [F.struct(F.lit(c).alias("figure"), nothing[True].alias("number"), F.col(c).cast("string").alias("words")) for c in words]
    return rows.select(F.lit(mart).alias("mart"), F.col(key).cast("string").alias("key"), F.explode(F.array(*cells)).alias("c")).select("mart", "key", "c.*")


def held(published: DataFrame, derived: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Each figure as published and as derived again; it holds if both sides tell it, once, and agree.

    A figure that one side lacks or tells twice does not hold, so a mart that drew nothing is no pass.
    """
    side = lambda df, s: df.groupBy(*FACT).agg(
        F.count(F.lit(1)).alias(f"{s}_times"), F.max("number").alias(s), F.max("words").alias(f"{s}_words")
    )
    both = side(published, "published").join(side(derived, "derived"), list(FACT), "full_outer")
    once = (F.coalesce("published_times", F.lit(0)) == 1) & (F.coalesce("derived_times", F.lit(0)) == 1)
    same = compare.close(F.col("published"), F.col("derived"), tolerance) & F.col("published_words").eqNullSafe(F.col("derived_words"))
    return both.select(*FACT, "published", "derived", "published_words", "derived_words", (once & same).alias("holds"))
