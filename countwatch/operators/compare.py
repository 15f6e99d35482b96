"""Cell-by-cell comparison of two tables and small set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def close(a: Column, b: Column, tolerance: float) -> Column:
    """Equal, both null, or within a relative tolerance of the larger of one and ``|a|``."""
    near = F.abs(a - b) <= F.lit(tolerance) * F.greatest(F.lit(1.0), F.abs(a))
    return a.eqNullSafe(b) | F.coalesce(near, F.lit(False))


def compare_cells(
    published: DataFrame, derived: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = 1e-4
) -> DataFrame:
    """Per compared column, how many cells differ and how many keys only one side holds."""
    left = published.select(*keys, *[F.col(v).alias(f"p_{v}") for v in values], F.lit(True).alias("in_p"))
    right = derived.select(*keys, *[F.col(v).alias(f"d_{v}") for v in values], F.lit(True).alias("in_d"))
    both = left.join(right, list(keys), "full_outer")
    paired = F.col("in_p").isNotNull() & F.col("in_d").isNotNull()
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(v).alias("column"),
                    F.when(paired, ~close(F.col(f"p_{v}").cast("double"), F.col(f"d_{v}").cast("double"), tolerance)).alias("differs"),
                    (~paired).alias("one_sided"),
                )
                for v in values
            ]
        )
    )
    return (
        both.select(cells.alias("c"))
        .groupBy(F.col("c.column").alias("column"))
        .agg(
            F.count(F.lit(1)).alias("cells"),
            F.count_if("c.differs").alias("differing"),
            F.count_if("c.one_sided").alias("one_sided"),
        )
    )


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """C18."""
    return child.join(parent, list(keys), "left_anti")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets; stops at the first surplus row on either side."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
