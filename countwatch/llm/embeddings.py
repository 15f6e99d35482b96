"""Near-duplicate vectors by collision counting over sorted projections (operator 7).

Vectors link when their cosine is at least ``least``. On unit vectors, a Gaussian projection of two linked
vectors differs by at most a normal variable of known spread, so a window of half-width ``window`` around a
vector's own value holds a linked one with known probability, while most others fall outside. A pair that
collides in too few of the ``projections`` cannot plausibly link; the least count is calibrated so that a pair
at the threshold passes with probability ``1 - MISSED``. Only pairs that pass get their exact cosine.

So that not every pair is counted, vectors are dealt out first: ``tables`` times, by the signs of a few
projections. The number of signs follows the logarithm of the number of vectors (about ``cell`` vectors to a
cell on spread-out data), the number of tables follows from it so that a pair at the threshold shares a cell
with probability ``recall``. Inside the cells all projections are sorted, windows found by binary search, and
collisions counted per pair, for many cells in one numpy pass.

Equal vectors are grouped before anything else and carry their number. A pair counts in the first table where
it meets, so link numbers add up by sums and no pair is written; only a spanning forest leaves a task. A cell
with more than ``block`` vectors is cut into blocks, every pair of blocks being a task of its own, because
each pair of different vectors in it may be a link that has to be counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, erf, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countwatch.llm.common import arrow_map, forest, runs, stage, table, whole_groups
from countwatch.llm.components import components

LEAST = 0.95
RECALL = 0.995
MISSED = 0.001
PROJECTIONS = 16
WINDOW = 0.6
CELL = 24
BLOCK = 1024
SEED = 7


def signs_for(n: int, cell: int = CELL) -> int:
    """Signs per table for ``n`` vectors."""
    return max(4, ceil(log2(max(n, 1) / cell + 1)))


def tables_for(signs: int, least: float = LEAST, recall: float = RECALL) -> int:
    """Tables so that a pair at the threshold shares a cell of one with probability ``recall``."""
    same = (1 - acos(least) / pi) ** signs
    return max(1, ceil(log(1 - recall) / log(1 - same)))


def least_count(projections: int = PROJECTIONS, least: float = LEAST, window: float = WINDOW, missed: float = MISSED) -> int:
    """The largest count that a pair at the threshold reaches with probability ``1 - missed``."""
    p = erf(window / sqrt(2 * (1 - least)) / sqrt(2))
    below = 0.0
    for k in range(projections + 1):
        below += comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if below > missed:
            return k
    return projections


def directions(dim: int, many: int, what: int) -> np.ndarray:
    """Gaussian directions, the same on every worker for a dimension and purpose."""
    return np.random.default_rng((SEED, what, dim)).standard_normal((dim, many))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(lists), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares of tiny and huge components in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(x: np.ndarray, signs: int, tables: int) -> np.ndarray:
    """(vectors, tables): the cell of each vector in each table."""
    bits = x @ directions(x.shape[1], signs * tables, 0) > 0
    return bits.reshape(len(x), tables, signs) @ (1 << np.arange(signs, dtype=np.int64))


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors of a batch, one dimension at a time."""
    sizes = np.array(batch.column("vec").value_lengths())
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield at, _unit(_matrix(batch.column("vec").take(pa.array(at))))


def _cells(signs: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _by_dim(batch):
                keys = _keys(x, signs, tables)
                nodes = batch.column("node").to_numpy()[at]
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n * tables, x.shape[1], dtype=np.int32)), pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(keys.ravel()), pa.array(np.repeat(nodes, tables))],
                    ["dim", "tab", "cell", "node"],
                )

    return run


def colliding(projected: np.ndarray, cells: np.ndarray, sizes: np.ndarray, window: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) inside cells that collide in at least ``least`` projections.

    For each projection the values are sorted within their cells, and the run of values that one vector's
    window holds is found by binary search. ``cells`` numbers the cell of each row, rows of a cell adjoin.
    """
    first = np.cumsum(sizes) - sizes
    squares = np.cumsum(sizes**2) - sizes**2
    count = np.zeros(int((sizes**2).sum()), dtype=np.uint8)
    place = np.arange(len(cells)) - first[cells]
    span = float(np.abs(projected).max()) * 2 + 4 * window + 1
    for k in range(projected.shape[1]):
        value = projected[:, k] + cells * span
        order = np.argsort(value, kind="stable")
        ranked = value[order]
        # From a vector's own place to the end of its window: the other half is the other vector's.
        high = np.searchsorted(ranked, ranked + window, "right")
        n = high - np.arange(len(ranked)) - 1
        query = np.repeat(np.arange(len(ranked)), n)
        hit = query + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a, b = order[query], order[hit]
        a, b = np.minimum(a, b), np.maximum(a, b)
        count[squares[cells[a]] + place[a] * sizes[cells[a]] + place[b]] += 1
    passing = np.flatnonzero(count >= least)
    cell = np.searchsorted(squares, passing, "right") - 1
    inside = passing - squares[cell]
    return first[cell] + inside // sizes[cell], first[cell] + inside % sizes[cell]


def _link(signs: int, tables: int, least: float):
    needed = least_count(least=least)

    def solve(rows: pa.Table, dim: int) -> tuple[np.ndarray, ...]:
        x = _unit(_matrix(rows.column("vec")))
        tab, node, many, block = (rows.column(c).to_numpy() for c in ("tab", "node", "many", "block"))
        starts, sizes = runs(*(rows.column(c).to_numpy() for c in ("tab", "cell", "i", "j")))
        apart = rows.column("i").to_numpy() != rows.column("j").to_numpy()
        cells = np.repeat(np.arange(len(starts)), sizes)
        projected = x @ directions(dim, PROJECTIONS, 1)
        keys = _keys(x, signs, tables)
        seen, u, v = np.zeros(len(x), dtype=np.int64), [], []
        # So many cells at once that the pair counts stay near 16 MB.
        chunk = np.cumsum(sizes.astype(np.int64) ** 2) // (1 << 24)
        for c in np.unique(chunk):
            own = np.flatnonzero(chunk == c)
            lo, hi = starts[own[0]], starts[own[-1]] + sizes[own[-1]]
            a, b = colliding(projected[lo:hi], cells[lo:hi] - own[0], sizes[own].astype(np.int64), WINDOW, needed)
            a, b = a + lo, b + lo
            ok = ~apart[a] | (block[a] != block[b])  # two blocks: only pairs across
            a, b = a[ok], b[ok]
            for s in range(0, len(a), 1 << 17):
                p, q = a[s : s + (1 << 17)], b[s : s + (1 << 17)]
                linked = np.einsum("ij,ij->i", x[p], x[q]) >= least
                p, q = p[linked], q[linked]
                u.append(p)
                v.append(q)
                earliest = np.argmax(keys[p] == keys[q], axis=1) == tab[p]
                p, q = p[earliest], q[earliest]
                seen += np.bincount(p, weights=many[q], minlength=len(x)).astype(np.int64) + np.bincount(q, weights=many[p], minlength=len(x)).astype(np.int64)
        a, b = (np.concatenate(z) if z else np.zeros(0, dtype=np.int64) for z in (u, v))
        a, b = forest(node[a], node[b])
        met = seen > 0
        return node[met], seen[met], a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["dim", "tab", "cell", "i", "j"], 1 << 15):
            for dim in np.unique(rows.column("dim").to_numpy()):
                node, n, a, b = solve(rows.filter(pc.equal(rows.column("dim"), pa.scalar(dim))), int(dim))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([node, a])), pa.array(np.concatenate([n, np.zeros(len(a), dtype=np.int64)])), pa.array(np.concatenate([node, b]))], ["node", "n", "other"]
                )

    return run


def valid(column: str):
    """Neither null nor empty nor zero, and every component a finite number."""
    c = F.col(column)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return c.isNotNull() & finite & F.exists(c, lambda x: x != 0)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = LEAST, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per input row.

    Vectors that are null, empty, zero or not finite link with nothing and name their own component, and so
    do vectors of different lengths among each other. Equal vectors link. Rows that repeat an id count as
    separate vectors; a null id takes part but never names a component that has another. An empty table
    gives no rows; other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    good = rows.where(F.coalesce(valid("vec"), F.lit(False)))
    # Written once, so the numbers given here do not change.
    distinct = stage(good.groupBy("vec").agg(F.min("id").alias("least"), F.count("*").alias("many")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    signs = signs_for(distinct.count(), cell)
    tables = tables_for(signs, least)
    dealt = arrow_map(distinct.select("node", "vec"), _cells(signs, tables), "dim int, tab int, cell long, node long")
    over = dealt.groupBy("dim", "tab", "cell").agg(F.count("*").alias("held")).where(F.col("held") > block)
    over = stage(over.withColumn("blocks", F.ceil(F.col("held") / block).cast("int")).drop("held"), "large_cells")
    at = dealt.join(over, ["dim", "tab", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    at = at.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    at = at.select("dim", "tab", "cell", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node")
    full = at.join(distinct.select("node", "vec", "many"), "node").repartition("dim", "tab", "cell", "i", "j").sortWithinPartitions("dim", "tab", "cell", "i", "j")
    found = stage(arrow_map(full.select("dim", "tab", "cell", "i", "j", "block", "node", "many", "vec"), _link(signs, tables, least), "node long, n long, other long"), "links")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    joined = components(found.where("node != other"), "node", "other")
    known = distinct.join(counts, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(named, "component").select("vec", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id")
    out = rows.withColumn("ok", F.coalesce(valid("vec"), F.lit(False)))
    linked = out.where("ok").join(known, "vec").select("id", "n_links", "component_id")
    alone = out.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all rows of ``embeddings``."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
