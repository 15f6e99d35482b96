"""Small helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countwatch.session import ship, stage

#: Rows of a batch that a task function sees at once.
BATCH_ROWS = 2048
#: Bits of the fixed-size key filters: 2 MB, whatever the number of keys.
FILTER_BITS = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with the package sent to the workers first, and batches cut so that few texts are Python strings at once."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(batch.slice(i, BATCH_ROWS) for batch in batches for i in range(0, batch.num_rows, BATCH_ROWS))

    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in either case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings; null reads as the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Cut a stream that is sorted by ``keys`` into tables of about ``rows`` rows, never inside a group.

    The caller bounds its groups, so what is held is bounded by ``rows`` and one group.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        all_rows = pa.Table.from_batches(held).combine_chunks()
        last = np.ones(n, dtype=bool)
        for k in keys:
            values = all_rows.column(k).to_numpy()
            last &= values == values[-1]
        start = int(n - np.argmin(last[::-1])) if not last.all() else 0
        if start:
            yield all_rows.slice(0, start)
        rest = all_rows.slice(start)
        held, n = rest.to_batches(), rest.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal key tuples in sorted arrays."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    new = np.ones(n, dtype=bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, n))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member) that keep the components of the edges ``a - b``."""
    if not len(a):
        return a, b
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            break
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while not np.array_equal(up := root[root], root):
            root = up
    inner = root != np.arange(len(nodes))
    return nodes[inner], nodes[root[inner]]


def key_filter(hashes: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of the low bits of all keys in ``column``: no key is missed, few others pass.

    Spark ors the words together, so at most ``bits / 64`` words reach the driver however many keys
    there are. It only thins out rows before an exact join.
    """
    word, bit = F.col(column).bitwiseAND(F.lit(bits - 1)), F.lit(63)
    words = (
        hashes.where(F.col(column).isNotNull())
        .select(F.shiftright(word, 6).cast("int").alias("w"), word.bitwiseAND(bit).cast("int").alias("b"))
        .groupBy("w")
        .agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"))
    )
    got = words.toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[got.column("w").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the unsigned 64-bit hashes may be in the bitmap."""
    low = hashes & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1


def fold(column: Column, modulus: int) -> Column:
    """The fold of a row: crc32 of its id as text, modulo."""
    return F.crc32(column.cast("string")) % modulus


__all__ = ["FILTER_BITS", "arrow_map", "fold", "forest", "fresh", "key_filter", "passes", "runs", "ship", "stage", "table", "texts", "whole_groups"]
