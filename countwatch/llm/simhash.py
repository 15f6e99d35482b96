"""SimHash near-duplicates with a Gray-order hierarchical index (operator 1).

A fingerprint has a bit set where more than half of a text's shingle hashes have it. Fingerprints
that differ in at most ``k`` bits link; the operator returns the components of those links.

The index. Cut the 64 bits into ``k + 1`` blocks: two fingerprints within ``k`` bits agree on a whole
block, so with one index for each leading block every link lies below one top node of at least one
index. Top nodes are what Spark deals out: a row for each (block, its bits). Inside one, fingerprints
are sorted by their Gray rank, runs of eight form a node that factors out the bits its members share
(mask and pattern), runs of eight nodes the next level, and so on. A search descends pairs of nodes
and adds up the differences on commonly shared bits; a pair beyond ``k`` is pruned with all below it,
a pair that cannot exceed ``k`` is linked as a whole. All pairs of a level advance together in numpy.

A top node with more than ``node_rows`` fingerprints is cut again: its remaining bits are split into
``k + 1`` blocks, one of which must still agree. Fingerprints are distinct by then (copies are grouped
first), so this ends, loses no link, and leaves no task with an unbounded node. Every cut repeats rows, so
each level may hold four times what the one above may: a dense ball of near copies then ends after a few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from countwatch.llm.common import arrow_map, forest, fresh, runs, stage, table, texts, whole_groups
from countwatch.llm.components import components

BITS = 64
SEED = 42
SHINGLE = 4
MAX_BITS = 4
NODE_ROWS = 512
FAN = 8
ALL = (1 << BITS) - 1


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text; zero where there is no word.

    ``bytes.lower`` and ``bytes.split`` act on A-Z and on 0x20, 0x09-0x0D alone, as the contract asks.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64)
    set_in = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_in += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per document; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in texts(batch, "text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps)], ["id", "fp"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, "id long, fp long")


def split_bits(bits: list[int], parts: int) -> list[list[int]]:
    return [x.tolist() for x in np.array_split(np.array(bits), parts)]


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The rank of each code in the Gray sequence (prefix xor of its bits)."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


def _levels(codes: np.ndarray, sizes: np.ndarray) -> list[dict[str, np.ndarray]]:
    """From the codes up: for each node its first child, number of children, shared mask and pattern."""
    out = [{"mask": np.full(len(codes), ALL, dtype=np.uint64), "pattern": codes}]
    all_and, all_or = codes, codes
    while (sizes > 1).any():
        counts = -(-sizes // FAN)
        first_in = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        tree = np.repeat(np.arange(len(sizes)), counts)
        place = np.arange(len(tree)) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        first = first_in[tree] + place * FAN
        n = np.minimum(FAN, sizes[tree] - place * FAN)
        all_and, all_or = np.bitwise_and.reduceat(all_and, first), np.bitwise_or.reduceat(all_or, first)
        mask = ~(all_and ^ all_or)
        out.append({"first": first, "n": n, "mask": mask, "pattern": all_and & mask})
        sizes = counts
    return out


def near_pairs(codes: np.ndarray, sizes: np.ndarray, k: int = MAX_BITS, step: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) whose codes link, block by block; ``sizes`` are the trees, Gray-sorted inside.

    Of a pair of nodes that links as a whole only a spanning star is given.
    """
    levels = _levels(codes, sizes)
    top = len(levels) - 1
    roots = np.arange(len(sizes))
    spans = [np.ones(len(codes), dtype=np.int64)]
    starts = [np.arange(len(codes))]
    for lv in levels[1:]:
        spans.append(np.add.reduceat(spans[-1], lv["first"]))
        starts.append(starts[-1][lv["first"]])
    # Depth first over levels, breadth first inside a step, so what is held stays small.
    stack = [(top, roots[i : i + step], roots[i : i + step]) for i in range(0, len(roots), step)]
    while stack:
        level, x, y = stack.pop()
        if level == 0:
            yield x[x != y], y[x != y]
            continue
        lv, below = levels[level], levels[level - 1]
        grid = np.arange(FAN)
        i, j = np.meshgrid(grid, grid, indexing="ij")
        i, j = i.ravel(), j.ravel()
        ok = (i[None] < lv["n"][x][:, None]) & (j[None] < lv["n"][y][:, None]) & ((x != y)[:, None] | (i <= j)[None])
        row, col = np.nonzero(ok)
        cx, cy = lv["first"][x][row] + i[col], lv["first"][y][row] + j[col]
        shared = below["mask"][cx] & below["mask"][cy]
        apart = np.bitwise_count((below["pattern"][cx] ^ below["pattern"][cy]) & shared)
        near = apart <= k
        cx, cy, shared, apart = cx[near], cy[near], shared[near], apart[near]
        if level > 1:
            sure = apart + np.bitwise_count(~shared) <= k
            if sure.any():
                for ends in (_star(cx[sure], cy[sure], starts[level - 1], spans[level - 1]), _star(cy[sure], cx[sure], starts[level - 1], spans[level - 1])):
                    yield ends
                cx, cy = cx[~sure], cy[~sure]
        stack += [(level - 1, cx[s : s + step], cy[s : s + step]) for s in range(0, len(cx), step)]


def _star(x: np.ndarray, y: np.ndarray, start: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first code below each x with every code below its y."""
    n = span[y]
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(start[x], n), np.repeat(start[y], n) + offset


def _link(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["path", "key"], 1 << 16):
            path, key = rows.column("path").to_numpy(), rows.column("key").to_numpy()
            codes = rows.column("fp").to_numpy().view(np.uint64)
            starts, sizes = runs(path, key)
            order = np.lexsort((gray_rank(codes), np.repeat(np.arange(len(starts)), sizes)))
            codes = codes[order]
            a, b = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            held: list[tuple[np.ndarray, np.ndarray]] = []
            n = 0
            for x, y in near_pairs(codes, sizes, k):
                held.append((x, y))
                n += len(x)
                if n > 1 << 20:
                    a, b = forest(np.concatenate([a, *(h[0] for h in held)]), np.concatenate([b, *(h[1] for h in held)]))
                    held, n = [], 0
            a, b = forest(np.concatenate([a, *(h[0] for h in held)]), np.concatenate([b, *(h[1] for h in held)]))
            if len(a):
                signed = codes.view(np.int64)
                u, v = forest(signed[a], signed[b])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])

    return run


def links(fps: DataFrame, k: int = MAX_BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """(a, b): edges whose components are those of all fingerprint pairs within ``k`` bits.

    ``fps`` has one distinct fingerprint per row, in ``fp``.
    """
    spark = fps.sparkSession
    fixed = dict(enumerate(split_bits(list(range(BITS)), k + 1)))
    tops = F.array(*(F.struct(F.lit(i).alias("path"), F.col("fp").bitwiseAND(F.lit(_signed(mask_of(b)))).alias("key")) for i, b in fixed.items()))
    level = fps.select("fp", F.explode(tops).alias("at")).select("at.path", "at.key", "fp")
    ready: DataFrame | None = None
    allowed = node_rows
    while True:
        over = stage(level.groupBy("path", "key").agg(F.count("*").alias("n")).where(F.col("n") > allowed).drop("n"), "over")
        if over.isEmpty():
            ready = level if ready is None else ready.unionByName(level)
            break
        allowed *= 4
        small = level.join(over, ["path", "key"], "left_anti")
        ready = small if ready is None else ready.unionByName(small)
        # One level down: each path's remaining bits in k + 1 blocks, paths numbered as in a heap. This
        # table has k + 1 rows for each path above, whatever the data.
        children, wider = [], {}
        for path, bits in fixed.items():
            for i, part in enumerate(split_bits([b for b in range(BITS) if b not in bits], k + 1)):
                child = (path + 1) * (k + 1) + i
                wider[child] = bits + part
                children.append((path, child, _signed(mask_of(bits + part))))
        fixed = wider
        down = spark.createDataFrame(children, "path int, child int, mask long")
        level = (
            level.join(over, ["path", "key"], "left_semi")
            .join(F.broadcast(down), "path")
            .select(F.col("child").alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        )
    dealt = ready.repartition("path", "key").sortWithinPartitions("path", "key")
    return arrow_map(dealt, _link(k), "a long, b long")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = MAX_BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_copies): one row per document.

    ``component_id`` is the smallest id reachable over links, itself included; ``n_copies`` is the
    number of documents with this very fingerprint. Null and empty texts have fingerprint zero and
    link like any other. Repeated rows stay repeated. A null id takes part but is never a
    component's name unless it has no other. An empty table gives no rows; other columns are not read.
    """
    fps = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = stage(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n_copies")), "codes")
    joined = components(links(nodes.select("fp"), k, node_rows))
    of_code = nodes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = of_code.groupBy("component").agg(F.min("least").alias("component_id"))
    of_code = of_code.join(named, "component").select("fp", "component_id", "n_copies")
    return fps.join(of_code, "fp").select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_copies"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component: the row whose id names it. Rows without an id stay.

    Rows that repeat an id count as one document; of several rows with the kept id the one with the
    smallest text hash stays, of wholly equal rows one.
    """
    found = near_duplicates(docs, id_col, text_col)
    kept, place = fresh(docs, "kept_id"), fresh(docs, "place")
    names = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(kept)).distinct()
    first = Window.partitionBy(id_col).orderBy(F.xxhash64(F.col(text_col)))
    return (
        docs.join(names, F.col(id_col) == F.col(kept), "left_semi")
        .withColumn(place, F.row_number().over(first))
        .where(F.col(place) == 1)
        .select(docs.columns)
        .unionByName(docs.where(F.col(id_col).isNull()))
    )


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
