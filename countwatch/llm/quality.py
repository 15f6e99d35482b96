"""Quality scores from histogram gradient-boosted trees over document statistics (operator 6).

Each text becomes a few statistics of its characters, words and lines. Trees are grown level by level on
gradient and curvature histograms of quantile-binned statistics, then flattened: a forest is three arrays
(split statistic, split value, leaf value) with a tree per row in heap order, so scoring a block of texts is
``depth`` rounds of array indexing over (texts, trees).

Training reads at most ``rows`` labelled texts, chosen by a hash of the id; scoring reads every whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countwatch.llm.common import arrow_map, fold, fresh, table, texts

ROWS = 20_000
TREES, DEPTH, BINS, RATE, L2, MIN_CURVATURE = 80, 4, 64, 0.15, 1.0, 2.0
THRESHOLD = 0.3

STATISTICS = (
    "log_chars", "log_words", "word_length", "longest_word", "distinct_words", "top_word", "upper", "digits", "punctuation", "symbols", "sentence_ends",
    "spaces", "other_bytes", "pipes", "upper_words", "bare_words", "log_lines", "line_length", "distinct_lines", "ended_lines", "repeated_chars",
)
_UPPER, _DIGIT = slice(65, 91), slice(48, 58)
_PUNCTUATION = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
_SYMBOLS = np.array([ord(c) for c in "#$%&*+<=>@[\\]^_`{|}~"])
_ENDS = np.array([ord(c) for c in ".!?"])
_WORD_ENDS = frozenset("#$%&*+<=>@^_|~")


def statistics(text: str) -> list[float]:
    """One text's statistics; an empty text has zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(STATISTICS)
    n = len(raw)
    seen = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words = text.split()
    counts = Counter(words)
    w = max(len(words), 1)
    lines = text.split("\n")
    distinct = Counter(lines)
    chars = len(text)
    repeated = sum(len(line) * (k - 1) for line, k in distinct.items() if k > 1)
    return [
        np.log1p(chars), np.log1p(len(words)), sum(map(len, words)) / w, np.log1p(max(map(len, words), default=0)), len(counts) / w, max(counts.values(), default=0) / w,
        seen[_UPPER].sum() / n, seen[_DIGIT].sum() / n, seen[_PUNCTUATION].sum() / n, seen[_SYMBOLS].sum() / n, seen[_ENDS].sum() / w,
        (seen[32] + seen[9:14].sum()) / n, seen[128:].sum() / n, seen[124] / w, sum(map(str.isupper, words)) / w, sum(x[-1] in _WORD_ENDS for x in words) / w,
        np.log1p(len(lines)), np.log1p(chars / len(lines)), len(distinct) / len(lines), sum(x[-1:] in ".!?" and x != "" for x in lines) / len(lines), repeated / chars,
    ]


@dataclass
class Forest:
    """Flattened trees in heap order: node i has children 2i + 1 and 2i + 2; leaves follow the inner nodes."""

    feature: np.ndarray
    split: np.ndarray
    leaf: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of ``x``."""
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(x), 1.0 / (1.0 + np.exp(-self.bias)))
        out = np.full(len(x), self.bias)
        tree = np.arange(trees)
        for i in range(0, len(x), 4096):
            rows = x[i : i + 4096]
            row = np.arange(len(rows))[:, None]
            node = np.zeros((len(rows), trees), dtype=np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (rows[row, self.feature[tree, node]] > self.split[tree, node])
            out[i : i + 4096] += self.leaf[tree, node - inner].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-np.clip(out, -60, 60)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Forest:
    """Boost trees for logistic loss. Without both labels the forest is empty and scores the label's share."""
    n, width = x.shape
    share = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    inner = (1 << depth) - 1
    feature, split, leaf = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    if not n or y.min() == y.max():
        return Forest(feature[:0], split[:0], leaf[:0], bias)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)], axis=1)
    g_all = np.full(n, bias)
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-g_all))
        grad, curve = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, dtype=np.int64)
        for d in range(depth):
            first, count = (1 << d) - 1, 1 << d
            at = node - first
            best_gain, best = np.zeros(count), np.zeros((count, 2), dtype=np.int64)
            best[:, 1] = -1
            for f in range(width):
                key = at * bins + binned[:, f]
                gs = np.bincount(key, weights=grad, minlength=count * bins).reshape(count, bins)
                hs = np.bincount(key, weights=curve, minlength=count * bins).reshape(count, bins)
                gl, hl = np.cumsum(gs, axis=1), np.cumsum(hs, axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                gain[(hl < MIN_CURVATURE) | (ht - hl < MIN_CURVATURE)] = -1.0
                cut = np.argmax(gain, axis=1)
                top = gain[np.arange(count), cut]
                up = top > best_gain + 1e-9
                best_gain[up], best[up, 0], best[up, 1] = top[up], f, cut[up]
            for i in range(count):
                f, cut = best[i]
                if cut >= 0 and cut < len(edges[f]):
                    feature[t, first + i], split[t, first + i] = f, edges[f][cut]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > split[t, node])
        at = node - inner
        gs, hs = np.bincount(at, weights=grad, minlength=inner + 1), np.bincount(at, weights=curve, minlength=inner + 1)
        leaf[t] = -RATE * gs / (hs + L2)
        g_all += leaf[t, at]
    return Forest(feature, split, leaf, bias)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 5, held_out: int = 0, rows: int = ROWS) -> Forest:
    """Learn from labelled rows outside the held-out fold, at most ``rows`` of them by a hash of the id.

    Rows with a null id or label take no part; several labels of one id count as the larger.
    """
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(F.col(id_col), modulus) != held_out))
    own = own.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    # At most ``rows`` rows, so this side may be broadcast.
    picked = F.broadcast(own.orderBy(F.xxhash64("id"), "id").limit(rows))
    sample = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(picked, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([statistics(t) for t in texts(batch, "text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), x], ["id", "label", "x"])

    got = arrow_map(sample, run, "id long, label int, x array<double>").toArrow().sort_by("id")
    x = np.array(got.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(STATISTICS))
    return grow(x, got.column("label").to_numpy().astype(np.float64))


def score(docs: DataFrame, forest: Forest, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all by default) with a last column score, named afresh where taken.

    Null texts read as empty; empty texts are scored like any other. Repeated rows stay repeated.
    """
    columns = docs.columns if columns is None else columns
    name, text = fresh(docs, "score"), fresh(docs, "text_in")
    rows = docs.select(*columns, F.col(text_col).cast("string").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in texts(batch, text)], dtype=np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(forest.score(x))], [*columns, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return arrow_map(rows, run, f"{fields}, `{name}` double" if fields else f"`{name}` double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; the fold crc32(doc_id) mod 5 = 0 is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), columns=["doc_id"])
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
