"""Toxicity by non-negative positive-unlabelled learning (operator 9).

Known: some texts confirmed toxic. Not known: which of the others are. A linear model over the words and
word beginnings of a text is trained in numpy on the class-prior-corrected risk

    prior * mean_P loss(+g)  +  max(0, mean_U loss(-g) - prior * mean_P loss(-g))

where P are confirmed texts, U unlabelled ones and g the model. The second term estimates the risk on
clean texts, which cannot be negative: where it falls below zero, the step goes up it instead of down,
which keeps a flexible model from fitting U away. With logistic loss, 1 / (1 + exp(-g)) is a probability.

Training reads bounded samples: ``positives`` confirmed texts and ``unlabelled`` others, chosen by a hash of
the id, never by place. Spark counts the features of the samples, the strongest ``features`` are kept.
Scoring reads every whole text. A feature counts once per text, so length adds nothing by itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countwatch.llm.common import arrow_map, fold, fresh, stage, table, texts

POSITIVES = 3000
UNLABELLED = 9000
FEATURES = 2048
THRESHOLD = 0.7
#: Lengths of the word beginnings that count where they are frequent.
STEMS = (4, 5, 7)
#: A beginning is frequent if this share of a text's words, and two different ones, go on after it.
FREQUENT = 0.008
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»¡¿“”„’‘…–—"


def words_of(text: str) -> Counter[str]:
    """Lower-case words with their counts, bare of punctuation at their ends."""
    out: Counter[str] = Counter()
    for word, n in Counter(text.lower().split()).items():
        if bare := word.strip(PUNCTUATION):
            out[bare] += n
    return out


def frequent_stems(words: Counter[str], among: Iterable[str]) -> set[str]:
    """Beginnings that are frequent in a text with these words, looked for in the words ``among``."""
    least = FREQUENT * sum(words.values())
    found = set()
    for length in STEMS:
        n: Counter[str] = Counter()
        different: Counter[str] = Counter()
        for w in among:
            if len(w) > length:
                stem = w[:length]
                n[stem] += words[w]
                different[stem] += 1
        found |= {x for x, k in different.items() if k > 1 and n[x] >= least}
    return found


def features_of(text: str) -> list[str]:
    """w: a word, r: a frequent beginning."""
    words = words_of(text)
    return ["w" + w for w in words] + ["r" + x for x in frequent_stems(words, words)]


@dataclass
class Model:
    """Weights of features by name, and the bias."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0

    def __post_init__(self) -> None:
        self.words, self.frequent = ({k[1:]: w for k, w in self.weights.items() if k[0] == kind} for kind in "wr")
        self.heads = {x[: STEMS[0]] for x in self.frequent}

    def score(self, text: str) -> float:
        words, head = words_of(text), STEMS[0]
        g = self.bias + sum(self.words[w] for w in words.keys() & self.words.keys())
        if among := [w for w in words if w[:head] in self.heads]:
            g += sum(self.frequent[x] for x in frequent_stems(words, among) & self.frequent.keys())
        return float(1.0 / (1.0 + np.exp(-np.clip(g, -60.0, 60.0))))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [features_of(t) for t in texts(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("positive"), pa.array(lists, pa.list_(pa.string()))], ["row", "positive", "found"])


def nn_pu(rows: np.ndarray, cols: np.ndarray, n: int, width: int, positive: np.ndarray, prior: float, steps: int = 500, rate: float = 0.1, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk; the features are (rows, cols) pairs of ones."""
    w, bias = np.zeros(width), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    p, u = positive, ~positive
    n_p, n_u = max(int(p.sum()), 1), max(int(u.sum()), 1)
    for t in range(1, steps + 1):
        g = bias + np.bincount(rows, weights=w[cols], minlength=n)
        s = 1.0 / (1.0 + np.exp(-np.clip(g, -60, 60)))
        minus = np.logaddexp(0, g)  # loss(-g)
        clean = minus[u].sum() / n_u - prior * minus[p].sum() / n_p
        d_clean = np.where(p, -prior * s / n_p, s / n_u)
        d = np.where(p, prior * (s - 1) / n_p, 0.0) + d_clean if clean >= 0 else -d_clean
        grad = np.append(np.bincount(cols, weights=d[rows], minlength=width) + l2 * w, d.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - move[:width], bias - move[width]
    return w, float(bias)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 3, held_out: int = 1,
    positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = FEATURES, prior: float | None = None,
) -> Model:
    """Learn from the rows outside the held-out fold.

    ``prior`` is the share of toxic texts; by default that of the confirmed ones among the labelled rows of
    the training folds. Without a confirmed text the model scores every text 0. Rows without id take no part.
    """
    in_folds = F.col(id_col).isNotNull() & (fold(F.col(id_col), modulus) != held_out)
    known = labels.where(in_folds & F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("toxic"))
    share = known.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("toxic")).first()
    if not share["toxic"]:
        return Model(bias=-60.0)
    prior = min(max(prior if prior is not None else share["toxic"] / share["n"], 1e-4), 0.9)
    chosen = F.xxhash64("id")
    confirmed = known.where("toxic = 1").select("id").distinct()
    own = docs.where(in_folds).select(F.col(id_col).cast("long").alias("id"))
    # Bounded by the two parameters, so these may be broadcast.
    first = confirmed.orderBy(chosen, "id").limit(positives).withColumn("positive", F.lit(True))
    others = own.orderBy(chosen, "id").limit(unlabelled).distinct().withColumn("positive", F.lit(False))
    picked = F.broadcast(first.unionByName(others))
    sample = docs.where(in_folds).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(picked, "id")
    found = stage(arrow_map(sample.select(F.col("id").alias("row"), "positive", "text"), _features, "row long, positive boolean, found array<string>"), "toxic_sample")
    totals = found.agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u")).first()
    n_p, n_u = max(totals["p"], 1), max(totals["u"], 1)
    df_p, df_u = F.col("p") / n_p, F.col("u") / n_u
    spread = F.sqrt((df_u + 1.0 / n_u) * (1 / n_p + 1 / n_u))
    strongest = (
        found.select("positive", F.explode("found").alias("feature"))
        .groupBy("feature")
        .agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
        .where((F.col("p") >= 3) & (df_p >= 0.01) & ((df_p - df_u) / spread > 3.0))
        .orderBy(F.desc((df_p - df_u) / spread), "feature")
        .limit(features)
        .select("feature")
    )
    vocabulary = [r["feature"] for r in strongest.collect()]
    if not vocabulary:
        return Model(bias=float(np.log(prior / (1 - prior))))
    places = F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(vocabulary)), "col int, feature string"))
    got = found.select("row", "positive", F.explode("found").alias("feature")).join(places, "feature").select("row", "positive", "col").distinct().toArrow()
    ids, flags = got.column("row").to_numpy(), got.column("positive").to_numpy().astype(bool)
    texts_met, at = np.unique(ids * 2 + flags, return_inverse=True)
    met = (texts_met & 1).astype(bool)
    # Texts without any of the features still count.
    bare_p, bare_u = max(totals["p"] - int(met.sum()), 0), max(totals["u"] - int((~met).sum()), 0)
    positive = np.concatenate([met, np.ones(bare_p, dtype=bool), np.zeros(bare_u, dtype=bool)])
    w, bias = nn_pu(at, got.column("col").to_numpy(), len(positive), len(vocabulary), positive, prior)
    return Model(dict(zip(vocabulary, w.tolist(), strict=True)), bias)


def score(docs: DataFrame, model: Model, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all by default) with a last column score, named afresh where taken.

    Null and empty texts have the score of a text without features. Repeated rows stay repeated.
    """
    columns = docs.columns if columns is None else columns
    name, text = fresh(docs, "score"), fresh(docs, "text_in")
    rows = docs.select(*columns, F.col(text_col).cast("string").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([model.score(t) for t in texts(batch, text)], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), scores], [*columns, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return arrow_map(rows, run, f"{fields}, `{name}` double")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below ``threshold``, with their own columns."""
    scored = score(docs, train(docs, labels))
    return scored.where(F.col(scored.columns[-1]) < threshold).select(docs.columns)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; the fold crc32(doc_id) mod 3 = 1 is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), columns=["doc_id"])
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
