"""Benchmark decontamination by template windows (operator 3).

A text becomes a sequence of canonical tokens: words in lower case without outer punctuation, and typed
placeholders for numbers, quantities (a number with its unit) and names (a run of capitalised words that do
not begin a sentence). Windows of ``WINDOW`` tokens of benchmark items are hash-joined with those of the
documents, so a question is found again when its numbers, names or units were exchanged.

A hit aligns a document with an item at one offset. There the values in the slots are compared: a value of the
item should always have become the same value of the document and the other way round. New values may
coincide (3 and 5 become 5 and 5) and equal ones part (2 and 2 become 3 and 2), so ``CONSISTENT`` of the pairs of
values have to be one to one, of names and of figures each; an alignment with fewer is no copy of the
question and does not count. The windows of the consistent ones together tell how much of an item a document holds: it is contaminated by an item if it has
``COVERAGE`` of its windows, or ``RUN`` of them.

Documents first pass a bitmap of the item windows' hashes, of a fixed 2 MB, that misses none; what passes is
joined exactly. Equal items are one. The windows of a long item need ``LITERALS`` plain words each, unless
it has no such window; an item shorter than a window is one window of its own length, and an item of fewer
than ``LEAST_TOKENS`` tokens is too general to be found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countwatch.llm.common import arrow_map, fresh, key_filter, passes, stage, table, texts

WINDOW = 8
LITERALS = 5
LEAST_TOKENS = 5
COVERAGE = 0.5
RUN = 6
CONSISTENT = 0.5
REMEMBERED = 400_000
BLOCK_WORDS = 200_000

# Units that make a number a quantity.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons tonne tonnes "
    "ml l liter liters litre litres gallon gallons pint pints cup cups s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months "
    "year years mph kmh km/h m/s hz khz mhz ghz w kw v a ohm ohms j kj cal kcal pa kpa bar k °c °f % percent degree degrees dollar dollars euro euros cent cents usd eur gbp "
    "kb mb gb tb bytes bits people students apples".split()
)
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d,]*(?:\.\d+)?(?:st|nd|rd|th)?")
WITH_UNIT = re.compile(r"([+-]?[$€£]?\d[\d,]*(?:\.\d+)?)([a-z°%/]+)")
OUTER = "\"'“”„’‘«»()[]{}<>,;:!?.*#&$|…–—-_=+~^`@"
WORD, NUM, QUANTITY, NAME, UNIT, ENDS, EMPTY = 0, 1, 2, 3, 4, 8, 16
TYPES = {NUM: "number", QUANTITY: "quantity", NAME: "name"}
_MARKS = np.random.default_rng(3).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACEHOLDER = {k: np.uint64(xxhash.xxh64_intdigest(f"<{v}>".encode(), 3)) for k, v in TYPES.items()}


def classify(word: str) -> tuple[int, int]:
    """(hash of the plain token, class): a word's class holds for any place; the neighbours decide the rest."""
    bare = word.strip(OUTER)
    ends = ENDS if word.rstrip("\"'”’»)]*#&$%|").endswith((".", "!", "?", ":")) else 0
    if not bare:
        return 0, EMPTY | (UNIT if word == "%" else 0) | ends
    low = bare.lower()
    key = xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass"), 3)
    if NUMBER.fullmatch(low):
        return key, (QUANTITY if word.rstrip(".,;:!?)").endswith("%") or word.lstrip("(")[:1] in "$€£" else NUM) | ends
    if (m := WITH_UNIT.fullmatch(low)) and m[2] in UNITS:
        return key, QUANTITY | ends
    if low in UNITS:
        return key, UNIT | ends
    if len(bare) > 1 and bare[0].isupper() and bare[1:].islower():
        return key, NAME | ends
    return key, WORD | ends


class Canon:
    """Canonical tokens of blocks of texts; a worker remembers the classes of words."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        size = REMEMBERED + 2 * BLOCK_WORDS
        self.hashes, self.classes = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.uint8)

    def indices(self, words: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.forget()
        known = self.known
        new = [w for w in set(words) if w not in known]
        if len(known) + len(new) > len(self.hashes):
            more = len(new)
            self.hashes, self.classes = np.append(self.hashes, np.zeros(more, np.uint64)), np.append(self.classes, np.zeros(more, np.uint8))
        for w in new:
            i = known[w] = len(known)
            self.hashes[i], self.classes[i] = classify(w)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def tokens(self, words: list[str], first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, type, first word, end word) of the tokens; ``first`` marks words that begin a text."""
        at = self.indices(words)
        raw = self.classes[at]
        kind = (raw & 7).astype(np.int8)
        ends, empty = raw & ENDS > 0, raw & EMPTY > 0
        begins = first.copy()
        begins[1:] |= ends[:-1]
        kind[(kind == NAME) & begins] = WORD
        keep = ~empty | (kind == UNIT)
        place = np.flatnonzero(keep)
        kind, hashes, starts = kind[place], self.hashes[at[place]], np.cumsum(first)[place]
        before = np.concatenate([[-1], kind[:-1]])
        same_text = np.concatenate([[False], starts[1:] == starts[:-1]])
        unit = (kind == UNIT) & (before == NUM) & same_text
        kind[np.flatnonzero(unit) - 1] = QUANTITY
        kind[(kind == UNIT) & ~unit] = WORD
        goes = unit | ((kind == NAME) & (before == NAME) & same_text)
        left = np.flatnonzero(~goes)
        kind = kind[left]
        hashes = hashes[left]
        for k, h in _PLACEHOLDER.items():
            hashes[kind == k] = h
        begin = place[left]
        end = np.append(begin[1:], len(words))
        return hashes, kind, begin, end


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """The hash of each window of ``length`` tokens, length included."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, int(_MARKS[length]) * length & (1 << 64) - 1, dtype=np.uint64)
    for j in range(length):
        t = hashes[j : j + n] + _MARKS[j]
        out += (t ^ (t >> np.uint64(31))) * _MARKS[j + 16]
    out ^= out >> np.uint64(29)
    out *= _MARKS[40]
    return out ^ (out >> np.uint64(32))


def slot_values(words: list[str], kind: np.ndarray, begin: np.ndarray, end: np.ndarray, at: int, length: int, limit: int) -> list[str]:
    """type=value of the slots of a window, in order.

    A name at either edge is left out: its run may have begun before the passage or go on after it.
    """
    out = []
    for t in range(at, at + length):
        if kind[t] in TYPES and not (kind[t] == NAME and t in (at, at + length - 1)):
            stop = min(int(end[t]), limit)
            value = " ".join(x.strip(OUTER).lower() or x for x in words[int(begin[t]) : stop] if x.strip(OUTER) or x == "%")
            out.append(f"{TYPES[int(kind[t])]}={value}")
    return out


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    canon = Canon()
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for item, text in zip(batch.column("item").to_pylist(), texts(batch, "text"), strict=True):
            words = text.split()
            if not words:
                continue
            hashes, kind, begin, end = canon.tokens(words, np.arange(len(words)) == 0)
            length = min(WINDOW, len(hashes))
            if length < LEAST_TOKENS:
                continue
            keys = window_hashes(hashes, length)
            literal = np.convolve(kind == WORD, np.ones(length, dtype=int), "valid")
            own = np.flatnonzero(literal >= min(LITERALS, length))
            own = own if len(own) else np.arange(len(keys))
            for p in own.tolist():
                row = (item, p, length, int(keys[p].view(np.int64)), len(own), slot_values(words, kind, begin, end, p, length, len(words)))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["item", "at", "length", "key", "windows", "item_slots"])


_canon: list[Canon] = []


def _doc_windows(shared, lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _canon:
            _canon.append(Canon())
        canon = _canon[0]
        for batch in batches:
            all_texts = texts(batch, "text")
            i = 0
            while i < len(all_texts):
                words, sizes, start = [], [], i
                while i < len(all_texts) and len(words) < BLOCK_WORDS:
                    own = all_texts[i].split()
                    words += own
                    sizes.append(len(own))
                    i += 1
                if not words:
                    continue
                edges = np.concatenate([[0], np.cumsum(sizes)])
                first = np.zeros(len(words), dtype=bool)
                first[edges[:-1][np.array(sizes) > 0]] = True
                hashes, kind, begin, end = canon.tokens(words, first)
                doc = np.searchsorted(edges, begin, "right") - 1
                rows: list[tuple] = []
                for length in lengths:
                    keys = window_hashes(hashes, length)
                    hit = np.flatnonzero(passes(shared.value, keys))
                    hit = hit[doc[hit] == doc[hit + length - 1]]
                    rows += [
                        (int(doc[p]), int(p), length, int(keys[p].view(np.int64)), slot_values(words, kind, begin, end, p, length, int(edges[doc[p] + 1])))
                        for p in hit.tolist()
                    ]
                if rows:
                    d, p, length, key, slots = zip(*rows, strict=True)
                    at = pa.array(np.array(d) + start)
                    tkey = np.array([xxhash.xxh64_intdigest(all_texts[k].encode("utf-8", "surrogatepass"), 42) for k in (np.array(d) + start).tolist()], dtype=np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(at), pa.array(tkey), pa.array(p, pa.int64()), pa.array(length, pa.int32()), pa.array(key, pa.int64()), pa.array(slots, pa.list_(pa.string()))],
                        ["id", "tkey", "place", "length", "key", "doc_slots"],
                    )

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, text_hash, item_id, n_matched, n_windows, coverage, n_slots, n_changed, kind).

    One row per document and item it holds; kind is exact or reparameterised. Equal items are reported under
    their smallest id. Null and empty texts hold nothing; rows equal in id and text count as one; items
    without an id do not take part. An empty benchmark or table gives no rows.
    """
    items = benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).groupBy(F.col(item_text).cast("string").alias("text")).agg(F.min(item_id).cast("long").alias("item"))
    windows = stage(arrow_map(items.select("item", "text"), _item_windows, "item long, at long, length int, key long, windows long, item_slots array<string>"), "item_windows")
    lengths = [r["length"] for r in windows.select("length").distinct().collect()]  # at most WINDOW values
    bitmap = docs.sparkSession.sparkContext.broadcast(key_filter(windows, "key"))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = arrow_map(own, _doc_windows(bitmap, sorted(lengths)), "id long, tkey long, place long, length int, key long, doc_slots array<string>")
    hits = found.distinct().join(windows, ["key", "length"]).withColumn("offset", F.col("place") - F.col("at"))
    slots = F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("item_slots", "doc_slots"))))
    aligned = hits.groupBy("id", "tkey", "item", "windows", "offset").agg(F.collect_set("at").alias("matched"), slots.alias("slots"))
    # Of so many pairs of values at most so many can be one to one as there are values on the poorer side.
    size = F.size("slots")

    def one_to_one(pairs: Column) -> Column:
        return F.least(*(F.size(F.array_distinct(pairs[side])) for side in ("item_slots", "doc_slots"))) >= CONSISTENT * F.size(pairs)

    names = F.filter("slots", lambda s: s["item_slots"].startswith("name="))
    figures = F.filter("slots", lambda s: ~s["item_slots"].startswith("name="))
    changed = F.size(F.filter("slots", lambda s: s["item_slots"] != s["doc_slots"]))
    consistent = aligned.where(one_to_one(names) & one_to_one(figures)).withColumn("changed", changed).withColumn("n_slots", size)
    together = consistent.groupBy("id", "tkey", "item", "windows").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("matched")))).cast("long").alias("n_matched"), F.max("n_slots").alias("n_slots"), F.min("changed").alias("n_changed")
    )
    coverage = F.col("n_matched") / F.col("windows")
    return together.where((coverage >= COVERAGE) | (F.col("n_matched") >= RUN)).select(
        F.col("id").alias("doc_id"), F.col("tkey").alias("text_hash"), F.col("item").alias("item_id"), "n_matched", F.col("windows").alias("n_windows"),
        coverage.alias("coverage"), "n_slots", "n_changed", F.when(F.col("n_changed") > 0, "reparameterised").otherwise("exact").alias("kind"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    bad, a, b = contaminated(docs, benchmark, id_col, text_col), fresh(docs, "bad_id"), fresh(docs, "bad_text")
    bad = bad.select(F.col("doc_id").alias(a), F.col("text_hash").alias(b)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(a)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(b))
    return docs.join(bad, same, "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
