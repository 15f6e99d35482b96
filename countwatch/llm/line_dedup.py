"""Line dedup by a deletion-neighbourhood join (operator 10).

Lines are compared in lower case with white space collapsed; blank ones are never copies. Of equal lines of
``min_equal`` characters or more (by default every line) the earliest stays (by id, hash of the text, place). A line of
``min_chars`` or more also goes if an earlier one is within one edit (one character inserted, deleted or replaced) of it:
of shorter lines too many differ by one character and yet say something else.

Two lines within one edit share their first or their last ``half(q)`` characters, q being the shorter length.
So a line has a key for its first and its last half (for q its own length and one less, mostly the same
half). A line that shares such a key with a different line gets finer ones: what lies outside the half is cut
into ``PIECES`` pieces, all but one of which the edit leaves alone, so a finer key holds everything but one
piece. Only lines that share one of these with a different line emit the deletion neighbourhood, of that
piece alone. A variant's key is a 128-bit hash of the finer key, place and rest of the piece:

- the rest without character p, with p: lines with an equal key differ at p at most, so each of them is a
  copy of the earliest;
- the rest without character p, without p, of the longer line, and the whole rest of the shorter one:
  the shorter line is a copy of the earliest longer one, or they of it.

A key's earliest lines are minima, so no pair inside a group is formed, and a candidate's distance to that
earliest line is verified on the texts before it goes. Lines travel as hashes and places; texts are fetched
for lines with a shared half only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countwatch.llm.common import arrow_map, fresh, key_filter, passes, stage, table, texts

MIN_EQUAL, MIN_CHARS = 1, 20
FILTER_BITS = 1 << 26
#: Pieces of what lies outside a shared half; none is shorter than eight characters.
PIECES = 8
KEYS = ("first_half", "last_half", "first_half_less", "last_half_less")


def normalise(line: str) -> str:
    return " ".join(line.lower().split())


def half(q: int) -> int:
    """At most half of q, in steps, so that neighbouring lengths mostly have the same."""
    step = 4 if q < 128 else 16
    return q // 2 // step * step


def half_keys(x: str) -> list[int | None]:
    """Keys of first and last half for q the length, and for one less where that half is another."""
    n = len(x)
    out: list[int | None] = []
    for h in (half(n), half(n - 1) if half(n - 1) != half(n) else 0):
        out += [xxhash.xxh64_intdigest(x[:h].encode(), 2 * h), xxhash.xxh64_intdigest(x[n - h :].encode(), 2 * h + 1)] if h else [None, None]
    return out


def pieces(x: str, which: int, key: int) -> list[tuple[int, int, str, bool]]:
    """(finer key, number, piece, longer) for one of the half keys: everything but a piece, hashed.

    Pieces are cut on the shorter line's length: the longer line's piece has one character more.
    """
    n = len(x)
    out = []
    for q in (n, n - 1):
        h = half(q)
        if (which < 2) != (q == n) and half(n) != half(n - 1) or not h:
            continue
        rest, r = (x[h:], q - h) if which % 2 == 0 else (x[: n - h], q - h)
        size = max(8, -(-r // PIECES))
        for j, a in enumerate(range(0, r, size)):
            after = max(r - a - size, 0)
            stop = len(rest) - after
            finer = xxhash.xxh64_intdigest(f"{key}:{q}:{j}:{rest[:a]}\n{rest[stop:]}".encode())
            out.append((finer, 2 * j + (q < n), rest[a:stop], q < n))
    return out


def neighbourhood(piece: str, finer: int, longer: bool) -> list[tuple[bytes, int]]:
    """(key, role) of a piece's variants; role 0: replaced at p, 1: the shorter line, 2: the longer line."""
    seed = finer & 0xFFFFFFFFFFFFFFFF
    digest = xxhash.xxh3_128_digest
    if longer:
        return [(digest(v.encode(), seed), 2) for v in dict.fromkeys(piece[:p] + piece[p + 1 :] for p in range(len(piece)))]
    out = [(digest(piece[:p].encode() + b"\xff" + piece[p + 1 :].encode(), seed), 0) for p in range(len(piece))]
    return [*out, (digest(piece.encode(), seed), 1)]


def within_one(a: str, b: str) -> bool:
    """Whether one edit at most turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _longs(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(digests), dtype=">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _lines(batch: pa.RecordBatch, min_chars: int) -> Iterator[tuple[int, int, str]]:
    """(row, place, normalised line) of the lines that are long enough."""
    for i, text in enumerate(texts(batch, "text")):
        for j, line in enumerate(text.split("\n")):
            if len(line) >= min_chars and len(x := normalise(line)) >= min_chars:
                yield i, j, x


def _text_keys(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t.encode(), 42) for t in texts(batch, "text")], dtype=np.uint64).view(np.int64)


def _occurrences(min_equal: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, place, digests, keys = [], [], [], []
            for i, j, x in _lines(batch, min_equal):
                at.append(i)
                place.append(j)
                digests.append(xxhash.xxh3_128_digest(x.encode()))
                keys.append(half_keys(x) if len(x) >= min_chars else [None] * 4)
            h, g = _longs(digests)
            rows = np.array(at, dtype=np.int64)
            four = zip(*keys, strict=True) if keys else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows)), pa.array(_text_keys(batch)[rows]), pa.array(place, pa.int32()), pa.array(h), pa.array(g), *(pa.array(k, pa.uint64()).view(pa.int64()) for k in four)],
                ["id", "tkey", "line", "h", "g", *KEYS],
            )

    return run


def _picked(shared, min_chars: int):
    """Lines with a key that may be shared, with key, place and text; of a block's equal lines the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tkeys, ids = _text_keys(batch), batch.column("id").to_pylist()
            seen: dict[str, tuple] = {}
            for i, j, x in _lines(batch, min_chars):
                order = (ids[i] is None, ids[i] or 0, int(tkeys[i]), j, i)
                if x not in seen or order < seen[x]:
                    seen[x] = order
            rows = [(w, k, o, x) for x, o in seen.items() for w, k in enumerate(half_keys(x)) if k is not None]
            if not rows:
                continue
            keys = np.array([r[1] for r in rows], dtype=np.uint64)
            rows = [rows[i] for i in np.flatnonzero(passes(shared.value, keys)).tolist()]
            if rows:
                which, key, order, x = zip(*rows, strict=True)
                h, g = _longs([xxhash.xxh3_128_digest(t.encode()) for t in x])
                at = np.array([o[4] for o in order])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(which, pa.int32()), pa.array(np.array(key, dtype=np.uint64).view(np.int64)), batch.column("id").take(pa.array(at)), pa.array(tkeys[at]), pa.array([o[3] for o in order], pa.int32()), pa.array(h), pa.array(g), pa.array(x, pa.string())],
                    ["which", "key", "id", "tkey", "line", "h", "g", "x"],
                )

    return run


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            (finer, which, key, number, rank)
            for which, key, rank, x in zip(*(batch.column(c).to_pylist() for c in ("which", "key", "rank", "x")), strict=True)
            for finer, number, _, _ in pieces(x, which, key)
        ]
        if rows:
            finer, which, key, number, rank = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(finer, dtype=np.uint64).view(np.int64)), pa.array(which, pa.int32()), pa.array(key, pa.int64()), pa.array(number, pa.int32()), pa.array(rank, pa.int64())],
                ["finer", "which", "key", "number", "rank"],
            )


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ranks, roles, digests = [], [], []

        def out() -> pa.RecordBatch:
            a, b = _longs(digests)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(roles, pa.int32()), pa.array(ranks, pa.int64())], ["v", "w", "role", "rank"])

        for which, key, number, rank, x in zip(*(batch.column(c).to_pylist() for c in ("which", "key", "number", "rank", "x")), strict=True):
            for finer, own, piece, longer in pieces(x, which, key):
                if own == number:
                    for digest, role in neighbourhood(piece, finer, longer):
                        ranks.append(rank)
                        roles.append(role)
                        digests.append(digest)
            if len(ranks) > 50_000:
                yield out()
                ranks, roles, digests = [], [], []
        if ranks:
            yield out()


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = [within_one(a, b) for a, b in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
        yield batch.select(["h", "g"]).filter(pa.array(near, pa.bool_()))


def place_of() -> Column:
    """The order of lines: by id (null last), hash of the text, line."""
    return F.struct(F.col("id").isNull().alias("nameless"), "id", "tkey", "line")


def near_lines(docs: DataFrame, occurrences: DataFrame, min_chars: int) -> DataFrame:
    """(h, g) of the distinct lines that have an earlier line within one edit."""
    keys = occurrences.select("h", F.explode(F.array(*KEYS)).alias("key")).where("key is not null")
    # Different lines meet under a key where its smallest and largest line hash differ.
    shared = stage(keys.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a != b").select("key"), "shared_halves")
    bitmap = docs.sparkSession.sparkContext.broadcast(key_filter(shared, "key", FILTER_BITS))
    picked = arrow_map(docs, _picked(bitmap, min_chars), "which int, key long, id long, tkey long, line int, h long, g long, x string")
    met = stage(picked.join(shared, "key", "left_semi"), "half_lines")
    # Numbers in the order of first places, so that the earliest line of a group is the least number.
    lines = met.groupBy("h", "g").agg(F.min(place_of()).alias("first"), F.first("x").alias("x"))
    lines = stage(lines.orderBy("first").select("h", "g", "x", F.monotonically_increasing_id().alias("rank")), "ranked_lines")
    halves = met.select("h", "g", "which", "key").distinct().join(lines, ["h", "g"])
    finer = stage(arrow_map(halves.select("which", "key", "rank", "x"), _finer, "finer long, which int, key long, number int, rank long"), "finer_keys")
    alike = finer.groupBy("finer").agg(F.min("rank").alias("a"), F.max("rank").alias("b")).where("a != b").select("finer")
    own = finer.join(alike, "finer", "left_semi").drop("finer").join(lines.select("rank", "x"), "rank")
    variants = stage(arrow_map(own, _variants, "v long, w long, role int, rank long"), "variants")
    least = variants.groupBy("v", "w").agg(*(F.min(F.when(F.col("role") == r, F.col("rank"))).alias(f"m{r}") for r in range(3)), F.count("*").alias("n")).where("n > 1").drop("n")
    earlier = F.when(F.col("role") == 0, F.col("m0")).when(F.col("role") == 1, F.col("m2")).otherwise(F.col("m1"))
    pairs = variants.join(least, ["v", "w"]).withColumn("early", earlier).where("early < rank").select("rank", "early").distinct()
    pairs = pairs.join(lines, "rank").join(lines.select(F.col("rank").alias("early"), F.col("x").alias("y")), "early")
    return arrow_map(pairs.select("h", "g", "x", "y"), _verified, "h long, g long").distinct()


def removed_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_equal: int = MIN_EQUAL) -> DataFrame:
    """(nameless, id, tkey, gone): for each document that loses lines their places; ``docs`` has id and text."""
    if not 1 <= min_equal <= min_chars:
        raise ValueError("lines compared by edits are compared for equality too: 1 <= min_equal <= min_chars")
    occurrences = stage(arrow_map(docs.select("id", "text"), _occurrences(min_equal, min_chars), "id long, tkey long, line int, h long, g long, " + ", ".join(f"{c} long" for c in KEYS)), "lines")
    place = place_of()
    repeated = occurrences.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    near = near_lines(docs.select("id", "text"), occurrences, min_chars)
    none = F.lit(None).cast(repeated.schema["first"].dataType)
    marked = stage(repeated.withColumn("near", F.lit(False)).unionByName(near.select("h", "g", none.alias("first"), F.lit(True).alias("near"))), "marked_lines")
    gone = occurrences.select("id", "tkey", "line", "h", "g").join(marked, ["h", "g"]).where(F.col("near") | ~place.eqNullSafe(F.col("first")))
    return gone.groupBy(F.col("id").isNull().alias("nameless"), F.coalesce("id", F.lit(0)).alias("id"), "tkey").agg(F.collect_set("line").alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_equal: int = MIN_EQUAL) -> DataFrame:
    """``docs`` with the text's copied lines taken out, and n_lines, n_removed (named afresh where taken).

    The other lines keep their order and their own spelling. Null texts stay null, with no line. Rows that
    are equal in id and text count as one and keep the same lines. Rows without an id come after the others.
    An empty table gives no rows.
    """
    spark_docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    removed = removed_lines(spark_docs, min_chars, min_equal)
    names = [fresh(docs, c) for c in ("n_lines", "n_removed")]
    k_null, k_id, k_text, k_gone = (fresh(docs, c) for c in ("nameless", "id", "tkey", "gone"))
    removed = removed.select(F.col("nameless").alias(k_null), F.col("id").alias(k_id), F.col("tkey").alias(k_text), F.col("gone").alias(k_gone))
    own: list[Column] = [F.col(id_col).isNull() == F.col(k_null), F.coalesce(F.col(id_col).cast("long"), F.lit(0)) == F.col(k_id), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(k_text)]
    columns = list(docs.columns)
    joined = docs.join(removed, own[0] & own[1] & own[2], "left").select(*docs.columns, k_gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n, less = [], [], []
            for text, gone in zip(batch.column(text_col).to_pylist(), batch.column(k_gone).to_pylist(), strict=True):
                lines = text.split("\n") if text is not None else []
                if gone:
                    drop = set(gone)
                    text = "\n".join([x for i, x in enumerate(lines) if i not in drop])
                kept.append(text)
                n.append(len(lines))
                less.append(len(gone) if gone else 0)
            arrays = [pa.array(kept, pa.string()) if c == text_col else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n, pa.int64()), pa.array(less, pa.int64())], [*columns, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return arrow_map(joined, run, f"{fields}, " + ", ".join(f"`{n}` long" for n in names))


def without_copied_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_equal: int = MIN_CHARS) -> DataFrame:
    """``docs`` without copied lines; a document of which only white space is left goes, n_chars follows the text.

    Short lines stay unless ``min_equal`` asks for them: "Yes." or a closing bracket is no copy of another document's.
    """
    out = dedup_lines(docs, id_col, text_col, min_equal=min_equal)
    lost = F.col(out.columns[-1])
    out = out.where((lost == 0) | (F.length(F.trim(F.translate(text_col, "\n\t\r", "   "))) > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(lost > 0, F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without copied lines."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_removed")
