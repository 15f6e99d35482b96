"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie (operator 8).

The vocabulary file is read once on the driver and its trie broadcast (a few MB, bounded by the
file). Pieces are stored as UTF-8 bytes with the white-space marker as a plain space, so a literal
marker character in a text is an unknown character like any other and survives the round trip.

Encoding puts one space before a non-empty text and finds the segmentation with the largest sum of log
scores; of equal sums, at each position, the one whose last piece is longest. A character that is
no piece by itself costs the smallest score less ten and becomes its bytes. No piece continues over
a space that follows another character (checked when the file is read), so the best path of a text
is the best paths of its runs "spaces, then non-spaces" in order. Each worker remembers runs it has
met; the new ones of a block are solved together, one byte of all of them per numpy step.

Scores are the file's where it holds log probabilities. A merge-ranked file has ranks instead:
rank r then gets the log of a Zipf probability, 1 / (r + 1) normalised.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countwatch.llm.common import arrow_map, fresh, table, texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Runs a worker remembers; when full, it starts anew.
REMEMBERED = 500_000
#: Runs of more bytes are solved one by one.
TOGETHER = 100
BLOCK_CHARS = 1_000_000
UNKNOWN_PENALTY = 10.0
RUN = re.compile(r" ( *[^ ]*)")


@dataclass(frozen=True)
class Pieces:
    """A vocabulary: pieces as bytes by id, scores, byte ids, and the double array over the pieces."""

    pieces: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray
    unknown: float
    split: bool
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


def double_array(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value): from state s a byte c leads to t = base[s] + c if check[t] = s; value[t] is an id or -1."""
    children: list[dict[int, int]] = [{}]
    ids = [-1]
    for word, i in words.items():
        node = 0
        for c in word:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                ids.append(-1)
            node = children[node][c]
        ids[node] = i
    size = len(children) + (1 << 16)
    free = np.ones(size, dtype=bool)
    free[0] = False
    first = 1
    place, offset = {0: 0}, {}
    # Wide nodes first, while the array is empty; the many narrow ones then fill the gaps.
    for n in sorted((n for n in range(len(children)) if children[n]), key=lambda n: -len(children[n])):
        own = np.array(sorted(children[n]))
        first += int(np.argmax(free[first:]))
        b = max(1, first - int(own[0]))
        while True:
            if b + 256 + 4096 >= len(free):
                free = np.concatenate([free, np.ones(1 << 16, dtype=bool)])
            fits = np.logical_and.reduce([free[b + c : b + c + 4096] for c in own])
            if fits.any():
                b += int(np.argmax(fits))
                break
            b += 4096
        offset[n] = b
        free[b + own] = False
        for c in own.tolist():
            place[children[n][c]] = b + c
    # 256 more than the last state can reach, so that an absent byte fails instead of overflowing.
    size = max(place.values()) + 257
    base, check, value = np.zeros(size, dtype=np.int32), np.full(size, -1, dtype=np.int32), np.full(size, -1, dtype=np.int32)
    for n, b in offset.items():
        base[place[n]] = b
        for c, child in children[n].items():
            check[b + c] = place[n]
            value[b + c] = ids[child]
    return base, check, value


def build(words: dict[bytes, int], scores: np.ndarray, pieces: list[bytes], byte_ids: np.ndarray) -> Pieces:
    base, check, value = double_array(words)
    split = not any(b" " in w.lstrip(b" ") for w in words)
    lowest = float(min((scores[i] for i in words.values()), default=0.0))
    return Pieces(pieces, scores, byte_ids, lowest - UNKNOWN_PENALTY, split, base, check, value)


@lru_cache(maxsize=4)
def load(path: str = MODEL) -> Pieces:
    """Read a SentencePiece file with byte fallback."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces, byte_ids, words = [b""] * n, np.full(256, -1, dtype=np.int32), {}
    scores = np.array([sp.get_score(i) for i in range(n)], dtype=np.float64)
    for i in range(n):
        name = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
            pieces[i] = bytes([int(name[3:5], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces[i] = name.replace("▁", " ").encode()
            words[pieces[i]] = i
    if (byte_ids < 0).any():
        raise ValueError(f"{path} has no byte fallback")
    own = np.array(sorted(words.values()))
    if (scores[own] == np.round(scores[own])).all():  # merge ranks
        weights = 1.0 / (1.0 - scores[own])
        scores[own] = np.log(weights / weights.sum())
    return build(words, scores, pieces, byte_ids)


def viterbi_one(p: Pieces, data: bytes) -> list[int]:
    """The best segmentation of one run, byte by byte."""
    n = len(data)
    best, back, ids = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    base, check, value, scores = p.base, p.check, p.value, p.scores
    for s in range(n):
        if best[s] == -np.inf:
            continue
        end = s + 1
        while end < n and data[end] & 0xC0 == 0x80:
            end += 1
        state, at, single = 0, s, False
        while at < n:
            to = base[state] + data[at]
            if check[to] != state:
                break
            state, at = to, at + 1
            if value[state] >= 0:
                single |= at == end
                score = best[s] + scores[value[state]]
                if score > best[at]:
                    best[at], back[at], ids[at] = score, s, int(value[state])
        if not single and best[s] + p.unknown > best[end]:
            best[end], back[end], ids[end] = best[s] + p.unknown, s, -1
    return _trace(p, data, back, ids)


def _trace(p: Pieces, data: bytes, back: list[int], ids: list[int]) -> list[int]:
    out: list[int] = []
    at = len(data)
    while at:
        s = back[at]
        if ids[at] >= 0:
            out.append(ids[at])
        else:
            out += [int(p.byte_ids[c]) for c in reversed(data[s:at])]
        at = s
    return out[::-1]


def viterbi_many(p: Pieces, runs: list[bytes]) -> list[list[int]]:
    """As ``viterbi_one`` for many short runs at once."""
    w = len(runs)
    lengths = np.fromiter(map(len, runs), np.int64, w)
    width = int(lengths.max())
    data = np.zeros((w, width + 1), dtype=np.int64)
    flat = np.frombuffer(b"".join(runs), dtype=np.uint8)
    row = np.repeat(np.arange(w), lengths)
    data[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    best = np.full((w, width + 1), -np.inf)
    best[:, 0] = 0.0
    back, ids = np.zeros((w, width + 1), dtype=np.int64), np.full((w, width + 1), -1, dtype=np.int64)
    for s in range(width):
        row = np.flatnonzero((lengths > s) & (best[:, s] > -np.inf))
        if not len(row):
            continue
        end = np.full(len(row), s + 1)
        for step in range(s + 1, min(s + 4, width)):
            end += (end == step) & (step < lengths[row]) & (data[row, step] & 0xC0 == 0x80)
        single = np.zeros(w, dtype=bool)
        ends = np.zeros(w, dtype=np.int64)
        ends[row] = end
        all_rows, state = row, np.zeros(len(row), dtype=np.int64)
        for at in range(s, width):
            to = p.base[state] + data[row, at]
            ok = (p.check[to] == state) & (lengths[row] > at)
            row, state = row[ok], to[ok]
            if not len(row):
                break
            i = p.value[state]
            hit = i >= 0
            r, i = row[hit], i[hit]
            single[r] |= ends[r] == at + 1
            score = best[r, s] + p.scores[i]
            up = score > best[r, at + 1]
            r = r[up]
            best[r, at + 1], back[r, at + 1], ids[r, at + 1] = score[up], s, i[up]
        row = all_rows[~single[all_rows]]
        score, end = best[row, s] + p.unknown, ends[row]
        up = score > best[row, end]
        row, end = row[up], end[up]
        best[row, end], back[row, end], ids[row, end] = score[up], s, -1
    return [_trace(p, d, b, i) for d, b, i in zip(runs, back.tolist(), ids.tolist(), strict=True)]


class Encoder:
    """Encodes texts with one vocabulary, remembering runs."""

    def __init__(self, pieces: Pieces, remembered: int = REMEMBERED) -> None:
        self.p, self.remembered = pieces, remembered
        self.known: dict[str, bytes] = {}

    def runs(self, text: str) -> list[str]:
        """The runs of a text, each without its first space."""
        if not text:
            return []
        if not self.p.split:
            return [text]
        if "  " in text or text[0] == " " or text[-1] == " ":
            return RUN.findall(" " + text)
        return text.split(" ")

    def learn(self, wanted: set[str]) -> None:
        if len(self.known) + len(wanted) > self.remembered:
            self.known = {}
        new = [x for x in wanted if x not in self.known]
        short = sorted((x for x in new if len(x) < TOGETHER // 4), key=len)
        long = [x for x in new if len(x) >= TOGETHER // 4]
        for x in long:
            self.known[x] = np.array(viterbi_one(self.p, (" " + x).encode()), dtype=np.int32).tobytes()
        for i in range(0, len(short), 4096):
            block = short[i : i + 4096]
            for x, ids in zip(block, viterbi_many(self.p, [(" " + x).encode() for x in block]), strict=True):
                self.known[x] = np.array(ids, dtype=np.int32).tobytes()

    def encode(self, block: list[str]) -> list[np.ndarray]:
        cut = [self.runs(t) for t in block]
        self.learn(set().union(*cut))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, c)), dtype=np.int32) for c in cut]


def decode(p: Pieces, ids: np.ndarray) -> str:
    """Pieces joined, bytes put together, the first space taken off; bytes that are no UTF-8 read as U+FFFD."""
    pieces = p.pieces
    joined = b"".join([pieces[i] for i in ids.tolist()])
    return (joined[1:] if joined[:1] == b" " else joined).decode("utf-8", "replace")


_encoders: dict[int, Encoder] = {}


def _encoder(broadcast) -> Encoder:
    key = id(broadcast.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(broadcast.value)
    return _encoders[key]


def blocks(all_texts: list[str], chars: int = BLOCK_CHARS) -> Iterator[list[str]]:
    held, n = [], 0
    for t in all_texts:
        held.append(t)
        n += len(t)
        if n >= chars:
            yield held
            held, n = [], 0
    if held:
        yield held


def encode(docs: DataFrame, text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``docs`` with ids (array of int), n_pieces, n_byte_pieces and round_trip, named afresh where taken.

    ``round_trip`` says whether decoding the ids gives the text back. Null and empty texts have no
    pieces. Repeated rows stay repeated.
    """
    p = load(model)
    shared = docs.sparkSession.sparkContext.broadcast(p)
    names = [fresh(docs, c) for c in ("ids", "n_pieces", "n_byte_pieces", "round_trip")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        is_byte = np.zeros(len(encoder.p.pieces), dtype=bool)
        is_byte[encoder.p.byte_ids] = True
        for batch in batches:
            start = 0
            for block in blocks(texts(batch, text_col)):
                ids = encoder.encode(block)
                counts = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.concatenate(ids) if len(ids) else np.zeros(0, dtype=np.int32)
                offsets = np.concatenate([[0], np.cumsum(counts)])
                in_bytes = np.concatenate([[0], np.cumsum(is_byte[flat])])
                back = [decode(encoder.p, i) == t for i, t in zip(ids, block, strict=True)]
                arrays = [
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())),
                    pa.array(counts),
                    pa.array(in_bytes[offsets[1:]] - in_bytes[offsets[:-1]]),
                    pa.array(back),
                ]
                own = batch.slice(start, len(block))
                start += len(block)
                yield pa.RecordBatch.from_arrays([*own.columns, *arrays], [*own.schema.names, *names])

    kinds = ("array<int>", "long", "long", "boolean")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return arrow_map(docs, run, ", ".join([*fields, *(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))]))


def decoded(rows: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``rows`` with the text of their ids in ``decoded``; null ids read as none. Ids outside the vocabulary fail."""
    shared = rows.sparkSession.sparkContext.broadcast(load(model))
    name = fresh(rows, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [decode(shared.value, np.array(x or [], dtype=np.int64)) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return arrow_map(rows, run, f"{fields}, `{name}` string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding gives its text back."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), "text")
    return encode(docs).drop("text")
