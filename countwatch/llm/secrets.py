"""Secret scans with multipart credential linking (operator 4).

Base findings are strong enough alone: an assignment to a secret's name, an access key, a long
hexadecimal run. Weak candidates are parts of a credential that mean little alone: an identifier
(user, client or key id), a secret under a vague name, an endpoint. They are reported only where the
parts that complete them lie in the same scope: an identifier beside a secret, a secret beside an
identifier, an endpoint beside both. A scope is a paragraph (between blank lines), however long; distance
inside it does not part a credential.

Parts never link across documents, so the interval join runs where a document is read: each role's
intervals are sorted by start with the running maximum of their ends, and one binary search tells
whether any interval of that role overlaps a part's reach. Nothing is shuffled, no pair is built, and
a document's cost grows with its own parts only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countwatch.llm.common import arrow_map, table, texts

# The base patterns and the least number of characters they need.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24

# Names under which parts of a credential appear.
IDENTIFIER = re.compile(
    r"""(?<![A-Za-z0-9])(?:(?:aws_)?access_?key_?id|client_?id|account_?id|key_?id|app_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})""",
    re.ASCII | re.IGNORECASE,
)
VAGUE = re.compile(
    r"""(?<![A-Za-z0-9])(?:pwd|pass|passphrase|private_?key|access_?key|signing_?key|auth|credentials?|key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})""",
    re.ASCII | re.IGNORECASE,
)
ENDPOINT = re.compile(
    r"""(?:https?|ftps?|ssh|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s3|jdbc:[a-z]+)://[A-Za-z0-9.@:_-]+"""
    r"""|(?<![A-Za-z0-9])(?:host|hostname|endpoint|server|base_?url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+""",
    re.ASCII | re.IGNORECASE,
)
BLANK_LINE = re.compile(r"\n[ \t\r]*\n")
KINDS = ("assign", "access", "hex", "weak_identifier", "weak_secret", "weak_endpoint")
_HEX_RUN = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_IDENTIFIER_WORDS = ("id", "user", "login")

Span = tuple[int, int, int]  # kind's place in KINDS, start, end


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base pattern that are long enough, in order."""
    out: list[Span] = []
    low = text.lower()
    # Substring tests are far cheaper than the patterns, and no match lacks them.
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    if b"x" * HEX_CHARS in text.encode("utf-8", "surrogatepass").translate(_HEX_RUN):
        out += [(2, m.start(), m.end()) for m in LONG_HEX.finditer(text)]  # a maximal run, so the length test is in the pattern
    return sorted(out, key=lambda s: (s[1], s[0]))


@dataclass
class Role:
    """Intervals of one role, ready to be asked whether any overlaps a range."""

    starts: np.ndarray
    furthest: np.ndarray

    @classmethod
    def of(cls, spans: list[Span]) -> "Role":
        spans = sorted(spans, key=lambda s: s[1])
        return cls(np.array([s[1] for s in spans], dtype=np.int64), np.maximum.accumulate(np.array([s[2] for s in spans], dtype=np.int64)))

    def meets(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each range, whether an interval starts before ``high`` and ends after ``low``."""
        last = np.searchsorted(self.starts, high, "left") - 1
        return (last >= 0) & (self.furthest[np.maximum(last, 0)] > low) if len(self.starts) else np.zeros(len(low), dtype=bool)


def weak_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak parts that complementary parts of the same scope complete; none overlaps a base span."""
    strong_ids = [s for s in base if s[0] == 1]
    low = text.lower()
    if not strong_ids and not any(w in low for w in _IDENTIFIER_WORDS):
        return []
    taken = Role.of(base)

    def found(kind: int, pattern: re.Pattern[str]) -> list[Span]:
        spans = [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
        if not spans:
            return spans
        hit = taken.meets(np.array([s[1] for s in spans]), np.array([s[2] for s in spans]))
        return [s for s, h in zip(spans, hit, strict=True) if not h]

    identifiers = found(3, IDENTIFIER)
    if not strong_ids and not identifiers:
        return []
    secrets = found(4, VAGUE)
    strong_secrets = [s for s in base if s[0] != 1]
    if not secrets and not strong_secrets:
        return []
    endpoints = found(5, ENDPOINT) if "://" in text or "." in text else []
    ids, keys = Role.of(strong_ids + identifiers), Role.of(strong_secrets + secrets)
    cuts = np.array([0, *(m.start() for m in BLANK_LINE.finditer(text)), len(text)], dtype=np.int64)

    def range_of(spans: list[Span]) -> tuple[np.ndarray, np.ndarray]:
        start, end = np.array([s[1] for s in spans]), np.array([s[2] for s in spans])
        at = np.searchsorted(cuts, start, "right")
        return cuts[at - 1], np.maximum(cuts[np.minimum(at, len(cuts) - 1)], end)

    out: list[Span] = []
    for spans, roles in ((identifiers, (keys,)), (secrets, (ids,)), (endpoints, (ids, keys))):
        if spans:
            low_at, high_at = range_of(spans)
            ok = np.logical_and.reduce([r.meets(low_at, high_at) for r in roles])
            out += [s for s, good in zip(spans, ok, strict=True) if good]
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): one row per document, spans sorted by start, then kind.

    Each span is (kind, start, end, matched) with code points, end exclusive, and its text. Null texts
    read as empty; repeated rows stay repeated; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in texts(batch, "text"):
                base = base_spans(text)
                rows.append([
                    {"kind": KINDS[k], "start": a, "end": b, "matched": text[a:b]}
                    for k, a, b in sorted(base + weak_spans(text, base), key=lambda s: (s[1], s[0]))
                ])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return arrow_map(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")),
        run,
        "doc_id long, spans array<struct<kind: string, start: long, end: long, matched: string>>",
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans of every document."""
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id", *(count(k) for k in KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["kind"].isin(*KINDS[:3]))).cast("long").alias("n_weak"),
    )
