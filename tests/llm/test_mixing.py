"""Mixing against a plain version, and against its DuckDB text."""

import hashlib
import math
import re

import pytest

from countwatch.llm import mixing
from oracle import connect, difference

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def size_of(text):
    return len(re.findall(mixing.WORD, text or ""))


def weight_of(text):
    n = size_of(text)
    if text is None:
        return 1
    marks = sum(c in mixing.OTHER for c in text)
    letters = sum(c not in mixing.OTHER + mixing.SPACE for c in text)
    ends = sum(c in ".!?" for c in text)
    return 1 + (n > 0 and 2 * n <= letters <= 12 * n) + (n > 0 and marks * 8 <= len(text)) + (ends > 0 and ends * 40 >= n)


def shared_out(sizes):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            open_.remove(s)
        left -= sum(target[s] for s in over)
    return target


def draw(doc, text):
    bits = int(hashlib.md5(f"{mixing.SEED}:{'null' if doc is None else doc}".encode()).hexdigest()[:13], 16)
    return -math.log((bits + 0.5) / (1 << 52)) / weight_of(text)


def plain(rows):
    groups = {}
    for doc, text, _, source, _ in rows:
        groups.setdefault(source, []).append((draw(doc, text), doc is not None, doc or 0, size_of(text), doc))
    sizes = {s: sum(d[3] for d in docs) for s, docs in groups.items()}
    target = shared_out(sizes)
    out = []
    for s, docs in groups.items():
        epochs = math.floor(target[s] / sizes[s] + 1e-12) if sizes[s] else 0
        left = math.floor(target[s] - epochs * sizes[s] + 1e-9)
        for _, _, _, n, doc in sorted(docs, key=lambda d: d[:4]):
            out.append((doc, n, sizes[s], round(target[s], 6), epochs * n + max(0, min(n, left))))
            left -= n
    return sorted(out, key=str)


def mixed(df, **more):
    return sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(df, **more).collect()), key=str)


@pytest.mark.parametrize("sources", [1, 2, 3, 7, 40])
def test_against_a_plain_version(spark, sources):
    rows = [(i, "Some words. " * (i * 37 % 23 + 1), "en", None if i % sources == 1 else f"s{i % sources:02d}", 1) for i in range(300)]
    assert mixed(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows)


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [
        (None, None, None, None, None), (None, "a b", None, None, None), (1, "", "en", "a", 0), (1, " \t\x0b ", "en", "a", 0), (1, "x y z", "en", "a", 1), (1, "x y", "en", "a", 1),
        *[(2, "a b c d e. 1", "en", "hot", 1)] * 50, (3, "word " * 300_000, "en", "hot", 1), (4, None, "en", "nothing", 1), (5, "é ü b", "en", "ü", 1),
    ]
    got = mixed(spark.createDataFrame(rows, SCHEMA))
    assert got == plain(rows)


def test_bounds_and_reruns(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    got = mixed(docs)
    assert got == mixed(docs.repartition(3)) == mixed(docs.orderBy("text"))
    assert all(0 <= taken <= 2 * n for _, n, _, _, taken in got)
    rows = {r.doc_id: r.source for r in docs.collect()}
    taken, target = {}, {}
    for doc, _, _, t, k in got:
        taken[rows[doc]] = taken.get(rows[doc], 0) + k
        target[rows[doc]] = t
    assert all(0 <= target[s] - taken[s] < 1 + 1e-6 for s in target)


def test_better_documents_come_sooner(spark):
    rows = [(i, "Plain words that read well. " * 4 if i % 2 else "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0", "en", "s", 1) for i in range(2000)]
    got = {doc: (n, k) for doc, n, _, _, k in mixed(spark.createDataFrame(rows, SCHEMA), share=0.5)}
    good, poor = (sum(k > 0 for d, (_, k) in got.items() if d % 2 == odd) for odd in (1, 0))
    assert good > 1.5 * poor


def test_every_source_at_its_bound(spark):
    rows = [(i, "a b c", "en", f"s{i % 3}", 1) for i in range(30)]
    assert {(n, t, k) for _, n, _, t, k in mixed(spark.createDataFrame(rows, SCHEMA), share=5.0)} == {(3, 60.0, 6)}


def test_empty_and_clashing_columns(spark):
    assert mixed(spark.createDataFrame([], SCHEMA)) == []
    rows = [(i, "a b " * i, "en", f"s{i % 3}", 1) for i in range(20)]
    wide = spark.createDataFrame([(*r, 1, "y", 2, 3) for r in rows], f"{SCHEMA}, size int, SOURCE string, at int, draw int")
    assert mixed(wide) == plain(rows)


def test_native(spark, sf_small):
    plan = mixing.op12_mix(spark, sf_small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_query(spark, sf_small):
    assert difference(mixing.op12_mix(spark, sf_small), connect(sf_small), mixing.OP12_SQL) is None
