"""Merkle manifest against a plain tree, and against its DuckDB text."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from countwatch.llm import merkle
from countwatch.llm.common import fold
from oracle import connect, difference

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row):
    doc, text, lang, source, n = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def grow(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = grow([leaf_of(r) for r in groups[g]])
    top = grow([trees[g][-1][0] for g in order])
    root = top[-1][0] if order else None
    out = []
    for k, g in enumerate(order):
        for p, r in enumerate(groups[g]):
            now = leaf_of(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                now = leaf_of((r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:]))
            siblings = []
            for levels, q in ((trees[g], p), (top, k)):
                for level in levels[:-1]:
                    run = level[q // 8 * 8 : q // 8 * 8 + 8]
                    siblings += run[: q % 8] + run[q % 8 + 1 :]
                    run[q % 8] = now
                    now = sha("".join(run))
                    q //= 8
            out.append((r[0], leaf_of(r), trees[g][-1][0], root, sha("".join(siblings)), now, now == root))
    return sorted(out, key=str)


def checked(df):
    return sorted((tuple(r) for r in merkle.manifest(df, fold(F.col("doc_id"), 3) == 0).collect()), key=str)


def rows_of(n, lang):
    return [(i, f"Text {i} É\nZ" if i % 5 else None, lang, f"s{i % 3}" if i % 7 else None, i if i % 4 else None) for i in range(n)]


@pytest.mark.parametrize("sizes", [(1,), (8,), (9, 1), (64, 65), (512, 513), (1300, 3, 1)])
def test_against_a_plain_tree(spark, sizes):
    rows = [r for g, n in enumerate(sizes) for r in rows_of(n, None if g == 1 else f"l{g}")]
    assert checked(spark.createDataFrame(rows, SCHEMA).repartition(3)) == plain(rows)


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [
        (None, "A", "en", None, None), (None, None, None, None, None), (None, "A", "en", None, None), (3, "", "", "", 0), (3, "x", "en", "s", 1),
        (3, "W", "en", "s", 1), *[(3, "Same", "en", "s", 4)] * 40, (9, "Long É " * 200_000, "en", "s", 1), (-5, "ÀB", "é", "ü", -1),
    ]
    assert checked(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_more_languages_than_a_run(spark):
    rows = [(i, f"T{i}", f"lang{i % 75}", "s", 1) for i in range(300)]
    assert checked(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_only_altered_texts_fail(spark):
    rows = [(i, "lower" if i % 2 else "Upper", "en", "s", 5) for i in range(100)]
    got = {r.doc_id: r.verified for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA), fold(F.col("doc_id"), 3) == 0).collect()}
    assert got == {i: not (zlib.crc32(str(i).encode()) % 3 == 0 and i % 2 == 0) for i in range(100)}
    assert all(r.verified for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect())


def test_empty_and_clashing_columns(spark):
    assert checked(spark.createDataFrame([], SCHEMA)) == []
    rows = rows_of(20, "en")
    wide = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], f"{SCHEMA}, leaf string, DOC_ID string, pos int, at int")
    assert checked(wide) == plain(rows)


def test_query(spark, sf_small):
    assert difference(merkle.op11_merkle(spark, sf_small), connect(sf_small), merkle.OP11_SQL) is None
