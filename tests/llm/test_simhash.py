import brute
import numpy as np
import xxhash
from pyspark.sql import functions as F

from countwatch.llm import simhash
from countwatch.llm.common import forest, key_filter, passes
from countwatch.llm.components import components


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints_follow_the_contract():
    for text in ["", "One", "a b  C\td", "É é a\x0bb\x0c c d e A B", "x " * 50 + "y", "a b c d e"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    assert spark.createDataFrame([("aé b",)], "s string").select(F.xxhash64("s")).first()[0] == np.uint64(xxhash.xxh64_intdigest("aé b".encode(), 42)).astype(np.int64)


def test_tree_search_finds_the_components_of_all_pairs():
    rng = np.random.default_rng(0)
    seeds = rng.integers(0, 2**63, 60, dtype=np.uint64)
    ball = np.array([seeds[0] ^ np.uint64((1 << i) | (1 << j)) for i in range(25) for j in range(25)])
    codes = np.unique(np.concatenate([seeds, seeds[:30] ^ np.uint64(7), seeds[:20] ^ np.uint64(31), ball]))
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    sizes = np.array([100, 1, len(codes) - 101])
    tree = np.repeat(np.arange(3), sizes)
    near = (np.bitwise_count(codes[:, None] ^ codes[None]) <= 4) & (tree[:, None] == tree[None])
    found = [(i, j) for x, y in simhash.near_pairs(codes, sizes) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
    assert all(near[i, j] for i, j in found)
    assert brute.components(len(codes), found) == brute.components(len(codes), zip(*np.nonzero(near), strict=True))


def compare(rows, docs):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    codes = np.array([plain_fingerprint(t) for _, t in docs], dtype=np.uint64)
    near = np.bitwise_count(codes[:, None] ^ codes[None]) <= 4
    roots = brute.components(len(docs), zip(*np.nonzero(near), strict=True))
    for (d, _), code, root in zip(docs, codes.tolist(), roots, strict=True):
        least = min((docs[i][0] for i in range(len(docs)) if roots[i] == root and docs[i][0] is not None), default=None)
        assert got[(d, f"{code:016x}")] == least


def test_equals_brute_force_on_documents(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    rows = simhash.op1_simhash(spark, sf_small).collect()
    compare(rows, [tuple(r) for r in docs.collect()])


def test_small_nodes_are_split_without_losing_links(spark):
    base = " ".join(f"w{i}" for i in range(80))
    docs = [(i, base + f" tail{i}") for i in range(150)] + [(200 + i, f"other {i} text of its own number {i * i}") for i in range(30)]
    rows = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), node_rows=3).collect()
    compare(rows, docs)
    assert len({r.component_id for r in rows if r.doc_id < 200}) < 100


def test_nulls_empties_ties_and_clashing_columns(spark):
    long = "very long " * 30_000
    docs = [(5, None), (3, ""), (9, " \n"), (None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "alone here"), (1, long), (2, long)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, fp int, component string")
    rows = simhash.near_duplicates(df).collect()
    assert len(rows) == len(docs)
    compare(rows, docs)
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {3}
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 7]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_first(df.limit(0)).count() == 0


def test_components_of_a_path_a_star_and_a_cycle(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(50)] + [(300, 301), (301, 302), (302, 300), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got[i] for i in range(41)) == {0} and set(got[100 + i] for i in range(51)) == {100} and got[302] == 300
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_and_filter(spark):
    a, b = forest(np.array([5, 3, 9, 9]), np.array([3, 1, 9, 10]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(3, 1), (5, 1), (10, 9)]
    keys = spark.range(0, 5000).select(F.xxhash64("id").alias("k"))
    own = np.array([r.k for r in keys.collect()]).view(np.uint64)
    bitmap = key_filter(keys, "k", 1 << 16)
    assert passes(bitmap, own).all() and passes(bitmap, np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64)).mean() < 0.2
