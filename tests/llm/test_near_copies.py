import brute
import numpy as np

import corpus_pipeline
from countwatch.llm import near_copies, simhash


def sets_of(texts):
    words = [(t or "").lower().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]


def pairs(sets, least=0.8):
    out = []
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) / len(a | sets[j]) >= least or not (a or sets[j]):
                out.append((i, j))
    return out


def family(n_words, changed, seed):
    """A text and one with words changed in evenly spread places."""
    words = np.random.default_rng(seed).integers(0, 10**9, n_words).astype(str).tolist()
    other = words.copy()
    for k in range(changed):
        other[10 + k * 20] = f"x{seed}y{k}"
    return " ".join(words), " ".join(other)


def test_near_copies_beyond_four_bits_go_and_looser_ones_stay(spark):
    near = [family(120, 2, s) for s in range(30)]  # 106 of 126 shingles: 0.84
    loose = [family(120, 3, s) for s in range(100, 130)]  # 101 of 131: 0.77
    rows = [(2 * i + j, t) for i, pair in enumerate(near + loose) for j, t in enumerate(pair)]
    sets = sets_of([t for _, t in rows])
    assert all(len(sets[2 * i] & sets[2 * i + 1]) / len(sets[2 * i] | sets[2 * i + 1]) >= 0.8 for i in range(30))
    bits = [(simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() for a, b in near]
    assert max(bits) > 4
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    roots = brute.components(len(rows), pairs(sets))
    assert got == set(roots) and len(got) == 90


def test_large_buckets_equal_brute_force(spark):
    base = family(200, 0, 1)[0].split()
    texts = []
    for i in range(60):  # two balls whose centres are apart, cut in rounds
        words = base[:150] + [f"own{i % 2}w{k}" for k in range(80 * (i % 2))] + base[150:]
        texts.append(" ".join([*words[: 30 + i], f"odd{i}", *words[31 + i :]]))
    rows = [*enumerate(texts), (90, None), (91, " "), (None, texts[0]), (5, "another text of id five here"), (5, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in near_copies.keep_first(docs, bucket=4).collect())
    roots = brute.components(60, pairs(sets_of(texts)))
    assert got == sorted([(False, r) for r in {*roots, 5, 90}] + [(True, 0)])


def test_equals_brute_force_on_documents(spark, sf_small):
    docs = spark.read.parquet(sf_small + "/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    roots = brute.components(len(rows), pairs(sets_of([r.text for r in rows])))
    assert {r.doc_id for r in near_copies.keep_first(docs).collect()} == {rows[r].doc_id for r in roots}
