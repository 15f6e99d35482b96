import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from countwatch.llm import sentencepieces as sp


def small(words, scores):
    ids = {w.encode(): i for i, w in enumerate(words)}
    n = len(words)
    byte_ids = np.arange(n, n + 256, dtype=np.int32)
    return sp.build(ids, np.array([*scores, *[0.0] * 256]), [w.encode() for w in words] + [bytes([i]) for i in range(256)], byte_ids)


WORDS = ["a", "b", "ab", "aba", "bb", " a", " ab", " ", "  ", "é", "abé"]
VOCABULARY = small(WORDS, [-3.0, -3.2, -4.1, -6.5, -5.0, -2.5, -5.2, -4.0, -4.5, -6.0, -7.7])


def best_score(p, words, data: str) -> float:
    """The best sum over all segmentations into pieces and unknown characters."""
    best = [0.0] + [-np.inf] * len(data)
    for i in range(len(data)):
        for w in words:
            if data.startswith(w, i):
                best[i + len(w)] = max(best[i + len(w)], best[i] + p.scores[words.index(w)])
        if data[i] not in words:
            best[i + 1] = max(best[i + 1], best[i] + p.unknown)
    return best[-1]


def score_of(p, ids, n_pieces):
    total, at = 0.0, 0
    while at < len(ids):
        if ids[at] < n_pieces:
            total += p.scores[ids[at]]
            at += 1
        else:
            lead = ids[at] - n_pieces
            at += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            total += p.unknown
    return total


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é▁z\n", max_size=14))
def test_segmentation_has_the_best_score(text):
    ids = sp.Encoder(VOCABULARY).encode([text])[0].tolist()
    assert sp.decode(VOCABULARY, np.array(ids)) == text
    if text:
        assert score_of(VOCABULARY, ids, len(WORDS)) == pytest.approx(best_score(VOCABULARY, WORDS, " " + text))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abé z▁", min_size=1, max_size=20), min_size=1, max_size=12))
def test_many_at_once_equal_one_by_one(texts):
    data = [t.encode() for t in texts]
    assert sp.viterbi_many(VOCABULARY, data) == [sp.viterbi_one(VOCABULARY, d) for d in data]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_round_trip_with_the_public_vocabulary(text):
    p = sp.load()
    assert sp.decode(p, sp.Encoder(p).encode([text])[0]) == text


def test_pieces_over_spaces_are_solved_whole():
    words = [*WORDS, "a b"]
    p = small(words, [*VOCABULARY.scores[: len(WORDS)], -1.0])
    assert not p.split
    ids = sp.Encoder(p).encode(["ba b"])[0].tolist()
    assert words.index("a b") in ids and score_of(p, ids, len(words)) == pytest.approx(best_score(p, words, " ba b"))


def test_double_array_holds_exactly_its_words():
    rng = np.random.default_rng(0)
    words = {bytes(rng.integers(0, 256, rng.integers(1, 5)).astype(np.uint8).tolist()): i for i in range(500)}
    base, check, value = sp.double_array(words)

    def find(word):
        s = 0
        for c in word:
            t = base[s] + c
            if check[t] != s:
                return -1
            s = t
        return value[s]

    assert all(find(w) == i for w, i in words.items())
    for _ in range(2000):
        w = bytes(rng.integers(0, 256, 3).astype(np.uint8).tolist())
        assert find(w) == words.get(w, -1)


def test_worker_memory_is_bounded():
    e = sp.Encoder(VOCABULARY, remembered=50)
    for i in range(20):
        block = [f"{'ab' * (i % 5 + 1)} {k}" for k in range(20)]
        assert all(sp.decode(VOCABULARY, x) == t for x, t in zip(e.encode(block), block, strict=True))
    assert len(e.known) <= 50


def test_encode_rows(spark):
    rows = [(1, "Hello  world\n", 5), (2, None, 6), (3, "", 7), (None, "x" * 50_000, 8), (1, "Hello  world\n", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = sp.encode(df)
    assert out.columns == ["doc_id", "text", "ids", "ids_", "n_pieces", "n_byte_pieces", "round_trip"]
    got = out.collect()
    assert len(got) == 5 and all(r.round_trip and len(r.ids_) == r.n_pieces for r in got)
    back = {(r.doc_id, r.decoded) for r in sp.decoded(out, "ids_").collect()}
    assert back == {(1, "Hello  world\n"), (2, ""), (3, ""), (None, "x" * 50_000)}
    assert sp.encode(df.limit(0)).count() == 0


def test_query_round_trips(spark, sf_small):
    rows = sp.op8_sentencepiece(spark, sf_small)
    assert rows.where("not round_trip or size(ids) != n_pieces").count() == 0 and rows.count() == 200
