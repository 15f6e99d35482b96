import random

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from countwatch.llm import line_dedup


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abé", max_size=9), st.text(alphabet="abé", max_size=9))
def test_within_one_edit(a, b):
    assert line_dedup.within_one(a, b) == (brute.edits(a, b) <= 1)


def mutated(rnd, s):
    for _ in range(rnd.choice([0, 1, 1, 1, 2])):
        i, how = rnd.randrange(len(s) + 1), rnd.randrange(3)
        s = s[:i] + rnd.choice("abcz") + s[i:] if how == 0 else s[: max(i - 1, 0)] + s[i:] if how == 1 else s[: max(i - 1, 0)] + rnd.choice("abq") + s[i:]
    return s


def random_docs(seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abc é") for _ in range(rnd.choice([20, 21, 23, 24, 60, 127, 128, 129]))) for _ in range(14)] + ["a" * 22, "a" * 23, "a" * 24]
    return [(i, "\n".join(mutated(rnd, rnd.choice(base)) for _ in range(rnd.randrange(1, 5)))) for i in range(60)]


def test_every_pair_within_one_edit_meets():
    """Two lines share a variant in matching roles exactly where they are within one edit."""
    lines = sorted({line_dedup.normalise(x) for _, t in random_docs(5) for x in t.split("\n")})
    lines = [x for x in lines if len(x) >= line_dedup.MIN_CHARS]
    variants = []
    for x in lines:
        finer = [f for w, k in enumerate(line_dedup.half_keys(x)) if k is not None for f in line_dedup.pieces(x, w, k)]
        variants.append({v for key, _, piece, longer in finer for v in line_dedup.neighbourhood(piece, key, longer)})
    for i, a in enumerate(lines):
        for j in range(i):
            meet = any((v, {0: 0, 1: 2, 2: 1}[r]) in variants[j] for v, r in variants[i])
            assert meet == (brute.edits(a, lines[j]) <= 1)


def test_equals_brute_force(spark):
    for seed, min_equal in ((3, 1), (4, 20), (5, 6)):
        docs = random_docs(seed) + [(60, None), (61, ""), (62, "short\nshort\n"), (63, "Short\nshor\n}\n}"), (64, " }\n\n \nlonger line\nlonger  LINE")]
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), min_equal=min_equal).collect()}
        want = brute.without_copied_lines(docs, line_dedup.normalise, line_dedup.MIN_CHARS, min_equal)
        assert [got[d] for d, _ in docs] == want
        # Equal short lines go from one character on, short lines one edit apart and blank ones stay.
        assert want[-3:] == {1: ["short\n", "shor\n}", "\n \nlonger line"], 20: [t for _, t in docs[-3:]], 6: ["short\nshort\n", "Short\nshor\n}\n}", " }\n\n \nlonger line"]}[min_equal]


def test_floors_must_fit(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for bad in (0, 21):
        with pytest.raises(ValueError, match="min_equal"):
            line_dedup.dedup_lines(docs, min_equal=bad)


def test_nulls_ties_and_clashing_columns(spark):
    line = "this line is long enough to count"
    rows = [(None, line, 1, "n"), (2, line + "\nown words that only this one has", 2, "n"), (2, line + "\nown words that only this one has", 2, "n"), (1, f"  {line.upper()} ", 3, "n"), (3, None, 4, "n"), (4, "z" * 120_000, 5, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, gone string")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "n_lines", "gone", "n_lines_", "n_removed"]
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in out.collect()), key=str)
    assert got == sorted([(None, "", 1), (2, "own words that only this one has", 1), (2, "own words that only this one has", 1), (1, f"  {line.upper()} ", 0), (3, None, 0), (4, "z" * 120_000, 0)], key=str)
    kept = line_dedup.without_copied_lines(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "2", "3", "4"]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_query_keeps_all_documents(spark, sf_small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    rows = line_dedup.op10_line_dedup(spark, sf_small).collect()
    assert len(rows) == len(docs) and any(r.n_removed for r in rows)
    want = brute.without_copied_lines(sorted(docs.items()), line_dedup.normalise, line_dedup.MIN_CHARS, 1) if len(docs) <= 200 and sum(map(len, docs.values())) < 300_000 else None
    for r in rows:
        assert r.n_lines == len(docs[r.doc_id].split("\n")) and (r.text == docs[r.doc_id]) == (r.n_removed == 0)
        if want is not None:
            assert r.text == want[sorted(docs).index(r.doc_id)]
