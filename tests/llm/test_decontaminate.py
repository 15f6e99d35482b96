import numpy as np

from countwatch.llm import decontaminate as dec

ITEM = "Then Alice bought 12 apples for $3 each and gave 5 kg of flour to Bob who lives near the river in Paris, so how many apples are left for Alice?"
BENCH = [(1, ITEM), (9, ITEM), (2, "hi there"), (3, None), (4, "six plain words make one window"), (None, "no id for this item at all here"), (5, "1 2 3 4 5 6 7 8 9 10 11 12")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def found(spark, docs, bench=BENCH):
    out = dec.contaminated(frame(spark, docs), spark.createDataFrame(bench, "item_id long, text string")).collect()
    return {(r.doc_id, r.item_id): r.kind for r in out}


def test_copies_and_reparameterised_questions(spark):
    again = "Intro text here. Then Maria bought 30 apples for $7 each and gave 9 lb of flour to John Smith who lives near the river in Rome, so how many apples are left for Maria? bye"
    mixed = "Then Maria bought 30 apples for $7 each and gave 9 kg of flour to Maria who lives near the river in Maria, so how many apples are left for Tom?"
    docs = [(1, again), (2, mixed), (3, "x y z " + ITEM + " w"), (4, "Say: SIX plain, words make (one) window."), (5, None), (6, ""), (7, "hi there"), (8, ITEM[: len(ITEM) // 4]), (None, ITEM), (3, "x y z " + ITEM + " w")]
    assert found(spark, docs) == {(1, 1): "reparameterised", (3, 1): "exact", (4, 4): "exact", (None, 1): "exact"}
    assert found(spark, docs[:0]) == {} and found(spark, docs, BENCH[:0]) == {}
    kept = dec.without_contaminated(frame(spark, docs), spark.createDataFrame(BENCH, "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 6, 7, 8]


def test_numbers_only_items_and_repeated_passages(spark):
    docs = [(1, "1 2 3 4 5 6 7 8 9 10 11 12"), (2, "1 1 1 1 1 1 1 1 1 1 1 1"), (3, (ITEM + " and then more. ") * 40)]
    assert found(spark, docs) == {(1, 5): "exact", (3, 1): "exact"}


def test_window_hashes_depend_on_order_and_length():
    rng = np.random.default_rng(0)
    t = rng.integers(0, 2**63, 30, dtype=np.uint64)
    keys = dec.window_hashes(t, 8)
    assert len(keys) == 23 and len(set(keys.tolist())) == 23
    assert dec.window_hashes(t[::-1].copy(), 8)[0] != keys[-1] and dec.window_hashes(t[3:11], 8)[0] == keys[3]
    assert len(dec.window_hashes(t[:4], 8)) == 0


def test_blocks_of_texts_equal_single_texts():
    texts = [ITEM, "A b. New York is 5 km off", "", "%% 7 % of it", "It cost 3kg or $5 or 7.5% of 2,000 Euro for New York City people."]
    words = [t.split() for t in texts]
    first = np.zeros(sum(map(len, words)), dtype=bool)
    edges = np.cumsum([0, *map(len, words)])
    first[edges[:-1][[len(w) > 0 for w in words]]] = True
    together = dec.Canon().tokens([w for ws in words for w in ws], first)
    alone = [dec.Canon().tokens(w, np.arange(len(w)) == 0) for w in words if w]
    assert together[0].tolist() == [h for a in alone for h in a[0].tolist()]
    assert together[1].tolist() == [k for a in alone for k in a[1].tolist()]


def test_every_planted_item_is_found(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()
    want = {(d.doc_id, b.item_id) for d in docs for b in items if b.text in d.text}
    rows = dec.op3_decontaminate(spark, sf_small).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert want and want <= got
    half = {(d.doc_id, b.item_id) for d in docs for b in items if b.text[: len(b.text) // 3] in d.text or b.text[-(len(b.text) // 3) :] in d.text}
    assert got <= half


def test_wide_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "clean words", 1, 2)], "doc_id long, text string, bad_id int, bad_text int")
    out = dec.without_contaminated(df, spark.createDataFrame(BENCH, "item_id long, text string"))
    assert out.columns == df.columns and out.count() == 1


def test_coinciding_and_parting_values_do_not_hide_a_question(spark):
    bench = [
        (1, "On Monday morning the farmer had 3 pears in the basket and later found another 5 pears under the old tree, so how many pears are there now?"),
        (2, "Every shelf of the small shop holds 2 red boxes on the left and 2 blue boxes on the right, so how many boxes does one shelf hold?"),
        (3, "After lunch young Alice met her neighbour Bob at the gate and asked him whether the old mill was still open to visitors today"),
    ]
    texts = [
        bench[0][1].replace("3 pears", "5 pears"), bench[1][1].replace("2 red", "3 red"), bench[2][1].replace("Alice", "Maria").replace("Bob", "Maria"),
        bench[0][1].replace("3 pears", "7 pears"), "On Monday the farmer went home and found another 5 pears",
    ]
    got = found(spark, list(enumerate(texts)), bench)
    assert got == {(0, 1): "reparameterised", (1, 2): "reparameterised", (2, 3): "reparameterised", (3, 1): "reparameterised"}
