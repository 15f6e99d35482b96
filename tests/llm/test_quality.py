import brute
import numpy as np
import pytest

from countwatch.llm import quality


def walk(forest, row):
    """One row down every tree, node by node."""
    total = forest.bias
    inner = forest.feature.shape[1]
    for t in range(len(forest.feature)):
        node = 0
        while node < inner:
            node = 2 * node + 1 + int(row[forest.feature[t, node]] > forest.split[t, node])
        total += forest.leaf[t, node - inner]
    return 1 / (1 + np.exp(-total))


def test_flattened_traversal_equals_a_walk():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    forest = quality.grow(x, y, trees=12)
    got = forest.score(x[:50])
    assert got == pytest.approx([walk(forest, r) for r in x[:50]])
    assert brute.auc(forest.score(x), y) > 0.97


def test_no_or_one_label_scores_the_share():
    assert quality.grow(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert quality.grow(np.zeros((4, 3)), np.ones(4)).score(np.zeros((1, 3)))[0] > 0.99


def test_statistics_of_odd_texts():
    for text in ["", "\n\n", "x" * 100_000, "a | b | c", "ÉÉ!! ÀÀ!!", "one"]:
        values = quality.statistics(text)
        assert len(values) == len(quality.STATISTICS) and np.isfinite(values).all()


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = quality.op6_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert brute.auc([r.score for r in rows], [r.quality for r in rows]) > 0.98
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.98 and np.mean([r.predicted for r in rows if r.quality == 0]) < 0.1


def test_labels_of_held_out_rows_are_never_learnt(spark, sf_small):
    docs, labels = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) as quality")
    a, b = quality.train(docs, labels), quality.train(docs, turned)
    assert np.array_equal(a.feature, b.feature) and np.array_equal(a.leaf, b.leaf)


def test_edges(spark, sf_small):
    docs, labels = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "labels"))
    forest = quality.train(docs.limit(0), labels)
    odd = spark.createDataFrame([(1, None, 1), (None, "", 2), (1, None, 1)], "doc_id long, text string, Score int")
    out = quality.score(odd, forest)
    assert out.columns == ["doc_id", "text", "Score", "score_"] and out.count() == 3
    assert quality.score(odd.limit(0), forest).count() == 0
