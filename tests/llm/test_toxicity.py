import brute
import numpy as np
import pytest

from countwatch.llm import toxicity


def test_features():
    words = toxicity.words_of("Idiot, idiot! (Clown) *** été***")
    assert words == {"idiot": 2, "clown": 1, "été": 1}
    text = "bomentea bomentei " + "word " * 20
    assert {"rboment"[:5], "rbomen"} & set(toxicity.features_of(text))
    assert not [x for x in toxicity.features_of("bomentea " + "word " * 20) if x[0] == "r" and x[1:] != "word"]


def test_score_equals_the_plain_sum():
    model = toxicity.Model({"widiot": 2.0, "wclown": 1.5, "rbomen": 3.0}, -1.0)
    for text in ["", "idiot", "an Idiot clown idiot", "bomentea bomentei x", "bomentea x"]:
        g = -1.0 + sum(model.weights.get(f, 0.0) for f in set(toxicity.features_of(text)))
        assert model.score(text) == pytest.approx(1 / (1 + np.exp(-g)))


def test_risk_minimiser_separates_unlabelled_positives():
    rng = np.random.default_rng(0)
    n_p, n_u, prior = 300, 2000, 0.2
    toxic = np.concatenate([np.ones(n_p, bool), rng.random(n_u) < prior])
    shown = np.where(toxic[:, None], rng.random((n_p + n_u, 6)) < [0.6, 0.5, 0.4, 0.3, 0.3, 0.3], rng.random((n_p + n_u, 6)) < [0.01, 0.01, 0.01, 0.3, 0.3, 0.3])
    rows, cols = np.nonzero(shown)
    positive = np.arange(n_p + n_u) < n_p
    w, b = toxicity.nn_pu(rows, cols, n_p + n_u, 6, positive, prior)
    score = 1 / (1 + np.exp(-(shown @ w + b)))
    hidden = toxic[n_p:]
    assert brute.auc(score[n_p:], hidden.astype(int)) > 0.85
    assert score[n_p:][hidden].mean() > 0.6 and score[n_p:][~hidden].mean() < 0.15


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    out = toxicity.op9_toxicity(spark, sf)
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert brute.auc([r.score for r in rows], [r.toxic for r in rows]) > 0.94
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert np.mean(clean) < 0.01 and np.mean([r.predicted for r in rows if r.toxic == 1]) > 0.85


def test_labels_of_held_out_rows_are_never_learnt(spark, sf_small):
    docs, labels = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "quality", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - toxic, toxic) as toxic")
    assert toxicity.train(docs, labels) == toxicity.train(docs, turned)


def test_edges(spark, sf_small):
    docs, labels = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "labels"))
    assert toxicity.train(docs, labels.limit(0)).score("anything") < 1e-6
    model = toxicity.train(docs.limit(0), labels)
    assert 0 <= model.score("") <= 1
    odd = spark.createDataFrame([(1, None, 1), (None, "", 2), (1, None, 1), (2, "x " * 100_000, 3)], "doc_id long, text string, score int")
    out = toxicity.score(odd, toxicity.Model({"wx": 1.0}, -2.0))
    assert out.columns == ["doc_id", "text", "score", "score_"] and out.count() == 4
    assert toxicity.without_toxic(odd, labels.limit(0)).columns == odd.columns
    assert toxicity.score(odd.limit(0), toxicity.Model()).count() == 0
