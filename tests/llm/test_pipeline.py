import tempfile

import brute
from test_near_copies import pairs, sets_of

import __spark_entry__
import corpus_pipeline
from countwatch.llm import line_dedup, toxicity


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_each_stage_equals_its_plain_version(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        out = tempfile.mkdtemp(prefix="stage-") + "/out"
        step(spark, docs, sf_small).write.parquet(out)
        before, docs = rows_of(docs), spark.read.parquet(out)
        after = rows_of(docs)
        seen[name] = (before, after)
        assert name == "sentencepiece" or docs.columns == columns
    before, after = seen["toxicity"]
    model = toxicity.train(spark.read.parquet(f"{sf_small}/documents.parquet"), spark.read.parquet(f"{sf_small}/labels.parquet"))
    assert set(after) == {d for d, r in before.items() if model.score(r.text) < 0.7} != set(before)
    before, after = seen["line_dedup"]
    ids = sorted(before)
    texts = brute.without_copied_lines([(d, before[d].text) for d in ids], line_dedup.normalise, line_dedup.MIN_CHARS, line_dedup.MIN_CHARS)
    want = {d: t for d, t in zip(ids, texts, strict=True) if t == before[d].text or t.strip()}
    assert {d: r.text for d, r in after.items()} == want
    assert all(r.n_chars == len(r.text) for d, r in after.items() if r.text != before[d].text)
    before, after = seen["simhash_near_dedup"]
    ids = sorted(before)
    roots = brute.components(len(ids), pairs(sets_of([before[d].text for d in ids])))
    assert set(after) == {ids[r] for r in roots}
    before, after = seen["decontamination"]
    items = [b.text for b in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    held = {d for d, r in before.items() if any(t in r.text for t in items)}
    assert held and not held & set(after) and len(before) - len(after) <= len(held) + 2
    before, after = seen["sentencepiece"]
    assert set(after) == set(before) and all(r.round_trip for r in after.values())


def test_run_and_registration(spark, sf_small):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "sentencepiece"]
    queries = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries if q.startswith("op")}
    out = queries["pipeline"](spark, sf_small)
    assert 0 < out.count() < 200 and set(spark.read.parquet(f"{sf_small}/documents.parquet").columns) < set(out.columns)


def test_empty_and_odd_documents_pass_through(spark, sf_small):
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "w " * 60_000, "en", "s", 120_000), (3, None, None, "s", None)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs, sf_small).count() > 0
        assert step(spark, docs.limit(0), sf_small).count() == 0


