import gzip
import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from countwatch.config import STAR
from countwatch.functions.text import TokenLists
from countwatch.operators import live, measures, recall, records
from countwatch.sources import lists, manifests, pages, sinks

LISTS = TokenLists(firm=("acme",), not_firm=("acme tools",), brand=("zap",))


def record(key, received="20200105", codes=("AAA",), maker="", brand="", **extra):
    return {
        "mdr_report_key": key, "date_received": received, "event_type": "M", "type_of_report": ["B", "A", "", "B"],
        "remedial_action": ["Recall", ""], "manufacturer_name": extra.pop("firm", ""),
        "device": [{"device_report_product_code": c, "manufacturer_d_name": maker, "brand_name": brand} for c in codes], **extra,
    }


@pytest.fixture(scope="module")
def page_dir(tmp_path_factory):
    root = tmp_path_factory.mktemp("pages")
    put = {
        "BBB/p1.json.gz": [record("k1", codes=("BBB",), firm="Other"), record("k2", codes=(" bbb ", "AAA"), maker="Acme  Corp")],
        "AAA/p2.json.gz": [record("k4", received="2020"), record("k1", codes=("AAA",), brand="x-zap 3"), record("k5", received="20991231")],
        "AAA/p1.json.gz": [record("k1", codes=("CCC",), firm="acme tools ltd"), record("k3", date_of_event="20191203"), record("")],
    }
    for name, rows in put.items():
        path = root / name
        path.parent.mkdir(exist_ok=True)
        with gzip.open(path, "wt") as fh:
            json.dump({"meta": {"last_updated": "2020-02-01"}, "results": rows}, fh)
    return str(root)


def test_pages_first_seen(spark, page_dir):
    raw = pages.read_record_pages(spark, page_dir, ["BBB", "AAA"])
    raw = raw.filter(F.coalesce("mdr_report_key", F.lit("")) != "")
    shaped = records.shape_records(raw, LISTS)
    first = records.shape_records(records.first_seen(raw), LISTS)
    done = {r.mdr_report_key: r for r in records.finish_reports(first, STAR.with_(history_start="2019-01", as_of="20201231")).collect()}
    assert set(done) == {"k1", "k2", "k3", "k4", "k5"}
    # BBB comes first in the cohort order, so its copy of k1 decides attributes and exclusion.
    assert done["k1"].first_code == "BBB" and done["k1"].copies == 3 and not done["k1"].excluded
    assert done["k2"].excluded and done["k2"].device_codes == "AAA|BBB" and done["k2"].n_devices == 2
    assert done["k3"].lag_months == 1 and done["k3"].type_of_report == "A|B" and done["k3"].remedial_action == "Recall"
    assert done["k4"].quarantine_reason == "missing_or_malformed_date_received" and not done["k4"].countable
    assert done["k5"].quarantine_reason == "received_after_as_of"
    audit = [tuple(r) for r in records.audit(first).collect()]
    assert audit == [("k2", "BBB", "device.manufacturer_d_name", "acme")]
    assert {tuple(r) for r in records.bridge(raw).collect()} >= {("k1", "AAA"), ("k1", "BBB")}
    dup = {r.product_code: r.duplicates for r in records.duplicates_within_code(raw).collect()}
    assert dup == {"AAA": 1, "BBB": 0}
    marked = {r.device_codes for r in shaped.filter("queried_code = 'AAA' and mdr_report_key = 'k1'").collect()}
    assert marked == {"CCC|AAA?", "AAA"}
    reasons = {r.reason: r.reports for r in records.quarantine(
        first, STAR.with_(history_start="2019-01", as_of="20201231"), records.duplicates_within_code(raw)).collect()}
    assert reasons["duplicate_key_within_AAA_pages"] == 1 and reasons["received_after_as_of"] == 1


def test_hashes_and_manifest(spark, page_dir, tmp_path):
    stored = manifests.stored_hashes(spark, page_dir).withColumn("path", F.regexp_extract("path", r"([^/]+/[^/]+)$", 1))
    with gzip.open(f"{page_dir}/BBB/p1.json.gz") as fh:
        good = hashlib.sha256(fh.read()).hexdigest()
    doc = {"files": {"BBB/p1.json.gz": {"source": "S", "sha256": good}, "AAA/p1.json.gz": {"source": "S", "sha256": "0"}, "gone": {"source": "S", "sha256": "1"}}}
    (tmp_path / "manifest.json").write_text(json.dumps(doc))
    listed = manifests.read_keyed(spark, str(tmp_path / "manifest.json"), "files", manifests.FILE_ENTRY).withColumnRenamed("key", "path")
    verdicts = {r.path: r.verdict for r in manifests.reconcile(stored, listed).collect()}
    assert verdicts == {"BBB/p1.json.gz": "matched", "AAA/p1.json.gz": "moved", "AAA/p2.json.gz": "stray", "gone": "missing"}


def test_gzip_bodies_with_several_members(spark, tmp_path):
    parts = [b"one " * 400_000, b"", b"two"]
    body = b"".join(gzip.compress(x) for x in parts)
    assert manifests.unpacked_hash(body) == hashlib.sha256(b"".join(parts)).hexdigest()
    assert manifests.unpacked_hash(body + b"\0" * 7) == hashlib.sha256(b"".join(parts)).hexdigest()
    with pytest.raises(EOFError):
        manifests.unpacked_hash(body[:-20])
    (tmp_path / "x.json.gz").write_bytes(body)
    assert manifests.stored_hashes(spark, str(tmp_path)).first().sha256 == hashlib.sha256(b"".join(parts)).hexdigest()


def test_zip_larger_than_a_batch_and_last_entry_wins(spark, tmp_path):
    rows = [{"product_code": f"C{i % 2500}", "device_name": "n" + str(i) + ' "]}{['} for i in range(5200)]
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("c.json", json.dumps({"meta": {"results": {"total": 1}}, "results": rows}, indent=1))
    bulk = pages.read_bulk(spark, str(tmp_path / "c.zip"), pages.CLASSIFICATION)
    assert bulk.count() == 5200
    named = {r.product_code: r.device_name for r in pages.classification(bulk).collect()}
    assert len(named) == 2500 and named["C100"] == 'n5100 "]}{[' and named["C300"] == 'n2800 "]}{['
    import io

    text = json.dumps({"a": [1], "results": rows[:50]})
    assert [json.loads(x) for x in pages.result_items(io.StringIO(text), 7)] == rows[:50]
    assert list(pages.result_items(io.StringIO("{}"))) == []
    with pytest.raises(EOFError):
        list(pages.result_items(io.StringIO(text[:-30])))


def test_unparsed_objects_are_counted(spark):
    df = spark.createDataFrame([("a", '{"k": 1}'), ("a", "no"), ("b", None)], "g string, props string")
    assert {tuple(r) for r in manifests.unparsed_rows(df, "props", "bigint", "g").collect()} == {("a", 2, 1), ("b", 1, 0)}


def test_extraction_log(spark, tmp_path):
    log = {"windows": {"w1": {"status": "complete", "expected": 5, "api_total": 5}, "w2": {"status": "complete", "expected": 5, "api_total": 4}, "w3": {"status": "open"}}}
    (tmp_path / "log.json").write_text(json.dumps(log))
    rows = manifests.read_keyed(spark, str(tmp_path / "log.json"), "windows", manifests.WINDOW_ENTRY)
    assert sorted(r.key for r in manifests.incomplete_windows(rows).collect()) == ["w2", "w3"]


def test_count_series(spark, tmp_path):
    body = {"meta": {"last_updated": "2020-03-01"}, "results": [{"time": "20200101", "count": 2}, {"time": "20200115", "count": 3}, {"time": "2020-9-1", "count": "x"}]}
    (tmp_path / "AAA_date_received.json").write_text(json.dumps(body))
    series = pages.read_count_series(spark, str(tmp_path))
    problems = live.bucket_problems(series).first()
    assert (problems.product_code, problems.buckets, problems.malformed) == ("AAA", 3, 1)
    months = measures.day_counts_to_months(pages.daily_counts(series).filter("length(day) = 8 and day rlike '^[0-9]+$'"))
    assert [tuple(r) for r in months.collect()] == [("AAA", 2020 * 12 + 1, 5)]


def test_bulk_zip_and_recalls(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "classification.zip", "w") as z:
        z.writestr("readme.txt", "no")
        z.writestr("c.json", json.dumps({"results": [{"product_code": " aaa ", "device_name": "Thing"}, {"product_code": None}]}))
    got = pages.classification(pages.read_bulk(spark, str(tmp_path / "classification.zip"), pages.CLASSIFICATION)).collect()
    assert [(r.product_code, r.device_name, r.device_class) for r in got] == [("AAA", "Thing", "")]
    recalls = {"results": [
        {"product_code": "-aaa-", "res_event_number": "7", "event_date_initiated": "2020-05-02", "root_cause_description": " b ", "reason_for_recall": "After COMPLAINTS came in", "k_numbers": ["K1"]},
        {"product_code": "BBB", "res_event_number": "7", "event_date_initiated": "2020-05-01", "root_cause_description": "a", "reason_for_recall": "reported"},
        {"product_code": "AAA", "res_event_number": "", "event_date_initiated": "2020-05-01"},
    ]}
    enf = {"results": [{"event_id": "7", "classification": "Class II", "report_date": "2020-06-01"}, {"event_id": "7", "classification": "Class III"}]}
    (tmp_path / "recall.json").write_text(json.dumps(recalls))
    (tmp_path / "enf.json").write_text(json.dumps(enf))
    product, enforced = pages.recall_inputs(
        pages.read_bulk(spark, str(tmp_path / "recall.json"), pages.RECALL), pages.read_bulk(spark, str(tmp_path / "enf.json"), pages.ENFORCEMENT)
    )
    codes = spark.createDataFrame([("AAA",), ("BBB",)], "product_code string")
    rows = recall.timeline(product, enforced, codes, "2020-01-01", "2020-12-31")
    row = recall.published(rows).collect()
    assert len(row) == 1
    assert row[0].product_codes == "AAA|BBB" and row[0].classification == "Class II|Class III" and row[0].root_cause == "a|b"
    assert row[0].reason_cites_reports and row[0].records_with_k_numbers == 1 and row[0].event_date_initiated == "2020-05-01"
    # "Class II" contains the text "Class I" but is not that class.
    assert recall.class_one(rows, codes, ("2020-01", "2020-12")).count() == 0


def test_token_lists(tmp_path):
    (tmp_path / "list.txt").write_text("# private\n[firm_tokens]\nacme\n\n[not_firm_tokens]\nacme tools\n[brand_tokens]\nzap\n")
    got = lists.read_tokens(str(tmp_path / "list.txt"))
    assert got == LISTS
    with pytest.raises(FileNotFoundError):
        lists.read_tokens(str(tmp_path / "absent.txt"))


def test_sinks(spark, tmp_path):
    empty = spark.createDataFrame([], "reason string, reports bigint")
    sinks.export_csv(empty, str(tmp_path / "q"), ["reason"], {"reason": "none", "reports": 0})
    assert [tuple(r) for r in sinks.read_csv(spark, str(tmp_path / "q"), "reason string, reports bigint").collect()] == [("none", 0)]
    for i, ok in enumerate((True, False)):
        sinks.append_history(spark.createDataFrame([(f"v{i}", ok)], "vintage string, passed boolean"), str(tmp_path / "h"))
    history = spark.read.schema("vintage string, passed boolean").json(str(tmp_path / "h"))
    assert history.count() == 2 and sinks.latest_run(history, "passed").first().vintage == "v0"
    sinks.write_json_fact(spark.range(1).select(F.struct(F.lit(1).alias("a")).alias("facts")), str(tmp_path / "fact"))
    assert spark.read.json(str(tmp_path / "fact")).first().facts.a == 1
