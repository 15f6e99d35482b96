"""The body source: a partition per file or member, streamed; errors name their file."""

import gzip
import hashlib
import json
import resource
import zipfile

import pytest

from countwatch.sources import bodies, manifests, pages


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_files_members_and_padding(spark, tmp_path):
    parts = [b"first\n", b"x" * 3_000_000, b"", b"\xc3\xa9 last"]
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "a.json.gz").write_bytes((b"\0" * 700).join(gzip.compress(p) for p in parts) + b"\0" * 100)
    (tmp_path / "deep" / "er" / "b.json").write_bytes(b"plain")
    (tmp_path / "deep" / "empty.json.gz").write_bytes(gzip.compress(b""))
    (tmp_path / "deep" / "nothing").write_bytes(b"")
    with zipfile.ZipFile(tmp_path / "deep" / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("one.json", b"1" * 2_500_000)
        z.writestr("in/two.json", b"2")
        z.writestr("note.txt", b"n")
    df = bodies.read_bodies(spark, str(tmp_path / "deep"))
    got = {(r.path.rsplit("/", 1)[1], r.member): (r.bytes, r.sha256) for r in df.collect()}
    want = {("a.json.gz", ""): b"".join(parts), ("b.json", ""): b"plain", ("empty.json.gz", ""): b"", ("nothing", ""): b"",
            ("z.zip", "one.json"): b"1" * 2_500_000, ("z.zip", "in/two.json"): b"2", ("z.zip", "note.txt"): b"n"}
    assert got == {k: (len(v), sha(v)) for k, v in want.items()}
    assert df.rdd.getNumPartitions() == 7
    assert {r.member for r in bodies.read_bodies(spark, str(tmp_path), "*.zip", member="*.json").collect()} == {"one.json", "in/two.json"}


def test_no_file_fits_and_no_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    assert bodies.read_bodies(spark, str(tmp_path), "*.gz").count() == 0
    assert manifests.stored_hashes(spark, str(tmp_path)).count() == 0
    assert not bodies.reachable(str(tmp_path / "absent")) and not bodies.reachable("nostore://x/y")


def test_a_cut_body_is_an_error(spark, tmp_path):
    (tmp_path / "cut.json.gz").write_bytes(gzip.compress(b"whole" * 1000)[:-12])
    with pytest.raises(Exception, match="cut.json.gz: a gzip body ends inside a member"):
        bodies.read_bodies(spark, str(tmp_path)).collect()


def test_a_large_body_is_never_held(tmp_path):
    size = 384 << 20
    with gzip.open(tmp_path / "big.json.gz", "wb", compresslevel=1) as f:
        for _ in range(size >> 20):
            f.write(b"0123456789abcdef" * 65536)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    (row,) = bodies.BodyReader({"path": str(tmp_path)}).read(bodies.Body(str(tmp_path / "big.json.gz"), ""))
    grown = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before
    assert row[2] == size and grown < 64 << 10  # KB


def test_bulk_items_from_several_zips_and_members(spark, tmp_path):
    def entry(i):
        return {"product_code": f"c{i % 7}", "device_name": f"name {i}", "text": "é" * (i % 50)}

    n = 0
    for z in ("a.zip", "b.zip"):
        with zipfile.ZipFile(tmp_path / z, "w", zipfile.ZIP_DEFLATED) as out:
            for member in ("x.json", "y.json"):
                out.writestr(member, json.dumps({"meta": {}, "results": [entry(i) for i in range(n, n + 900)]}, ensure_ascii=False))
                n += 900
            out.writestr("readme.txt", "no results here")
    bulk = pages.read_bulk(spark, str(tmp_path), pages.CLASSIFICATION)
    assert bulk.count() == 3600
    named = {r.product_code: r.device_name for r in pages.classification(bulk).collect()}
    assert named == {f"C{k}": f"name {max(i for i in range(3600) if i % 7 == k)}" for k in range(7)}


def test_results_that_do_not_end(spark, tmp_path):
    (tmp_path / "cut.json").write_text('{"results": [{"a": 1}, {"a": 2}')
    with pytest.raises(Exception, match="does not end"):
        bodies.read_bodies(spark, str(tmp_path), yields="items").collect()
