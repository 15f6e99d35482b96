import random

from oracle import connect, difference
from pyspark.sql import functions as F

from countwatch.llm import url_filters as uf


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.01"  # the smallest tables' fetch times end before most entries begin
    df = uf.op2_url_filter(spark, sf)
    assert difference(df, connect(sf), uf.OP2_SQL) is None
    assert {r.verdict for r in df.select("verdict").distinct().collect()} == {"allow", "block", "pass"}


def test_lookup_keys(spark):
    urls = ["https://me:x@A.b.Example.COM.:8080/p//q/?z=1#f", "http://host", "ftp://x.y/", "nonsense", "", None, "http://"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(uf.lookup_keys(F.col("url")).alias("k")).collect()
    got = [[(x.key, x.rank) for x in r.k] if r.k is not None else None for r in rows]
    assert got[0] == [("a.b.example.com", 4), ("b.example.com", 3), ("example.com", 2), ("a.b.example.com/p", 1001), ("a.b.example.com/p/q", 1002)]
    assert got[1:] == [[("host", 1)], [("x.y", 2)], None, None, None, None]


def plain(captures, entries):
    out = []
    def listed(pattern):
        host, slash, path = pattern.partition("/")
        return host.lower() + slash + path

    rows = sorted({(e[0], listed(e[1]), e[4], e[3] == "remove", e[2]) for e in entries if None not in (e[0], e[1], e[4])})
    for page, url, t, keys in captures:
        best = None
        for (name, pattern) in {(r[0], r[1]) for r in rows}:
            if t is None or pattern not in keys:
                continue
            past = [r for r in rows if r[:2] == (name, pattern) and r[2] <= t]
            if past and not past[-1][3]:
                candidate = (-keys[pattern], past[-1][4] != "allow", name, past[-1][4], pattern)
                best = min(best, candidate) if best else candidate
        out.append((page, "unparsed" if not keys else "undated" if t is None else best[3] if best else "pass", best[4] if best else None, best[2] if best else None))
    return sorted(out, key=str)


def test_as_of_join_equals_a_scan_of_the_history(spark):
    rnd = random.Random(1)
    hosts = ["a.x.com", "b.x.com", "x.com", "y.org"]
    captures, raw = [], []
    for i in range(300):
        h, seg = rnd.choice(hosts), rnd.choice(["", "p", "p/q", "P"])
        t = rnd.choice([None] + list(range(0, 1000, 7)))
        labels = h.split(".")
        keys = {".".join(labels[j:]): len(labels) - j for j in range(len(labels) - 1)} | {f"{h}/{'/'.join(seg.split('/')[: j + 1])}": 1001 + j for j in range(len(seg.split("/")) if seg else 0)}
        raw.append((i % 280, f"http://{h}/{seg}", t))
        captures.append((i % 280, f"http://{h}/{seg}", t, keys))
    raw += [(900, None, 5), (901, "bad", 5), (902, "http://x.com/", None)]
    captures += [(900, None, 5, {}), (901, "bad", 5, {}), (902, "http://x.com/", None, {"x.com": 2})]
    entries = [(rnd.choice(["l1", "l2"]), rnd.choice(["a.X.com", "x.com", "y.org", "b.x.com/p", "a.x.com/p/q", "B.x.com/P"]), rnd.choice(["block", "allow"]), rnd.choice(["add", "add", "remove"]), rnd.randrange(0, 1000)) for _ in range(60)]
    entries += entries[:5] + [(None, "x.com", "block", "add", 0), ("l1", None, "block", "add", 0), ("l1", "x.com", "block", "add", None)]
    cap = spark.createDataFrame(raw, "page_id long, url string, fetched_s long")
    ent = spark.createDataFrame(entries, "list_name string, pattern string, action string, change string, at long")
    for bucket in (50, 10_000):
        got = sorted(((r.page_id, r.verdict, r.pattern, r.list_name) for r in uf.evaluate(cap, ent, bucket).collect()), key=str)
        assert got == plain(captures, entries)
    assert {r.verdict for r in uf.evaluate(cap, ent.limit(0)).collect()} == {"pass", "unparsed", "undated"}
    assert uf.evaluate(cap.limit(0), ent).count() == 0


def test_intervals_never_overlap(spark):
    rows = [("l", "k", "block", c, t) for t in range(0, 400, 10) for c in ("add",) + (("remove",) if t % 30 == 0 else ())]
    out = uf.validity_intervals(spark.createDataFrame(rows, "list_name string, pattern string, action string, change string, at long"), 35).orderBy("valid_from").collect()
    assert all(a.valid_to <= b.valid_from for a, b in zip(out, out[1:], strict=False))
    assert [r.valid_from for r in out] == [t for t in range(0, 400, 10) if t % 30]


def test_paths_keep_their_case(spark):
    cap = spark.createDataFrame([(i, u, 5) for i, u in enumerate(("http://A.com/Docs/x", "http://a.com/docs/x", "http://a.com/Docs"))], "page_id long, url string, fetched_s long")
    ent = spark.createDataFrame([("l", "a.COM/Docs", "block", "add", 0)], "list_name string, pattern string, action string, change string, at long")
    assert {r.page_id: r.verdict for r in uf.evaluate(cap, ent).collect()} == {0: "block", 1: "pass", 2: "block"}
