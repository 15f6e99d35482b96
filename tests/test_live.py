"""Live-edge scenarios on temporary folders: no network, no clock."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from countwatch.config import STAR, mi_of
from countwatch.functions import months
from countwatch.operators import live
from countwatch.streaming import daily_counts
from countwatch.streaming.live_edge import LiveEdge, READING, freeze_from_counts

H = STAR.with_(last_actual="2001-04", recent=("2001-01", "2001-04"), as_of="20010430", outlook_issue_date="2001-05-02")
ENTRY = {"code": "AAA", "month": "1999-03", "frozen": 99, "live_at_disposition": 96, "dispositioned": "2001-06-01", "classification": "source revision", "decision": "D24"}


def dispositions(spark, *entries):
    return live.dispositions(spark, entries, {"AAA", "BBB"}, "1995-01", "2001-04")


def count(code, mi):
    return 80 + (mi * 7 + len(code) + ord(code[0])) % 40 if mi != mi_of("1999-03") else 99


def readings(spark, vintage, last_updated, upto, change=None):
    change = change or {}
    rows = []
    for code in ("AAA", "BBB"):
        for mi in range(H.start_mi, mi_of(upto) + 1):
            n = change.get((code, mi), count(code, mi))
            if n is not None:
                rows.append((vintage, last_updated, code, f"{(mi - 1) // 12}{(mi - 1) % 12 + 1:02d}01", n))
    return spark.createDataFrame(rows, READING)


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("edge"))
    monthly = spark.createDataFrame(
        [(c, m, count(c, m), count(c, m)) for c in ("AAA", "BBB") for m in range(H.start_mi, H.end_mi + 1)],
        "product_code string, mi int, raw_reports bigint, y bigint",
    )
    return freeze_from_counts(LiveEdge(spark, root, H, "2001-05-02", dispositions(spark, ENTRY)), monthly)


def last_run(edge, vintage):
    return edge.part("run", vintage).first()


def test_scenarios_in_order(spark, edge):
    # A source older than the frozen datum fails and changes nothing.
    edge.ingest(readings(spark, "a0", "2001-04-01", "2001-05"), "a0", "2001-04-01")
    run = last_run(edge, "a0")
    assert run.status == "failed" and not run.advanced and "frozen datum" in run.failed_checks
    # Two data in one batch fail.
    mixed = readings(spark, "a1", "2001-06-02", "2001-05").withColumn("last_updated", F.when(F.col("product_code") == "AAA", "2001-06-03").otherwise(F.col("last_updated")))
    edge.ingest(mixed, "a1", "2001-06-03")
    assert last_run(edge, "a1").status == "failed"
    # A malformed bucket fails before anything is stored.
    bad = readings(spark, "a2", "2001-06-02", "2001-05").withColumn("time", F.when(F.col("product_code") == "AAA", "2001-5-1").otherwise(F.col("time")))
    edge.ingest(bad, "a2", "2001-06-02")
    assert last_run(edge, "a2").failed_checks == "buckets well formed"
    assert edge.table("series").count() == 0
    # A code that does not answer stops the run: its silence is no zero, nothing is stored or scored.
    edge.ingest(readings(spark, "a3", "2001-06-02", "2001-05").filter("product_code = 'AAA'"), "a3", "2001-06-02")
    run = last_run(edge, "a3")
    assert (run.status, run.failed_checks, run.advanced, run.passed) == ("stopped", "every code answered", False, False)
    assert edge.table("series").count() == edge.table("score").count() == 0 and edge.table("body").filter("vintage = 'a3'").count() == 0
    # A new month: appended, frozen outlook rows for it scored, three models x two horizons issued per code.
    edge.ingest(readings(spark, "b1", "2001-06-02", "2001-05"), "b1", "2001-06-02")
    run = last_run(edge, "b1")
    assert (run.status, run.months_appended, run.forecasts_issued) == ("ok", 2, 12)
    assert run.forecasts_scored == 2 * 3 * 2  # h1 from the freeze month and h3 from two months before it
    # The same source again is skipped.
    edge.ingest(readings(spark, "b2", "2001-06-02", "2001-05"), "b2", "2001-06-02")
    run = last_run(edge, "b2")
    assert run.status.startswith("skipped") and run.passed and not run.advanced
    # The same month in a later vintage: both readings kept, nothing scored or issued again.
    late = {("AAA", mi_of("2001-05")): count("AAA", mi_of("2001-05")) + 5}
    edge.ingest(readings(spark, "b3", "2001-06-09", "2001-05", late), "b3", "2001-06-09")
    run = last_run(edge, "b3")
    assert (run.status, run.forecasts_scored, run.forecasts_issued) == ("ok", 0, 0)
    latest = {(r.product_code, r.mi): r.actual for r in edge.latest("b3").collect()}
    assert latest[("AAA", mi_of("2001-05"))] == count("AAA", mi_of("2001-05")) + 5
    assert edge.table("series").filter(f"mi = {mi_of('2001-05')} and product_code = 'AAA'").count() == 2
    # A retried batch rewrites the same rows.
    before = edge.table("score").count(), edge.table("forecast").count(), edge.table("series").count()
    edge.ingest(readings(spark, "b3", "2001-06-09", "2001-05", late), "b3", "2001-06-09")
    assert before == (edge.table("score").count(), edge.table("forecast").count(), edge.table("series").count())
    # A frozen month emptied at the source is a material decrease; a listed revision is known.
    gone = {("BBB", mi_of("2000-01")): None, ("AAA", mi_of("1999-03")): 96}
    edge.ingest(readings(spark, "c1", "2001-07-02", "2001-06", gone), "c1", "2001-07-02")
    run = last_run(edge, "c1")
    assert run.status == "failed" and run.failed_checks == "no unlisted fall of a frozen month" and run.advanced
    verdicts = {(r.product_code, months_of(r.mi)): r.verdict for r in edge.part("reread", "c1").filter("verdict <> 'same'").collect()}
    assert verdicts == {("BBB", "2000-01"): "material", ("AAA", "1999-03"): "known"}
    assert run.forecasts_issued == 12 and run.forecasts_scored > 0
    once = edge.table("score").groupBy("product_code", "model", "origin_mi", "target_mi", "horizon").count()
    assert once.filter("count > 1").count() == 0


def test_a_vintage_in_two_batches_is_whole(spark, edge, tmp_path):
    split = readings(spark, "d1", "2001-08-02", "2001-07")
    for code in ("AAA", "BBB"):
        split.filter(F.col("product_code") == code).coalesce(1).write.mode("append").json(str(tmp_path / "landing"))
        edge.run_available(str(tmp_path / "landing"))
        run = last_run(edge, "d1")
        assert run.status == ("stopped" if code == "AAA" else "ok")
    assert edge.part("body", "d1").count() == split.count()
    assert {r.product_code for r in edge.part("reading", "d1").select("product_code").distinct().collect()} == {"AAA", "BBB"}


def test_more_than_twenty_revised_months_are_all_told(spark):
    frozen = spark.createDataFrame([("AAA", 24000 + i, 100) for i in range(25)], "product_code string, mi int, raw_reports bigint")
    seen = spark.createDataFrame([("AAA", 24000, 1)], "product_code string, mi int, reports bigint")
    rows = live.frozen_reread(frozen, seen, dispositions(spark), H)
    assert live.variance_summary(rows).first().material_downward == 25
    told = live.revised_months(rows).collect()
    assert len(told) == 25 and {r.note for r in told} == {"not listed"}


def test_every_month_after_the_freeze_is_seen(spark):
    row = spark.range(1).select(F.size(months.months_seen(F.lit("2200-01-01"), mi_of("2001-04"))).alias("n")).first()
    assert row.n == mi_of("2199-12") - mi_of("2001-04")


def test_late_rows_are_counted_over_all_batches(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for i in range(9):
        rows = [(100, "2024-03-01 00:00:00", 1, "click", 1.0, "{}")] if i == 0 else [(i, "2024-01-01 00:00:00", 1, "click", 1.0, "{}")]
        spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").withColumn(
            "ts", F.col("ts").cast("timestamp_ntz")
        ).coalesce(1).write.mode("append").parquet(src)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")  # what the query itself remembers
    try:
        told = daily_counts.run_available(spark, src, out, files_per_batch=1)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert told["batches"] >= 9 and told["late_rows"] >= 5
    whole = daily_counts.every_reading(spark, src, str(tmp_path / "all")).collect()
    assert sorted(r.events for r in whole) == [1, 8]


def test_late_rows_are_rows_and_agree_with_the_engine(spark, tmp_path):
    """Files in order: each batch is split at the newest earlier time less a day; the engine's closed days hold just the rest."""
    src, out, closed = (str(tmp_path / n) for n in ("src", "out", "closed"))
    schema = "event_id bigint, ts string, user_id bigint, event_type string, value double, props string"
    files = [
        [(1, "2024-01-01 10:00:00"), (2, "2024-01-02 10:00:00"), (3, "2024-01-01 00:00:00")],
        [(4, "2024-01-01 10:00:00"), (5, "2024-01-01 10:00:00.001"), (6, "2024-01-05 12:00:00"), (7, None)],
        [(8, "2024-01-02 09:00:00"), (9, "2024-01-04 12:00:00"), (10, "2024-01-04 12:00:00.0015"), (11, "2024-01-09 00:00:00")],
        [(12, "2024-01-20 00:00:00")],
    ]
    want, upto = {}, None
    for n, rows in enumerate(files):
        spark.createDataFrame([(i, t, 1, "click", 1.0, "{}") for i, t in rows], schema).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(src)
        daily_counts.split_late(spark, src, out)
        daily_counts.run_available(spark, src, closed)
        for i, t in rows:
            at = None if t is None else pd.Timestamp(t)
            want[i] = (n, upto is not None and at is not None and at <= upto.floor("ms") - pd.Timedelta(days=1))
        upto = max([pd.Timestamp(t) for _, t in rows if t] + ([upto] if upto is not None else []))
    got = daily_counts.read_split(spark, out)
    assert {r.event_id: (r.batch, r.late) for r in got.collect()} == want
    assert [i for i, (_, late) in want.items() if late] == [4, 8, 9]
    kept = got.where("not late").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("events"))
    engine = {r.day.date(): r.events for r in daily_counts.read_closed(spark, closed).collect()}
    assert engine == {r.day: r.events for r in kept.collect() if r.day in engine} and len(engine) >= 4


def test_a_retried_batch_writes_the_same(spark, tmp_path):
    out = str(tmp_path / "out")
    for batch, ts in ((-1, None), (0, "2024-01-05 00:00:00"), (1, "2024-01-09 00:00:00")):
        spark.createDataFrame([(ts,)], "upto string").select(F.col("upto").cast("timestamp_ntz")).write.parquet(f"{out}/marks/batch={batch}")
    assert daily_counts.newest(spark, out, 0) is None
    assert daily_counts.newest(spark, out, 1).day == 5  # batch 1's own mark, from an earlier try, is not read


def months_of(mi):
    return f"{(mi - 1) // 12:04d}-{(mi - 1) % 12 + 1:02d}"


DISPOSED = [  # live reading, frozen entry, verdict
    (96, 99, "known"), (97, 99, "known"), (95, 99, "material"), (96, 98, "material"),
]


@pytest.mark.parametrize("reads,listed,want", DISPOSED)
def test_dispositions(spark, reads, listed, want):
    frozen = spark.createDataFrame([("AAA", mi_of("1999-03"), 99)], "product_code string, mi int, raw_reports bigint")
    seen = spark.createDataFrame([("AAA", mi_of("1999-03"), reads)], "product_code string, mi int, reports bigint")
    entry = {**ENTRY, "frozen": listed, "live_at_disposition": min(96, listed - 1)}
    assert live.frozen_reread(frozen, seen, dispositions(spark, entry), H).first().verdict == want


def test_one_percent_is_not_material(spark):
    frozen = spark.createDataFrame([("AAA", 24000, 100), ("AAA", 24001, 1000)], "product_code string, mi int, raw_reports bigint")
    seen = spark.createDataFrame([("AAA", 24000, 99), ("AAA", 24001, 989)], "product_code string, mi int, reports bigint")
    rows = live.frozen_reread(frozen, seen, dispositions(spark), H)
    assert {r.mi: r.verdict for r in rows.collect()} == {24000: "lower", 24001: "material"}
    total = live.variance_summary(rows).first()
    assert (total.months_compared, total.months_reading_lower, total.material_downward) == (2, 2, 1)


BROKEN = [
    {k: v for k, v in ENTRY.items() if k != "month"}, {**ENTRY, "extra": 1}, {**ENTRY, "code": "ZZZ"}, {**ENTRY, "month": "2001-05"},
    {**ENTRY, "frozen": 96}, {**ENTRY, "frozen": "99"}, {**ENTRY, "dispositioned": "June"}, {**ENTRY, "classification": "typo"}, {**ENTRY, "decision": "24"},
]


@pytest.mark.parametrize("entry", BROKEN)
def test_malformed_dispositions_raise(spark, entry):
    with pytest.raises(ValueError):
        dispositions(spark, entry)


def test_duplicate_and_empty_dispositions(spark, tmp_path):
    from countwatch.sources import lists

    with pytest.raises(ValueError):
        dispositions(spark, ENTRY, ENTRY)
    assert dispositions(spark).count() == 0
    with pytest.raises(FileNotFoundError):
        lists.read_revisions(str(tmp_path / "none.toml"))
    (tmp_path / "empty.toml").write_text("")
    assert lists.read_revisions(str(tmp_path / "empty.toml")) == []


def test_months_seen_is_strict(spark):
    row = spark.range(1).select(
        months.months_seen(F.lit("2001-06-30"), mi_of("2001-04")).alias("a"),
        months.months_seen(F.lit("2001-07-01"), mi_of("2001-04")).alias("b"),
        months.months_seen(F.lit("2001-04-30"), mi_of("2001-04")).alias("c"),
        months.month_end(F.lit(mi_of("2000-02"))).alias("d"),
    ).first()
    assert row.a == [mi_of("2001-05")] and row.b == [mi_of("2001-05"), mi_of("2001-06")] and row.c == [] and row.d == "2000-02-29"


def test_event_stream_reports_late_rows(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    day = lambda d, i: (i, f"2024-01-{d:02d} 10:00:00", 1, "click", 2.0, "{}")

    def land(rows):
        spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").withColumn(
            "ts", F.col("ts").cast("timestamp_ntz")
        ).coalesce(1).write.mode("append").parquet(src)

    land([day(1, 1), day(1, 1), day(1, 2), day(2, 3), day(5, 4)])
    first = daily_counts.run_available(spark, src, out)
    assert first["late_rows"] == 0
    land([day(1, 9), day(6, 10)])
    second = daily_counts.run_available(spark, src, out)
    assert second["late_rows"] >= 1
    got = {r.day.day: (r.events, r.total) for r in daily_counts.read_closed(spark, out).collect()}
    assert got[1] == (2, 4.0) and got[2] == (1, 2.0) and 6 not in got


RUN = "vintage string, last_updated string, status string, failed_checks string, advanced boolean, error string"


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([], (0, None, None, None, None)),
        ([("a", "d1", "ok", "", True, None)], (1, "a", None, None, "d1")),
        ([("a", "d1", "ok", "", True, None), ("b", "d1", "skipped: nothing newer than d1", "", False, None)], (2, "a", "b", None, "d1")),
        # A stopped run failed a check; a later skipped one is the last that was not fine.
        ([("a", "d1", "ok", "", True, None), ("b", "d2", "stopped", "every code answered", False, None), ("c", "d1", "skipped: nothing newer than d1", "", False, None)], (3, "a", "c", "b", "d1")),
        ([("a", "d1", "failed", "", False, "IOError: gone"), ("b", "d2", "ok", "", True, None), ("c", "d3", "failed", "no unlisted fall of a frozen month", True, None)], (3, "b", "c", "c", "d3")),
        ([("a", None, "failed", "", False, "IOError: gone"), ("b", "d2", "ok", "", True, None)], (2, "b", "a", "a", "d2")),
    ],
)
def test_run_rollup(spark, rows, want):
    got = live.run_rollup(spark.createDataFrame(rows, RUN)).first()
    assert (got.runs_recorded, got.last_ok_run, got.last_not_ok_run, got.last_failed_run, got.source_last_updated_seen) == want
    assert got.runs_recorded == got.runs_ok + got.runs_skipped + got.runs_stopped + got.runs_failed


def test_health_has_a_row_before_the_first_run(spark, tmp_path):
    from countwatch.streaming.live_edge import TABLES

    empty = {k: spark.createDataFrame([], f"{v}, vintage string") for k, v in TABLES.items()}
    listed = live.dispositions(spark, [ENTRY], {"AAA"}, "1995-01", "2001-04")
    in_use = spark.createDataFrame([("AAA", "baseline_a")], "product_code string, model_in_use string")
    row = live.health(live.latest_reading(empty["series"]), empty["series"], empty["forecast"], empty["score"], in_use, empty["run"], empty["reread"], listed).collect()
    assert len(row) == 1 and row[0].runs_recorded == 0 and row[0].revisions_listed == 1 and row[0].revisions_reports_removed == 3 and row[0].reread_vintage is None


def test_newest_outlook_takes_each_codes_newest_origin(spark):
    rows = [("AAA", "candidate", 10, 11, 1, 5.0, "v1"), ("AAA", "candidate", 11, 12, 1, 6.0, "v2"), ("AAA", "candidate", 11, 14, 3, 9.0, "v2"), ("AAA", "baseline_a", 11, 12, 1, 7.0, "v2"), ("BBB", "baseline_a", 10, 11, 1, 4.0, "v1")]
    issued = spark.createDataFrame(rows, "product_code string, model string, origin_mi int, target_mi int, horizon int, point double, vintage string")
    in_use = spark.createDataFrame([("AAA", "candidate"), ("BBB", "baseline_a")], "product_code string, model_in_use string")
    assert {(r.product_code, r.point) for r in live.newest_outlook(issued, in_use).collect()} == {("AAA", 6.0), ("BBB", 4.0)}
