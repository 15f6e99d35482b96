"""The corruption runs themselves: what is generated, and that only a true catch counts as one."""

import datetime

import pytest
from pyspark.sql import functions as F

from countwatch.operators import corruptions, gates
from countwatch.operators.corruptions import CAUGHT, MISSED, NO_CONTROL, NO_SETUP, UNCHANGED, Gate, Table

DAY, TIME = datetime.date(2020, 1, 31), datetime.datetime(2020, 1, 31, 12)
SCHEMA = "k string, n int, b boolean, d date, t timestamp, l array<int>"
ROWS = [("b", 5, True, DAY, TIME, [1]), ("c", None, False, DAY, TIME, [2]), ("a", 7, None, DAY, TIME, [])]


@pytest.fixture(scope="module")
def table(spark):
    return Table(spark.createDataFrame(ROWS, SCHEMA), ("k",))


def content(rows):
    return sorted((tuple(r) for r in rows.collect()), key=lambda r: (str(r[0]), str(r[1])))


def test_mutations_follow_the_schema(table):
    got = {name: copy() for name, copy in corruptions.mutations(table).items()}
    columns = "knbdtl"
    assert set(got) == {"drop", "repeat"} | {f"{kind}:{c}" for kind in ("blank", "swap") for c in columns} | {f"shift:{c}" for c in columns if c != "l"}
    assert all(copy.schema.simpleString() == table.rows.schema.simpleString() for copy in got.values())
    assert [r[0] for r in content(got["drop"])] == ["b", "c"] and [r[0] for r in content(got["repeat"])] == ["a", "a", "b", "c"]
    first = lambda name, i: next(r for r in content(got[name]) if str(r[0]).startswith("a") or r[0] is None)[i]
    assert (first("shift:k", 0), first("shift:n", 1), first("shift:d", 3), first("shift:t", 4)) == ("ax", 8, datetime.date(2020, 2, 1), TIME + datetime.timedelta(days=1))
    assert first("blank:n", 1) is None and first("blank:l", 5) is None and first("shift:b", 2) is None
    assert [(r[0], r[1]) for r in content(got["swap:n"])] == [("a", None), ("b", 5), ("c", 7)]
    assert all(next(r for r in content(copy) if r[0] == "b") == ROWS[0] for copy in got.values())


def test_only_the_named_rows_are_picked(spark):
    rows = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 30), ("b", None, 40)], "k string, m int, n int")
    got = corruptions.mutations(Table(rows, ("k", "m"), "n > 10"))
    assert sorted(r.n for r in got["drop"]().collect()) == [10, 30, 40]
    assert sorted((r.k, str(r.m), r.n) for r in got["swap:n"]().collect()) == [("a", "1", 10), ("a", "2", 30), ("b", "1", 20), ("b", "None", 40)]


def test_an_empty_table_changes_nothing(spark):
    empty = Table(spark.createDataFrame([], "k string, n int"), ("k",))
    assert all(copy().isEmpty() for copy in corruptions.mutations(empty).values())
    counts = Gate(lambda t: gates.check_rows(t["t"].agg(F.count_if(F.col("n") < 0).alias("none below zero"))), ("t:drop",))
    assert [r.outcome for r in corruptions.prove({"t": empty}, {"g": counts}).collect()] == [UNCHANGED]


def test_only_a_true_catch_counts(table):
    rows = table.rows

    def picky(tables):  # cannot be set up where the table was changed
        if tables["t"] is not rows:
            raise ValueError("no list to check against")
        return total(17)(tables)

    total = lambda limit: lambda t: gates.check_rows(t["t"].agg(F.when(F.coalesce(F.sum("n"), F.lit(0)) <= limit, 0).otherwise(1).alias("total in bounds")))
    unknown = lambda t: t["t"].where("n > 100").select(F.col("nothing").alias("check"), F.lit(True).alias("passed"))
    runs = {
        "bounds": Gate(total(12), ("t:shift:n", "t:repeat", "t:drop", "t:swap:d")),
        "broken": Gate(total(3), ("t:shift:n",)),
        "picky": Gate(picky, ("t:shift:n",)),
        "never": Gate(unknown, ("t:repeat",)),
    }
    got = {(r.gate, r.mutation): (r.outcome, r.failing) for r in corruptions.prove({"t": table}, runs).collect()}
    assert got[("bounds", "t:shift:n")] == (CAUGHT, "total in bounds") and got[("bounds", "t:repeat")][0] == CAUGHT
    assert got[("bounds", "t:drop")] == (MISSED, "") and got[("bounds", "t:swap:d")] == (UNCHANGED, "")
    assert got[("broken", "t:shift:n")][0] == NO_CONTROL
    assert got[("picky", "t:shift:n")][0] == NO_SETUP and got[("never", "t:repeat")][0] == NO_SETUP
    with pytest.raises(ValueError, match="gives no mutation shift:l"):
        corruptions.prove({"t": table}, {"g": Gate(total(1), ("t:shift:l",))})


def test_a_blank_is_no_agreement(spark):
    rows = spark.createDataFrame([(1, None, 0, 1), (None, None, 0, None), (2, 2, 0, 2)], "raw_reports int, series_reports int, excluded_reports int, eligible_reports int")
    got = {r.check: r.failures for r in gates.monthly_gate(rows).collect()}
    assert got == {"raw equals the independent series": 1, "eligible is raw minus excluded": 1}
