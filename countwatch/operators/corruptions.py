"""Corruption runs (M15): gates shown to fail on tables with one row changed, the changes drawn from schema and keys.

A gate that has never failed proves little. Here every table states its keys, ``mutations`` derives one-row changes from
its schema, and every gate names those it must catch. ``prove`` runs each gate on the clean tables and on each changed
copy, and a catch counts only where the clean copy passed, the change changed something and nothing broke in setting up.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countwatch.session import stage

CAUGHT, MISSED, UNCHANGED = "caught", "missed", "unchanged"
NO_CONTROL, NO_SETUP = "no proof: the clean copy fails", "no proof: set-up error"


@dataclass(frozen=True)
class Table:
    """Rows, the columns that tell them apart, and which rows may be picked for a change."""

    rows: DataFrame
    keys: tuple[str, ...]
    among: str = "true"


@dataclass(frozen=True)
class Gate:
    """From tables by name to rows (check, passed); ``must`` names mutations as ``table:kind[:column]``."""

    check: Callable[[Mapping[str, DataFrame]], DataFrame]
    must: tuple[str, ...]


def _shifted(field: T.StructField) -> Column | None:
    """The next value along, or None for a type that has none."""
    c = F.col(field.name)
    if isinstance(field.dataType, T.NumericType):
        return (c + 1).cast(field.dataType)
    if isinstance(field.dataType, T.BooleanType):
        return ~c
    if isinstance(field.dataType, T.StringType):
        return F.concat(c, F.lit("x"))
    if isinstance(field.dataType, T.DateType):
        return F.date_add(c, 1)
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return c + F.expr("interval 1 day")
    return None


def mutations(table: Table) -> dict[str, Callable[[], DataFrame]]:
    """Changed copies by ``kind`` or ``kind:column``, each differing in the row of the least key (swap: and of the greatest).

    drop and repeat take the whole row; shift moves a value to the next, blank empties it, swap exchanges it with the
    other end's. One aggregate per table finds both ends; the copies read it as scalar subqueries, so no row passes
    through the driver. A copy is built when its function is called.
    """
    rows, key = table.rows, F.struct(*table.keys)
    values = [pick(F.col(c), key).alias(f"{c} {end}") for c in rows.columns for pick, end in ((F.min_by, "first"), (F.max_by, "last"))]
    ends = stage(rows.where(table.among).agg(F.min(key).alias("first"), F.max(key).alias("last"), *values), "ends")
    at = lambda name: ends.select(F.col(f"`{name}`")).scalar()
    first, last = key.eqNullSafe(at("first")), key.eqNullSafe(at("last"))

    def changed(name: str, value: Column) -> Callable[[], DataFrame]:
        return lambda: rows.withColumn(name, F.when(first, value).otherwise(F.col(name)))

    def swapped(name: str) -> Callable[[], DataFrame]:
        return lambda: rows.withColumn(name, F.when(first, at(f"{name} last")).when(last, at(f"{name} first")).otherwise(F.col(name)))

    out = {"drop": lambda: rows.where(~first), "repeat": lambda: rows.unionByName(rows.where(first))}
    for field in rows.schema.fields:
        shifted = _shifted(field)
        if shifted is not None:
            out[f"shift:{field.name}"] = changed(field.name, shifted)
        out[f"blank:{field.name}"] = changed(field.name, F.lit(None).cast(field.dataType))
        out[f"swap:{field.name}"] = swapped(field.name)
    return out


def _content(rows: DataFrame) -> DataFrame:
    """An order-free summary of a table: equal tables have equal ones. Nulls are told from absent values."""
    cells = [x for c in sorted(rows.columns) for x in (F.col(c), F.col(c).isNull())]
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*cells).cast("decimal(38,0)")).alias("h")).select(F.concat_ws("/", "n", "h").alias("content"))


def _run(gate: Gate, tables: Mapping[str, DataFrame], name: str, mutation: str) -> DataFrame:
    label = F.lit(name).alias("gate"), F.lit(mutation).alias("mutation")
    try:
        return gate.check(tables).select(*label, "check", "passed", F.lit(False).alias("broken"))
    except (AnalysisException, ValueError, KeyError):
        some = next(iter(tables.values())).sparkSession
        return some.range(1).select(*label, F.lit(None).cast("string").alias("check"), F.lit(False).alias("passed"), F.lit(True).alias("broken"))


def prove(tables: Mapping[str, Table], gates: Mapping[str, Gate]) -> DataFrame:
    """(gate, mutation, outcome, failing): per gate and mutation it must catch, what came of it and which checks failed.

    A mutation that a table's schema does not give is an error of the declaration and is raised. An error met while a
    gate is set up on a changed copy is reported as no proof; one met at run time stops the run. A gate's runs are one
    job, written before the next gate's.
    """
    clean = {n: t.rows for n, t in tables.items()}
    copies = {n: mutations(t) for n, t in tables.items() if any(m.startswith(f"{n}:") for g in gates.values() for m in g.must)}
    for name, gate in gates.items():
        for mutation in gate.must:
            table, kind = mutation.split(":", 1)
            if kind not in copies.get(table, {}):
                raise ValueError(f"{name}: table {table} gives no mutation {kind}")
    parts = []
    for name, gate in gates.items():
        runs, contents = [_run(gate, clean, name, "")], []
        for mutation in gate.must:
            table, kind = mutation.split(":", 1)
            copy = copies[table][kind]()
            runs.append(_run(gate, {**clean, table: copy}, name, mutation))
            contents.append(_content(copy).select(F.lit(mutation).alias("mutation"), F.lit(table).alias("table"), "content"))
        before = [_content(clean[t]).select(F.lit("").alias("mutation"), F.lit(t).alias("table"), "content") for t in sorted({m.split(":", 1)[0] for m in gate.must})]
        union = lambda rows: reduce(DataFrame.unionByName, rows)
        parts.append((stage(union(runs), "runs"), stage(union(before + contents), "contents")))
    told = (
        union([runs for runs, _ in parts])
        .groupBy("gate", "mutation")
        .agg(
            F.array_join(F.array_sort(F.collect_set(F.when(~F.coalesce("passed", F.lit(False)), F.coalesce("check", F.lit("?"))))), "; ").alias("failing"),
            F.bool_or("broken").alias("broken"),
        )
    )
    seen = union([contents for _, contents in parts]).distinct()
    before = seen.where("mutation = ''").select("table", F.col("content").alias("before"))
    changes = seen.where("mutation <> ''").join(before, "table").select("mutation", (~F.col("content").eqNullSafe(F.col("before"))).alias("changed"))
    control = told.where("mutation = ''").select("gate", ((F.col("failing") == "") & ~F.col("broken")).alias("control"))
    outcome = (
        F.when(F.col("broken"), NO_SETUP).when(~F.col("control"), NO_CONTROL).when(~F.col("changed"), UNCHANGED).when(F.col("failing") != "", CAUGHT).otherwise(MISSED)
    )
    return told.where("mutation <> ''").join(control, "gate").join(changes, "mutation").select("gate", "mutation", outcome.alias("outcome"), "failing")
