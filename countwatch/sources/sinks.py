"""Writers: CSV export, record tables, JSON facts, append-only history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A5: header, explicit schema, empty text reads as absent."""
    return spark.read.schema(schema).option("header", True).option("emptyValue", "").csv(path)


def export_csv(df: DataFrame, path: str, order: Sequence[str], empty_label: dict | None = None) -> None:
    """A5/F1: a published CSV in its stated order; booleans as true/false, absent as empty.

    The sort is a range partitioning, so part files are in order and a small table is one file. An
    empty table gets its labelled row here and nowhere else.
    """
    if empty_label is not None and df.isEmpty():
        df = df.sparkSession.createDataFrame([empty_label]).select(*empty_label)
    ordered = df.orderBy(*[c for c in order if c in df.columns])
    ordered.write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


def write_record_table(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Rebuild a record table bucketed and sorted by its key, so key joins need no shuffle; returns the table.

    Rows are dealt by the bucket function first, so each bucket is one file. With ``path`` the table lies there and the
    catalog only names it.
    """
    dealt = df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    (dealt.option("path", path) if path else dealt).saveAsTable(name)
    return df.sparkSession.table(name)


def write_json_fact(df: DataFrame, path: str) -> None:
    """A one-row table of facts as one JSON object."""
    df.write.mode("overwrite").json(path)


def append_history(df: DataFrame, path: str) -> None:
    """One JSON line per run, failed runs included; never rewritten."""
    df.write.mode("append").json(path)


def latest_run(history: DataFrame, condition: str) -> DataFrame:
    """the newest run that satisfies ``condition``."""
    row = F.struct(*history.columns)
    return history.filter(condition).agg(F.max_by(row, "vintage").alias("r")).filter("r is not null").select("r.*")
