"""The record tables, written once per source folder and read by every measure.

Reports (one row per report) and their bridge to product codes (one row per pair) are bucketed and sorted by the
report key with the same number of buckets. Whatever joins or groups by that key reads them without a shuffle, and the
lines behind them are rolled up once, not once per measure. Files lie in the shared folder and go with the application;
the session's catalog names them. ``refresh`` writes them anew when a folder's files were replaced under their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from countwatch.session import shared_folder
from countwatch.sources.sinks import write_record_table

KEY = "report_key"
#: Source bytes, as rows in memory, that a bucket should stand for, and the bounds of their number.
BUCKET_BYTES = 256 << 20
LEAST_BUCKETS, MOST_BUCKETS = 8, 16_384


def buckets_for(size: int) -> int:
    """A power of two, so that tables of different sizes still line up by coalescing buckets."""
    wanted = max(LEAST_BUCKETS, min(MOST_BUCKETS, -(-size // BUCKET_BYTES)))
    return 1 << (wanted - 1).bit_length()


def size_of(df: DataFrame) -> int:
    """Bytes of a table's rows as a task holds them: a word a field, and two more for a text.

    Files are no measure of that: packed columns grow many times over in a sort or a hash map. The rows are counted
    by the files' footers.
    """
    width = 8 + sum(8 + (16 if isinstance(f.dataType, (T.StringType, T.BinaryType)) else 0) for f in df.schema.fields)
    return df.count() * width


def record_tables(
    spark: SparkSession, name: str, sources: list[DataFrame], reports: Callable[[], DataFrame], bridge: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """(reports, bridge), from this application's earlier run where the sources' files are the same.

    The bridge is made from the reports as written, so that what is behind them runs once.

    ``name`` tells builds over the same files apart (the code column, the token lists, the window).
    """
    files = sorted(f for s in sources for f in s.inputFiles())
    digest = hashlib.sha256("\n".join([name, *files]).encode()).hexdigest()[:16]
    held = _held(spark)
    if digest not in held:
        buckets = buckets_for(sum(size_of(s) for s in sources))
        made = f"countwatch_reports_{digest}", f"countwatch_bridge_{digest}"
        places = [shared_folder(spark, table) for table in made]
        written = write_record_table(reports(), made[0], KEY, buckets, places[0])
        # Read by its files: known as bucketed, its rows would not be dealt anew, and each bucket of the bridge would be many files.
        pairs = bridge(spark.read.schema(written.schema).parquet(places[0]))
        write_record_table(pairs, made[1], KEY, buckets, places[1])
        held[digest] = made
    kept = held[digest]
    return spark.table(kept[0]), spark.table(kept[1])


def refresh(spark: SparkSession) -> None:
    """Forget what was written, so that the next plan writes it from the sources as they are now."""
    for tables in _held(spark).values():
        for t in tables:
            spark.sql(f"DROP TABLE IF EXISTS {t}")
    _held(spark).clear()


def _held(spark: SparkSession) -> dict[str, tuple[str, ...]]:
    context = spark.sparkContext
    if getattr(context, "_countwatch_records", None) is None:
        context._countwatch_records = {}
    return context._countwatch_records
