"""Manifests, extraction logs and content hashes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countwatch.session import ship
from countwatch.sources.bodies import reachable, read_bodies

WINDOW_ENTRY = (
    "struct<code:string,start:string,end:string,expected:bigint,api_total:bigint,pages:bigint,"
    "distinct_keys:bigint,status:string,utc:string>"
)
FILE_ENTRY = (
    "struct<source:string,url:string,retrieved_utc:string,bytes:bigint,sha256:string,meta_last_updated:string,"
    "results_total:bigint,results_skip:bigint,results_limit:bigint>"
)


def keyed_rows(df: DataFrame, column: str, value_type: str, *keep: str) -> DataFrame:
    """A4: a JSON object column, keyed by name, to one row per entry."""
    parsed = F.from_json(F.col(column), f"map<string,{value_type}>")
    return df.select(*keep, F.explode(parsed).alias("key", "value"))


def unparsed_rows(df: DataFrame, column: str, value_type: str, *keep: str) -> DataFrame:
    """A4: how many rows of a group hold text that is no such object; ``keyed_rows`` has nothing for them."""
    parsed = F.from_json(F.col(column), f"map<string,{value_type}>")
    return df.groupBy(*keep).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(column).isNotNull() & parsed.isNull()).alias("unparsed"))


def read_keyed(spark: SparkSession, path: str, field: str, entry: str) -> DataFrame:
    """A4: entries of a landed JSON document's object ``field`` (``windows`` or ``files``)."""
    schema = T.StructType([T.StructField(field, T._parse_datatype_string(f"map<string,{entry}>"))])
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    return whole.select(F.explode(field).alias("key", "entry")).select("key", "entry.*")


def incomplete_windows(log: DataFrame) -> DataFrame:
    """M2: windows that are not complete or do not hold what was expected; missing is never zero."""
    fine = (F.col("status") == "complete") & (F.col("api_total") == F.col("expected"))
    return log.filter(~F.coalesce(fine, F.lit(False)))


def unpacked_hash(packed: bytes, step: int = 1 << 20) -> str:
    """SHA-256 of a gzip body with all its members, unpacked a piece at a time and never held whole."""
    digest = hashlib.sha256()
    while packed:
        member = zlib.decompressobj(wbits=31)
        rest = packed
        while not member.eof:
            piece = member.decompress(rest, step)
            digest.update(piece)
            rest = member.unconsumed_tail
            if not piece and not rest and not member.eof:
                raise EOFError("gzip body ends inside a member")
        packed = member.unused_data.lstrip(b"\0")  # padding after a member is allowed
    return digest.hexdigest()


def _hashed(batches: Iterator) -> Iterator:
    for pdf in batches:
        yield pdf[["path"]].assign(sha256=[unpacked_hash(c) for c in pdf["content"]])


def stored_hashes(spark: SparkSession, path: str, pattern: str = "*.json.gz") -> DataFrame:
    """Hash of every stored body below ``path``, unpacked where it is gzip, each streamed by a task of its own.

    Where only Spark's readers reach the store, a body is one binary row instead.
    """
    if reachable(path):
        return read_bodies(spark, path, pattern).select("path", "sha256")
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    ).select("path", "content")
    if pattern.endswith(".gz"):
        ship(spark)
        return files.mapInPandas(_hashed, "path string, sha256 string")
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def reconcile(stored: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every path on either side with its verdict: matched, moved, stray (unlisted) or missing."""
    s = stored.select("path", F.col("sha256").alias("stored_sha"))
    m = manifest.select("path", F.col("sha256").alias("listed_sha"))
    verdict = (
        F.when(F.col("listed_sha").isNull(), "stray")
        .when(F.col("stored_sha").isNull(), "missing")
        .when(F.col("stored_sha") == F.col("listed_sha"), "matched")
        .otherwise("moved")
    )
    return s.join(m, "path", "full_outer").select("path", verdict.alias("verdict"))


def source_summary(entries: DataFrame) -> DataFrame:
    """Files, bytes and the distinct ``last_updated`` values per source."""
    return entries.groupBy("source").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(F.col("bytes").cast("long")).alias("bytes"),
        F.array_join(F.array_sort(F.collect_set("last_updated")), "|").alias("last_updated"),
    )
