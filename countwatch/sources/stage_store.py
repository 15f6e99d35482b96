"""A versioned store of forecast rows: development may run again, the locked test runs once.

Rows lie in partitions (version, stage) of one folder. A run overwrites only the partitions it brings (dynamic partition
overwrite), so a development run leaves locked rows alone and a run that died half-way is simply run again. What may happen
once is committed by creating a folder that must not exist: the decision per code, and the locked result with its content
hash. Until that commit a locked run may be retried; after it every further one is refused. A later version republishes the
locked rows; the hash per version tells whether they are still the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from countwatch.session import stage as staged

DEVELOPMENT, LOCKED = "development", "locked"
KEYS = ("product_code", "model", "origin", "target", "horizon", "issue_date", "period")
VALUES = ("point", "lower50", "upper50", "lower80", "upper80", "calibration_n")


class Refused(ValueError):
    """An operation that the order of stages forbids."""


def row_text(keys=KEYS, values=VALUES, unit: float = 1e6) -> Column:
    """A row as text that any engine can write: figures in whole units of 1e-6, absent ones as ``-``."""
    told = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in keys]
    told += [F.coalesce(F.round(F.col(c) * unit).cast("long").cast("string"), F.lit("-")) for c in values]
    return F.concat_ws("|", *told)


def content_hash(rows: DataFrame, by: str) -> DataFrame:
    """(by, rows, content_hash): 60 bits of each row's md5, summed, so neither order nor partitions matter and repeats count."""
    bits = F.conv(F.substring(F.md5(row_text()), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.sum(bits).cast("string").alias("content_hash"))


class StageStore:
    def __init__(self, spark: SparkSession, root: str, locked_from: str) -> None:
        """``locked_from``: the first origin (``YYYY-MM``) that belongs to the locked stage."""
        self.spark, self.root, self.locked_from = spark, root.rstrip("/"), locked_from

    # what is there ---------------------------------------------------------------------------

    def _has(self, name: str) -> bool:
        """Whether a folder was committed: written whole, with the writer's success mark."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/_SUCCESS")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def rows(self, stage: str | None = None) -> DataFrame:
        all_rows = self.spark.read.parquet(f"{self.root}/rows").withColumn("version", F.col("version").cast("string"))
        return all_rows if stage is None else all_rows.where(F.col("stage") == stage)

    def decisions(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.root}/decision") if self._has("decision") else None

    def locked_versions(self) -> DataFrame:
        """M8: rows and content hash of the locked stage per version; one locked result means one hash."""
        return content_hash(self.rows(LOCKED), "version")

    # what may happen -------------------------------------------------------------------------

    def develop(self, version: str, rows: DataFrame) -> None:
        """Replace the development rows of a version; every other partition stays."""
        self._write(version, DEVELOPMENT, rows.where(F.col("origin") < self.locked_from))

    def decide(self, decisions: DataFrame) -> None:
        """The model in use per code, once."""
        self._once("decision", decisions, "the decision was made; it is not revisited")

    def lock(self, version: str, rows: DataFrame) -> None:
        """The locked rows, once, after every code among them has a decision."""
        if self._has("locked"):
            raise Refused("locked rows were committed; the locked test runs once")
        mine = rows.where(F.col("origin") >= self.locked_from)
        made = self.decisions()
        if made is None or not mine.join(made, "product_code", "left_anti").isEmpty():
            raise Refused("a code has no decision; decide on the development rows first")
        self._write(version, LOCKED, mine)
        written = self.rows(LOCKED).where(F.col("version") == version)
        self._once("locked", content_hash(written, "version"), "locked rows were committed; the locked test runs once")

    def republish(self, version: str, of: str, changed: dict[str, Column] | None = None) -> None:
        """Carry the locked rows of ``of`` into a later version; ``changed`` (column to expression) is for proofs that a change shows."""
        rows = self.rows(LOCKED).where(F.col("version") == of).drop("version", "stage")
        # Read whole before anything under the same folder is written.
        rows = staged(rows.withColumns(changed) if changed else rows, "republished")
        self._write(version, LOCKED, rows)

    def same_as_committed(self) -> DataFrame:
        """Versions whose locked rows are no longer those of the commit."""
        commit = self.spark.read.parquet(f"{self.root}/locked").select(F.col("rows").alias("n"), F.col("content_hash").alias("h"))
        told = self.locked_versions()
        return told.join(commit, (F.col("rows") == F.col("n")) & (F.col("content_hash") == F.col("h")), "left_anti")

    def _write(self, version: str, stage: str, rows: DataFrame) -> None:
        # Versions and stages are literals, so a run can touch no partition but its own.
        named = rows.withColumn("version", F.lit(version)).withColumn("stage", F.lit(stage))
        named.write.partitionBy("version", "stage").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.root}/rows")

    def _once(self, name: str, df: DataFrame, why: str) -> None:
        try:
            df.write.mode("errorifexists").parquet(f"{self.root}/{name}")
        except AnalysisException as found:
            if self._has(name):
                raise Refused(why) from found
            # A folder without the success mark is a commit that died: nothing was ever read from it.
            df.write.mode("overwrite").parquet(f"{self.root}/{name}")
