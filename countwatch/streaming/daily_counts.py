"""Daily counts per event type from an event stream, late rows reported rather than lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
CLOSED = "day timestamp, event_type string, events bigint, total double"
DELAY = "1 day"


def closed_days(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Tumbling days that the watermark has closed; a repeated event id counts once."""
    timed = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return (
        timed.withWatermark("ts", delay)
        .dropDuplicatesWithinWatermark(["event_id"])
        .groupBy(F.window("ts", "1 day").alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("day"), "event_type", "events", "total")
    )


def run_available(spark: SparkSession, source: str, out: str, delay: str = DELAY, files_per_batch: int | None = None) -> dict[str, int]:
    """Process what has landed, append closed days to ``out``, and report the rows that came too late.

    ``source`` may be a file, a folder or a glob. Each micro-batch writes its own partition, so a
    retried batch replaces its rows instead of repeating them.
    """
    reader = spark.readStream.schema(EVENT)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    events = reader.parquet(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    told = Told(out)
    spark.streams.addListener(told)
    query = (
        closed_days(events, delay)
        .writeStream.outputMode("append")
        .queryName(out)
        .foreachBatch(write)
        .option("checkpointLocation", f"{out}_stream")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    # The listener bus is asynchronous: wait for what the query has already posted.
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    spark.streams.removeListener(told)
    return {"late_rows": told.late, "batches": told.batches}


class Told(StreamingQueryListener):
    """Adds up every batch of one query as it ends; the query itself keeps only its newest batches."""

    def __init__(self, out: str) -> None:
        self.name, self.late, self.batches = out, 0, 0

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        if event.progress.name == self.name:
            self.batches += 1
            self.late += sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)


def every_reading(spark: SparkSession, source: str, out: str) -> DataFrame:
    """The second view: days of all rows, late ones and open days included, from one partial table per batch.

    A repeated event id counts once over all batches; each batch writes its own partition, so a retried
    batch replaces its rows.
    """
    events = spark.readStream.schema(EVENT).parquet(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        day = F.date_trunc("day", F.col("ts")).cast("timestamp")
        batch.select("event_id", day.alias("day"), "event_type", "value").distinct().write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = events.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}_stream").trigger(availableNow=True).start()
    query.awaitTermination()
    kept = spark.read.schema("event_id bigint, day timestamp, event_type string, value double").parquet(f"{out}/batch=*")
    return kept.distinct().groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))


def read_closed(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(CLOSED).parquet(f"{out}/batch=*")


SPLIT = f"{EVENT}, late boolean"
MARKS = "upto timestamp_ntz, batch bigint"


def split_late(spark: SparkSession, source: str, out: str, delay: str = DELAY, files_per_batch: int | None = None) -> None:
    """Append every event to ``out`` with ``late``: whether it came behind the watermark that stood when its batch began.

    The watermark of a batch is the newest time of all earlier batches less ``delay``, to the millisecond, as the
    engine keeps it; an event at or before it is late, and a first batch has no late events. Each batch writes its rows and
    the newest time so far under its own number and reads only lower numbers, so a retried batch writes the same again.
    Events without a time are never late.
    """
    reader = spark.readStream.schema(EVENT)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def write(batch: DataFrame, batch_id: int) -> None:
        before = newest(spark, out, batch_id)
        mark = F.date_trunc("millisecond", F.lit(before).cast("timestamp_ntz")) - F.expr(f"INTERVAL {delay}")
        rows = f"{out}/rows/batch={batch_id}"
        batch.withColumn("late", F.coalesce(F.col("ts") <= mark, F.lit(False))).write.mode("overwrite").parquet(rows)
        # The batch is read back, not run again: one column, from the files just written.
        seen = spark.read.schema(SPLIT).parquet(rows).agg(F.max("ts").alias("ts"))
        seen.select(F.greatest("ts", F.lit(before).cast("timestamp_ntz")).alias("upto")).write.mode("overwrite").parquet(f"{out}/marks/batch={batch_id}")

    # The marks' folder exists from the start, so that the first batch finds it empty.
    spark.createDataFrame([], "upto timestamp_ntz").write.mode("overwrite").parquet(f"{out}/marks/batch=-1")
    query = reader.parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", f"{out}_stream").trigger(availableNow=True).start()
    query.awaitTermination()


def newest(spark: SparkSession, out: str, batch_id: int):
    """The newest event time before a batch: one value, from one row per batch; None before the first."""
    marks = spark.read.schema(MARKS).parquet(f"{out}/marks").where(F.col("batch") < batch_id)
    return marks.agg(F.max("upto")).first()[0]


def read_split(spark: SparkSession, out: str) -> DataFrame:
    """All events with ``late`` and the ``batch`` that brought them."""
    return spark.read.schema(f"{SPLIT}, batch bigint").parquet(f"{out}/rows")
