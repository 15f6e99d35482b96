"""Readers for paged records, count series and bulk dimension files (A1, A2, A3)."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from typing import TextIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countwatch.session import ship
from countwatch.sources.bodies import reachable, read_bodies

#: Where ``read_bulk`` found a row: (file, place in its results).
PLACE = "listed_at"
RECORD = (
    "struct<mdr_report_key:string,report_number:string,date_received:string,date_of_event:string,date_report:string,"
    "event_type:string,report_source_code:string,summary_report_flag:string,noe_summarized:string,"
    "number_devices_in_event:string,manufacturer_name:string,manufacturer_g1_name:string,distributor_name:string,"
    "type_of_report:array<string>,remedial_action:array<string>,"
    "device:array<struct<device_report_product_code:string,manufacturer_d_name:string,brand_name:string>>>"
)
META = "struct<last_updated:string,results:struct<total:bigint,skip:bigint,limit:bigint>>"
BUCKET = "struct<time:string,count:string>"
CLASSIFICATION = (
    "struct<product_code:string,device_name:string,device_class:string,medical_specialty:string,"
    "medical_specialty_description:string,review_panel:string,regulation_number:string,implant_flag:string,"
    "life_sustain_support_flag:string,summary_malfunction_reporting:string,submission_type_id:string>"
)
RECALL = (
    "struct<product_code:string,res_event_number:string,event_date_initiated:string,event_date_posted:string,"
    "root_cause_description:string,reason_for_recall:string,k_numbers:array<string>,pma_numbers:array<string>>"
)
ENFORCEMENT = "struct<event_id:string,classification:string,report_date:string,center_classification_date:string>"


def _results(item: str, meta: str | None = None) -> T.StructType:
    fields = [T.StructField("results", T.ArrayType(T._parse_datatype_string(item)))]
    if meta:
        fields.append(T.StructField("meta", T._parse_datatype_string(meta)))
    return T.StructType(fields)


def read_record_pages(spark: SparkSession, path: str, cohort: list[str] | None = None) -> DataFrame:
    """A1: ``<path>/<code>/*.json.gz``, one row per record with its code and orderable position.

    The position is (cohort order, file name, place in page); explicit schema, absent fields are null.
    A gzip page is one task; pages are small by construction of the source.
    """
    order = {c: i for i, c in enumerate(cohort or [])}
    pages = spark.read.schema(_results(RECORD, META)).option("multiLine", True).json(f"{path}/*/*.json*")
    located = pages.select(
        F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("queried_code"),
        F.col("_metadata.file_name").alias("file_name"),
        "meta",
        F.posexplode("results").alias("place", "r"),
    )
    known = F.create_map(*(F.lit(x) for pair in order.items() for x in pair)) if order else F.create_map().cast("map<string,int>")
    rank = F.coalesce(F.try_element_at(known, F.col("queried_code")), F.lit(len(order)))
    return located.select(
        "r.*", "queried_code", F.struct(rank.alias("rank"), "queried_code", "file_name", "place").alias("position"),
        F.col("meta.last_updated").alias("last_updated"),
    )


def read_count_series(spark: SparkSession, path: str) -> DataFrame:
    """A2: count-by-day files ``<code>_*.json``: product_code, time, count (text as read), last_updated."""
    files = spark.read.schema(_results(BUCKET, "struct<last_updated:string>")).option("multiLine", True).json(path)
    return files.select(
        F.regexp_extract("_metadata.file_name", r"^([^_.]+)", 1).alias("product_code"),
        F.col("meta.last_updated").alias("last_updated"),
        F.explode("results").alias("b"),
    ).select("product_code", "last_updated", "b.time", "b.count")


def daily_counts(series: DataFrame) -> DataFrame:
    """Buckets of a checked series as (product_code, day, count)."""
    return series.select("product_code", F.col("time").alias("day"), F.col("count").try_cast("bigint").alias("count"))


def read_bulk(spark: SparkSession, path: str, item: str) -> DataFrame:
    """A3: the ``results`` arrays of a bulk JSON file, landed as is or as the JSON members of a zip.

    Every file and every zip member is streamed by a task of its own (``bodies``); where only Spark's readers reach the
    store, an unpacked file is read by the JSON reader and a zip as one binary row.
    """
    if reachable(path):
        items = read_bodies(spark, path, "*", "items", "*.json").select(F.concat_ws("!", "path", F.nullif("member", F.lit(""))).alias("file"), F.col("place").cast("int").alias("place"), "item")
        return _parsed(items, item)
    if not path.endswith(".zip"):
        landed = spark.read.schema(_results(item)).option("multiLine", True).json(path)
        return landed.select(F.col("_metadata.file_path").alias("file"), F.posexplode("results").alias("place", "r")).select("r.*", F.struct("file", "place").alias(PLACE))

    def unzip(batches: Iterator) -> Iterator:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in (n for n in z.namelist() if n.endswith(".json")):
                        with z.open(member) as body:
                            rows = enumerate(result_items(io.TextIOWrapper(body, encoding="utf-8")))
                            while block := list(islice(rows, 1000)):
                                yield pd.DataFrame({"file": f"{file}!{member}", "place": [p for p, _ in block], "item": [x for _, x in block]})

    ship(spark)
    return _parsed(spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unzip, "file string, place int, item string"), item)


def _parsed(items: DataFrame, item: str) -> DataFrame:
    """A result is a row of its own before it is parsed, so no value grows with the file."""
    parsed = items.select(F.from_json("item", T._parse_datatype_string(item)).alias("r"), F.struct("file", "place").alias(PLACE))
    return parsed.select("r.*", PLACE)


def result_items(body: TextIO, step: int = 1 << 20) -> Iterator[str]:
    """The elements of the ``results`` array as JSON texts, read piece by piece; only an unfinished one is held."""
    decoder, between = json.JSONDecoder(), re.compile(r"[\s,]*")
    held, inside = "", False
    while piece := body.read(step):
        held += piece
        if not inside:
            opened = re.search(r'"results"\s*:\s*\[', held)
            held = held[opened.end() :] if opened else held[-64:]
            inside = opened is not None
        at = 0
        while inside:
            at = between.match(held, at).end()
            if held[at : at + 1] == "]":
                return
            try:
                end = decoder.raw_decode(held, at)[1]
            except json.JSONDecodeError:  # the element goes on in the next piece
                break
            yield held[at:end]
            at = end
        held = held[at:]
    if inside:
        raise EOFError("the results array does not end")


def classification(bulk: DataFrame) -> DataFrame:
    """One row per upper-case code, blanks for absent values; the last entry of a code by (file, place) wins."""
    code = F.upper(F.trim("product_code"))
    details = [c for c in bulk.columns if c not in ("product_code", PLACE)]
    kept = F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in details])
    listed = bulk.withColumn("product_code", code).filter("product_code <> ''")
    return listed.groupBy("product_code").agg(F.max_by(kept, PLACE).alias("d")).select("product_code", "d.*")


def recall_inputs(recalls: DataFrame, enforcement: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Source recall and enforcement rows in the shape the recall operators take."""
    from countwatch.functions import text

    product = recalls.select(
        F.col("res_event_number").alias("event_number"), text.normal_code("product_code").alias("product_code"),
        F.col("event_date_initiated").alias("initiated"), F.col("event_date_posted").alias("posted"),
        F.col("root_cause_description").alias("root_cause"), text.cites_reports("reason_for_recall").alias("cites_reports"),
        (F.size("k_numbers") > 0).alias("has_k_numbers"), (F.size("pma_numbers") > 0).alias("has_pma_numbers"),
    )
    enforced = enforcement.select(
        "event_id", "classification", "report_date", F.col("center_classification_date").alias("classification_date")
    )
    return product, enforced
