"""Readers of source registries, native texts and page files, and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import split_lines

REGISTRY = "source_id string, title string, source_type string, path string, sha256 string, method_hint string, author string, pdf_pages int, original_pdf_path string, original_pdf_sha256 string"
PAGE = "source_id string, page int, text string, text_sha256 string, provenance struct<method:string,review_status:string,original_pdf_sha256:string,source_page:int>"


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a JSON-lines file; an empty file or a repeated id is an error."""
    df = spark.read.schema(REGISTRY).json(path)
    if df.isEmpty():
        raise ValueError("the registry is empty")
    twice = df.groupBy("source_id").count().where("count > 1 or source_id is null").limit(5).collect()
    if twice:
        raise ValueError(f"ids are repeated or missing: {[r.source_id for r in twice]}")
    return df


def native_text(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, sha256, line_no (from 1), line of UTF-8 files, hashed as bytes."""
    files = spark.read.format("binaryFile").load(paths)
    lines = files.select("path", F.sha2("content", 256).alias("sha256"), split_lines(F.decode("content", "UTF-8")).alias("l"))
    return lines.select("path", "sha256", F.posexplode("l").alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE).json(path)


def page_problems(df: DataFrame, total: int) -> DataFrame:
    """(source_id, page, problem): out of range, repeated, wrong hash, no provenance."""
    n = F.count("*").over(Window.partitionBy("source_id", "page"))
    checks = {
        "range": F.col("page").between(1, total),
        "repeated": n == 1,
        "hash": F.sha2("text", 256) == F.col("text_sha256"),
        "provenance": F.col("provenance.method").isNotNull(),
    }
    found = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in checks.items())), lambda x: x.isNotNull())
    return df.withColumn("_p", found).select("source_id", "page", F.explode("_p").alias("problem"))


def missing_pages(df: DataFrame, totals: DataFrame) -> DataFrame:
    """(source_id, page) of 1 .. pdf_pages that no record holds; totals: (source_id, pdf_pages)."""
    want = totals.where("pdf_pages > 0").select("source_id", F.explode(F.sequence(F.lit(1), F.col("pdf_pages"))).alias("page"))
    return want.join(df.select("source_id", "page"), ["source_id", "page"], "left_anti")


def body_lines(df: DataFrame) -> DataFrame:
    """source_id, page, line_no of the assembled body, where a head line opens each page."""
    w = Window.partitionBy("source_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    counted = df.withColumn("_l", F.split("text", "\n")).withColumn("_before", F.coalesce(F.sum(F.size("_l") + 1).over(w), F.lit(0)))
    lines = F.concat(F.array(F.concat(F.lit("[page "), F.col("page"), F.lit("]"))), F.col("_l"))
    return counted.select("source_id", "page", "_before", F.posexplode(lines).alias("i", "line")).select("source_id", "page", (F.col("_before") + F.col("i") + 1).alias("line_no"), "line")
