"""Incremental builds on Structured Streaming: new records extend postings by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.index import postings


def new_postings(docs: DataFrame, key: str, text: str, late: str, ts: str) -> DataFrame:
    """A stream of documents without repeats of one text within the watermark, as a stream of token rows."""
    own = docs.withWatermark(ts, late).withColumn("_hash", F.sha2(text, 256)).dropDuplicatesWithinWatermark(["_hash"])
    return own.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))).alias("term"))


def extend(path: str, key: str, focus, body):
    """A foreachBatch sink that appends each batch's postings under its own number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        postings(batch, key, focus, body).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
