"""Structural similarity of feature cells with a request: matched, different, unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(key: str, value: Column, kind: str) -> Column:
    """A feature cell: key, kind of value (number, text, list) and its items as sorted strings; a null value is no cell."""
    items = F.transform(value, lambda x: x.cast("string")) if kind == "list" else F.array(value.cast("string"))
    return F.struct(F.lit(key).alias("key"), F.lit(kind).alias("kind"), F.when(value.isNotNull(), F.array_sort(items)).alias("items"))


def compare(expected: Column, stored: Column, key: str, kind: str) -> Column:
    """True, false, or null where nothing is stored.

    Lists of positions are equal as bags; other lists hold what is expected, and an empty one expects an empty one.
    """
    if kind != "list":
        same = stored == expected
    elif key.endswith("_positions"):
        same = F.array_sort(stored) == F.array_sort(expected)
    else:
        same = F.when(F.size(expected) == 0, F.size(stored) == 0).otherwise(F.size(F.array_except(expected, stored)) == 0)
    return F.when(stored.isNull() | expected.isNull(), F.lit(None).cast("boolean")).otherwise(same)


def scored(df: DataFrame, key: str, results: dict[str, Column]) -> DataFrame:
    """key, matched, different, unknown (names), score = matched / (matched + different); only rows with a match."""
    def names(want) -> Column:
        return F.filter(F.array(*(F.when(want(c), F.lit(n)) for n, c in results.items())), lambda x: x.isNotNull())

    out = df.select(key, names(lambda c: c).alias("matched"), names(lambda c: ~c).alias("different"), names(lambda c: c.isNull()).alias("unknown"))
    return out.where(F.size("matched") > 0).withColumn("score", F.size("matched") / (F.size("matched") + F.size("different")))


def scored_cells(cells: DataFrame, request: DataFrame, key: str) -> DataFrame:
    """The relational form: cells (key column, feature, value) against a request (feature, value), a few rows.

    (key, n_matched, n_known, score), with a match at least. Cells of features that aren't asked for are dropped by
    the broadcast join, and partial sums are formed before the shuffle.
    """
    both = cells.join(F.broadcast(request.withColumnRenamed("value", "expected")), "feature").where(F.col("value").isNotNull() & F.col("expected").isNotNull())
    hit = (F.col("value") == F.col("expected")).cast("long")
    return both.groupBy(key).agg(F.sum(hit).alias("n_matched"), F.count("*").alias("n_known")).where("n_matched > 0").withColumn("score", F.col("n_matched") / F.col("n_known"))


def scored_items(cells: DataFrame, request: DataFrame, key: str) -> DataFrame:
    """Cells (key, feature, kind, items) against a request (feature, kind, items), kind number, text or list; items as strings.

    (key, n_matched, n_known, score), with a match at least. Scalars match in value and kind; positions match as bags;
    other lists hold what is asked for, a scalar request as a list of one, and an empty request asks for an empty list.
    """
    r = request.select("feature", F.col("kind").alias("_k"), F.array_sort("items").alias("_i"))
    both = cells.join(F.broadcast(r), "feature").where(F.col("items").isNotNull() & F.col("_i").isNotNull())
    own = F.array_sort("items")
    listed = F.when(F.endswith("feature", F.lit("_positions")), own == F.col("_i")).when(F.size("_i") == 0, F.size(own) == 0).otherwise(F.size(F.array_except("_i", own)) == 0)
    hit = F.when(F.col("kind") == "list", listed).otherwise((F.col("kind") == F.col("_k")) & (own == F.col("_i"))).cast("long")
    return both.groupBy(key).agg(F.sum(hit).alias("n_matched"), F.count("*").alias("n_known")).where("n_matched > 0").withColumn("score", F.col("n_matched") / F.col("n_known"))


def request_of(spark, features: dict) -> DataFrame:
    """A request of a few features; null ones ask for nothing."""
    def items(v):
        one = lambda x: "true" if x is True else "false" if x is False else repr(float(x)) if isinstance(x, (int, float)) else str(x)
        one_number = lambda x: repr(float(x)) if isinstance(x, (bool, int, float)) else str(x)
        return ("list", [one(x) for x in v]) if isinstance(v, (list, tuple)) else ("number" if isinstance(v, (bool, int, float)) else "text", [one_number(v)])

    rows = [(k, *items(v)) for k, v in features.items() if v is not None]
    return spark.createDataFrame(rows, "feature string, kind string, items array<string>")
