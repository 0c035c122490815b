"""Exact cosine nearest neighbours, filtered before the top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def valid(v: Column, size: int) -> Column:
    """Of the right length, finite, and not all zero."""
    return (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


#: Query vectors that are broadcast at most.
QUERIES = 1 << 12


def knn(vectors: DataFrame, query: DataFrame, evidence: Column, k: int, scope: Column | None = None) -> DataFrame:
    """(evidence, score) of the k best evidences: its best window over all query vectors.

    query: (q, qv), a stated set; up to QUERIES rows are broadcast, more meet the vectors block by block. Of each query
    vector the k + 1 best evidences count.
    """
    few = query.limit(QUERIES + 1).count() <= QUERIES
    own = vectors if scope is None else vectors.where(scope)
    rows = own.select(evidence.alias("evidence"), "vec_id", "embedding").crossJoin(F.broadcast(query) if few else query).select("evidence", "vec_id", "q", cosine(F.col("embedding"), F.col("qv")).alias("score"))
    best = rows.groupBy("evidence", "q").agg(F.max("score").alias("score"))
    top = best.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "evidence"))).where(F.col("n") <= k + 1)
    return top.groupBy("evidence").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "evidence").limit(k)
