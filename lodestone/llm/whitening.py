"""Whitening of embeddings: sums of centred products for each pair of dimensions, LAPACK, projections.

Each entry c becomes the whole number x = floor(1024 * c) + 100000. One aggregation sums x and counts, a second one
sums the products of centred entries for every pair of the upper triangle of dimensions: generated SQL expressions, one
column a pair, with map-side partial sums, so that a task sends one row whatever it has read. Only the assembled
covariance (dimensions squared) is on the driver, where LAPACK decomposes it. Projections are expressions again.

Centring is exact: with S = q * n + r, an entry's deviation from the mean is the whole number x - q less the fraction
r / n, so that no large numbers cancel.

Defined results: a vector that is null, empty or holds a null or non-finite entry is dropped; so is one whose length
isn't the table's most frequent (the smaller of equally frequent ones), as it has no covariance with the others.
Entries beyond +-2**40 count as +-2**40. `deviation` is null where it needs more than 64 bits. A component without
variance (an eigenvalue of no more than rounding) has null as `whitened` and stays out of `identity_error`; without any
variance `explained` and `identity_error` are null. Null or repeated ids are rows like any other; an empty table gives
an empty result. Other columns don't matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import setting

SCALE, SHIFT, LIMIT = 1024, 100_000, float(1 << 40)


def usable(vectors: DataFrame, vec: str = "embedding") -> Column:
    """Not null, not empty, all entries finite numbers."""
    v = F.col(vec).cast("array<double>")
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))


def _entries(vectors: DataFrame, vec_id: str, vec: str) -> tuple[DataFrame, int]:
    """(vec_id, x0, x1, ...) of the rows that count, dimensions."""
    rows = vectors.where(usable(vectors, vec)).select(F.col(vec_id).alias("vec_id"), F.col(vec).cast("array<double>").alias("v"))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = most[0].d if most else 0
    c = [F.greatest(F.least(F.element_at("v", i + 1), F.lit(LIMIT)), F.lit(-LIMIT)) for i in range(d)]
    return rows.where(F.size("v") == d).select("vec_id", *((F.floor(c[i] * SCALE) + SHIFT).cast("long").alias(f"x{i}") for i in range(d))), d


def covariance(entries: DataFrame, names: list[str], means: list[tuple[int, int]], n: int) -> np.ndarray:
    """Covariance of whole-number columns, divisor n; means: (quotient, remainder) of each sum by n."""
    d = len(names)
    centred = entries.selectExpr(*(f"CAST({x} - {q}L AS DOUBLE) - {r / n!r}D AS c{i}" for i, (x, (q, r)) in enumerate(zip(names, means, strict=True))))
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    # Thousands of sums make generated code too large for the JIT compiler; interpreted they take less time.
    with setting(entries.sparkSession, spark_sql_codegen_wholeStage="false"):
        row = centred.selectExpr(*(f"SUM(c{i} * c{j}) AS p{i}_{j}" for i, j in upper)).first()
    v = np.zeros((d, d))
    for (i, j), total in zip(upper, row, strict=True):
        v[i, j] = v[j, i] = total / n
    return v


def whiten(vectors: DataFrame, components: int = 8, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error, for each row that counts."""
    entries, d = _entries(vectors, vec_id, vec)
    names = [f"x{i}" for i in range(d)]
    total = entries.agg(F.count("*").alias("n"), *(F.sum(F.col(x).cast("decimal(20,0)")).alias(x) for x in names)).first()
    n, k = total.n, min(components, d)
    if not n:
        kind = "vec_id " + dict(vectors.dtypes)[vec_id] + ", component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], kind)
    means = [divmod(int(total[x]), n) for x in names]
    cov = covariance(entries, names, means, n)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    trace = float(np.trace(cov))
    least = max(trace, 0.0) * d * np.finfo(float).eps
    centred = [F.expr(f"CAST({x} - {q}L AS DOUBLE) - {r / n!r}D") for x, (q, r) in zip(names, means, strict=True)]
    whole = [F.expr(f"CAST({x} - {q}L AS DECIMAL(19,0)) * {n}BD - {r}BD") for x, (q, r) in zip(names, means, strict=True)]
    squares = F.array(*(F.try_multiply(w, w).cast("decimal(38,0)") for w in whole))
    deviation = F.aggregate(squares, F.lit(0).cast("decimal(38,0)"), lambda a, b: F.try_add(a, b).cast("decimal(38,0)")).try_cast("long")

    def projected(j: int) -> Column:
        if values[j] <= least:
            return F.lit(None).cast("double")
        weights = F.array(*(F.lit(float(w)) for w in axes[:, j] / np.sqrt(values[j])))
        return F.aggregate(F.zip_with("c", weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    rows = entries.select("vec_id", deviation.alias("deviation"), F.array(*centred).alias("c")).select("vec_id", "deviation", *(projected(j).alias(f"w{j}") for j in range(k)))
    error = _identity_error(rows, [j for j in range(k) if values[j] > least])
    each = [F.struct(F.lit(j + 1).alias("component"), F.col(f"w{j}").alias("whitened"), F.lit(float(values[j]) / trace if trace > 0 else None).cast("double").alias("explained")) for j in range(k)]
    return rows.select("vec_id", "deviation", F.explode(F.array(*each)).alias("e")).select("vec_id", "e.component", F.lit(n).cast("long").alias("n"), "deviation", "e.whitened", "e.explained", F.lit(error).cast("double").alias("identity_error"))


def _identity_error(rows: DataFrame, held: list[int]) -> float | None:
    """Largest absolute entry of the covariance of the whitened columns minus the identity, measured over all rows."""
    if not held:
        return None
    mean = rows.agg(*(F.avg(f"w{j}") for j in held)).first()
    upper = [(a, b) for a in range(len(held)) for b in range(a, len(held))]
    row = rows.agg(*(F.avg((F.col(f"w{held[a]}") - mean[a]) * (F.col(f"w{held[b]}") - mean[b])) for a, b in upper)).first()
    return max(abs(v - (a == b)) for (a, b), v in zip(upper, row, strict=True))
