"""Two-sided matching by evidence: a pair holds only if it is the one choice of both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matched(candidates: DataFrame, wanted: DataFrame, left: str, right: str, alike: str | None = None) -> DataFrame:
    """(left, right, status, n_candidates, n_compatible) for each of `wanted`; right is null unless matched.

    candidates: (left, right, evidence, conflicts), a row for each pair that was compared; a pair is compatible with some evidence and no
    conflict. A left side takes its only compatible candidate, and loses it if another one takes the same. Statuses: matched; ambiguous
    (several are compatible, or the only one is taken twice); conflict (none is, and one conflicts); insufficient_evidence; missing
    (nothing to compare with). With `alike`, a row stands for that many pairs of one left side with equal evidence and conflicts, and names the
    least of their right sides; so pairs that only differ in their right side needn't be formed. Counts of a side are formed before the shuffle, so neither a popular candidate nor a side with very many is held whole.
    """
    fits = (F.coalesce("evidence", F.lit(0)) > 0) & (F.coalesce("conflicts", F.lit(0)) == 0)
    n = F.col(alike) if alike else F.lit(1)
    by_left = candidates.where(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(left).agg(
        F.sum(n).alias("n_candidates"), F.sum(F.when(fits, n).otherwise(0)).alias("n_compatible"), F.max(F.coalesce("conflicts", F.lit(0))).alias("_worst"), F.min(F.when(fits, F.col(right))).alias("_only"),
    )
    taken = by_left.where("n_compatible = 1").groupBy(F.col("_only").alias("_right")).agg(F.count("*").alias("_uses"))
    out = wanted.select(left).distinct().join(by_left, left, "left").join(taken, (F.col("_only") == F.col("_right")) & (F.col("n_compatible") == 1), "left")
    sole = (F.col("n_compatible") == 1) & (F.col("_uses") == 1)
    status = F.when(F.col("n_candidates").isNull(), "missing").when(sole, "matched").when(F.col("n_compatible") > 0, "ambiguous").when(F.col("_worst") > 0, "conflict").otherwise("insufficient_evidence")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(left, F.when(sole, F.col("_only")).alias(right), status.alias("status"), zero("n_candidates"), zero("n_compatible"))
