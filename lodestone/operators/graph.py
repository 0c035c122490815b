"""Groups of records that blocked pairs join; the representative is the smallest member."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.segment import ratio as similarity
from ..sources.publish import shared_dir

#: Rounds after which labels must have settled; they halve the longest path each time.
ROUNDS = 64


def _checkpoints(spark: SparkSession) -> None:
    """The shared folder as the context's checkpoint folder, where it has none."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def checkpointed(df: DataFrame) -> DataFrame:
    """df as written in the shared folder: what several later steps read is made once, and a lost executor doesn't bring it back."""
    _checkpoints(df.sparkSession)
    return df.checkpoint()


def grouped(nodes: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """(key, group) for every node; edges: (a, b). Labels sink to the smallest neighbour's label and jump along them.

    Each round is checkpointed; rounds grow with the logarithm of the longest path.
    """
    _checkpoints(nodes.sparkSession)
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = nodes.select(F.col(key).alias("n"), F.col(key).alias("g")).distinct().checkpoint()
    for _ in range(ROUNDS):
        near = both.join(labels, F.col("b") == F.col("n")).groupBy("a").agg(F.min("g").alias("m"))
        sunk = labels.join(near, F.col("n") == F.col("a"), "left").select("n", F.least("g", F.coalesce("m", "g")).alias("g"))
        # The label's own label is at most the label: one jump halves a path.
        jump = sunk.select(F.col("n").alias("j"), F.col("g").alias("jg"))
        new = sunk.join(jump, F.col("g") == F.col("j"), "left").select("n", F.least("g", F.coalesce("jg", "g")).alias("g")).checkpoint()
        if new.join(labels.toDF("o", "og"), F.col("n") == F.col("o")).where("g != og").isEmpty():
            return labels.select(F.col("n").alias(key), F.col("g").alias("group"))
        labels = new
    raise RuntimeError("the groups did not settle")


def blocked_pairs(df: DataFrame, key: str, block: list[str], test: Column) -> DataFrame:
    """Pairs (a, b), a < b, of one block that pass a test over the columns of both (x. and y.)."""
    x, y = df.alias("x"), df.alias("y")
    same = F.lit(True)
    for b in block:
        same &= F.col(f"x.{b}") == F.col(f"y.{b}")
    return x.join(y, same & (F.col(f"x.{key}") < F.col(f"y.{key}"))).where(test).select(F.col(f"x.{key}").alias("a"), F.col(f"y.{key}").alias("b"))


def similar_pairs(df: DataFrame, key: str, block: list[str], text: str, date: str, near: float = 0.97, dated: float = 0.85) -> DataFrame:
    """Pairs (a, b, ratio), a < b, of one block whose texts are alike: from `dated` on where both have the same date, from `near` on otherwise; two different dates never match.

    The ratio is twice the characters of common blocks over all characters. Two bounds that lose no pair come before it: by
    lengths, and by common characters counted with their repeats. Equal texts of one date stand for each other: they link
    with the first of them, and only the firsts meet. A null in the block, a null text and an empty one link with nothing.
    """
    own = df.select(F.col(key).alias("_k"), *block, F.col(text).alias("_t"), F.col(date).cast("string").alias("_d")).where(F.col("_t") != "").dropna(subset=block)
    firsts = own.groupBy(*block, "_t", "_d").agg(F.min("_k").alias("_first"))
    on = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*block, "_t", "_d")]
    copies = own.alias("x").join(firsts.alias("y"), on).where("x._k != y._first").select(F.col("y._first").alias("a"), F.col("x._k").alias("b"), F.lit(1.0).alias("ratio"))
    counted = firsts.withColumns({"_n": F.char_length("_t"), "_c": F.array_sort(F.split("_t", ""))})
    needed = F.when(F.col("x._d") == F.col("y._d"), dated).otherwise(near)
    fits = (F.col("x._d").isNull() | F.col("y._d").isNull() | (F.col("x._d") == F.col("y._d"))) & (2 * F.least("x._n", "y._n") >= needed * (F.col("x._n") + F.col("y._n")))
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in block]
    met = counted.alias("x").join(counted.alias("y"), [*same, F.col("x._first") < F.col("y._first"), fits])
    both = met.select(F.col("x._first").alias("a"), F.col("y._first").alias("b"), F.col("x._t").alias("s"), F.col("y._t").alias("t"), needed.alias("needed"), (2 * _shared(F.col("x._c"), F.col("y._c")) / (F.col("x._n") + F.col("y._n"))).alias("most"))
    both = both.where("most >= needed")
    return both.withColumn("ratio", similarity(F.col("s"), F.col("t"))).where("ratio >= needed").select("a", "b", "ratio").unionByName(copies)


def _shared(a: Column, b: Column) -> Column:
    """Common elements of two sorted arrays, with their repeats: of each element of either side, the smaller count."""
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(_count(a, x), _count(b, x)))


def _count(values: Column, x: Column) -> Column:
    return F.size(F.filter(values, lambda v: v == x))
