"""Records over time: overlays, incremental builds, quality precedence, validation, deterministic samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def overlaid(base: DataFrame, review: DataFrame, key: str, value: str, hash_: str) -> DataFrame:
    """Reviewed values replace those of the base; what the base held stays as its hash; new keys are added."""
    r = review.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    both = base.join(r, F.col(key) == F.col("_k"), "full_outer")
    return both.select(F.coalesce(key, "_k").alias(key), F.coalesce("_v", value).alias(value), F.sha2(value, 256).alias(hash_), F.col("_k").isNotNull().alias("reviewed"))


def changes(old: DataFrame, new: DataFrame, key: str, hash_: str) -> DataFrame:
    """(key, change): added, removed, changed or same, by content hash."""
    both = old.select(F.col(key).alias("_o"), F.col(hash_).alias("_ho")).join(new.select(F.col(key).alias("_n"), F.col(hash_).alias("_hn")), F.col("_o") == F.col("_n"), "full_outer")
    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_ho") == F.col("_hn"), "same").otherwise("changed")
    return both.select(F.coalesce("_n", "_o").alias(key), kind.alias("change"))


def reused(texts: DataFrame, held: DataFrame, hash_: str, value: str) -> DataFrame:
    """Texts with what an earlier build holds for their hash, null where it must be computed."""
    return texts.join(held.select(hash_, value).dropDuplicates([hash_]), hash_, "left")


def effective(inline: Column, sidecar: Column, fresh: Column) -> Column:
    """Inline status wins; then a sidecar's if its text hash is the current one; else pending."""
    return F.coalesce(inline, F.when(fresh, sidecar), F.lit("pending"))


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each broken rule; a rule that is null is broken."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return df.select(key, F.explode(broken).alias("rule"))


def hash_split(key: Column, parts: int) -> Column:
    """Part of a key: the first eight hex digits of its hash, modulo parts."""
    return (F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") % parts).cast("int")


def capped_sample(df: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """The `most` rows of each group that come first by the hash of their key."""
    w = Window.partitionBy(by).orderBy(F.sha2(F.col(key).cast("string"), 256), key)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def tree_hash(df: DataFrame, key: Column, value: Column, depth: int = 3) -> DataFrame:
    """One row: a tree of hashes over all rows, whatever their order.

    Rows are dealt to 16**depth leaves by the hash of their key; a leaf is the hash of its rows' hashes in order, and each node above the
    hash of its sixteen children at most, level by level, so that no task holds more than a leaf. A null key or value counts as empty, and is
    told from an empty one by its mark; repeated rows count.
    """
    marked = lambda c: F.sha2(F.concat(F.when(c.isNull(), "0").otherwise("1"), F.coalesce(c.cast("string"), F.lit(""))), 256)
    rows = df.select(marked(key).alias("k"), marked(value).alias("v")).select(F.substring("k", 1, depth).alias("p"), F.concat("k", "v").alias("h"))
    for level in range(depth, -1, -1):
        joined = F.array_join(F.array_sort(F.collect_list("h")), "")
        rows = rows.groupBy("p").agg(F.sha2(joined, 256).alias("h")).select(F.substring("p", 1, max(level - 1, 0)).alias("p"), F.concat("p", "h").alias("h") if level else F.col("h"))
    return rows.select(F.col("h").alias("tree_hash"))


def corpus_hash(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """One row: the hash of the rows' hashes in order of key (rows of a fixed small table, or hashes of parts)."""
    return df.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.sha2(value, 256).alias("h")))), lambda x: x["h"]), ""), 256).alias("corpus_hash"))
