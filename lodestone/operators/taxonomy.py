"""Topics by alias: substring hits weighted by their length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(text: Column, aliases: dict[str, list[str]]) -> Column:
    """Array of (topic, score) with score > 0, best first, equal scores by topic; score is the sum of hit aliases' lengths."""
    low = F.lower(text)
    scores = [
        F.struct(sum((F.when(F.contains(low, F.lit(a)), len(a)).otherwise(0) for a in own), F.lit(0)).alias("score"), F.lit(topic).alias("topic"))
        for topic, own in aliases.items()
    ]
    found = F.filter(F.array(*scores), lambda s: s["score"] > 0)
    return F.transform(F.array_sort(F.transform(found, lambda s: F.struct((-s["score"]).alias("n"), s["topic"].alias("topic")))), lambda s: F.struct(s["topic"].alias("topic"), (-s["n"]).alias("score")))


def roots(found: Column) -> Column:
    """Roots of topics `root/child`, by the sum of their scores, best first, equal sums by name."""
    names = F.array_distinct(F.transform(found, lambda s: F.element_at(F.split(s["topic"], "/"), 1)))
    sums = F.transform(names, lambda r: F.struct((-F.aggregate(F.filter(found, lambda s: F.element_at(F.split(s["topic"], "/"), 1) == r), F.lit(0), lambda a, s: a + s["score"])).alias("n"), r.alias("root")))
    return F.transform(F.array_sort(sums), lambda s: s["root"])


def counts(topics: DataFrame, evidence: DataFrame) -> DataFrame:
    """Topics (topic, parent, title) with the number of evidences (evidence, topic); topics without any have 0."""
    n = evidence.groupBy("topic").agg(F.count("*").alias("n_evidence"))
    return topics.join(n, "topic", "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)).cast("long"))


def routed(df: DataFrame, text: str, rules: list[tuple[str, str, int]], name: str) -> DataFrame:
    """The value of the most specific rule (substring, value, rank) that fits: longest substring, then smallest rank."""
    hits = F.array(*(F.when(F.contains(F.lower(F.col(text)), F.lit(s)), F.struct(F.lit(-len(s)).alias("n"), F.lit(rank).alias("rank"), F.lit(v).alias("v"))) for s, v, rank in rules))
    return df.withColumn(name, F.get(F.array_sort(F.filter(hits, lambda x: x.isNotNull())), F.lit(0))["v"])
