"""Scope, fusion, de-duplication, tiers, budgets and pages of search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF = 60


def ranked(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows with their rank: a top-k, then a window over it alone."""
    return df.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def fuse(channels: list[DataFrame], key: str) -> DataFrame:
    """(key, rrf, channels): sums of 1 / (60 + rank) over ranked channels."""
    rows = channels[0].select(key, "rank")
    for c in channels[1:]:
        rows = rows.unionByName(c.select(key, "rank"))
    return rows.groupBy(key).agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("rrf"), F.count("*").alias("channels"))


def first_of_group(df: DataFrame, group: Column, order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_n = 1").drop("_n")


def exclude_groups(df: DataFrame, group: str, excluded: DataFrame) -> DataFrame:
    """Rows of no group that holds an excluded row (excluded: the column `group`)."""
    return df.join(excluded.select(group).distinct(), group, "left_anti")


def tier(same: Column, parent: Column, common: Column) -> Column:
    """0 same subtopic, 1 parent topic, 2 common, 3 unclassified."""
    return F.when(same, 0).when(parent, 1).when(common, 2).otherwise(3)


def packed(df: DataFrame, group: str, order: list[str], size: Column, limit: int, most: int) -> DataFrame:
    """Greedy packing in order: what doesn't fit is skipped, not the end. Adds taken, used (after the row) and skipped.

    The fold runs over the rows of one result page, which are few.
    """
    item = F.struct(*order, size.cast("long").alias("size"))
    rows = df.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("items"))
    out_type = f"array<struct<{','.join(f'{o}:{df.schema[o].dataType.simpleString()}' for o in order)},size:bigint,taken:boolean,used:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.from_json(F.lit("[]"), out_type).alias("out"))

    def step(s: Column, x: Column) -> Column:
        fits = (s["n"] < limit) & (s["used"] + x["size"] <= most)
        used = s["used"] + F.when(fits, x["size"]).otherwise(F.lit(0).cast("long"))
        row = F.struct(*(x[o].alias(o) for o in order), x["size"].alias("size"), fits.alias("taken"), used.alias("used"))
        return F.struct(used.alias("used"), (s["n"] + fits.cast("int")).alias("n"), F.array_append(s["out"], row).alias("out"))

    return rows.select(group, F.explode(F.aggregate("items", start, step, lambda s: s["out"])).alias("x")).select(group, "x.*")


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset + limit of the order, has_more and next_offset; one row more is read, no more are sorted."""
    own = df.orderBy(*order).limit(offset + limit + 1).withColumn("pos", F.row_number().over(Window.orderBy(*order)))
    more = F.max("pos").over(Window.partitionBy(F.lit(1))) > offset + limit
    return own.withColumn("has_more", more).where((F.col("pos") > offset) & (F.col("pos") <= offset + limit)).withColumn("next_offset", F.when(F.col("has_more"), F.lit(offset + limit)))


def rerank_head(limit: int, configured: int = 40) -> int:
    """How many of the fused candidates are scored again."""
    return max(configured, 2 * limit)


def reranked(pool: DataFrame, key: str, windows: DataFrame, limit: int, configured: int = 40) -> DataFrame:
    """The head of the pool by (rerank desc, rrf desc, key); rerank is the best score over a text's windows.

    pool: key, rrf, and what else comes along; windows: key, score. What has no window scores least.
    """
    head = pool.orderBy(F.desc("rrf"), key).limit(rerank_head(limit, configured))
    best = windows.join(F.broadcast(head.select(key)), key, "left_semi").groupBy(key).agg(F.max("score").alias("rerank"))
    return head.join(best, key, "left").orderBy(F.desc_nulls_last("rerank"), F.desc("rrf"), key)


def blocked_rules(rules: DataFrame, cases: DataFrame, block: int = 64) -> DataFrame:
    """evidence_id of the rules of which some text that isn't blank stands in a span of an excluded case, and of their siblings.

    rules: evidence_id, group_id, source_id, start, end, text (of the span); cases: source_id, start, end; offsets of
    characters, ends excluded. A rule with the group of a blocked one goes with it.
    """
    # Cases are reduced to the places that they cover in each block of characters, and a rule sends each block only its own
    # characters there: what is shuffled is each text once, however many cases meet it.
    def cut(df: DataFrame) -> DataFrame:
        x = df.where("end > start").withColumn("_block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
        first = F.col("_block") * block
        return x.withColumns({"_s": F.greatest("start", first) - first, "_e": F.least("end", first + block) - first})

    covers = cut(cases).select("source_id", "_block", "_s", "_e").distinct().select("source_id", "_block", F.explode(F.sequence(F.col("_s"), F.col("_e") - 1)).alias("_p"))
    covers = covers.groupBy("source_id", "_block").agg(F.collect_set("_p").alias("_covered"))
    # Blanks before a text put its characters at their places in the blocks.
    shown = F.concat(F.repeat(F.lit(" "), F.pmod("start", F.lit(block)).cast("int")), F.substring("text", F.lit(1), (F.col("end") - F.col("start")).cast("int")))
    parts = rules.where("end > start").select("source_id", "group_id", F.floor(F.col("start") / block).alias("_first"), F.posexplode_outer(F.regexp_extract_all(shown, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))).alias("_i", "_own"))
    pieces = parts.where(F.col("_own").rlike(r"\S")).select("source_id", "group_id", (F.col("_first") + F.col("_i")).alias("_block"), "_own")
    said = F.exists("_covered", lambda p: F.substring(F.col("_own"), (p + 1).cast("int"), F.lit(1)).rlike(r"\S"))
    groups = pieces.join(covers, ["source_id", "_block"]).where(said).select("group_id").distinct()
    return rules.join(groups, "group_id", "left_semi").select("evidence_id").distinct()


def context_packed(df: DataFrame, item: str, contexts: Column, used: Column, most: int) -> DataFrame:
    """item, included and omitted ids: an item's contexts (id, size) in order, while they fit what is left of the budget; what doesn't fit is left out, not the end."""
    start = F.struct(used.cast("long").alias("used"), F.from_json(F.lit("[]"), "array<string>").alias("yes"), F.from_json(F.lit("[]"), "array<string>").alias("no"))

    def step(s: Column, x: Column) -> Column:
        fits = s["used"] + x["size"] <= most
        return F.struct((s["used"] + F.when(fits, x["size"]).otherwise(0)).cast("long").alias("used"), F.when(fits, F.array_append(s["yes"], x["id"])).otherwise(s["yes"]).alias("yes"), F.when(fits, s["no"]).otherwise(F.array_append(s["no"], x["id"])).alias("no"))

    return df.select(item, F.aggregate(contexts, start, step).alias("x")).select(item, F.col("x.yes").alias("included"), F.col("x.no").alias("omitted"), F.col("x.used").alias("used"))
