"""Trees and references: children with counts, closures, nearest enclosing nodes, all-or-nothing references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import checkpointed


def children(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """Nodes with the number of their direct children; leaves have 0."""
    n = nodes.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("_p")).agg(F.count("*").alias("n_children"))
    return nodes.join(n, F.col(node) == F.col("_p"), "left").drop("_p").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))


def closure(levels: list[DataFrame]) -> DataFrame:
    """(ancestor, descendant, distance) of a tree of known depth; levels: (child, parent) edges from the top down."""
    out, paths = None, None
    for edges in levels:
        e = edges.select(F.col("child").alias("descendant"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
        if paths is not None:
            longer = paths.join(edges, paths["descendant"] == edges["parent"]).select(F.col("child").alias("descendant"), "ancestor", (F.col("distance") + 1).alias("distance"))
            e = e.unionByName(longer)
        paths = e
        out = e if out is None else out.unionByName(e)
    return out


def closure_of(edges: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of trees of any depth; edges: (child, parent). A cycle is an error.

    Known paths double in length each round, so the rounds grow with the logarithm of the depth; each is written to the shared
    folder. A node has one parent, so no pair comes twice.
    """
    paths = checkpointed(edges.where("parent is not null").select(F.col("child").alias("descendant"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance")))
    reach = 1
    while not (longest := paths.where(F.col("distance") == reach)).isEmpty():
        if not paths.where("descendant = ancestor").isEmpty():
            raise ValueError("the parents form a cycle")
        more = paths.select(F.col("descendant").alias("_m"), F.col("ancestor").alias("_a"), F.col("distance").alias("_d"))
        longer = longest.join(more, F.col("ancestor") == F.col("_m")).select("descendant", F.col("_a").alias("ancestor"), (F.col("distance") + F.col("_d")).alias("distance"))
        paths, reach = checkpointed(paths.unionByName(longer)), 2 * reach
    return paths.select("ancestor", "descendant", "distance")


def anchored(anchors: DataFrame, lines: DataFrame) -> DataFrame:
    """Anchors (source, key, line, anchor) with a verdict against the text (source, n, text) and the nearest line that holds theirs.

    held: the line holds the anchor's text; moved: another line of the source does, `at` being the nearest (the earlier of two
    equally near); lost: none does; out_of_range: the source has no such line; no_source: the source has no lines. Anchors and lines of one text meet in one
    pass over both in order, so a text that stands on very many lines gives no pairs.
    """
    ends = lines.groupBy("source").agg(F.max("n").alias("_end"))
    a = anchors.select("source", F.col("anchor").alias("_t"), F.col("line").alias("_n"), F.struct("key", "line").alias("_a"))
    both = a.unionByName(lines.select("source", F.col("text").alias("_t"), F.col("n").alias("_n")), allowMissingColumns=True)
    # Of one number the line stands first, so that an anchor on it finds it at distance 0.
    w = Window.partitionBy("source", "_t").orderBy("_n", F.col("_a").isNotNull())
    back = Window.partitionBy("source", "_t").orderBy(F.desc("_n"), F.col("_a").isNotNull())
    here = F.when(F.col("_a").isNull(), F.col("_n"))
    up_to = lambda v: F.last(here, True).over(v.rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumns({"_before": up_to(w), "_after": up_to(back)}).where("_a is not null").join(ends, "source", "left")
    line, before, after = F.col("_a.line"), F.col("_before"), F.col("_after")
    at = F.when(before.isNull() | (after.isNotNull() & (after - line < line - before)), after).otherwise(before)
    verdict = F.when(F.col("_end").isNull(), "no_source").when(line.isNull() | ~line.between(1, F.col("_end")), "out_of_range").when(at == line, "held").when(at.isNotNull(), "moved").otherwise("lost")
    return met.select("source", "_a.key", "_a.line", verdict.alias("verdict"), at.alias("at"))


def deepest(points: DataFrame, spans: DataFrame, by: str, point: str, start: str, end: str, depth: str, node: str) -> DataFrame:
    """Each point with the deepest span of its group that holds it; the first by node of equals."""
    best = F.max_by(node, F.struct(F.col(depth), -F.col(node))) if dict(spans.dtypes)[node] in ("int", "bigint") else F.max_by(node, depth)
    hit = points.join(spans, by).where((F.col(point) >= F.col(start)) & (F.col(point) <= F.col(end)))
    return hit.groupBy(by, point).agg(best.alias(node))


def node_ends(nodes: DataFrame, by: str, start: str, depth: str, last: str) -> DataFrame:
    """A node ends before the next node of its depth or less, else at `last`: the smallest of the next starts by depth (0 or more)."""
    deepest_ = nodes.agg(F.max(depth)).first()[0] or 0
    w = Window.partitionBy(by).orderBy(start).rowsBetween(1, Window.unboundedFollowing)
    nexts = [F.min(F.when(F.col(depth) <= d, F.col(start))).over(w) for d in range(int(deepest_) + 1)]
    chosen = F.element_at(F.array(*nexts), F.col(depth).cast("int") + 1)
    return nodes.withColumn("end", F.coalesce(chosen - 1, F.col(last)))


def resolved(references: DataFrame, targets: DataFrame, approved: str) -> DataFrame:
    """(reference, n_targets, n_approved, ok): ok only if every target exists and is approved.

    references: (reference, target); targets: (target, `approved` boolean).
    """
    both = references.join(targets, "target", "left").withColumn("_ok", F.coalesce(F.col(approved), F.lit(False)))
    return both.groupBy("reference").agg(F.count("*").alias("n_targets"), F.count_if("_ok").alias("n_approved"), F.bool_and("_ok").alias("ok"))


def related(evidence: DataFrame, node: str, id_: str, status: str, most: int = 10) -> DataFrame:
    """For each node: total, the first `most` ids in order, the first eligible ones, and counts by status as text.

    Only the first ids of a node are gathered, found by rank; counts are formed before the shuffle.
    """
    own = evidence.select(node, id_, F.coalesce(status, F.lit("pending")).alias("_s"))
    counts = own.groupBy(node, "_s").agg(F.count("*").alias("_n")).groupBy(node).agg(F.sum("_n").alias("total"), F.array_sort(F.collect_list(F.struct("_s", "_n"))).alias("_c"))

    def first(df: DataFrame, name: str) -> DataFrame:
        top = df.withColumn("_r", F.row_number().over(Window.partitionBy(node).orderBy(id_))).where(F.col("_r") <= most)
        return top.groupBy(node).agg(F.array_sort(F.collect_list(id_)).alias(name))

    out = counts.join(first(own, "ids"), node, "left").join(first(own.where("_s = 'eligible'"), "eligible_ids"), node, "left")
    return out.withColumn("quality", F.array_join(F.transform("_c", lambda x: F.concat(x["_s"], F.lit(":"), x["_n"])), ",")).withColumn("has_more", F.col("total") > most).drop("_c")


def by_alias(references: DataFrame, targets: DataFrame) -> DataFrame:
    """reference with the id it names: by id, else by alias (the smallest id of those that share one), else null.

    references: reference; targets: id, aliases.
    """
    ids = targets.select(F.col("id").alias("reference"), F.col("id").alias("_by_id")).distinct()
    aliases = targets.select("id", F.explode("aliases").alias("reference")).groupBy("reference").agg(F.min("id").alias("_by_alias"))
    both = references.join(ids, "reference", "left").join(aliases, "reference", "left")
    return both.select(*references.columns, F.coalesce("_by_id", "_by_alias").alias("id"), F.when(F.col("_by_id").isNotNull(), "id").when(F.col("_by_alias").isNotNull(), "alias").alias("via"))


def members(df: DataFrame, declared: str, unit: str) -> DataFrame:
    """Units with the event they belong to (declared, or themselves) and the other units of it, in order.

    The lists are as long as an event has units; an event is a few tellings of one matter.
    """
    own = df.select(F.col(unit), F.coalesce(F.col(declared), F.col(unit)).alias("event"))
    lists = own.groupBy("event").agg(F.array_sort(F.collect_set(unit)).alias("_all"))
    return own.join(lists, "event").select(unit, "event", F.array_remove("_all", F.col(unit)).alias("others"))


def expanded_casts(units: DataFrame, unit: str, casts: str) -> DataFrame:
    """One record for each cast of a unit; the first keeps the unit's id, the others are named `.cast2` and so on."""
    own = units.select(unit, F.posexplode(casts).alias("pos", "cast"))
    return own.select(F.when(F.col("pos") == 0, F.col(unit).cast("string")).otherwise(F.concat(F.col(unit).cast("string"), F.lit(".cast"), F.col("pos") + 1)).alias("record_id"), unit, (F.col("pos") + 1).alias("cast_index"), "cast")


def in_order(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Distinct values of each group in the order in which they first stand."""
    firsts = df.groupBy(by, value).agg(F.min(order).alias("_o"))
    return firsts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda x: x[value]).alias(f"{value}s"))
