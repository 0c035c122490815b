"""Gates of a build: each is a table of what breaks a rule, and a build goes on only where it is empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import let
from . import records, spans

STATUSES = ("eligible", "noise", "pending")


class Incomplete(ValueError):
    """A gate found rows; `problems` holds some of them."""

    def __init__(self, name: str, problems: list):
        self.problems = problems
        super().__init__(f"{name}: {problems[:5]}")


def check(name: str, problems: DataFrame, allowed: bool = False, shown: int = 20) -> DataFrame:
    """The problems; an error if there are any and they aren't allowed (a partial build allows them)."""
    if not allowed and (some := problems.limit(shown).collect()):
        raise Incomplete(name, [r.asDict(True) for r in some])
    return problems


def _said(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def reviews(df: DataFrame, key: str, status: str, basis: str, reviewer: str) -> DataFrame:
    """(key, rule): an approved review without a basis or a reviewer. Others need neither."""
    approved = F.coalesce(F.col(status) == "approved", F.lit(False))
    return records.violations(df, key, {"basis": ~approved | _said(F.col(basis)), "reviewer": ~approved | _said(F.col(reviewer))})


def qualities(df: DataFrame, key: str, status: str, reason: str, reviewer: str, question: str, feedback: str) -> DataFrame:
    """(key, rule): an unknown status, no reason or reviewer, or eligible without a question or feedback."""
    eligible = F.coalesce(F.col(status) == "eligible", F.lit(False))
    return records.violations(df, key, {
        "status": F.col(status).isin(*STATUSES), "reason": _said(F.col(reason)), "reviewer": _said(F.col(reviewer)),
        "question": ~eligible | _said(F.col(question)), "feedback": ~eligible | _said(F.col(feedback)),
    })


def searchable(kind: Column, role: Column, analysis: Column, quality: Column, text: Column) -> Column:
    """Rules of a telling role (an excerpt of a case only with analysis); eligible cases with a text."""
    rule = ~F.coalesce(role, F.lit("")).isin("background", "chart_only", "heading_only") & ((F.coalesce(role, F.lit("")) != "case_excerpt") | _said(analysis))
    return F.when(kind == "rule", rule).when(kind == "case", F.coalesce(quality == "eligible", F.lit(False)) & _said(text)).otherwise(F.lit(False))


def bound(casts: DataFrame, audits: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """casts and `validation`: calculated if exactly one audit record stands for the key, passed, and equal in all fields.

    audits: key, fields, status. A field that is null on both sides is equal. Records are counted before the join.
    """
    same = F.struct(*fields)
    own = audits.groupBy(key).agg(F.count("*").alias("_n"), F.first(F.struct("status", same.alias("f"))).alias("_a"))
    ok = (F.col("_n") == 1) & (F.col("_a.status") == "passed") & same.eqNullSafe(F.col("_a.f"))
    return casts.join(own, key, "left").withColumn("validation", F.when(F.coalesce(ok, F.lit(False)), "calculated").otherwise("not_run")).drop("_n", "_a")


def exposed(df: DataFrame, features: list[str]) -> DataFrame:
    """Features are null but where the chart is calculated."""
    return df.withColumns({f: F.when(F.col("validation") == "calculated", F.col(f)) for f in features})


def role_overlaps(df: DataFrame, by: str, role: str, start: str, end: str, exempt: list[tuple[str, str]], block: int = 64) -> DataFrame:
    """(by, role_a, role_b, n): pairs of half-open intervals of different roles that overlap, but for exempt pairs of roles.

    Intervals meet on blocks of the same group; empty intervals overlap nothing.
    """
    own = df.where(F.col(end) > F.col(start)).withColumn("_id", F.monotonically_increasing_id())
    side = lambda s: own.select(F.col(by).alias("g"), F.col(role).alias(f"role_{s}"), F.col("_id").alias(f"{s}_id"), F.col(start).alias(f"{s}_start"), (F.col(end) - 1).alias(f"{s}_end"))
    pairs = spans.overlapping(side("a"), side("b"), ["g"], block).where("role_a < role_b")
    for x, y in exempt:
        pairs = pairs.where(~((F.col("role_a") == min(x, y)) & (F.col("role_b") == max(x, y))))
    return pairs.groupBy(F.col("g").alias(by), "role_a", "role_b").agg(F.count("*").alias("n"))


def contained(inner: DataFrame, outer: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """inner with `inside`: whether a single merged interval of outer holds it."""
    whole = spans.merged(outer.select(*by, start, end), by, start, end).select(*by, F.col(start).alias("_s"), F.col(end).alias("_e"))
    own = inner.withColumn("_id", F.monotonically_increasing_id())
    # The last merged interval that begins at or before the start: a union and a running value, no range join.
    marks = whole.select(*by, F.col("_s").alias("_at"), F.lit(0).alias("_kind"), "_e", F.lit(None).cast("long").alias("_id"), F.lit(None).cast(inner.schema[end].dataType).alias("_end"))
    points = own.select(*by, F.col(start).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(outer.schema[end].dataType).alias("_e"), "_id", F.col(end).alias("_end"))
    w = Window.partitionBy(*by).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    held = marks.unionByName(points).withColumn("_last", F.last("_e", ignorenulls=True).over(w)).where("_kind = 1")
    inside = held.select("_id", F.coalesce(F.col("_end") <= F.col("_last"), F.lit(False)).alias("inside"))
    return own.join(inside, "_id").drop("_id")


def partition_problems(df: DataFrame, by: str, start: str, end: str, total: str) -> DataFrame:
    """(by, problem, at): places of 0 .. total that no interval [start, end) or more than one holds."""
    w = Window.partitionBy(by).orderBy(start, end)
    reach = F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.max(end).over(Window.partitionBy(by))
    own = df.withColumn("_r", reach).withColumn("_l", last).withColumn("_n", F.row_number().over(w))
    found = F.array(
        F.when(F.col(start) > F.col("_r"), F.struct(F.lit("gap").alias("problem"), F.col("_r").cast("long").alias("at"))),
        F.when(F.col(start) < F.col("_r"), F.struct(F.lit("double").alias("problem"), F.col(start).cast("long").alias("at"))),
        F.when((F.col("_n") == 1) & (F.col("_l") != F.col(total)), F.struct(F.lit("end").alias("problem"), F.col("_l").cast("long").alias("at"))),
    )
    return own.select(by, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select(by, "x.*")


#: Characters of a block of a text: a place is found by counting from the start of its block, not of the text.
BLOCK = 256


def text_coverage(text: Column, intervals: Column) -> Column:
    """struct(total, covered, gaps) of characters that aren't blank, under sorted, merged intervals (start, end) of the text.

    Takes time linear in the text and its intervals.
    """
    # Read in lambdas, the text's size and the intervals would be worked out anew for each interval: they are bound first.
    held = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks"), intervals.alias("own"), F.char_length(text).alias("n"))
    total = lambda sizes: F.aggregate(sizes, F.lit(0), lambda s, x: s + x)

    def counted(h: Column) -> Column:
        def solid(x: Column) -> Column:
            start, size = x["start"].cast("int"), (x["end"] - x["start"]).cast("int")
            first = F.floor(start / BLOCK).cast("int")
            own = F.array_join(F.slice(h["blocks"], first + 1, F.floor((start + size - 1) / BLOCK).cast("int") - first + 1), "")
            return F.when(size > 0, F.char_length(F.regexp_replace(F.substring(own, start - first * BLOCK + 1, size), r"(?U)\s", ""))).otherwise(0)

        edges = lambda name: F.transform(h["own"], lambda x: x[name].cast("int"))
        between = F.zip_with(F.concat(F.array(F.lit(0)), edges("end")), F.concat(edges("start"), F.array(h["n"])), lambda a, b: F.struct(a.alias("start"), b.alias("end")))
        return F.struct(F.transform(h["own"], solid).alias("inside"), F.transform(between, solid).alias("outside"))

    return let(let(held, counted), lambda x: F.struct((total(x["inside"]) + total(x["outside"])).alias("total"), total(x["inside"]).alias("covered"), F.size(F.filter(x["outside"], lambda v: v > 0)).alias("gaps")))


def coverage_report(df: DataFrame, status: str, ok: Column) -> DataFrame:
    """One row: total, n_ok, ratio, and the number of rows by status."""
    n = df.groupBy(status).agg(F.count("*").alias("n"), F.count_if(ok).alias("k"))
    pairs = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(status), F.lit("none")).alias("s"), "n")))  # a row for each status
    return n.agg(F.sum("n").alias("total"), F.sum("k").alias("n_ok"), (F.sum("k") / F.sum("n")).alias("ratio"), F.array_join(F.transform(pairs, lambda x: F.concat(x["s"], F.lit(":"), x["n"])), ",").alias("by_status"))


def repeated_names(df: DataFrame, key: str, names: Column) -> DataFrame:
    """(name, n): ids, aliases or targets that stand for more than one row."""
    return df.select(key, F.explode(F.array_distinct(names)).alias("name")).where("name is not null").groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def parity(metadata: DataFrame, index: DataFrame, key: str, flag: str) -> DataFrame:
    """(key, problem): what should be in an index and isn't, what is and shouldn't be, and what is more than once."""
    n = index.groupBy(key).agg(F.count("*").alias("_n"))
    both = metadata.select(key, F.col(flag).alias("_f")).join(n, key, "full_outer")
    problem = F.when(F.coalesce("_f", F.lit(False)) & F.col("_n").isNull(), "missing").when(~F.coalesce("_f", F.lit(False)) & F.col("_n").isNotNull(), "extra").when(F.col("_n") > 1, "repeated")
    return both.withColumn("problem", problem).where("problem is not null").select(key, "problem")


def citations(items: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """items with `problem`: source (none of that key), hash or text if what is cited isn't what the source holds, else null."""
    s = sources.select(key, F.col("text").alias("_t"), F.sha2("text", 256).alias("_h"))
    both = items.join(s, key, "left")
    problem = F.when(F.col("_h").isNull(), "source").when(~F.col("source_hash").eqNullSafe(F.col("_h")), "hash").when(F.col("quote").isNotNull() & ~F.contains("_t", F.col("quote")), "text")
    return both.withColumn("problem", problem).drop("_t", "_h")
