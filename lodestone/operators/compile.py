"""Compiling documents from routed ranges: envelopes, sections with offsets, workflows, groups, accounts, review reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import spans


def envelope(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """One whole-line range for each unit: from its smallest start to its largest end, contexts included."""
    return df.groupBy(*by).agg(F.min(start).alias(start), F.max(end).alias(end))


def ranges(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Closed ranges of lines, merged where they overlap or the next begins on the following line."""
    open_ = df.select(*by, F.col(start), (F.col(end) + 1).alias(end))
    return spans.merged(open_, by, start, end).withColumn(end, F.col(end) - 1)


def sections(parts: DataFrame, file: str, order: list[str], text: str, separator: int = 1) -> DataFrame:
    """Sections of each output file in order, with their hash and character offsets; `separator` characters between them."""
    w = Window.partitionBy(file).orderBy(*order)
    size = F.char_length(text)
    before = F.coalesce(F.sum(size + separator).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("text_sha256", F.sha2(text, 256)).withColumn("start_offset", before).withColumn("end_offset", before + size)


def on_page(sections_: DataFrame, offset: int, size: int) -> DataFrame:
    """Sections that meet the page [offset, offset + size)."""
    return sections_.where((F.col("start_offset") < offset + size) & (F.col("end_offset") > offset))


def touched(ranges_: DataFrame, pages: DataFrame, by: list[str], block: int = 64) -> DataFrame:
    """(by, a_id, pages): the pages whose lines a range meets, in order. ranges: a_id, a_start, a_end; pages: b_id, b_start, b_end.

    A range that covers many pages holds their list, which is as long as the range has pages.
    """
    hits = spans.overlapping(ranges_, pages, by, block).select(*by, "a_id", "b_id").distinct()
    return hits.groupBy(*by, "a_id").agg(F.array_sort(F.collect_list("b_id")).alias("pages"))


def workflow_problems(steps: DataFrame, units: DataFrame, allowed: Column) -> DataFrame:
    """(step, problem): not positive, repeated, untitled, without evidence; evidence that is missing or of a source that isn't allowed.

    steps: step, title, route, evidence_ids; units: unit_id, source_id.
    """
    n = F.count("*").over(Window.partitionBy("step"))
    plain = F.array(
        F.when(F.coalesce(F.col("step") < 1, F.lit(True)), "positive"), F.when(n > 1, "unique"),
        F.when(~F.coalesce(F.trim("title") != "", F.lit(False)) | ~F.coalesce(F.trim("route") != "", F.lit(False)), "title"),
        F.when(F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0, "evidence"),
    )
    own = steps.withColumn("_p", F.filter(plain, lambda x: x.isNotNull())).select("step", F.explode("_p").alias("problem"))
    used = steps.select("step", F.explode("evidence_ids").alias("unit_id")).join(units.withColumn("_ok", allowed), "unit_id", "left")
    bad = used.withColumn("problem", F.when(F.col("_ok").isNull(), "missing_evidence").when(~F.col("_ok"), "source_not_allowed")).where("problem is not null")
    return own.unionByName(bad.select("step", "problem")).distinct()


def grouped_rules(rules: DataFrame, rule: str, groups: DataFrame) -> DataFrame:
    """rules with the group of their bracketed title (groups: title, grp); what has none stays, with a null group."""
    title = F.nullif(F.regexp_extract(F.col(rule), r"^[\[【]([^\]】]+)[\]】]", 1), F.lit(""))
    return rules.withColumn("title", title).join(groups, "title", "left")


def unaccounted(units: DataFrame, routed: list[DataFrame], key: str) -> DataFrame:
    """(key, problem): units that no list holds, and entries of lists that are no unit."""
    held = routed[0].select(key)
    for r in routed[1:]:
        held = held.unionByName(r.select(key))
    held = held.distinct()
    return units.select(key).distinct().join(held, key, "left_anti").withColumn("problem", F.lit("unrouted")).unionByName(held.join(units.select(key), key, "left_anti").withColumn("problem", F.lit("unknown")))


def review_reasons(text: Column, candidates: Column, doubtful: Column, headings: str, marks: str, relatives: str) -> Column:
    """Why a page's chart candidates need review, from how many of its lines show signs of charts."""
    rows = F.split(text, "\n")
    hits = lambda p: F.size(F.filter(rows, lambda x: x.rlike(p)))
    has_text = F.coalesce(F.trim(text) != "", F.lit(False))
    signal = (hits(headings) > 0) | (hits(marks) >= 3) | (hits(relatives) >= 4)
    first = F.when((candidates == 0) & ~has_text, "zero_candidates_without_text_evidence").when((candidates == 0) & signal, "zero_candidates_with_chart_text_signals").when(candidates < hits(headings), "fewer_candidates_than_chart_heading_signals")
    return F.array_compact(F.array(first, F.when(doubtful, "candidate_requires_review")))


def starts(lines: DataFrame, by: str, line_no: str, line: str, pattern: str, most: int = 6) -> DataFrame:
    """The first `most` lines of each source that begin a record."""
    hit = lines.where(F.col(line).rlike(pattern))
    return hit.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(line_no))).where(F.col("place") <= most)


def progress(units: DataFrame, by: list[str], key: str, reviewed: str) -> DataFrame:
    """The ledger of a review: units and reviewed ones of each part, and the first that waits (null where none does)."""
    return units.groupBy(*by).agg(F.count("*").alias("total"), F.count(reviewed).alias("reviewed"), F.min(F.when(F.col(reviewed).isNull(), F.col(key))).alias("next_pending"))


def bucket(quality: Column) -> Column:
    """Where a unit goes by its review: noise is only compared with, what waits stays in the database, the rest is routed."""
    return F.when(quality == 0, "compare_only").when(quality.isNull(), "database_only").otherwise("routed")


def manifest(tables: dict[str, DataFrame], identities: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """(name, rows, tree_hash) of a release's tables; identities: key and content of those whose identity is to be pinned, null for others."""
    from .records import tree_hash

    parts = []
    for name, df in tables.items():
        own = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        pinned = tree_hash(df, *identities[name]) if name in (identities or {}) else None
        # One row on either side; an empty table has no hash.
        parts.append(own.join(pinned, how="left") if pinned is not None else own.withColumn("tree_hash", F.lit(None).cast("string")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def around(lines: DataFrame, by: str, line: str, n: int) -> DataFrame:
    """Lines with the range of `n` lines on either side that their text has."""
    w = Window.partitionBy(by)
    return lines.select(by, line, F.greatest(F.col(line) - n, F.min(line).over(w)).alias("from"), F.least(F.col(line) + n, F.max(line).over(w)).alias("to"))
