"""Chunks of running text, and an account of every line: owned by one chunk or left out for a stated reason.

Lines come as (source, n, text) with flags. A chunk ends before a heading, at a border of a case, after a line that is left out for
another reason than being blank, and before a line that follows a blank one once the chunk holds enough characters. The last rule
looks back at the running size of its own chunk, so lines between forced borders are folded in order; everything else is windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import plain
from .cases import COPY, HEADING, PAGE

#: Characters of lines in a chunk from which a blank line ends it; pieces folded at a time.
SIZE, RUN = 1100, 256
# Lines that are no text of a source, in the order in which reasons are tried.
METADATA, IMAGE, CONTENTS, NOTICE = r"^(?:```|> 原文件|> 转换方式)", r"^!\[.*\]\(.*\)$", r"^\[.*\]\(#.*\)$", "请加助理"
BACKGROUND = r"^(?:第[一二三四五六七八九十百\d]+[章节])?(?:序言|前言|自序|后记|六爻预测和我们的生活|知微易学会六爻段位表|学员感悟[〈《（(]*[一二三四五六七八九十\d]*[)）〉》]*)$"


def reason(text: Column, copied: Column, front: Column | None = None) -> Column:
    """Why a line belongs to no chunk; null of a line that does."""
    bare = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    return (
        F.when(copied, "validation_copy").when(F.lit(False) if front is None else front, "front_matter").when(bare == "", "blank").when(text.rlike(PAGE), "page_anchor")
        .when(bare.rlike(METADATA), "format_metadata").when(bare.rlike(r"^\d+$"), "printed_page_number").when(bare.rlike(IMAGE), "image_placeholder")
        .when(bare.rlike(CONTENTS) | F.contains(bare, F.lit(NOTICE)), "toc_or_advertisement")
    )


def background(title: Column) -> Column:
    """Whether a heading announces background; words of topics in prose never do."""
    return F.regexp_replace(F.regexp_replace(plain(title), r"\s+", ""), "^[#]+", "").rlike(BACKGROUND)


def headings(text: Column) -> Column:
    bare = F.trim(text)
    return (bare.rlike(HEADING) & (F.char_length(plain(bare)) < 110)) | background(bare)


def folded(sizes: Column, free: Column, least: int = SIZE) -> Column:
    """Number of the chunk of each line, from 0: a line that may begin one does so once the lines before it hold `least` characters.

    `sizes` and `free` are arrays of one length; a chunk never ends within a paragraph, however long. Numbers are gathered
    RUN at a time, as appending to an array copies it.
    """
    both = F.arrays_zip(sizes.alias("size"), free.alias("free"))
    none = F.array().cast("array<int>")

    def line(s: Column, x: Column) -> Column:
        ends = x["free"] & (s["size"] >= least)
        number = s["number"] + ends.cast("int")
        return F.struct(number.alias("number"), (F.when(ends, 0).otherwise(s["size"]) + x["size"]).alias("size"), F.array_append(s["out"], number).alias("out"))

    def run(lines: Column):
        def step(s: Column, i: Column) -> Column:
            own = F.aggregate(F.slice(lines, i * RUN + 1, F.lit(RUN)), F.struct(s["number"].alias("number"), s["size"].alias("size"), none.alias("out")), line)
            return F.struct(own["number"].alias("number"), own["size"].alias("size"), F.array_append(s["out"], own["out"]).alias("out"))

        return step

    start = F.struct(F.lit(0).alias("number"), F.lit(0).alias("size"), F.array().cast("array<array<int>>").alias("out"))
    bound = F.transform(F.array(both), lambda n: F.aggregate(F.sequence(F.lit(0), F.floor(F.size(n) / RUN).cast("int")), start, run(n), lambda s: F.flatten(s["out"])))
    return F.get(bound, F.lit(0))


def accounted(lines: DataFrame, border: Column | None = None, kept: Column | None = None, least: int = SIZE, heading: Column | None = None, left_out: Column | None = None) -> DataFrame:
    """Lines with `reason`, or `chunk` (its first line) and the flag `heading`; each line has exactly one of both.

    border: a case begins or has ended here; kept: lines of a display, before which size never ends a chunk; heading and left_out
    say which lines are headings and why a line is left out, by default from their text.
    """
    rising = Window.partitionBy("source").orderBy("n")
    copied = F.coalesce(F.max(F.startswith("text", F.lit(COPY))).over(rising.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    text = F.coalesce("text", F.lit(""))
    own = lines.withColumns({"_copied": copied, "_border": F.lit(False) if border is None else F.coalesce(border, F.lit(False)), "_kept": F.lit(False) if kept is None else F.coalesce(kept, F.lit(False))})
    own = own.withColumn("reason", reason(text, F.col("_copied")) if left_out is None else left_out).withColumn("heading", F.col("reason").isNull() & (headings(text) if heading is None else heading))
    closes = F.col("reason").isNotNull() & (F.col("reason") != "blank")
    # What stands before a line: borders, headings and lines left out force a new section; a blank one only allows a new chunk.
    forced = (F.col("_border") | F.col("heading") | closes).cast("int")
    own = own.withColumn("_section", F.sum(forced).over(rising.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_free", ~F.col("_kept") & F.coalesce(F.lag(F.trim(text) == "").over(rising), F.lit(True)))
    held = own.where("reason is null").groupBy("source", "_section").agg(F.array_sort(F.collect_list(F.struct("n", F.char_length(text).alias("size"), F.col("_free").alias("free")))).alias("l"))
    size, free = F.transform("l", lambda x: x["size"]), F.transform("l", lambda x: x["free"])
    numbered = held.select("source", "_section", F.explode(F.arrays_zip(F.transform("l", lambda x: x["n"]).alias("n"), folded(size, free, least).alias("number"))).alias("x")).select("source", "_section", "x.n", "x.number")
    first = F.min("n").over(Window.partitionBy("source", "_section", "number"))
    return own.join(numbered.withColumn("chunk", first).select("source", "n", "chunk"), ["source", "n"], "left").drop("_copied", "_border", "_kept", "_section", "_free")


def chunks(accounts: DataFrame) -> DataFrame:
    """(source, chunk, end, n_lines, size, text): the lines from a chunk's first to its last, blank ones between them included."""
    w = Window.partitionBy("source").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max("n").over(Window.partitionBy("source", "chunk"))
    own = accounts.withColumn("_last", F.when(F.col("chunk").isNotNull(), last)).withColumn("_in", F.last(F.when(F.col("chunk").isNotNull(), F.struct("chunk", F.col("_last").alias("last"))), True).over(w))
    inside = own.where((F.col("n") <= F.col("_in.last")) & (F.col("chunk").isNotNull() | (F.col("reason") == "blank")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    return inside.groupBy("source", F.col("_in.chunk").alias("chunk")).agg((F.max("n") + 0).alias("end"), F.count("chunk").alias("n_lines"), F.sum(F.when(F.col("chunk").isNotNull(), F.char_length("text")).otherwise(0)).alias("size"), F.array_join(lines, "\n").alias("text"))


def excluded(accounts: DataFrame) -> DataFrame:
    """(source, reason, start, end): ranges of adjacent lines left out for one reason."""
    out = accounts.where("reason is not null").withColumn("_g", F.col("n") - F.row_number().over(Window.partitionBy("source", "reason").orderBy("n")))
    return out.groupBy("source", "reason", "_g").agg(F.min("n").alias("start"), F.max("n").alias("end")).drop("_g")


def account(accounts: DataFrame) -> DataFrame:
    """(source, total_lines, covered_lines, unaccounted): what a source's lines add up to; lines without chunk or reason are an error of the input's flags."""
    known = F.col("chunk").isNotNull() | F.col("reason").isNotNull()
    return accounts.groupBy("source").agg(F.count("*").alias("total_lines"), F.count_if(known).alias("covered_lines"), F.count_if(~known | (F.col("chunk").isNotNull() & F.col("reason").isNotNull())).alias("unaccounted"))
