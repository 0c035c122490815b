"""Deterministic extraction: symbols, panels of rows, roles, outcomes, edits, and addressed text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Signs of lines in charts, and the values they stand for.
SIGNS = {"×": 0, "Ｘ": 0, "○": 3, "〇": 3, "- -": 2, "▅ ▅": 2, "━━━": 1, "▅▅▅": 1}


def symbol(c: Column) -> Column:
    """The value of the first sign of a row: changing signs before plain ones."""
    out = F.lit(None).cast("int")
    for sign, value in reversed(sorted(SIGNS.items(), key=lambda x: (x[1] not in (0, 3), x[1]))):
        out = F.when(F.contains(c, F.lit(sign)), F.lit(value)).otherwise(out)
    return out


def panels(rows: DataFrame, by: str, line: str, hit: Column, least: int = 5, most: int = 6) -> DataFrame:
    """Runs of `least` to `most` adjacent lines that hit: (by, start, end, n)."""
    own = rows.where(hit).select(by, line)
    run = own.withColumn("_g", F.col(line) - F.row_number().over(Window.partitionBy(by).orderBy(line)))
    return run.groupBy(by, "_g").agg(F.min(line).alias("start"), F.max(line).alias("end"), F.count("*").alias("n")).where(F.col("n").between(least, most)).drop("_g")


#: Lines whose offsets are gathered at a time: appending to an array copies it.
_RUN = 256


def offsets(lines: Column) -> Column:
    """Where each line begins in the text that the lines make with line ends between them; null of null.

    One running sum; the lengths are bound once, as an expression inside a lambda would be formed again for each line.
    """
    none = F.array().cast("array<int>")

    def line(s: Column, n: Column) -> Column:
        return F.struct((s["at"] + n).alias("at"), F.array_append(s["out"], s["at"]).alias("out"))

    def run(n: Column):
        def step(s: Column, i: Column) -> Column:
            own = F.aggregate(F.slice(n, i * _RUN + 1, F.lit(_RUN)), F.struct(s["at"].alias("at"), none.alias("out")), line)
            return F.struct(own["at"].alias("at"), F.array_append(s["out"], own["out"]).alias("out"))

        return step

    lengths = F.array(F.transform(lines, lambda x: F.char_length(x) + 1))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    return F.get(F.transform(lengths, lambda n: F.aggregate(F.sequence(F.lit(0), F.floor(F.size(n) / _RUN).cast("int")), start, run(n), lambda s: F.flatten(s["out"]))), F.lit(0))


def resolved(text: Column, start_line: Column, end_line: Column, start_column: Column, end_column: Column) -> Column:
    """Exact text of a span: lines from 1, both ends included; columns from 0, the end excluded; null out of range."""
    lines = F.split(text, "\n")
    own = F.slice(lines, start_line, end_line - start_line + 1)
    head = F.substring(F.get(own, F.lit(0)), start_column + 1, F.char_length(F.get(own, F.lit(0))))
    last = F.substring(F.element_at(lines, end_line), F.lit(1), end_column)
    middle = F.slice(own, F.lit(2), F.greatest(F.size(own) - 2, F.lit(0)))
    one = F.substring(F.element_at(lines, start_line), start_column + 1, end_column - start_column)
    many = F.array_join(F.concat(F.array(head), middle, F.array(last)), "\n")
    ok = (start_line >= 1) & (end_line >= start_line) & (end_line <= F.size(lines))
    return F.when(ok, F.when(start_line == end_line, one).otherwise(many))


def edited(text: Column, edits: Column) -> Column:
    """Text after edits (at from 0, old, new), from right to left; an edit whose old text doesn't stand there is left out."""
    order = F.reverse(F.array_sort(edits))

    def apply(t: Column, e: Column) -> Column:
        n = F.char_length(e["old"])
        fits = F.substring(t, e["at"] + 1, n) == e["old"]
        return F.when(fits, F.concat(F.substring(t, F.lit(1), e["at"]), e["new"], F.substring(t, e["at"] + n + 1, F.char_length(t)))).otherwise(t)

    return F.aggregate(order, text, apply)


def role(text: Column, analysis: str, chart: str) -> Column:
    """heading_only, chart_only, background or analysis, by what a text holds."""
    return F.when(F.char_length(F.trim(text)) < 20, "heading_only").when(text.rlike(analysis), "analysis").when(text.rlike(chart), "chart_only").otherwise("background")


def outcome(text: Column, quote: str, none: str) -> Column:
    """The first outcome sentence, unless the text says that there was no feedback."""
    found = F.regexp_extract(text, quote, 0)
    return F.when(text.rlike(none) | (found == ""), F.lit(None).cast("string")).otherwise(found)
