"""Spans: islands, merged coverage, gaps, overlap, chunks by size, windows of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that a task sorts, about.
TASK_ROWS = 2_000_000


def islands(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """Runs of consecutive numbers: (by, start, end, n)."""
    own = df.select(*by, number).distinct()
    run = own.withColumn("_g", F.col(number) - F.row_number().over(Window.partitionBy(*by).orderBy(number)))
    return run.groupBy(*by, "_g").agg(F.min(number).alias("start"), F.max(number).alias("end"), F.count("*").alias("n")).drop("_g")


def spread(df: DataFrame, by: list[str], *sources: DataFrame) -> DataFrame:
    """df with as many tasks as its rows need, TASK_ROWS each, where the session's shuffle partitions are too few for it.

    sources: what df is made of, counted instead of it.
    """
    tasks = sum(-(-x.count() // TASK_ROWS) for x in sources or (df,))
    return df.repartition(tasks, *by) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def merged(df: DataFrame, by: list[str], start: str, end: str, peers: bool = True) -> DataFrame:
    """Unions of intervals [start, end) that overlap or touch; unknown places come last.

    peers: whether equal intervals that don't touch each other (unknown or reversed ones) are one; else each is its own.
    """
    return _unions(spread(df, by), by, start, end, peers)


def _unions(df: DataFrame, by: list[str], start: str, end: str, peers: bool = True) -> DataFrame:
    """One sort, and nothing is hashed: a row begins a union or not, and a union's end is known where the next begins."""
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    equal = F.lag(start).over(w).eqNullSafe(F.col(start)) & F.lag(end).over(w).eqNullSafe(F.col(end)) & (F.row_number().over(w) > 1)
    marked = df.select(*by, start, end).withColumns({"_new": F.when(F.col(start) <= F.max(end).over(before), 0).otherwise(1), "_equal": equal})
    numbered = marked.withColumn("_u", F.struct(F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("g"), F.col(end).alias("end")))
    # The greatest (union, end) so far holds the end of the last union.
    ends = numbered.withColumns({"_before": F.max("_u").over(before), "_last": F.max("_u").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    own = ends.where("_new = 1 and not _equal" if peers else "_new = 1").withColumn("_end", F.coalesce(F.lead("_before").over(w), F.col("_last")))
    return own.select(*by, start, F.col("_end.end").alias(end))


def difference(a: DataFrame, b: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """What intervals [start, end) of a cover and those of b don't, as merged intervals; empty and null intervals cover nothing.

    One sweep: borders of both sides are counted by place before the shuffle, and running sums say which side covers what
    follows.
    """

    def borders(df: DataFrame, side: str) -> DataFrame:
        own = df.where(F.col(start) < F.col(end)).select(*by, F.inline(F.array(F.struct(F.col(start).alias("_at"), F.lit(1).alias("_d")), F.struct(F.col(end).alias("_at"), F.lit(-1).alias("_d")))))
        return own.select(*by, "_at", *(F.col("_d").alias(s) if s == side else F.lit(0).alias(s) for s in ("_in", "_out")))

    w = Window.partitionBy(*by).orderBy("_at")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    swept = borders(a, "_in").unionByName(borders(b, "_out")).groupBy(*by, "_at").agg(F.sum("_in").alias("_in"), F.sum("_out").alias("_out"))
    swept = spread(swept, by, a, b)
    swept = swept.select(*by, "_at", F.lead("_at").over(w).alias("_to"), F.sum("_in").over(run).alias("_in"), F.sum("_out").over(run).alias("_out"))
    return _unions(swept.where("_in > 0 and _out = 0").select(*by, F.col("_at").alias(start), F.col("_to").alias(end)), by, start, end)


def disclosed(spans: DataFrame, by: list[str], roles: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """What may be read first: spans (role, late) of the given roles, without any that is disclosed late, and whether late ones reached into them.

    (by, start, end, overlapped): a late span that overlaps a first one is taken out and reported, so that nothing late ever enters
    the first text whatever the roles say.
    """
    own = spans.where(F.col("role").isin(roles))
    first, late = own.where(~F.coalesce("late", F.lit(False))), spans.where(F.coalesce("late", F.lit(False)))
    kept = difference(first, late, by, start, end)
    whole = merged(first.where(F.col(start) < F.col(end)).select(*by, start, end), by, start, end)
    size = lambda df, name: df.groupBy(*by).agg(F.sum(F.col(end) - F.col(start)).alias(name))
    cut = size(whole, "_w").join(size(kept, "_k"), by, "left").select(*by, (F.col("_w") != F.coalesce("_k", F.lit(0))).alias("overlapped"))
    return kept.join(cut, by)


def gaps(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """What lies between merged intervals."""
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last(start))
    return merged(df, by, start, end).withColumn("_next", F.lead(start).over(w)).where("_next is not null").select(*by, F.col(end).alias("gap_start"), F.col("_next").alias("gap_end"))


def overlapping(a: DataFrame, b: DataFrame, by: list[str], block: int) -> DataFrame:
    """Pairs of closed intervals (a_id, a_start, a_end), (b_id, b_start, b_end) that meet.

    An equi-join on blocks instead of a theta join; a pair comes from the block where the later of both begins.
    """
    def cut(df: DataFrame, s: str, e: str) -> DataFrame:
        return df.withColumn("_block", F.explode(F.sequence(F.floor(F.col(s) / block), F.floor(F.col(e) / block))))

    x, y = cut(a, "a_start", "a_end"), cut(b, "b_start", "b_end")
    pairs = x.join(y, [*by, "_block"]).where("a_start <= b_end and b_start <= a_end")
    return pairs.where(F.col("_block") == F.floor(F.greatest("a_start", "b_start") / block)).drop("_block")


def carried(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that isn't null, up to each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def chunks(lines: Column, least: int) -> Column:
    """Chunk number of each line: a chunk ends with the line that makes it `least` characters or longer."""
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("size"), F.from_json(F.lit("[]"), "array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        size = s["size"] + F.char_length(x)
        full = size >= least
        return F.struct((s["chunk"] + full.cast("int")).alias("chunk"), F.when(full, 0).otherwise(size).alias("size"), F.array_append(s["out"], s["chunk"]).alias("out"))

    return F.aggregate(lines, start, step, lambda s: s["out"])


def windows(text: Column, size: int, overlap: int) -> Column:
    """Windows (start, end) of `size` characters, each `overlap` before the end of the last."""
    n, step = F.char_length(text), size - overlap
    count = F.greatest(F.ceil((n - overlap) / step), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * step).alias("start"), F.least(i * step + size, n).alias("end")))
