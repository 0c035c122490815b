"""Exact overlap of normalised texts: windows of a query text that stand in a corpus, extended as far as both agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, STEP = 32, 8
#: Characters of the parts that a text is cut into: a place is found by counting from the start of its part.
PART, BLOCK = 8192, 256
#: Pieces of query windows that are broadcast at most; more are shuffled.
BROADCAST = 400_000


def normalized(text: Column) -> Column:
    """Letters, digits and underscores in lower case; two characters that are often taken for a branch as that branch."""
    return F.translate(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_\x{4e00}-\x{9fff}]", "")), "已戍", "巳戌")


def windows(text: Column, size: int, step: int) -> Column:
    """(at, piece) of the windows of a text; none if it is shorter."""
    n = F.char_length(text) - size
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.floor(n / step).cast("int")), lambda i: F.struct((i * step).alias("at"), F.substring(text, i * step + 1, F.lit(size)).alias("piece"))))


def overlaps(queries: DataFrame, corpus: DataFrame, size: int = SIZE, step: int = STEP, longest: bool = True) -> DataFrame:
    """(q_id, d_id, n_windows, longest) for queries (q_id, q) and documents (d_id, d) that share a window; longest only if asked for.

    Each window of a document holds a piece of size - step + 1 characters that begins at a multiple of `step`. These pieces of
    the documents meet all such pieces of the queries' windows (step `step`) by an equi-join on their hash, and the windows around
    them are compared whole; so each window is found once, and no document is searched once for each query.
    """
    piece, before = size - step + 1, step - 1
    own = queries.select("q_id", F.inline(windows(F.col("q"), size, step))).withColumnRenamed("piece", "qp")
    keys = own.select("q_id", "at", "qp", F.explode(F.sequence(F.lit(0), F.lit(before))).alias("back")).withColumn("h", F.xxhash64(F.substring("qp", F.col("back") + 1, F.lit(piece))))

    def cut(part: str, first: Column, base: Column, every: int):
        """A text of which `base` is the first place, cut every `every` characters from `first` on; each part with what windows around its pieces need."""

        def one(i: Column) -> Column:
            at = first + i * every
            lead = F.least(at, F.lit(before))
            return F.struct(at.alias("first"), (at - lead).alias("base"), F.substring(F.col(part), at - lead - base + 1, lead + every + size).alias("part"))

        return one

    # Parts of parts: a place in a text is found by counting its characters, which is cheap in short texts only.
    block = step * max(1, BLOCK // step)
    whole, n = block * max(1, PART // block), F.char_length("d")
    docs = corpus.select("d_id", F.inline(F.transform(F.sequence(F.lit(0), F.greatest(F.floor((n - piece) / whole), F.lit(0)).cast("int")), cut("d", F.lit(0), F.lit(0), whole))))
    for every, within in ((block, whole), (step, block)):
        docs = docs.select("d_id", F.inline(F.transform(F.sequence(F.lit(0), F.lit(within // every - 1)), cut("part", F.col("first"), F.col("base"), every)))).where(F.char_length("part") - F.col("first") + F.col("base") >= piece)
    docs = docs.withColumn("h", F.xxhash64(F.substring("part", F.col("first") - F.col("base") + 1, F.lit(piece))))
    few = keys.limit(BROADCAST + 1).count() <= BROADCAST
    at = F.col("first") - F.col("back")
    found = docs.join(F.broadcast(keys) if few else keys, "h").where((at >= 0) & (F.substring("part", at - F.col("base") + 1, F.lit(size)) == F.col("qp")))
    hit = found.groupBy("q_id", "d_id", "at").agg(F.min(at).alias("dat"))
    if not longest:
        return hit.groupBy("q_id", "d_id").agg(F.count("*").alias("n_windows"))
    text = hit.join(queries, "q_id").join(corpus, "d_id")
    # The common run from a hit on: up to the first of the characters after it that differ.
    rest = F.least(F.char_length("q") - F.col("at"), F.char_length("d") - F.col("dat")) - size
    after = [F.split(F.substring(c, F.col(place) + size + 1, rest), "") for c, place in (("q", "at"), ("d", "dat"))]
    differ = F.array_position(F.zip_with(*after, lambda x, y: x == y), False)
    same = size + F.when(differ == 0, rest).otherwise(differ - 1)
    return text.groupBy("q_id", "d_id").agg(F.count("*").alias("n_windows"), F.max(same).cast("long").alias("longest"))
