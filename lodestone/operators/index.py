"""Inverted index and BM25. Statistics are those of the whole index; filters only restrict candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str, focus: Column, body: Column) -> DataFrame:
    """(key, term, tf_focus, tf_body) from two token arrays of each document."""
    both = docs.select(key, F.explode(F.concat(F.transform(focus, lambda t: F.struct(t.alias("term"), F.lit(1).alias("f"))), F.transform(body, lambda t: F.struct(t.alias("term"), F.lit(0).alias("f"))))).alias("t"))
    return both.groupBy(key, F.col("t.term").alias("term")).agg(F.sum("t.f").cast("long").alias("tf_focus"), F.sum(1 - F.col("t.f")).cast("long").alias("tf_body"))


def lengths(docs: DataFrame, key: str, focus: Column, body: Column) -> DataFrame:
    return docs.select(key, (F.size(focus) + F.size(body)).cast("long").alias("len"))


def bm25(docs: DataFrame, key: str, focus: Column, body: Column, terms: list[str], focus_weight: float, scope: Column | None = None) -> DataFrame:
    """(key, score) of documents in scope that hold a term; higher is better.

    One pass over the documents: counts of the few query terms are taken inside each row, and no posting is shuffled, only they;
    the statistics (documents, mean length, document frequencies) are one row.
    """
    terms = list(dict.fromkeys(terms))

    # Each token is looked at once; the counts are taken of the few that are asked for.
    asked = lambda tokens: F.filter(tokens, lambda t: t.isin(terms))
    counted = lambda tokens: F.transform(F.array(*map(F.lit, terms)), lambda q: F.size(F.filter(tokens, lambda t: t == q)))

    rows = docs.select(key, (scope if scope is not None else F.lit(True)).alias("_in"), focus.alias("_f"), body.alias("_b"))
    rows = rows.select(key, "_in", asked(F.col("_f")).alias("_f"), asked(F.col("_b")).alias("_b"), (F.size("_f") + F.size("_b")).alias("_len"))
    rows = rows.select(key, "_in", counted(F.col("_f")).alias("_tf"), counted(F.col("_b")).alias("_tb"), "_len")
    # The statistics and the scores read one exchange of these counts, so texts are tokenized once.
    rows = rows.repartition(F.col(key), F.col("_in"))
    has = [((F.get("_tf", F.lit(i)) + F.get("_tb", F.lit(i))) > 0) for i in range(len(terms))]
    stats = rows.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), F.array(*(F.count_if(h) for h in has)).alias("_df"))
    rows = rows.crossJoin(F.broadcast(stats))  # one row

    def part(i: int) -> Column:
        df = F.get("_df", F.lit(i))
        idf = F.log((F.col("_n") - df + 0.5) / (df + 0.5))
        f = focus_weight * F.get("_tf", F.lit(i)) + F.get("_tb", F.lit(i))
        return F.when(idf <= 0, 1e-6).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))

    # A test of the counts alone would be pushed below them, and texts tokenized anew for each count; this one reads the statistics as well.
    held = sum((F.when(h, F.get("_df", F.lit(i))).otherwise(0) for i, h in enumerate(has)), F.lit(0))
    return rows.where(F.when(F.col("_in"), held > 0)).select(key, sum((part(i) for i in range(len(terms))), F.lit(0.0)).alias("score"))


def unmatched(terms: list[str], docs: DataFrame, tokens: Column, scope: Column) -> DataFrame:
    """Query terms that no document in scope holds; one aggregation for all terms."""
    found = docs.where(scope).agg(*(F.max(F.array_contains(tokens, t)).alias(f"t{i}") for i, t in enumerate(terms)))
    pairs = F.array(*(F.struct(F.lit(t).alias("term"), F.coalesce(F.col(f"t{i}"), F.lit(False)).alias("hit")) for i, t in enumerate(terms)))
    return found.select(F.explode(pairs).alias("x")).where("not x.hit").select("x.term")


#: Partitions of stored postings: a query reads those of its terms.
TERM_BUCKETS = 64


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def stored(docs: DataFrame, key: str, focus: Column, body: Column, folder: str) -> None:
    """Writes an inverted index: postings (bucket, term, key, counts, length), terms (document frequencies), one row of statistics.

    Postings are partitioned by a hash of the term and sorted by it, so a query reads a few row groups of a few files.
    Texts are tokenized once: a row's tokens are counted with its length at hand, and a posting without a term stands for
    the row itself, so nothing is joined and the statistics come from the postings. Rows of one key are rows of their own.
    A frequent term's postings are spread over the tasks of its bucket by key.
    """
    own = docs.select(key, F.monotonically_increasing_id().alias("_row"), focus.alias("_f"), body.alias("_b"))
    held = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    rows = own.select(
        key, "_row", (F.size("_f") + F.size("_b")).cast("long").alias("len"), F.size(held("_f")).alias("_n"),
        F.posexplode(F.concat(F.array(F.lit(None).cast("string")), held("_f"), held("_b"))).alias("_at", "term"),
    ).where("_at = 0 or term is not null")
    counted = rows.groupBy(key, "_row", "len", "term").agg(F.count_if((F.col("_at") > 0) & (F.col("_at") <= F.col("_n"))).alias("tf_focus"), F.count_if(F.col("_at") > F.col("_n")).alias("tf_body"))
    counted = counted.drop("_row").withColumn("bucket", _bucket(F.col("term")))
    counted.repartitionByRange("bucket", "term", key).sortWithinPartitions("bucket", "term", key).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    written = docs.sparkSession.read.parquet(f"{folder}/postings")
    written.where("term is not null").groupBy("bucket", "term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{folder}/terms")
    written.where("term is null").agg(F.count("*").alias("n"), F.avg("len").alias("mean")).write.mode("overwrite").parquet(f"{folder}/statistics")


class Stored:
    """An index that `stored` wrote. Statistics are those of the whole of it; scopes restrict candidates."""

    def __init__(self, spark, folder: str, key: str):
        self.key = key
        self.postings, self.terms, self.statistics = (spark.read.parquet(f"{folder}/{t}") for t in ("postings", "terms", "statistics"))

    def _of(self, df: DataFrame, terms: list[str]) -> DataFrame:
        names = F.array(*map(F.lit, terms))
        buckets = [r.b for r in df.sparkSession.range(1).select(F.explode(F.transform(names, _bucket)).alias("b")).distinct().collect()]
        return df.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))

    def bm25(self, terms: list[str], focus_weight: float, scope: DataFrame | None = None) -> DataFrame:
        """(key, score) of documents that hold a term; scope: a table of keys that may."""
        terms = list(dict.fromkeys(terms))
        rows = self._of(self.postings, terms)
        if scope is not None:
            rows = rows.join(scope.select(self.key).distinct(), self.key, "left_semi")
        idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = self._of(self.terms, terms).crossJoin(F.broadcast(self.statistics)).select("term", F.when(idf <= 0, 1e-6).otherwise(idf).alias("idf"), "mean")  # a row for each term
        f = focus_weight * F.col("tf_focus") + F.col("tf_body")
        part = F.col("idf") * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("mean")))
        return rows.join(F.broadcast(weights), "term").groupBy(self.key).agg(F.sum(part).alias("score"))

    def unmatched(self, terms: list[str], scope: DataFrame) -> list[str]:
        """Terms that no document in scope holds."""
        rows = self._of(self.postings, terms).join(scope.select(self.key).distinct(), self.key, "left_semi")
        held = {r.term for r in rows.select("term").distinct().collect()}  # at most the terms
        return [t for t in terms if t not in held]
