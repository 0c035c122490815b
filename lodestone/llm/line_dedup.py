"""Line dedup: an exact set-similarity join of lines; lines that resemble an earlier one go.

A line is the set of its lower-cased tokens between blanks. Its tokens are ordered from rare to common (line counts of
all tokens in BUCKETS hash buckets, a table of fixed size). Two lines of Jaccard similarity t share at least
need = ceil(t (|x| + |y|) / (1 + t)) tokens, so the first token that they share, in that order, has need - 1 tokens
after it in both: it stands in both prefixes, at positions that leave room for need. Lines are joined on prefix
tokens under this positional filter, the length filter, and a bound from parity bits of their sets (64, and 128 of
lines of more than LONG tokens); what is left is verified on the lines' tokens. A line is removed if a line before it is similar. Lines of equal sets are one from the
start, and the first of them stands for all.

A line needs one similar line before it, not all. So each line first meets, for each token of its prefix for partners
that are no shorter (a similar line of its size has one of these), the first lines (of LEADS classes by hash) that have
the token among their LEADING rarest ones, which decides most lines of large families; then what is undecided meets all lines of its prefix tokens. Pairs
of decided lines aren't formed. Everything is a DataFrame expression: no group is collected, and joins on a token are
merge joins, which adaptive execution splits where a token is hot.

Lines are in the order of (doc_id, text hash, line number), documents of a null id last. Rows that have both the id
and the text in common are one document, and come out alike; rows that share an id alone are different documents.

Defined results: a null or empty text stays as it is; blank lines are never removed; a document all of whose lines go
keeps its row with an empty text; ids may be of any type that can be ordered; an empty table gives an empty one; other
columns are kept, whatever their names, except that `out` replaces a column of that name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, release

BUCKETS, LEADING, LEADS = 1 << 18, 3, 4
#: Bits of a token's hash below its bucket, which gives way to its rank.
_BITS = 46
#: Lines whose names are broadcast at most; more are joined by a shuffle.
BROADCAST = 1 << 19
#: Lines of more tokens have two words of parity bits.
LONG = 100
_BLANKS = "\t\r\x0b\x0c"


def _odd() -> Column:
    """Has the text blanks that aren't spaces? Most texts haven't, and their lines are spared the translation."""
    odd = F.lit(False)
    for c in _BLANKS:
        odd = odd | F.contains("text", F.lit(c))
    return odd.alias("odd")


def _plain(line: Column) -> Column:
    """A line in lower case with spaces for other blanks (odd: it may have some), trimmed. Lines of ASCII are lowered fast, even in texts that aren't."""
    return F.trim(F.lower(F.when(F.col("odd"), F.translate(line, _BLANKS, " " * len(_BLANKS))).otherwise(line)))


def lines(docs: DataFrame) -> DataFrame:
    """id (in the order of lines), doc_id, th (the text's hash), no (from 0), line (lower-cased, trimmed): the lines that aren't blank.

    Texts are sorted once, so that a line's place in the order is one number. Of rows with the id and the text in common, one counts.
    """
    key = ["last", "doc_id", "th"]
    own = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("th"), "text")
    own = own.orderBy(*key).select("*", _odd(), F.monotonically_increasing_id().alias("at"))
    own = own.withColumn("first", F.min("at").over(Window.partitionBy(*key))).where("at = first")
    own = own.select("doc_id", "th", "odd", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return own.select(F.monotonically_increasing_id().alias("id"), "doc_id", "th", "no", _plain(F.col("line")).alias("line")).where("line != ''")


def _hashes(line: Column) -> Column:
    """Distinct 64-bit hashes of the tokens; the empty string between two spaces isn't one."""
    return F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda x: F.xxhash64(x))), F.xxhash64(F.lit("")))


def _ranks(hashed: DataFrame) -> Column:
    """What makes a hash's upper bits, its bucket, the bucket's place in the order of counts, the rarest first, if the two are combined by exclusive or.

    As a scalar subquery of a written row: a literal of this size would stand in the text of every plan.
    """
    counts = hashed.select(F.explode("h").alias("h")).groupBy(F.shiftrightunsigned("h", _BITS).cast("int").alias("b")).count()
    found = counts.toPandas()  # BUCKETS rows at most
    n = np.zeros(BUCKETS, np.int64)
    n[found["b"].to_numpy()] = found["count"].to_numpy()
    out = np.empty(BUCKETS, np.int64)
    out[np.argsort(n, kind="stable")] = np.arange(BUCKETS) - BUCKETS // 2  # the upper bit is the sign
    out = (out ^ np.arange(BUCKETS)) << _BITS
    return keep(hashed.sparkSession.createDataFrame([(out.tolist(),)], "ranks array<long>"), "ranks").scalar()


def _parity(hashes: Column) -> Column:
    """A bit for each value of a hash's last six bits: do an odd number of hashes have it?"""
    one = F.lit(1).cast("long")
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", one, t.bitwiseAND(F.lit(63)).cast("int"))))


def _differ_at_least(a: str, b: str) -> Column:
    """Bits in which parities differ; the two words of a long line, odd and p2, fold into one for a short one."""
    odd, p2 = F.col(f"odd{a}").bitwiseXOR(F.col(f"odd{b}")), F.col(f"p2{a}").bitwiseXOR(F.col(f"p2{b}"))
    both_long = (F.col(f"p2{a}") != 0) & (F.col(f"p2{b}") != 0)
    return F.when(both_long, F.bit_count(odd.bitwiseXOR(p2)) + F.bit_count(p2)).otherwise(F.bit_count(odd))


def _quarter(q: int):
    """Hashes by the two bits above."""
    return lambda h: h.bitwiseAND(F.lit(192)) == 64 * q


def _need(total: Column, percent: int) -> Column:
    """Tokens that sets of that total size must share."""
    return F.call_function("div", percent * total + 99 + percent, F.lit(100 + percent))


def _rows(lines: DataFrame, tokens: Column) -> DataFrame:
    """token, id, odd, p2, at (size and position) for each of the tokens; of decided lines, `at` is negative."""
    own = lines.select("id", "odd", "p2", "size", "decided", F.posexplode(tokens).alias("pos", "token"))
    at = F.col("size").cast("long") * F.lit(1 << 32) + F.col("pos")
    return own.select("token", "id", "odd", "p2", F.when(F.col("decided"), -at).otherwise(at).alias("at"))


def _met(rows: DataFrame, others: DataFrame, percent: int, shorter: bool) -> DataFrame:
    """Distinct (x, y), x before y: an undecided y and a line that share a token which may be the first of all they share.

    shorter: `others` are met as the shorter of two lines only, or the earlier of two of one size.
    """
    a, b = (x.select("token", F.col("id").alias(n), F.col("odd").alias(f"odd{n}"), F.col("p2").alias(f"p2{n}"), F.col("at").alias(f"t{n}")) for x, n in ((others, "a"), (rows, "b")))
    size_a, size_b = (F.shiftright(F.abs(c), 32) for c in ("ta", "tb"))
    at_a, at_b = (F.abs(c).bitwiseAND(F.lit((1 << 32) - 1)) for c in ("ta", "tb"))
    need = _need(size_a + size_b, percent)
    order = (size_a < size_b) | ((size_a == size_b) & (F.col("a") < F.col("b"))) if shorter else F.col("a") < F.col("b")
    undecided = F.when(F.col("a") < F.col("b"), F.col("tb")).otherwise(F.col("ta")) > 0
    fits = (at_a + need <= size_a) & (at_b + need <= size_b) & (_differ_at_least("a", "b") <= size_a + size_b - 2 * need)
    return a.join(b, "token").where(order & fits & undecided).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()


def _sets_of(ids: DataFrame, places: DataFrame, docs: DataFrame) -> DataFrame:
    """id, t (token hashes) of those lines, from the texts."""
    wanted = ids.join(places, "id").groupBy(F.col("doc_id").alias("_doc_id"), F.col("th").alias("_th")).agg(F.collect_list(F.struct("id", "no")).alias("_nos"))
    wanted = keep(wanted, "wanted")
    few = (wanted.agg(F.sum(F.size("_nos"))).first()[0] or 0) <= BROADCAST
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    own = own.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("th") == F.col("_th")))
    own = own.select("_nos", _odd(), F.split("text", "\n").alias("lines"))
    own = own.select("odd", F.explode(F.transform("_nos", lambda x: F.struct(x["id"].alias("id"), F.get("lines", x["no"]).alias("line")))).alias("x"))
    own = own.select("x.id", _hashes(_plain(F.col("x.line"))).alias("t"))
    return own.dropDuplicates(["id"])  # repeated rows have the same lines


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """id of the later lines of those pairs (x earlier, y later) that are similar by their tokens; sets: id, t."""
    # 256 parity bits: most pairs that aren't similar end before their tokens are joined to them.
    bits = F.array(*(_parity(F.filter("t", _quarter(q))) for q in range(4)))
    own = keep(sets.select("id", "t", F.size("t").alias("n"), bits.alias("bits")), "candidates", **{"parquet.enable.dictionary": "false"})
    left, right = own.select("id", "n", "bits").toDF("x", "nx", "bx"), own.select("id", "n", "bits").toDF("y", "ny", "by")
    total = F.col("nx") + F.col("ny")
    differ = sum((F.bit_count(F.get("bx", F.lit(i)).bitwiseXOR(F.get("by", F.lit(i)))) for i in range(4)), F.lit(0))
    near = pairs.join(left, "x").join(right, "y").withColumn("d", differ / total).where(differ <= total - 2 * _need(total, percent))
    near = keep(near.select("x", "y", "d"), "near")

    def verified(some: DataFrame) -> DataFrame:
        x, y = own.select("id", "t").toDF("x", "tx"), own.select("id", "t").toDF("y", "ty")
        both = F.size(F.array_intersect("tx", "ty"))
        found = some.select("x", "y").join(x, "x").join(y, "y").where(100 * both >= percent * (F.size("tx") + F.size("ty") - both))
        return keep(found.select(F.col("y").alias("id")).distinct(), "similar")

    # The likeliest partner of each line first, the others only of lines that it doesn't decide.
    best = near.groupBy("y").agg(F.min_by("x", F.struct("d", "x")).alias("x"))
    found = verified(best)
    rest = near.join(best.select("x", "y"), ["x", "y"], "left_anti").join(found.select(F.col("id").alias("y")), "y", "left_anti")
    out = keep(found.union(verified(rest)), "similar")
    release(own, near, found)
    return out


def removed_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, th, no of every line that a line before it resembles; percent: the least similarity."""
    plain = {"parquet.enable.dictionary": "false"}
    hashed = keep(lines(docs).select("id", "doc_id", "th", "no", _hashes(F.col("line")).alias("h")), "hashes", **plain | {"parquet.compression.codec.zstd.level": "1"})
    # Never null, so that Spark sorts them as plain numbers.
    ranked = F.transform("h", lambda h: F.coalesce(h.bitwiseXOR(F.get("ranks", F.shiftrightunsigned(h, _BITS))), F.lit(0).cast("long")))
    size = F.size("h")
    # Prefixes for a partner of any size, and how much of them for one that is no shorter.
    most, index = (size - F.ceil(size * percent / 100) + 1).cast("int"), (size - _need(2 * size, percent) + 1).cast("int")
    p2 = F.when(size > LONG, _parity(F.filter("h", lambda h: h.bitwiseAND(F.lit(64)) != 0))).otherwise(F.lit(0).cast("long"))
    sets = hashed.withColumn("ranks", _ranks(hashed))
    sets = sets.select("id", "doc_id", "th", "no", size.alias("size"), _parity(F.col("h")).alias("odd"), p2.alias("p2"), most.alias("most"), index.alias("index"), F.sort_array(ranked).alias("set"))
    sets = sets.select("id", "doc_id", "th", "no", "size", "odd", "p2", "index", F.xxhash64("set").alias("k1"), F.xxhash64(F.lit(1), "set").alias("k2"), F.slice("set", F.lit(1), F.col("most")).alias("prefix"))
    sets = keep(sets, "lines", **plain)
    release(hashed)

    firsts = keep(sets.groupBy("k1", "k2").agg(F.min("id").alias("id")).select("id"), "firsts")
    # Above 75 %, sets of up to three tokens resemble only their equals.
    alone = sets.where("size >= 4") if percent > 75 else sets
    reps = keep(alone.select("id", "size", "odd", "p2", "index", "prefix").join(firsts, "id", "left_semi"), "sets", **plain)
    places = sets.select("id", "doc_id", "th", "no").join(firsts.withColumn("first", F.lit(True)), "id", "left")
    places = keep(places.withColumn("copy", F.col("first").isNull()).drop("first"), "places")
    release(sets, firsts)

    open_ = reps.withColumn("decided", F.lit(False))
    rarest = _rows(open_, F.slice("prefix", 1, LEADING))
    leads = rarest.groupBy("token", F.pmod(F.xxhash64("id"), F.lit(LEADS)).alias("class")).agg(*(F.min_by(c, "id").alias(c) for c in ("odd", "p2", "at")), F.min("id").alias("id"))
    met = keep(_met(_rows(open_, F.slice("prefix", F.lit(1), F.col("index"))), leads, percent, False), "met")
    gone = _similar(met, _sets_of(_ends(met), places, docs), percent)

    marked = keep(reps.join(gone.withColumn("decided", F.lit(True)), "id", "left").withColumn("decided", F.coalesce("decided", F.lit(False))), "sets", **plain)
    release(reps)
    pairs = _met(_rows(marked, F.col("prefix")), _rows(marked, F.slice("prefix", F.lit(1), F.col("index"))), percent, True)
    pairs = keep(pairs.join(met, ["x", "y"], "left_anti"), "pairs")
    release(marked, met)
    gone = gone.union(_similar(pairs, _sets_of(_ends(pairs), places, docs), percent))
    found = places.join(gone.withColumn("gone", F.lit(True)), "id", "left").where("copy or gone").select("doc_id", "th", "no")
    found = keep(found, "removed")
    release(places, pairs)
    return found


def without_repeated_lines(docs: DataFrame, percent: int = 80, out: str | None = None) -> DataFrame:
    """docs, each text without the lines that are removed; `out`, if given, counts them."""
    found = removed_lines(docs.select("doc_id", "text"), percent)
    gone = found.groupBy("doc_id", "th").agg(F.collect_set("no").alias("nos")).select(F.struct("doc_id", "th", "nos").alias("_gone"))
    x, g = docs.alias("x"), gone.alias("g")
    marked = x.join(g, F.col("x.doc_id").eqNullSafe(F.col("g._gone.doc_id")) & (F.xxhash64("x.text") == F.col("g._gone.th")), "left")
    nos = F.col("g._gone.nos")
    kept = F.array_join(F.filter(F.split("x.text", "\n"), lambda _, i: ~F.array_contains(nos, i)), "\n")
    columns = [F.when(nos.isNull(), F.col("x.text")).otherwise(kept).alias("text") if c == "text" else F.col(f"x.`{c}`") for c in docs.columns if c != out]
    return marked.select(*columns, *([F.coalesce(F.size(nos), F.lit(0)).alias(out)] if out else []))
