"""An exact Jaccard self-join of documents on word n-grams, by universe partition and pigeonhole.

A document is the set of its distinct n-word shingles. Sets of one size band share a partition of the universe into
segments (a shingle's hash names its segment). Two sets of Jaccard similarity t differ in at most H shingles, and H
follows from the smaller size; so of any H + 1 segments at least one is equal in both. Each set indexes the subset it
has in each of its first H + 1 + slack segments, in its own band's partition and, where a smaller partner may belong
to the band below, in that one's too. Some segments of a band may be wide: there the subset's one-deletion
neighbourhood is indexed as well, an equal or one-off subset is found, and the segment counts two. How many are wide
is chosen for each band by cost: the keys that a set of that size emits against the keys of one shingle or none,
which collide by chance. An empty subset is no key; the slack makes up for it, and a set whose segments count too
little (by its own sizes) also emits its empty ones, so nothing is lost.

Copies (equal sets) are one node from the start. The nodes that share a key are compared with the smallest of them;
what is verified forms components; only then are nodes of a key that are still in different components compared with
each other. A parity sketch (a bit for each of some buckets: is its number of shingles odd?) bounds the difference of
two sets from below, so most pairs under the threshold, of families of edited copies for instance, end inside the
join's condition and are never formed. Verification is exact, on the texts' shingles. No group is collected, and no
pair is formed within a component.

Defined results: null, empty and blank texts have an empty set and link with nothing; a text of fewer than n words
is one shingle; repeated rows are copies; an id with several texts is one node, with the links of each; rows of a null id are left out of links and have no component.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Held, keep, release, slices
from .components import components

#: Size of a band's largest set over its smallest; share of segments beyond H + 1; cost of a key of one shingle or none.
BAND, SLACK, CHANCE = 1.4, 0.12, 6.0
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _word(w: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(w)


_WORDS = Held(_word)


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def shingles(words: list, n: int) -> set[tuple]:
    return set(zip(*(words[i:] for i in range(n)))) if len(words) >= n else {tuple(words)} if words else set()


def hashed(text: str | None, n: int) -> np.ndarray:
    """Distinct 64-bit hashes of the text's shingles."""
    words = tokens(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = _mix(out + h[i : len(h) - k + 1 + i] + _M3)
    return np.unique(out)


class Scheme:
    """Bands, segments and their allocation for a threshold of percent / 100."""

    def __init__(self, percent: int):
        self.t = percent / 100
        self.percent = percent
        self._h = [0]
        self._period = (100 + percent) // math.gcd(100 + percent, percent)

    def differ(self, size: int) -> int:
        """Largest number of shingles in one set only, for a set of at most `size` and a partner no smaller than itself."""
        while len(self._h) <= size:
            s, p = len(self._h), self.percent
            top = 100 * s // p  # the partner's largest size; the bound rises by 1 or falls by 1 from size to size, and rises over each period
            most = max(s + l - 2 * (-(-p * (s + l) // (100 + p))) for l in range(max(s, top - self._period), top + 1))
            self._h.append(max(self._h[-1], most))
        return self._h[size]

    @functools.cached_property
    def _edges(self) -> list[int]:
        out = [1]
        while out[-1] < 1 << 31:
            out.append(max(out[-1] + 1, int(out[-1] * BAND)))
        return out

    def band(self, size: int) -> int:
        import bisect

        return bisect.bisect_right(self._edges, size) - 1

    def most(self, band: int) -> int:
        return self._edges[band + 1] - 1

    @functools.cache
    def segments(self, band: int) -> tuple[int, int]:
        """Number of segments of a band, and how many of them are wide: the cheapest of a few allocations."""
        size = self.most(band)
        need = self.differ(min(size, 1 << 20)) + 1 if size <= 1 << 20 else int(size * (1 - self.t) / self.t) + 1
        options = []
        for wide in {0, 1, 2, need // 4, need // 2} if size <= 64 else {0}:
            m = max(1, need + (math.ceil(SLACK * need) + 1 if need > 1 else 0) - wide)
            if wide > m:
                continue
            mean = size / m
            options.append((m - wide + wide * (1 + mean) + CHANCE * m * math.exp(-mean) * (1 + mean), m, wide))
        return min(options)[1:]

    def keys(self, h: np.ndarray) -> np.ndarray:
        """The keys of a set of hashed shingles."""
        n = len(h)
        if not n:
            return np.zeros(0, np.int64)
        own = self.band(n)
        out, placed, value = [], _mix(h ^ _M2), _mix(h)
        for band in range(own, -1, -1):
            top = self.most(band)
            if band < own and self.percent * n > 100 * top:
                break
            m, wide = self.segments(band)
            need = self.differ(min(n, top)) + 1
            emitted = min(m, max(1, need + (math.ceil(SLACK * need) + 1 if need > 1 else 0)))
            seg = (placed % np.uint64(m)).astype(np.int64)
            order = np.argsort(seg, kind="stable")
            order = order[: np.searchsorted(seg[order], emitted)]
            s, v = seg[order], value[order]
            name = _mix(np.arange(emitted, dtype=np.uint64) + np.uint64(band << 32) + _M3)
            starts = np.flatnonzero(np.diff(s, prepend=-1))
            filled = s[starts]
            sums = np.zeros(emitted, np.uint64)
            sizes = np.bincount(s, minlength=emitted)
            if len(v):
                sums[filled] = np.add.reduceat(v, starts)
            full = _mix(sums + name)
            counts = np.minimum(sizes, 1)
            is_wide = np.arange(emitted) < wide
            counts[is_wide] = np.minimum(sizes[is_wide], 2)
            out.append(full[sizes > 0])
            some = is_wide[s] & (sizes[s] > 1)
            out.append(_mix(sums[s[some]] - v[some] + name[s[some]]))
            if counts.sum() < need:  # rare: the empty subsets, and those one shingle away from empty
                out.append(full[sizes == 0])
                out.append(_mix(name[is_wide & (sizes == 1)]))
        return np.unique(np.concatenate(out)).view(np.int64)


@functools.cache
def _scheme(percent: int) -> Scheme:
    return Scheme(percent)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, np.int64)])))


def sketch(h: np.ndarray) -> np.ndarray:
    """Parities of the set's hashes over a power of two of buckets, four to eight for each shingle of most sets, as longs.

    Two sets differ in at least as many shingles as their parities do in bits; a longer sketch folds into a shorter one.
    """
    bits = 1 << max(9, min(16, (max(1, len(h)) * (4 if len(h) <= 1024 else 1) - 1).bit_length()))
    odd = np.bincount((_mix(h + _M2) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _differ_at_least(a: str, b: str) -> Column:
    """Bits in which two sketches differ, after the longer one is folded (sizes within a factor of four)."""

    def folded(x: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    def to(x: Column, other: Column) -> Column:
        return F.when(F.size(x) <= F.size(other), x).when(F.size(x) == 2 * F.size(other), folded(x)).when(F.size(x) == 4 * F.size(other), folded(folded(x)))

    x, y = F.col(a), F.col(b)
    return F.aggregate(F.zip_with(to(x, y), to(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, z: total + z)


def _within(sa: str, sb: str, percent: int) -> Column:
    """Largest difference that sets of these sizes may have."""
    both = F.col(sa) + F.col(sb)
    return both - 2 * F.ceil(percent * both / F.lit(100 + percent))


def _described(n: int, percent: int):
    kind = pa.struct([("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])

    @F.arrow_udf("n long, k1 long, k2 long, keys array<long>, sketch array<long>")
    def described(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scheme = _scheme(percent)
        for batch in slices(batches):
            size, k1, k2, keys, bits = [], [], [], [], []
            for t in batch.to_pylist():
                h = hashed(t, n)
                size.append(len(h))
                k1.append(int(_mix(h + _M1).sum(dtype=np.uint64).view(np.int64)))
                k2.append(int(_mix(h ^ _M3).sum(dtype=np.uint64).view(np.int64)))
                keys.append(scheme.keys(h))
                bits.append(sketch(h))
            yield pa.StructArray.from_arrays([pa.array(size, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), _lists(keys), _lists(bits)], fields=list(kind))

    return described


def _verified(pairs: DataFrame, docs: DataFrame, several: DataFrame | None, n: int, percent: int) -> DataFrame:
    """Those of the pairs (u, v) whose texts are similar enough; each text is shuffled once, to its pairs.

    several: ids with more than one text, if there are any; of their pairs, any text of u may be similar to any of v.
    """

    @F.arrow_udf("boolean")
    def similar(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        last, a = None, set()
        for left, right in batches:
            for at in range(0, len(left), 64):
                out = []
                for x, y in zip(left[at : at + 64].to_pylist(), right[at : at + 64].to_pylist()):
                    if x != last:
                        last, a = x, shingles(tokens(x), n)
                    b = shingles(tokens(y), n)
                    both = len(a & b)
                    out.append(100 * both >= percent * (len(a) + len(b) - both))
                yield pa.array(out, pa.bool_())

    def compared(own: DataFrame) -> DataFrame:
        ends = own.select("u", "v", F.explode(F.array("u", "v")).alias("doc_id"))
        texts = ends.join(docs, "doc_id").groupBy("u", "v").agg(F.min_by("text", "doc_id").alias("a"), F.max_by("text", "doc_id").alias("b"))
        return texts.where(similar("a", "b")).select("u", "v")

    if several is None:
        return compared(pairs)
    flag = lambda end: several.select(F.col("doc_id").alias(end), F.lit(True).alias(f"_{end}"))
    marked = pairs.join(flag("u"), "u", "left").join(flag("v"), "v", "left")
    odd = keep(marked.where("_u or _v").select("u", "v"), "odd")
    own = docs.join(odd.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "doc_id", "left_semi").distinct()
    texts = odd.join(own.select(F.col("doc_id").alias("u"), F.col("text").alias("a")), "u").join(own.select(F.col("doc_id").alias("v"), F.col("text").alias("b")), "v")
    return compared(marked.where("_u is null and _v is null").select("u", "v")).union(texts.where(similar("a", "b")).select("u", "v").distinct())


def similar_documents(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    own = docs.select("doc_id", "text")
    sets = keep(own.select("doc_id", _described(n, percent)("text").alias("s")).select("doc_id", "s.*"), "sets")
    filled = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    copies = keep(sets.where(filled).groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("size")), "copies")
    texts = own.where(F.col("doc_id").isNotNull())
    several = keep(sets.where(filled).groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("a"), F.max(F.struct("k1", "k2")).alias("b")).where("a != b").select("doc_id"), "several")
    several = None if several.isEmpty() else several

    # Nodes that share a key, with the smallest of them and the number of them.
    reps = sets.where(filled).join(copies.select(F.col("rep").alias("doc_id"), "size"), "doc_id", "left_semi")
    rows = reps.select(F.col("doc_id").alias("rep"), F.col("n").cast("int").alias("size"), F.explode("keys").alias("key"))
    w = Window.partitionBy("key").orderBy("rep")
    shared = rows.withColumn("lead", F.first("rep").over(w)).withColumn("next", F.lead("rep").over(w)).where("lead != rep or next is not null")
    shared = keep(shared.select("key", "rep", "size", "lead"), "shared")

    small = keep(reps.select(F.col("doc_id").alias("rep"), F.col("n").cast("int").alias("size"), "sketch"), "sketches")
    left, right = small.toDF("u", "su", "xu"), small.toDF("v", "sv", "xv")
    alike = _differ_at_least("xu", "xv") <= _within("su", "sv", percent)
    first = shared.where("rep != lead").select(F.col("lead").alias("u"), F.col("rep").alias("v")).distinct()
    first = keep(first.join(left, "u").join(right, "v").where(alike).select("u", "v"), "pairs")
    links = keep(_verified(first, texts, several, n, percent), "links")
    parts = components(links)

    # Nodes of a key outside its first node's component, against the other nodes of the key and of other components.
    at = shared.where("rep != lead").join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep"))
    lead_part = parts.select(F.col("node").alias("lead"), F.col("component").alias("lead_part"))
    outside = at.join(lead_part, "lead", "left").where(F.col("part") != F.coalesce("lead_part", "lead")).select("key", "rep", "part")
    outside = keep(outside, "outside")
    a = outside.join(small, "rep").select("key", F.col("rep").alias("u"), F.col("part").alias("pu"), F.col("size").alias("su"), F.col("sketch").alias("xu"))
    b = at.join(outside.select("key").distinct(), "key", "left_semi").join(small.drop("size"), "rep").select("key", F.col("rep").alias("v"), F.col("part").alias("pv"), F.col("size").alias("sv"), F.col("sketch").alias("xv"))
    near = (percent * F.col("su") <= 100 * F.col("sv")) & (percent * F.col("sv") <= 100 * F.col("su"))
    rest = a.join(b, (a["key"] == b["key"]) & (F.col("pu") != F.col("pv")) & near & alike)
    rest = rest.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    rest = keep(rest.join(first, ["u", "v"], "left_anti"), "pairs")
    more = keep(_verified(rest, texts, several, n, percent), "links")
    if not more.isEmpty():
        parts = components(links.union(more))

    groups = copies.select("k1", "k2", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    out = sets.select("doc_id", F.col("n").alias("n_shingles"), F.when(filled, F.col("k1")).alias("k1"), F.when(filled, F.col("k2")).alias("k2"))
    return out.join(groups, ["k1", "k2"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
