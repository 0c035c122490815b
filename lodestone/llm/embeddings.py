"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosine, distributed components.

Equal vectors are one node with a weight. A node's key in each table is the signs of its products with the table's
hyperplanes. Nodes of one bucket are compared exactly, in double precision, by matrix products; a bucket of more
than BLOCK nodes is cut into blocks, and each pair of blocks is a task of its own. No pair leaves a task: a block
returns, for each node, the weight of the nodes that it links there for the first time (no earlier table holds both
in one bucket) and the smallest node that it links to in that block, which is what components need.

The bits of a key grow with the logarithm of the nodes, so a bucket of unrelated vectors keeps its size; the number
of tables follows from MISS, the largest chance to miss a pair that has exactly the threshold's cosine.

Defined results: a vector that is null, of length 0 or norm 0, or that holds a null or non-finite component links
with nothing; vectors of different lengths never link; an id that stands for several vectors is one node; a null id
has no component of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, slices
from .components import components

BUCKET, BLOCK, MISS = 256, 1024, 1e-4
_NONE = np.iinfo(np.int64).max


def tables(n: int, cosine: float) -> tuple[int, int]:
    """Bits of a key, number of tables."""
    bits = max(2, math.ceil(math.log2(max(2, n) / BUCKET)) if n > BUCKET else 2)
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - same))


def _keys(bits: int, n_tables: int, seed: int):
    @F.arrow_udf("array<int>")
    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        planes: dict[int, np.ndarray] = {}
        for batch in slices(batches):
            out: list = [None] * len(batch)
            rows = batch.to_pylist()
            by: dict[int, list[int]] = {}
            for i, v in enumerate(rows):
                by.setdefault(len(v), []).append(i)
            for dim, at in by.items():
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).normal(size=(dim, bits * n_tables))
                signs = (np.array([rows[i] for i in at], float) @ planes[dim] > 0).reshape(len(at), n_tables, bits)
                for i, k in zip(at, signs @ (1 << np.arange(bits))):
                    out[i] = k
            yield pa.array(out, pa.list_(pa.int32()))

    return keys


def _compared(cosine: float):
    def compare(group: pa.Table) -> pa.Table:
        """One pair of blocks of one bucket."""
        n = group.num_rows
        t, left, right = (group[c][0].as_py() for c in ("t", "i", "j"))
        ids, weight, own = (group[c].to_numpy() for c in ("rep", "n", "own"))
        keys = np.stack(group["keys"].to_numpy())[:, :t]
        v = np.stack(group["embedding"].to_numpy()).astype(float)
        v /= np.linalg.norm(v, axis=1)[:, None]
        a, b = np.flatnonzero(own == left), np.flatnonzero(own == right)
        linked = v[a] @ v[b].T >= cosine
        if left == right:
            np.fill_diagonal(linked, False)
        least, last = ids.copy(), None
        while last is None or (least != last).any():  # each node takes the smallest id of its neighbours, until none changes
            last = least.copy()
            least[a] = np.minimum(least[a], np.where(linked, least[b][None, :], _NONE).min(1, initial=_NONE))
            least[b] = np.minimum(least[b], np.where(linked, least[a][:, None], _NONE).min(0, initial=_NONE))
        x, y = np.nonzero(np.triu(linked) if left == right else linked)
        x, y = a[x], b[y]
        for k in range(t):
            new = keys[x, k] != keys[y, k]
            x, y = x[new], y[new]
        links = np.bincount(x, weight[y], n) + np.bincount(y, weight[x], n)
        joined = np.zeros(n, bool)
        joined[a[linked.any(1)]] = joined[b[linked.any(0)]] = True
        return pa.table({"rep": ids[joined], "links": links[joined].astype(np.int64), "to": least[joined]})

    return compare


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding)."""
    own = vectors.select("vec_id", "embedding")
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = e.isNotNull() & finite & F.exists(e, lambda x: x != 0) & F.col("vec_id").isNotNull()
    # Two 64-bit hashes stand for a vector where only its identity matters.
    own = own.withColumn("fit", F.coalesce(fit, F.lit(False))).withColumn("k", F.when(F.col("fit"), F.struct(F.xxhash64(e).alias("a"), F.xxhash64(F.lit(1), e).alias("b"))))
    reps = keep(own.where("fit").groupBy("k").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding")), "vectors")
    bits, n_tables = tables(reps.count(), cosine)

    keyed = reps.select("rep", "n", "embedding", _keys(bits, n_tables, seed)("embedding").alias("keys"))
    rows = keyed.select("rep", "n", "embedding", "keys", F.posexplode("keys").alias("t", "key"), F.size("embedding").alias("dim"))
    bucket = ["t", "key", "dim"]
    sizes = keyed.select(F.posexplode("keys").alias("t", "key"), F.size("embedding").alias("dim")).groupBy(*bucket).agg(F.count("*").alias("size")).where("size > 1")
    rows = rows.join(sizes, bucket)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    found = rows.select("t", "key", "dim", "i", "j", "own", "rep", "n", "embedding", "keys").groupBy(*bucket, "i", "j").applyInArrow(_compared(cosine), "rep long, links long, to long")
    found = keep(found, "links")

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("rep").alias("u"), F.col("to").alias("v")))
    nodes = reps.select("k", "rep", "n").join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    nodes = nodes.select("k", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = own.select("vec_id", "k").join(nodes, "k", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
