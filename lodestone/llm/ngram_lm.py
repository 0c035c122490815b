"""A word trigram model in Elias-Fano tries, learnt from a corpus and asked about it.

Documents are cut into blocks of about BLOCK tokens. Words are counted and ranked over all blocks, so that tokens are
small whole numbers. Every block sends each shard the different trigrams that it holds there, once, with their training
counts; a shard builds its trie of what was trained, answers all that it was sent, and a block adds up the answers of
its documents. Word lists, trigrams and answers are shuffled as rows of packed numbers; no vocabulary, model or corpus is ever
whole in one place. What is broadcast is the ranks at which the word count changes: at most sqrt(2 N) for N tokens.

A shard holds everything that follows a word: its successors, the words before it, and what follows both. A word of
more than half a shard's tokens is dealt to several shards by a class of the word before it; each class has successors of its
own, learnt from that many tokens, so no shard grows with a frequent word.

The model is interpolated absolute discounting over (two words, one word, none): with D = n1 / (n1 + 2 n2) of an order
in its shard, p(w | u v) = max(c(u v w) - D, 0) / c(u v) + D t(u v) / c(u v) p(w | v), where t counts different
successors, p(w | v) likewise, and at last p(w) = (c + 0.1) / (N + 0.1 (V + 1)), which leaves a share for a word never seen. A text's first word has no context.

The trie of a shard is a flat memory-mapped buffer: Elias-Fano lists with monotone pointers. Successors of a word are
word ranks; successors of two words are places among the successors of the latter word (context-relative), found by successor search.
Probabilities and back-off weights are quantised to 1/1024 of a decimal logarithm. The mapping is anonymous, as
executors share no local folder.

Defined results: a null or empty text is the end alone; a null id counts as held out where the remainder 0 is; repeated
rows count and are scored as often as they stand; without any training document each token has the share of a word never
seen; an empty table gives an empty result; other columns don't matter. A document longer than BLOCK is a block of its own.
"""

from __future__ import annotations

import itertools
import mmap
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, release, slices
from .elias_fano import Lists, Sequence, encode

BLOCK, SHARD, STEPS, ADDED = 1 << 20, 1 << 20, 1024, 0.1
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: No word holds a line feed.
END = "\n"


def packed(a: np.ndarray) -> bytes:
    """Whole numbers from 0 as compressed planes of bytes, without the planes that are zero."""
    width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8).reshape(b[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : b[0]] = planes.T
    return out.view("<u8").ravel().astype(np.int64)


def _blocks(kind: pa.DataType, size: int):
    """Of (doc_id, held, text): rows of documents with tokens numbered by the block's own word list."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId(), itertools.count()
        names = ["block", "docs", "held", "lengths", "tokens", "words", "trained"]

        def fresh():
            return [], [], [], [], defaultdict(itertools.count().__next__)

        docs, held, lengths, tokens, number = fresh()

        def out() -> pa.RecordBatch:
            every = np.concatenate(tokens)
            trained = np.bincount(every[~np.repeat(held, lengths)], minlength=len(number))
            columns = [[(task << 32) + next(serial)], [docs], [held], [packed(np.array(lengths))], [packed(every)], [[w.decode("utf-8", "replace") for w in number]], [packed(trained)]]
            kinds = [pa.int64(), pa.list_(kind), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        total = 0
        for batch in batches:
            for part in slices([batch], 64):
                for doc, is_held, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
                    words.append(END.encode())
                    if docs and total + len(words) > size:
                        yield out()
                        docs, held, lengths, tokens, number = fresh()
                        total = 0
                    docs.append(doc)
                    held.append(is_held)
                    lengths.append(len(words))
                    tokens.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                    total += len(words)
        if docs:
            yield out()

    return make


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            words = batch.column("words")[i].values
            n = len(words)
            block = pa.array(np.full(n, batch.column("block")[i].as_py()))
            yield pa.RecordBatch.from_arrays([block, pa.array(np.arange(n, dtype=np.int32)), words, pa.array(unpacked(batch.column("trained")[i].as_py()))], names=["block", "place", "word", "trained"])


class Counts:
    """Training count of a rank, from the ranks at which it changes. The rank V is every unseen word, V + 1 what stands before a document."""

    def __init__(self, first: np.ndarray, count: np.ndarray, n_words: int, n_tokens: int):
        self.first, self.count = np.append(first, n_words), np.append(count, 0)
        self.unseen, self.start, self.n_tokens, self.n_words = n_words, n_words + 1, n_tokens, n_words

        p = (self.count + ADDED) / (n_tokens + ADDED * (n_words + 1))
        self.log, self.code = np.log10(p), _quantised(p).astype(np.int64)

    def places(self, rank: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, rank, "right") - 1

    def __call__(self, rank: np.ndarray) -> np.ndarray:
        return self.count[self.places(rank)]


def _mixed(a: np.ndarray) -> np.ndarray:
    x = a.astype(np.uint64)
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(m)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(1)


class Trigrams:
    """The different (v, u, w) of a block whose v was trained: word before, word before that, word; sorted, each with its shard and training count.

    tokens are places in `ranks`, the block's ranks in order. A document's first word has no context.
    """

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, ranks: np.ndarray, trained: np.ndarray | None, counts: Counts, shards: int, size: int):
        begin = np.cumsum(lengths) - lengths
        start = len(ranks)
        ranks = np.append(ranks, counts.start)
        one, two = np.append(start, tokens[:-1]), np.append([start] * 2, tokens)[: len(tokens)]
        two[begin[lengths > 1] + 1] = start
        known = ranks[one] != counts.unseen
        known[begin] = False
        self.asked = np.flatnonzero(known)
        (v, u, w), self.inverse = distinct(*(a[self.asked] for a in (one, two, tokens)), len(ranks))
        self.v, self.u, self.w = ranks[v], ranks[u], ranks[w]
        if trained is not None:
            self.n = np.bincount(self.inverse, weights=trained[self.asked], minlength=len(v)).astype(np.int64)
        classes = np.maximum(-(-counts(ranks) * 2 // size), 1).astype(np.uint64)
        mixed = _mixed(ranks)
        self.shard = ((mixed[v] + mixed[u] % classes[v]) % np.uint64(shards)).astype(np.int64)
        self.order = np.argsort(self.shard, kind="stable")
        self.bounds = np.searchsorted(self.shard[self.order], np.arange(shards + 1))


def distinct(v: np.ndarray, u: np.ndarray, w: np.ndarray, n: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """The different triples of numbers under n, sorted, and where each triple stands among them."""
    if n**3 < 1 << 63:
        key, inverse = np.unique((v * n + u) * n + w, return_inverse=True)
        pair = key // n
        return (pair // n, pair % n, key - pair * n), inverse
    pair, of = np.unique(v * n + u, return_inverse=True)
    key, inverse = np.unique(of * n + w, return_inverse=True)
    return (pair[key // n] // n, pair[key // n] % n, key % n), inverse


def _quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-STEPS * np.log10(p)), 0, 65535).astype(np.uint16)


def _changes(a: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it; true of the first."""
    return np.append(True, a[1:] != a[:-1]) if len(a) else np.zeros(0, bool)


def _discount(n: np.ndarray) -> float:
    one, two = int((n == 1).sum()), int((n == 2).sum())
    return float(np.clip(one / (one + 2 * two), 0.05, 0.95)) if one else 0.5


def build(v: np.ndarray, u: np.ndarray, w: np.ndarray, n: np.ndarray, shares: np.ndarray) -> bytes:
    """The trie of different triples sorted by (v, u, w), their counts n > 0, and shares of w (its probability without context)."""
    first = _changes(v)
    roots, root = v[first], np.cumsum(first) - 1
    new = first | _changes(u)
    context = np.cumsum(new) - 1
    most = int(w.max(initial=0)) + 1
    follow, pair = np.unique(root * most + w, return_inverse=True)
    at, word = follow // most, follow % most
    pair_n = np.bincount(pair, weights=n, minlength=len(follow)).astype(np.int64)
    share = np.zeros(len(follow))
    share[pair] = shares
    d2, d3 = _discount(pair_n), _discount(n)
    total, kinds = np.bincount(at, weights=pair_n, minlength=len(roots)), np.bincount(at, minlength=len(roots))
    back2 = d2 * kinds / np.maximum(total, 1)
    p2 = (pair_n - d2) / total[at] + back2[at] * share
    total, kinds = np.bincount(context, weights=n, minlength=int(new.sum())), np.bincount(context, minlength=int(new.sum()))
    back3 = d3 * kinds / np.maximum(total, 1)
    p3 = (n - d3) / total[context] + back3[context] * p2[pair]
    begins = np.searchsorted(at, np.arange(len(roots) + 1))
    parts = [encode(roots), Lists.encode(at, word, len(roots)), Lists.encode(root[new], u[new], len(roots)), Lists.encode(context, pair - begins[root], int(new.sum()))]
    for codes in (back2, p2, back3, p3):
        c = _quantised(codes)
        parts += [np.array([len(c)], np.int64).tobytes(), c.tobytes() + bytes(-2 * len(c) % 8)]
    return b"".join(parts)


class Trie:
    """A built trie, read in place from a memory map."""

    def __init__(self, built: bytes):
        held = mmap.mmap(-1, max(1, len(built)))
        held.write(built)
        self.roots = Sequence(held)
        self.followers = Lists(held, self.roots.end)
        self.before = Lists(held, self.followers.end)
        self.after = Lists(held, self.before.end)
        at, self.codes = self.after.end, []
        for _ in range(4):
            n = int(np.frombuffer(held, np.int64, 1, at)[0])
            self.codes.append(np.frombuffer(held, np.uint16, n, at + 8))
            at += 8 + -(-2 * n // 8) * 8

    def ask(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """Quantised -log10 p(w | u v) of triples sorted by (v, u, w); shares: quantised -log10 p(w)."""
        back2, p2, back3, p3 = self.codes
        out = shares.astype(np.int64)
        if not self.roots.n:
            return out
        first = _changes(v)
        root = self.roots.find(v[first])[np.cumsum(first) - 1]
        seen = np.flatnonzero(root >= 0)
        root, u, w = root[seen], u[seen], w[seen]
        place, relative = self.followers.find(root, w)
        two = np.where(place >= 0, p2[place], back2[root] + out[seen])
        new = _changes(root) | _changes(u)
        context = self.before.find(root[new], u[new])[0][np.cumsum(new) - 1]
        held = np.flatnonzero(context >= 0)
        two[held] += back3[context[held]]
        both = held[relative[held] >= 0]
        place, _ = self.after.find(context[both], relative[both])
        two[both[place >= 0]] = p3[place[place >= 0]]
        out[seen] = two
        return out


def _sent(counts, shards: int, size: int):
    """Of coded blocks: (shard, block, body), the trigrams of a block for one shard."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for part in slices([batch], 1) for r in part.to_pylist()):
                lengths = unpacked(row["lengths"])
                t = Trigrams(unpacked(row["tokens"]), lengths, unpacked(row["ranks"]), ~np.repeat(row["held"], lengths), counts.value, shards, size)
                for s in np.flatnonzero(np.diff(t.bounds)).tolist():
                    own = t.order[t.bounds[s] : t.bounds[s + 1]]
                    body = [packed(np.diff(t.v[own], prepend=0)), *(packed(a[own]) for a in (t.u, t.w, t.n))]
                    yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([row["block"]]), pa.array([body], pa.list_(pa.binary()))], names=["shard", "block", "body"])

    return send


def _answered(counts):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, blocks, parts = None, [], []
        for batch in batches:
            for i in range(batch.num_rows):
                shard = batch.column("shard")[i]
                blocks.append(batch.column("block")[i].as_py())
                parts.append([unpacked(b) for b in batch.column("body")[i].as_py()])
        sizes = np.cumsum([0, *(len(p[0]) for p in parts)])
        v = np.concatenate([np.cumsum(p[0]) for p in parts])
        u, w, n = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
        parts.clear()
        # A shard has few of all words as v, so that the three numbers mostly fit one key.
        kinds, at = np.unique(v, return_inverse=True)
        most = int(max(u.max(initial=0), w.max(initial=0))) + 1
        if len(kinds) * most * most < 1 << 63:
            key, inverse = np.unique((at * most + u) * most + w, return_inverse=True)
            pair = key // most
            v, u, w = kinds[pair // most], pair % most, key - pair * most
        else:
            rank = np.unique(np.concatenate([v, u, w]))
            key, inverse = distinct(*(np.searchsorted(rank, a) for a in (v, u, w)), len(rank))
            v, u, w = (rank[a] for a in key)
        total = np.bincount(inverse, weights=n, minlength=len(v)).astype(np.int64)
        of, known = counts.value.places(w), np.flatnonzero(total)
        trie = Trie(build(v[known], u[known], w[known], total[known], 10.0 ** counts.value.log[of[known]]))
        codes = trie.ask(v, u, w, counts.value.code[of])[inverse]
        for i, block in enumerate(blocks):
            yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()]), pa.array([block]), pa.array([packed(codes[sizes[i] : sizes[i + 1]])], pa.binary())], names=["shard", "block", "codes"])

    return answer


def _summed(counts, shards: int, size: int, kind: pa.DataType):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def add(coded: pa.Table, answers: pa.Table) -> pa.Table:
        row = coded.to_pylist()[0]
        tokens, lengths = unpacked(row["tokens"]), unpacked(row["lengths"])
        ranks = unpacked(row["ranks"])
        t = Trigrams(tokens, lengths, ranks, None, counts.value, shards, size)
        codes = np.zeros(len(t.v), np.int64)
        for s, body in zip(answers["shard"].to_pylist(), answers["codes"].to_pylist(), strict=True):
            codes[t.order[t.bounds[s] : t.bounds[s + 1]]] = unpacked(body)
        of = counts.value.places(ranks)[tokens]
        logs, score = counts.value.log[of], counts.value.code[of]
        score[t.asked] = codes[t.inverse]
        begin = np.cumsum(lengths) - lengths
        known = np.add.reduceat((ranks != counts.value.unseen)[tokens].astype(np.int64), begin)
        columns = [pa.array(row["docs"], kind), pa.array(row["held"], pa.bool_()), lengths, known, np.full(len(lengths), counts.value.n_tokens), np.add.reduceat(logs, begin), -np.add.reduceat(score, begin) / STEPS]
        return pa.table([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    return add


def _ranked(blocks: DataFrame) -> tuple[DataFrame, DataFrame, Counts]:
    """(block, place, word), (word, rank) of the words trained, most frequent first, and their counts."""
    rows = blocks.select("block", "words", "trained").mapInArrow(_word_rows, "block long, place int, word string, trained long")
    counted = rows.groupBy("word").agg(F.sum("trained").alias("c")).where("c > 0")
    ordered = keep(counted.orderBy(F.desc("c"), "word").withColumn("at", F.monotonically_increasing_id()), "words")
    part = F.shiftright("at", 33)
    sizes = ordered.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row for each partition
    ends = [0, *itertools.accumulate(r["count"] for r in sizes)]
    offsets = blocks.sparkSession.createDataFrame([(r.part, ends[i]) for i, r in enumerate(sizes)], "part long, before long")
    ranked = ordered.join(F.broadcast(offsets), part == F.col("part")).select("word", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("rank"))
    changes = ordered.groupBy("c").count().orderBy(F.desc("c")).collect()  # as many as there are different counts, at most sqrt(2 N)
    number = np.array([r["count"] for r in changes], np.int64)
    c = np.array([r.c for r in changes], np.int64)
    return rows.drop("trained"), ranked, Counts(np.cumsum(number) - number, c, int(number.sum()), int((number * c).sum()))


def _coded(unseen: int):
    def code(blocks: pa.Table, words: pa.Table) -> pa.Table:
        rank = np.full(words.num_rows, unseen, np.int64)
        rank[words["place"].to_numpy()] = words["rank"].to_numpy()
        ranks, place = np.unique(rank, return_inverse=True)
        out = blocks.select(["block", "docs", "held", "lengths"]).append_column("ranks", pa.array([packed(ranks)], pa.binary()))
        return out.append_column("tokens", pa.array([packed(place[unpacked(blocks["tokens"][0].as_py())])], pa.binary()))

    return code


def score(docs: DataFrame, held_out: Column, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: the model learns from rows that `held_out` isn't true of."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held"), F.col("text").cast("string").alias("text"))
    id_kind = rows.schema["doc_id"].dataType.simpleString()
    kind = spark.createDataFrame([], f"doc_id {id_kind}").toArrow().schema.field(0).type
    blocks = keep(rows.mapInArrow(_blocks(kind, block), f"block long, docs array<{id_kind}>, held array<boolean>, lengths binary, tokens binary, words array<string>, trained binary"), "blocks")
    places, ranked, found = _ranked(blocks)
    named = places.join(ranked, "word", "left").select("block", "place", F.coalesce("rank", F.lit(found.unseen)).alias("rank"))
    layout = f"block long, docs array<{id_kind}>, held array<boolean>, lengths binary, ranks binary, tokens binary"
    coded = keep(blocks.drop("words", "trained").groupBy("block").cogroup(named.groupBy("block")).applyInArrow(_coded(found.unseen), layout), "coded")
    release(blocks)
    shards = max(1, -(-found.n_tokens // shard))
    counts = spark.sparkContext.broadcast(found)
    sent = coded.mapInArrow(_sent(counts, shards, shard), "shard long, block long, body array<binary>")
    answers = keep(sent.groupBy("shard").applyInArrow(_answered(counts), "shard long, block long, codes binary"), "answers")
    result = f"doc_id {id_kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return coded.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_summed(counts, shards, shard, kind), result)
