"""Packing of token sequences by minimum bin slack.

Every document becomes its token ids followed by an end id. Whole windows of a document are sequences of their
own; what remains (shorter than a window) is packed with the remainders of other documents. A remainder matters
only by its length, so the plan is made on a histogram of lengths (at most one count for each length under the
window, whatever the corpus holds): the longest length that is left opens a sequence, and a subset-sum dynamic
programme on a bitset finds the multiset of other lengths that fills it closest to its capacity; backtracking
gives how many of each, and the pattern is repeated as often as the counts allow. Documents then find their place
by their rank among the remainders of the same length.

Defined results: a null or empty text is the end id alone; repeated rows are packed as often as they stand; an
empty table gives no pieces; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import bounded_batches, keep, slices

WINDOW = 2048
#: Ranks within one length are counted in so many parts, so that a very common length isn't one task.
SALTS = 64
#: Characters for which the character classes of both libraries surely agree; other texts go to `tokenizers`.
_PLAIN = bytes([*b"\t\n\r", *range(32, 127), *range(0xA1, 0x100)])
#: White space in a run, at most, for `tiktoken`: its pattern steps back over such runs on a stack of bounded size.
_BLANKS = 1 << 16
_LONG_BLANKS = re.compile(rf"\s{{{_BLANKS}}}")
#: The split of byte-level pre-tokenization.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenIds:
    """Token ids of a byte-level BPE file of `tokenizers`, as little-endian 32-bit integers.

    Where the file's ids rank its merges (checked on loading), `tiktoken` runs the same merges several times as fast;
    its ids are the same. Other files, and texts with rarer characters, very long runs of white space or what may be a special token, are encoded by
    `tokenizers`.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.fast = self._ranked(path)

    @staticmethod
    def _ranked(path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        pre = spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return None
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        joined = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if len(ranks) != 256 + len(joined) or joined != list(range(256, 256 + len(joined))):
            return None
        return tiktoken.Encoding("ranked", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str | None) -> bytes:
        text = text or ""
        try:
            plain = self.fast and "<|" not in text and not text.encode("latin-1").translate(None, _PLAIN)
        except UnicodeEncodeError:
            plain = False
        if plain and len(text) >= _BLANKS and _LONG_BLANKS.search(text):
            plain = False
        return _packed(self.fast.encode_to_numpy(text, disallowed_special=()) if plain else self.tok.encode(text, add_special_tokens=False).ids)


def _packed(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


_WORKER: dict[str, TokenIds] = {}


def _cut(path: str, window: int, end_id: int):
    kind = pa.struct([("doc_tokens", pa.int64()), ("crcs", pa.list_(pa.int64()))])
    end = end_id.to_bytes(4, "little")

    @F.arrow_udf(T.StructType([T.StructField("doc_tokens", T.LongType()), T.StructField("crcs", T.ArrayType(T.LongType()))]))
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids = _WORKER.get(path) or _WORKER.setdefault(path, TokenIds(path))
        for batch in slices(batches):
            out = []
            for text in batch.to_pylist():
                data = ids(text) + end
                out.append({"doc_tokens": len(data) // 4, "crcs": [zlib.crc32(data[i : i + 4 * window]) for i in range(0, len(data), 4 * window)]})
            yield pa.array(out, kind)

    return cut


def fill(room: int, counts: dict[int, int], order: list[int]) -> tuple[int, dict[int, int]]:
    """The largest sum of at most `room` that a multiset within counts reaches, and one such multiset.

    order: lengths from long to short. Bit s of the bitset is set when s can be reached; each length enters in
    parts of 1, 2, 4 ... pieces.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in order:
        if length > room:
            continue
        left, part = min(counts[length], room // length), 1
        while left > 0:
            part = min(part, left)
            steps.append((reach, length, part))
            reach |= (reach << (part * length)) & mask
            left -= part
            part *= 2
        if reach >> room & 1:
            break
    best = s = reach.bit_length() - 1
    used: dict[int, int] = Counter()
    for before, length, part in reversed(steps):
        if not before >> s & 1:
            s -= part * length
            used[length] += part
    return best, dict(used)


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, pieces)]) for each pattern; every remainder of the histogram is placed once."""
    counts = {k: v for k, v in histogram.items() if v > 0 and k > 0}
    order, out = sorted(counts, reverse=True), []
    while order:
        seed = order[0]
        counts[seed] -= 1
        _, used = fill(window - seed, counts, order)
        counts[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        times = min(counts[k] // v for k, v in used.items())
        out.append((times, sorted(used.items(), reverse=True)))
        for k, v in used.items():
            counts[k] -= times * v
        if any(counts[k] == 0 for k in used):
            order = [k for k in order if counts[k]]
    return out


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece."""
    spark = docs.sparkSession
    bounded_batches(docs)
    tokens = docs.select("doc_id", _cut(tokenizer_path, window, end_id)("text").alias("t")).select("doc_id", "t.*")
    tokens = keep(
        tokens.withColumn("r", (F.col("doc_tokens") % window).cast("int"))
        .withColumn("full", F.floor(F.col("doc_tokens") / window).cast("long"))
        .withColumn("salt", F.pmod(F.xxhash64("doc_id", "crcs"), F.lit(SALTS)).cast("int")),
        "tokens",
    )
    # At most window * SALTS rows, whatever the corpus holds.
    groups = sorted((x.r, x.salt, x.n, x.full) for x in tokens.groupBy("r", "salt").agg(F.count("*").alias("n"), F.sum("full").alias("full")).toLocalIterator())
    histogram: dict[int, int] = Counter()
    starts, full = [], 0
    for r, salt, n, blocks in groups:
        starts.append((r, salt, histogram[r], full))
        histogram[r] += n
        full += blocks
    segments, sequences, placed = [], 0, Counter()
    for times, used in plan(histogram, window):
        at = 0
        for length, pieces in used:
            lo = placed[length]
            placed[length] += times * pieces
            segments.append((length, lo, placed[length], pieces, sequences, at))
            at += length * pieces
        sequences += times
    starts = spark.createDataFrame(starts, "r int, salt int, first long, first_full long")
    segments = spark.createDataFrame(segments, "r int, lo long, hi long, pieces int, seq long, at long")

    w = Window.partitionBy("r", "salt").orderBy("doc_id", "crcs")
    ranked = (
        tokens.withColumn("rank", F.row_number().over(w) - 1)
        .withColumn("before", F.coalesce(F.sum("full").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(F.broadcast(starts), ["r", "salt"])
        .withColumn("rank", F.col("rank") + F.col("first"))
    )
    s = segments.withColumnRenamed("r", "_r")
    placed = ranked.join(F.broadcast(s), (F.col("r") == F.col("_r")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left")
    pieces = placed.select("*", F.posexplode("crcs").alias("k", "ids_crc32"))
    whole = F.col("k") < F.col("full")
    nth = F.col("rank") - F.col("lo")
    return pieces.select(
        "doc_id",
        (F.col("k") * F.lit(window).cast("long")).alias("start"),
        F.when(whole, F.lit(window)).otherwise(F.col("r")).cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        F.when(whole, F.lit(sequences) + F.col("first_full") + F.col("before") + F.col("k")).otherwise(F.col("seq") + F.floor(nth / F.col("pieces"))).cast("long").alias("sequence_id"),
        F.when(whole, F.lit(0)).otherwise(F.col("at") + (nth % F.col("pieces")) * F.col("r")).cast("long").alias("offset"),
    )
