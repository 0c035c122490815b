"""Spelling variants by anagram hashing.

A word's key is the sum of its letters' fifth powers, whatever their order. One letter added, removed or exchanged
changes a key by that letter's power or by the difference of two powers. So a word gives its key and, for each
different letter of it, the key without that letter: a word meets its one-letter extensions where a key equals
another's key less one letter, and its exchanges where two keys less one letter are equal. That is every addition,
removal and exchange value with as many rows a word as it has letters, and no word meets the whole alphabet. What meets
is verified for the order of letters (an edit distance of one).

Anagrams share keys. Where more than CROWD rows share one, rows also carry the place of the letter and a hash of the
letters around it, so that only words with equal surroundings meet (at most an alphabet of them); these are
verified too. No pair is lost either way, and no key's rows all meet each other.

Counts are made in Python, a bounded dictionary at a time, and summed by Spark. A chain of forms gains a factor of at
least ten in n with each step, so a few doublings of the followed steps reach every root.

Defined results: null, empty and letterless texts have no runs; a null id is the empty text in `<doc_id>:<run>`;
repeated rows and ids count once each time they occur; an empty table gives an empty result; other columns don't
matter. Runs may be of any length.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, release, slices

POWER, CROWD, DISTINCT = 5, 64, 200_000
_LETTER = re.compile("[A-Za-zÀ-ÿ]")
#: Runs are handled as Latin-1: other characters become "?" first, then every non-letter a blank, and A-Z a-z.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if _LETTER.match(chr(c)) else 32 for c in range(256))
_VALUE = np.arange(256, dtype=np.int64) ** POWER


def misspelt(prefix: int, run: bytes) -> bytes:
    """The run, less a letter where its hash says so; prefix: crc32 of `<doc_id>:`."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(least: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return found

        for batch in batches:
            for part in slices([batch], 64):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    runs = Counter(r for r in (text or "").encode("latin-1", "replace").translate(_FOLD).split() if len(r) >= least)
                    for run, n in runs.items():
                        word = misspelt(prefix, run)
                        if len(word) >= least:
                            total[word] += n
                    if len(total) >= DISTINCT:
                        yield out()
        if total:
            yield out()

    return count


def words(docs: DataFrame, least: int = 7, often: int = 2) -> DataFrame:
    """(word, n) of at least `least` letters and `often` occurrences."""
    return docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(_counted(least), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (word, n): the whole key (letter 0) and the key less each different letter."""
    for batch in batches:
        for part in slices([batch], 4096):
            row, key, letter = [], [], []
            for i, w in enumerate(part.column(0).to_pylist()):
                codes = np.frombuffer(w.encode("latin-1"), np.uint8)
                whole = int(_VALUE[codes].sum())
                row.append(i)
                key.append(whole)
                letter.append(0)
                for c in np.unique(codes).tolist():
                    row.append(i)
                    key.append(whole - c**POWER)
                    letter.append(c)
            took = part.take(pa.array(row, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(letter, pa.int16()), took.column(0), took.column(1)], names=["key", "letter", "word", "n"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of keyed rows: for each place of the letter, the place, whether it begins a run of that letter, and a hash of the other letters."""
    for batch in batches:
        for part in slices([batch], 4096):
            row, place, first, around = [], [], [], []
            for i, (word, letter) in enumerate(zip(part.column("word").to_pylist(), part.column("letter").to_pylist(), strict=True)):
                w = word.encode("latin-1")
                at = w.find(letter) if letter else -1
                while True:
                    row.append(i)
                    place.append(at)
                    first.append(at <= 0 or w[at - 1] != letter)
                    around.append(xxhash.xxh3_64_intdigest(w[:at] + w[at + 1 :] if letter else w) - (1 << 63))
                    at = w.find(letter, at + 1) if letter else -1
                    if at < 0:
                        break
            took = part.take(pa.array(row, pa.int32()))
            yield pa.RecordBatch.from_arrays([*took.columns, pa.array(place, pa.int32()), pa.array(first, pa.bool_()), pa.array(around, pa.int64())], names=["key", "letter", "word", "n", "place", "first", "around"])


def _met(left: DataFrame, right: DataFrame, on: list[str], also: str) -> DataFrame:
    near = F.levenshtein("l.word", "r.word", 1) == 1
    return left.alias("l").join(right.alias("r"), [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on] + [F.expr(also), near]).select(F.col("l.word").alias("a"), F.col("l.n").alias("a_n"), F.col("r.word").alias("b"), F.col("r.n").alias("b_n"))


def near_pairs(counted: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words one letter apart once."""
    rows = keep(counted.select("word", "n").mapInArrow(_keyed, "key long, letter short, word string, n long"), "keys")
    crowded = rows.groupBy("key").count().where(F.col("count") > CROWD).select("key")
    few = rows.join(crowded, "key", "left_anti")
    many = keep(rows.join(crowded, "key", "left_semi").select("key", "letter", "word", "n").mapInArrow(_placed, "key long, letter short, word string, n long, place int, first boolean, around long"), "placed")
    whole, less = F.col("letter") == 0, F.col("letter") != 0
    found = _met(few.where(whole), few.where(less), ["key"], "true").union(_met(few.where(less), few.where(less), ["key"], "l.letter < r.letter"))
    found = found.union(_met(many.where(whole), many.where(less & F.col("first")), ["key", "around"], "true"))
    return found.union(_met(many.where(less), many.where(less), ["key", "place", "around"], "l.letter < r.letter"))


def _roots(forms: DataFrame, largest: int) -> DataFrame:
    """(word, root) of each word that has a form: the number of followed steps doubles until the longest possible chain is."""
    held = keep(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(math.ceil(math.log2(1 + math.log10(max(largest, 10))))):
        on = held.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = keep(held.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        release(held)
        held = after
    return held


def variants(docs: DataFrame, least: int = 7, often: int = 2, times: int = 10) -> DataFrame:
    """word, n, n_near, form, form_n, root for each word of at least `least` letters that occurs `often`.

    `form` is the near word of largest n (ties: the first in code-point order) if its n is at least `times` the word's.
    """
    counted = keep(words(docs, least, often), "words")
    pairs = near_pairs(counted)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(pairs.select("b", "a", "a_n"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best"))
    taken = -F.col("best.rank") >= F.col("n") * times
    rows = counted.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.rank")).alias("form_n"))
    rows = keep(rows, "forms")
    largest = counted.agg(F.max("n")).first()[0] or 1
    return rows.join(_roots(rows.where("form IS NOT NULL"), largest), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
