"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark texts.

A window is 13 consecutive words of an item; an item of fewer words, but not none, is one window. The automaton
holds every window as a sequence of word numbers; a document, folded to its words in the same way, is scanned once.
A document's word inside an occurrence of a window is hit. Word numbers are mapped to places of the original text.

A benchmark of more than BLOCK_WORDS words becomes several automata. A worker keeps HELD of them; where there are
more, it takes documents of GATHERED characters at a time to each automaton in turn, so that making one is shared by
many documents and memory stays bounded. Blocks are read one after another and broadcast, each of bounded size.

Defined results: a null or empty text has no words, no hit, and is not contaminated; null and empty item texts have no
window; windows of an item without id hit, but it stands in no list; repeated items and repeated item ids count once; an empty benchmark contaminates nothing; repeated rows are
marked alike; no documents give no rows; a column named as `out` is replaced, all others are kept.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, bounded_batches, slices, word_bytes

WINDOW = 13
#: Words of benchmark text in one automaton (some 50 bytes for each of its at most 13 x so many nodes); automata that a
#: worker holds; characters of documents that it takes through all automata together if there are more.
BLOCK_WORDS, HELD, GATHERED = 60_000, 3, 4_000_000

_KIND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_TYPE = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
_WORKER: OrderedDict = OrderedDict()


class Machine:
    """The automaton of some items: windows as sequences of word numbers, 0 for words that no item has."""

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        held: dict[tuple, dict] = {}
        for item, text in items:
            own = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in word_bytes(text))
            for i in range(max(1, len(own) - size + 1) if own else 0):
                held.setdefault(own[i : i + size], {})[item] = None
        self.found, self.least = None, min(map(len, held), default=1)
        if held:
            self.found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for window, ids in held.items():
                self.found.add_word(window, (len(window), tuple(ids)))
            self.found.make_automaton()

    def scan(self, words: list[bytes], hits: set, items: set) -> None:
        """Adds the word ranges that windows occupy, and the ids of their items."""
        if not self.found or not words:
            return
        numbers = np.fromiter(map(self.numbers.get, words, repeat(0)), np.int64, len(words))
        # At a word that no item has the automaton is at its root again: only runs of known words are walked.
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (numbers > 0).view(np.int8), [0]])))
        starts, ends = edge[::2], edge[1::2]
        long_ = ends - starts >= self.least
        for a, b in zip(starts[long_].tolist(), ends[long_].tolist()):
            for end, (n, ids) in self.found.iter(tuple(numbers[a:b].tolist())):
                hits.add((a + end - n + 1, a + end + 1))
                items.update(ids)


def _spans(text: str, hit: np.ndarray) -> list[dict]:
    """Places in the original of each run of hit words."""
    at = [m.span() for m in WORD.finditer(text)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in zip(edge[::2], edge[1::2])]


def _gathered(batches: Iterator[pa.Array], chars: int) -> Iterator[list[str | None]]:
    """Texts of the batches, in parts of at least so many characters but the last."""
    held, size = [], 0
    for batch in slices(batches):
        held += batch.to_pylist()
        size += batch.nbytes
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def _scanner(blocks: list, size: int, held: int, gathered: int):
    key = uuid.uuid4().hex

    def machine(i: int) -> Machine:
        name = (key, i)
        if name not in _WORKER:
            while len(_WORKER) >= held:
                _WORKER.popitem(last=False)
            _WORKER[name] = Machine(blocks[i].value, size)
        return _WORKER[name]

    @F.arrow_udf(_TYPE)
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in _gathered(batches, 1 if len(blocks) <= held else gathered):
            words, found = [word_bytes(text) for text in texts], [(set(), set()) for _ in texts]
            for i in range(len(blocks)):
                own = machine(i)
                for w, x in zip(words, found):
                    own.scan(w, *x)
            out = []
            for text, w, (ranges, items) in zip(texts, words, found):
                n, spans, marked = len(w), [], 0
                if ranges:
                    hit = np.zeros(n, bool)
                    for a, b in ranges:
                        hit[a:b] = True
                    spans, marked = _spans(text, hit), int(hit.sum())
                out.append({"n_words": n, "n_hit": marked, "items": sorted(items - {None}), "spans": spans})
            yield pa.array(out, _KIND)

    return hits


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, out: str = "contamination", block_words: int = BLOCK_WORDS, held: int = HELD, gathered: int = GATHERED) -> DataFrame:
    """docs and a struct column `out`: n_words, n_hit, items (sorted as strings), spans of the original, contaminated."""
    sc = docs.sparkSession.sparkContext
    blocks, own, n = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("t is not null").distinct()
    for x in rows.toLocalIterator():
        words = len(word_bytes(x.t))
        if own and n + words > block_words:
            blocks.append(sc.broadcast(own))
            own, n = [], 0
        own.append((x.i, x.t))
        n += words
    blocks.append(sc.broadcast(own))
    bounded_batches(docs)
    marked = docs.withColumn(out, _scanner(blocks, size, held, gathered)(F.col("text")))
    c = F.col(out)
    return marked.withColumn(out, c.withField("contaminated", (c.n_hit > 0) & (20 * c.n_hit >= c.n_words)))
