"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), linear in the number of
features of a text. Words are hashed to WORD_BINS places; each statistic of the text's structure and each metadata
column falls into one of BINS steps, and the step is a feature, so that pairwise terms join words and structure.

The model is fitted on at most `bound` labelled rows (a documented parameter) and is of fixed size; every row is
scored from its whole text. Defined results: a null text is scored as an empty one; a null statistic or metadata
value has a step of its own; without labelled rows of both classes each score is 0.5.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Held, bounded_batches, labelled_sample, slices

WORD_BINS, BINS, RANK = 1 << 15, 24, 8
STATISTICS = ["chars", "words", "word_length", "upper", "digit", "sign", "space", "high", "distinct", "top_word", "lines", "line_length", "repeated_lines", "short_lines", "repeated_pairs", "sign_ends", "top_sign", "long_words"]
#: Labelled rows that the model is fitted on.
BOUND = 6000

_CLASS = np.zeros(256, np.int8)
for _c in range(256):
    _CLASS[_c] = 0 if 97 <= _c <= 122 else 1 if 65 <= _c <= 90 else 2 if 48 <= _c <= 57 else 3 if _c in b" \t\n\r\x0b\x0c" else 5 if _c >= 128 else 4


#: Word -> hashed place.
_PLACES = Held(lambda word: zlib.crc32(word.lower().encode("utf-8", "replace")) % WORD_BINS)


def _step(share: float) -> int:
    """Steps that are fine near 0 and near 1."""
    return min(BINS - 1, int(BINS * math.sqrt(min(1.0, max(0.0, share)))))


def _log_step(x: float) -> int:
    return min(BINS - 1, int(1.5 * math.log2(1 + max(0.0, x))))


def statistics(text: str, words: list[str]) -> list[int]:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    bytes_ = np.bincount(raw, minlength=256)
    kinds = np.bincount(_CLASS, weights=bytes_, minlength=6)
    n, m = max(1, len(raw)), max(1, len(words))
    seen = Counter(words)
    lines = text.split("\n")
    letters = max(1.0, kinds[0] + kinds[1])
    signs = np.where(_CLASS == 4, bytes_, 0)
    signs[[44, 46]] = 0  # commas and full stops belong to prose
    return [
        _log_step(len(text)), _log_step(len(words)), min(BINS - 1, int(2 * len(text) / m)), _step(kinds[1] / letters), _step(kinds[2] / n), _step(kinds[4] / n), _step(kinds[3] / n), _step(kinds[5] / n),
        _step(len(seen) / m), _step(max(seen.values(), default=0) / m), _log_step(len(lines)), _log_step(len(text) / len(lines)), _step(1 - len(set(lines)) / len(lines)), _step(sum(len(x) < 30 for x in lines) / len(lines)),
        _step(1 - len(set(zip(words, words[1:]))) / max(1, m - 1)) if len(words) > 1 else 0, _step(sum(not w[-1].isalnum() for w in words) / m), _step(signs.max() / n), _step(sum(len(w) > 25 for w in words) / m),
    ]


def features(text: str | None, meta: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's features; words together have length 1, each statistic and metadata value 1/4."""
    text = text or ""
    words = text.split()
    at = np.fromiter(map(_PLACES.__getitem__, words), np.int64, len(words))
    places, n = np.unique(at, return_counts=True)
    x = np.log1p(n)
    x /= max(1e-9, math.sqrt(float(x @ x)))
    steps = statistics(text, words) + [BINS - 1 if v is None or v != v else min(BINS - 2, _log_step(float(v))) for v in meta]
    return np.concatenate([places, WORD_BINS + BINS * np.arange(len(steps)) + steps]), np.concatenate([x, np.full(len(steps), 0.25)])


class Machine:
    """w0, w and v of the factorisation machine."""

    def __init__(self, size: int, rank: int = RANK, seed: int = 7):
        self.w0, self.w = 0.0, np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (size, rank))

    def margins(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins of rows whose features begin at starts, and the sums over v that the gradient needs."""
        vx = self.v[at] * x[:, None]
        sums = np.add.reduceat(vx, starts)
        squares = np.add.reduceat((vx * vx).sum(1), starts)
        return self.w0 + np.add.reduceat(self.w[at] * x, starts) + 0.5 * ((sums * sums).sum(1) - squares), sums

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 12, batch: int = 128, rate: float = 0.15, decay: float = 1e-5, seed: int = 7) -> None:
        """Adagrad on the logistic loss, both classes with the same weight."""
        y = np.array([r[2] for r in rows], float)
        weight = np.where(y > 0, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))
        gw, gv, g0 = np.full(len(self.w), 1e-4), np.full(self.v.shape, 1e-4), 1e-4
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for i in range(0, len(rows), batch):
                pick = order[i : i + batch]
                at, x = np.concatenate([rows[j][0] for j in pick]), np.concatenate([rows[j][1] for j in pick])
                sizes = np.array([len(rows[j][0]) for j in pick])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                z, sums = self.margins(at, x, starts)
                d = np.repeat((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) * weight[pick] / len(pick), sizes)
                own, back = np.unique(at, return_inverse=True)
                dw = np.bincount(back, d * x, len(own)) + decay * self.w[own]
                each = (d * x)[:, None] * (np.repeat(sums, sizes, 0) - self.v[at] * x[:, None])
                dv = np.stack([np.bincount(back, each[:, f], len(own)) for f in range(each.shape[1])], 1) + decay * self.v[own]
                gw[own] += dw * dw
                gv[own] += dv * dv
                self.w[own] -= rate * dw / np.sqrt(gw[own])
                self.v[own] -= 0.3 * rate * dv / np.sqrt(gv[own])
                d0 = float((d[starts]).sum())
                g0 += d0 * d0
                self.w0 -= rate * d0 / math.sqrt(g0)

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        z, _ = self.margins(at, x, np.zeros(1, np.int64))
        return float(1 / (1 + np.exp(-np.clip(z[0], -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, label: str, held_out_mod: int, held_out: int, meta: tuple[str, ...] = (), bound: int = BOUND) -> Machine | None:
    """A machine fitted on at most `bound` rows outside the held-out fold; None without both classes."""
    texts = docs.select("doc_id", F.struct("text", *meta).alias("text"))
    sample = labelled_sample(texts, labels, label, held_out_mod, held_out, bound)

    @F.arrow_udf("at array<int>, x array<double>")
    def featured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in slices(batches):
            out = []
            for t in batch.to_pylist():
                at, x = features(t["text"], tuple(t[m] for m in meta))
                out.append({"at": at, "x": x})
            yield pa.array(out, pa.struct([("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float64()))]))

    got = sample.select("_id", "y", featured("text").alias("f")).orderBy("_id").toPandas()
    rows = [(np.asarray(f["at"], np.int64), np.asarray(f["x"], float), int(y)) for f, y in zip(got.f, got.y)]
    if len({r[2] for r in rows}) < 2:
        return None
    machine = Machine(WORD_BINS + BINS * (len(STATISTICS) + len(meta)))
    machine.fit(rows)
    return machine


def score(docs: DataFrame, machine: Machine | None, meta: tuple[str, ...] = (), out: str = "score") -> DataFrame:
    """docs and a column `out`: the probability of label 1."""
    if machine is None:
        return docs.withColumn(out, F.lit(0.5))
    held = docs.sparkSession.sparkContext.broadcast(machine)  # of fixed size
    bounded_batches(docs)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = held.value
        for batch in slices(batches):
            yield pa.array([m.score(*features(x["text"], tuple(x[k] for k in meta))) for x in batch.to_pylist()], pa.float64())

    return docs.withColumn(out, scored(F.struct("text", *meta)))
