"""Toxic passages by maximum-scoring segments.

Learning: in labelled texts (at most `bound` of them, near copies once) each word, and each word's first four and
first five letters, get a log-odds ratio of toxic against clean texts under a Dirichlet prior that follows the
words' overall shares, with its variance. What stands out (by z and by the ratio itself) forms a lexicon; other words cost a fixed drift.
Scoring: one linear scan finds all maximal scoring segments of the sequence of word scores. Segments are rated by
extreme-value statistics: with the background's lambda (sum p_i exp(lambda s_i) = 1), a segment of score S in a text
of n words has the normalised score lambda S - ln(K n), and the best r of them together the sum statistic of that
theory. A logistic curve, fitted on texts that gave no counts, turns it into a probability.

Defined results: a null or empty text has no segment and gets the score of a text without any; without labelled
rows of both classes all scores are 0; where the quarter kept for the curve lacks a class, a fixed curve stands for
it, under which a text without segments is clean. Labels of null id or value don't count. Repeated rows score alike; a
text of any length is scored whole; a column named as `out` is replaced, all others are kept; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Held, bounded_batches, labelled_sample, release, slices, words

#: Labelled rows that are learnt from; least z and least log-odds ratio (and log ratio of shares) of the lexicon; weight of the prior, as a share of the texts; cost of a word outside the lexicon.
BOUND, Z, ODDS, PRIOR, DRIFT = 20_000, 4.0, 2.0, 1 / 30, 0.15
#: Share of clean texts at whose tail K is estimated.
TAIL = 0.003
#: A text's marks: its words and these numbers of first letters.
PREFIXES = (5, 4)


def marks(text: str | None) -> set[str]:
    own = set(words(text))
    return own | {f"{w[:n]}*" for n in PREFIXES for w in own if len(w) > n}


def _print_of(text: str | None) -> bytes:
    """Smallest hash of the text's runs of three words: equal for most near copies."""
    w = words(text)
    runs = {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
    return min(hashlib.blake2b(r.encode(), digest_size=8).digest() for r in runs)


class Lexicon:
    """Scores of marks, the background's lambda and K, and the logistic curve."""

    def __init__(self, scores: dict[str, float], drift: float = DRIFT):
        self.scores, self.drift = scores, drift
        # Until they are fitted: a usual K, and a curve that takes a text without segments for clean.
        self.lam, self.k, self.a, self.b = 1.0, 0.1, 2.0, -3.0

    def word(self, w: str) -> float:
        for mark in (w, *(f"{w[:n]}*" for n in PREFIXES if len(w) > n)):
            if (s := self.scores.get(mark)) is not None:
                return s
        return -self.drift

    def calibrate(self, clean: list[np.ndarray]) -> None:
        """lambda and K from the word scores of clean texts.

        lambda by bisection on their mixture. Under the theory a text's best segment reaches x = lambda S - ln n with
        probability 1 - exp(-K exp(-x)); K is read off at the value that TAIL of the clean texts reach,
        and is no less than its usual order, 0.1, as few clean texts have words of the lexicon.
        """
        s = np.concatenate([*clean, np.array([max(self.scores.values(), default=1.0), -self.drift])])
        values, n = np.unique(np.round(s, 3), return_counts=True)
        p = n / n.sum()
        lo, hi = 0.0, 8.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if float(p @ np.exp(mid * values)) < 1 else (lo, mid)
        self.lam = max(lo, 0.05)
        best = [self.lam * max((x[2] for x in segments(s)), default=0.0) - math.log(max(10, len(s))) for s in clean]
        if best:
            self.k = min(1e3, max(0.1, -math.log(1 - TAIL) * math.exp(float(np.quantile(best, 1 - TAIL)))))

    def statistic(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """Sum statistic of extreme-value theory: largest over r of the r best normalised scores and ln r!; 0 if none."""
        best, total = 0.0, 0.0
        for r, s in enumerate(sorted((self.lam * x[2] for x in segments), reverse=True), 1):
            total += s - math.log(self.k * max(n, 10))
            best = max(best, total + math.lgamma(r + 1))
        return best

    def fit_curve(self, x: np.ndarray, y: np.ndarray) -> None:
        """Newton steps of a logistic regression with a small ridge."""
        x = np.log1p(x)
        a = b = 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * x + b)))
            w = p * (1 - p) + 1e-9
            g = np.array([((p - y) * x).sum() + 0.1 * a, (p - y).sum() + 0.1 * b])
            h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
            da, db = np.linalg.solve(h, g)
            a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
        self.a, self.b = float(max(a, 0.0)), float(b)

    def probability(self, x: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.a * math.log1p(x) + self.b))))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in order; linear in the number of scores.

    Each candidate holds the sum left of it and up to its end. A new one looks back for the last candidate with a
    smaller left sum; if that one's right sum is smaller too, both and what lies between merge and look back again.
    Only places where the sign changes are visited.
    """
    positive = scores > 0
    if not positive.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], positive.view(np.int8), [0]])))
    total = np.concatenate([[0.0], np.cumsum(scores)])
    held: list[tuple[int, int, float, float, int]] = []  # start, end, left sum, right sum, number of the candidate to look back to
    for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
        left, right = float(total[start]), float(total[end])
        j = len(held) - 1
        while True:
            while j >= 0 and held[j][2] >= left:
                j = held[j][4]
            if j < 0 or held[j][3] >= right:
                held.append((start, end, left, right, j))
                break
            start, left = held[j][0], held[j][2]
            back = held[j][4]
            del held[j:]
            j = back
    return [(s, e, r - l) for s, e, l, r, _ in held]


def _scores(held: Held, text: str | None) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(held.__getitem__, found), float, len(found))


def fit(docs: DataFrame, labels: DataFrame, label: str, held_out_mod: int, held_out: int, bound: int = BOUND) -> Lexicon | None:
    """A lexicon from at most `bound` labelled texts outside the held-out fold; None without both classes."""
    sample = labelled_sample(docs, labels, label, held_out_mod, held_out, bound)

    @F.arrow_udf("print binary, marks array<string>")
    def marked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("print", pa.binary()), ("marks", pa.list_(pa.string()))])
        for batch in slices(batches):
            yield pa.array([{"print": _print_of(t), "marks": list(marks(t))} for t in batch.to_pylist()], kind)

    # Three quarters of the texts give counts, one quarter the curve; of texts with one print, one counts.
    counting = F.crc32(F.concat(F.lit("curve"), F.col("_id").cast("string")).cast("binary")) % 4 != 0
    own = sample.where(counting).select("_id", "y", marked("text").alias("m")).select("_id", "y", "m.*")
    firsts = own.groupBy("print", "y").agg(F.min_by("marks", "_id").alias("marks"))
    n = {x.y: x.n for x in firsts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not (n.get(0) and n.get(1)):
        release(sample)
        return None
    counts = firsts.select("y", F.explode("marks").alias("mark")).groupBy("mark").agg(F.sum("y").alias("y1"), F.sum(1 - F.col("y")).alias("y0"))
    share = (F.col("y1") + F.col("y0")) / float(n[0] + n[1])
    prior = PRIOR * (n[0] + n[1])
    a, b = F.col("y1") + prior * share, F.col("y0") + prior * share
    delta = F.log(a / (n[1] + prior - a)) - F.log(b / (n[0] + prior - b))
    z = delta / F.sqrt(1 / a + 1 / b)
    # Where most texts hold a mark, odds rise without bound and shares don't: both must stand out.
    ratio = F.log(a / (n[1] + prior)) - F.log(b / (n[0] + prior))
    # Each entry stands in several of the bounded texts, so the lexicon is bounded too.
    kept = counts.where(F.col("y1") >= 4).select("mark", F.least(delta, F.lit(9.0)).alias("score")).where((z >= Z) & (delta >= ODDS) & (ratio >= ODDS)).toPandas()
    lexicon = Lexicon(dict(zip(kept.mark, kept.score.astype(float))))
    held = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.arrow_udf("n int, hits array<double>, at array<int>")
    def lined(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = Held(held.value.word)
        kind = pa.struct([("n", pa.int32()), ("hits", pa.list_(pa.float64())), ("at", pa.list_(pa.int32()))])
        for batch in slices(batches):
            out = []
            for t in batch.to_pylist():
                s = _scores(cache, t)
                at = np.flatnonzero(s > 0)
                out.append({"n": len(s), "hits": s[at], "at": at})
            yield pa.array(out, kind)

    rest = sample.where(~counting).select("_id", "y", lined("text").alias("l")).orderBy("_id").toPandas()
    release(sample)
    if rest.y.nunique() < 2:
        return lexicon
    # The background must lose: the drift is at least twice what lexicon words gain for each other word of clean texts.
    hits, others = (sum(f(x) for x, v in zip(rest.l, rest.y) if not v) for f in (lambda x: float(np.sum(x["hits"])), lambda x: x["n"] - len(x["at"])))
    lexicon.drift = max(lexicon.drift, 2 * hits / max(1, others))
    rows = []
    for x in rest.l:
        s = np.full(x["n"], -lexicon.drift)
        s[np.asarray(x["at"], int)] = x["hits"]
        rows.append(s)
    y = rest.y.to_numpy(float)
    lexicon.calibrate([s for s, v in zip(rows, y) if not v])
    lexicon.fit_curve(np.array([lexicon.statistic(segments(s), len(s)) for s in rows]), y)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon | None, out: str = "toxicity") -> DataFrame:
    """docs and a struct column `out`: score, and the segments (first word, word after the last, score)."""
    kind = "score double, segments array<struct<start:int,end:int,score:double>>"
    if lexicon is None:
        return docs.withColumn(out, F.from_json(F.lit('{"score": 0.0, "segments": []}'), kind))
    held = docs.sparkSession.sparkContext.broadcast(lexicon)
    bounded_batches(docs)

    @F.arrow_udf(kind)
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = held.value
        cache = Held(own.word)
        arrow = pa.struct([("score", pa.float64()), ("segments", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))])
        for batch in slices(batches):
            rows = []
            for t in batch.to_pylist():
                s = _scores(cache, t)
                found = segments(s)
                rows.append({"score": own.probability(own.statistic(found, len(s))), "segments": [{"start": a, "end": b, "score": v} for a, b, v in found]})
            yield pa.array(rows, arrow)

    return docs.withColumn(out, scored(F.col("text")))
