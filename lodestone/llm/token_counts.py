"""Token counts of a unigram tokenizer without its tokens: count-only Viterbi.

An Aho-Corasick automaton over the vocabulary enumerates all pieces that end at a character; dynamic programming
carries the best score and the number of pieces. The rules of ties are those of the exact tokenizer
(`tokenizers.models.Unigram` with byte fallback): of equal scores the earlier start, so the longer last piece,
stands; a character that no piece covers costs 10 less than the smallest score and counts one for each UTF-8 byte.
No piece goes on past a space that follows something else, and none holds a character that stands in no piece, so
stretches between those places are counted once and kept by their text.

Defined results: a null or empty text has 0 tokens and score 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import Held, slices

SPACE = "▁"
#: By how much an unknown character scores less than the smallest score of the vocabulary.
UNKNOWN = 10.0


def vocabulary(model_path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file; control pieces and bytes are kept, as ids count."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.vocab_size())]


class Counter:
    """(tokens, score) of a text."""

    def __init__(self, vocab: list[tuple[str, float]]):
        import ahocorasick

        machine = self.machine = ahocorasick.Automaton()
        for piece, score in vocab:
            machine.add_word(piece, (len(piece), score))
        machine.make_automaton()
        if not {f"<0x{b:02X}>" for b in range(256)} <= {p for p, _ in vocab}:
            raise ValueError("the vocabulary has no piece for each byte")
        self.singles = {p for p, _ in vocab if len(p) == 1}
        self.unknown = min(s for _, s in vocab) - UNKNOWN
        known = set("".join(p for p, _ in vocab))
        inner = any(SPACE in p.lstrip(SPACE) for p, _ in vocab)
        # Cut before each run of spaces, and at line ends where no piece holds one.
        pieces = r"[^\n]+|\n" if "\n" not in known else r"(?s:.+)"
        if not inner:
            pieces = rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if "\n" not in known else rf"{SPACE}*[^{SPACE}]+|{SPACE}+"
        self.cut = re.compile(pieces)
        self.held = Held(self.viterbi)

    def viterbi(self, chunk: str) -> tuple[int, float]:
        if not self.singles.issuperset(chunk):
            return self.viterbi_unknown(chunk)
        # Each character ends a piece, and of one end the automaton gives the longest, so the earliest start, first.
        score, count, last = [0.0], [0], -1
        for end, (length, own) in self.machine.iter(chunk):
            if end != last:
                last = end
                best = score[-length] + own
                count.append(count[-length] + 1)
                score.append(best)
            else:
                total = score[~length] + own
                if total > best:
                    score[-1] = best = total
                    count[-1] = count[~length] + 1
        return count[-1], score[-1]

    def viterbi_unknown(self, chunk: str) -> tuple[int, float]:
        """Any chunk; characters that are no piece of their own may stand as bytes."""
        n = len(chunk)
        score: list[float] = [0.0] + [0.0] * n
        count = [0] * (n + 1)
        ends: list[list] = [[] for _ in range(n)]
        single = [False] * n
        for end, hit in self.machine.iter(chunk):
            ends[end].append(hit)
            single[end] |= hit[0] == 1
        for end in range(n):
            best = None
            hits = ends[end]
            if not single[end]:
                hits = [*hits, (1, self.unknown)]
            for length, own in sorted(hits, reverse=True):  # earlier starts come first
                total = score[end + 1 - length] + own
                if best is None or total > best:
                    best = total
                    more = 1 if length > 1 or single[end] else len(chunk[end].encode("utf-8", "replace"))
                    number = count[end + 1 - length] + more
            score[end + 1], count[end + 1] = best, number
        return count[n], score[n]

    def __call__(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        found = [*map(self.held.__getitem__, self.cut.findall(SPACE + text.replace(" ", SPACE)))]
        return sum(x[0] for x in found), float(sum(x[1] for x in found))


_WORKER: dict[str, Counter] = {}


def token_counts(text: Column, model_path: str) -> Column:
    """struct<n_tokens: long, score: double> of each whole text."""
    kind = pa.struct([("n_tokens", pa.int64()), ("score", pa.float64())])

    @F.arrow_udf("n_tokens long, score double")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = _WORKER.get(model_path) or _WORKER.setdefault(model_path, Counter(vocabulary(model_path)))
        for batch in slices(batches):
            got = [held(t) for t in batch.to_pylist()]
            yield pa.array([{"n_tokens": n, "score": s} for n, s in got], kind)

    return count(text)
