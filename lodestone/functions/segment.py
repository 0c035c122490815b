"""Dictionary segmentation and text similarity that column expressions can't say."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Dictionary:
    """Segmentation by the most probable path over a word graph; unknown characters stand alone, runs of letters together."""

    def __init__(self, frequencies: dict[str, int]):
        total = math.log(max(1, sum(frequencies.values())))
        self.score = {w: math.log(max(1, n)) - total for w, n in frequencies.items()}
        self.longest = max(map(len, frequencies), default=1)
        self.unknown = -total

    def cut(self, text: str) -> list[str]:
        n, best, to = len(text), [0.0] * (len(text) + 1), [0] * (len(text) + 1)
        for i in range(n - 1, -1, -1):
            options = [(self.unknown + best[i + 1], i + 1)]
            if text[i].isascii() and text[i].isalnum():
                j = i
                while j < n and text[j].isascii() and text[j].isalnum():
                    j += 1
                options.append((self.unknown + best[j], j))
            options += [(self.score[text[i:j]] + best[j], j) for j in range(i + 1, min(n, i + self.longest) + 1) if text[i:j] in self.score]
            best[i], to[i] = max(options)
        out, i = [], 0
        while i < n:
            out.append(text[i : to[i]])
            i = to[i]
        return [w.lower() for w in out if any(c.isalnum() or c == "_" for c in w)]


def segmented(text: Column, frequencies: dict[str, int]) -> Column:
    """Words of a text under a dictionary of fixed size."""

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Dictionary(frequencies)
        for batch in batches:
            yield batch.map(lambda t: own.cut(t) if t else [])

    return cut(text)


def expanded(tokens: Column, terms: list[str], aliases: dict[str, str]) -> Column:
    """Tokens, then terms that stand inside their text and aren't tokens yet, then the alias of each token that has one.

    tokens is a column of a table, not the segmentation itself: Python functions have no place in lambdas.
    """
    joined = F.array_join(tokens, "")
    inner = F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(joined, t) & ~F.array_contains(tokens, t))
    own = F.concat(tokens, inner)
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair)) if aliases else F.create_map()
    return F.concat(own, F.filter(F.transform(own, lambda t: table[t]), lambda x: x.isNotNull())) if aliases else own


def ratio(a: Column, b: Column) -> Column:
    """Similarity by matching blocks (Ratcliff and Obershelp), 0 to 1; null if a side is."""

    @F.pandas_udf("double")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p, q, autojunk=False).ratio() for p, q in zip(x, y)], dtype="float64")

    return similar(a, b)
