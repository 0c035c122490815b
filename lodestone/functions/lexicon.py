"""Tokens of texts in the corpus's own language: plain text, negations, dictionary words, compounds, aliases, query terms.

What words there are is the caller's: a Lexicon is made of tables of any size that fits a worker.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .segment import Dictionary

# Negators, words that questions are made of and that mean nothing in a search.
NEGATORS = "没有 并未 并不 不是 并非 不能 不会 未曾 不曾 不 未 无".split()
STOP = "的 了 是 在 我 你 他 她 这个 一下 怎么 什么 如何 是否 能否 请 帮 用 看 想 要 能 不能 吗 有 没有".split()
#: Weight of a domain term among the dictionary's frequencies; sign of a literal negation; most terms of a query.
TERM_WEIGHT, NOT, QUERY_TERMS = 100_000, "未", 50

_IMAGE, _LINK, _TAG = re.compile(r"!\[[^\]]*\]\([^)]*\)"), re.compile(r"\[([^\]]+)\]\([^)]*\)"), re.compile(r"<[^>]+>")
_BLANKS, _WORD = re.compile(r"[\s*_`\\]+"), re.compile(r"[\w一-鿿]+")


def plain(text: str | None) -> str:
    """No images, links as labels, tags as blanks, all character references decoded, blanks and marks as one blank."""
    text = _LINK.sub(r"\1", _IMAGE.sub(" ", text or ""))
    return _BLANKS.sub(" ", html.unescape(_TAG.sub(" ", text))).strip()


@dataclass
class Lexicon:
    """terms: domain words; aliases: word to canonical word; technical: words whose negation is a term of its own."""

    terms: list[str]
    aliases: dict[str, str] = field(default_factory=dict)
    technical: list[str] = field(default_factory=list)
    frequencies: dict[str, int] = field(default_factory=dict)
    stop: list[str] = field(default_factory=lambda: STOP)

    @cached_property
    def _vocabulary(self) -> list[str]:
        return list(dict.fromkeys([*self.terms, *self.aliases, *self.aliases.values()]))

    @cached_property
    def _dictionary(self) -> Dictionary:
        return Dictionary(self.frequencies | dict.fromkeys(self._vocabulary, TERM_WEIGHT))

    @cached_property
    def _negation(self) -> re.Pattern | None:
        longest = sorted(NEGATORS, key=len, reverse=True)
        return re.compile(f"(?:{'|'.join(longest)})({'|'.join(map(re.escape, self.technical))})") if self.technical else None

    def negations(self, text: str | None) -> list[str]:
        return [m[0] for m in self._negation.finditer(plain(text))] if self._negation else []

    def tokens(self, text: str | None) -> list[str]:
        """Words in order, then terms inside the text that are no word yet, literal negations, and aliases of all of them.

        A negated technical word is no positive word: it is the phrase itself and the sign of negation with the word.
        """
        text = plain(text)
        negated = list(self._negation.finditer(text)) if self._negation else []
        positive = self._negation.sub(" ", text) if negated else text
        words = [w for part in positive.split() for w in self._dictionary.cut(part) if _WORD.fullmatch(w)]
        own = set(words)
        words += [t for t in self._vocabulary if t not in own and t in positive]
        words += [x for m in negated for x in (m[0], NOT + m[1])]
        return words + [self.aliases[w] for w in words if self.aliases.get(w, w) != w]

    def query_terms(self, text: str | None) -> list[str]:
        return list(dict.fromkeys(t for t in self.tokens(text) if t not in self.stop))[:QUERY_TERMS]


def tokenized(text: Column, lexicon: Lexicon) -> Column:
    """array<string> of a text's tokens; none of a null one."""

    @F.arrow_udf("array<string>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([lexicon.tokens(t) for t in batch.to_pylist()], pa.list_(pa.string()))

    return cut(text)


def plain_text(text: Column) -> Column:
    @F.arrow_udf("string")
    def cleaned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if t is None else plain(t) for t in batch.to_pylist()], pa.string())

    return cleaned(text)


def bisected(text: str, count, most: int, query: str = "") -> list[tuple[int, int]]:
    """(start, end) of windows that cover the text, each of at most `most` tokens: halves, each with a part of the other.

    Left before right; an error if a window can't be small enough (`most` under 8, a long query, pieces under 8 characters).
    """
    if most < 8 or (query and count(query) >= most):
        raise ValueError("windows are too small for the text or the query")
    out, todo = [], [(0, len(text))]
    while todo:
        start, end = todo.pop()
        if count(query) * bool(query) + count(text[start:end]) <= most:
            out.append((start, end))
            continue
        if end - start < 8:
            raise ValueError("a piece of a few characters is more than a window")
        middle, more = (start + end) // 2, min(40, (end - start) // 8)
        todo += [(middle - more, end), (start, middle + more)]
    return out


def text_windows(text: Column, count, most: int) -> Column:
    """array<struct<start, end>> under a function that counts a text's tokens."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            yield pa.array([None if t is None else [{"start": a, "end": b} for a, b in bisected(t, count, most)] for t in batch.to_pylist()], kind)

    return cut(text)


def case_text(question: Column, features: dict[str, Column], facts: Column) -> Column:
    """What a case is searched by: its question, labelled features as JSON, and facts of its chart; never conclusions or outcomes."""
    labelled = [F.when(v.isNotNull(), F.concat(F.lit(f"{label}："), v)) for label, v in features.items()]
    return F.concat_ws("\n", F.coalesce(question, F.lit("")), *labelled, F.array_join(facts, "\n"))


def document_text(kind: Column, chapter: Column, text: Column, contexts: Column, case: Column) -> Column:
    """What an embedding is made of: chapter, text and contexts of a rule; the search text of a case."""
    return F.when(kind == "case", case).otherwise(F.concat_ws("\n", chapter, text, F.array_join(contexts, "\n")))


def navigation_text(titles: Column, hints: Column) -> Column:
    return F.concat_ws(" ", F.array_join(titles, " "), F.nullif(F.array_join(hints, " "), F.lit("")))
