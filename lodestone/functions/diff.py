"""What turns one text into another, as edit operations, and which of them may be proposed without a look at the page."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATIONS = "array<struct<tag:string,a_start:int,a_end:int,b_start:int,b_end:int>>"
_KIND = pa.list_(pa.struct([("tag", pa.string()), *((n, pa.int32()) for n in ("a_start", "a_end", "b_start", "b_end"))]))


def edit_operations(old: Column, new: Column) -> Column:
    """OPERATIONS (equal, replace, delete, insert) by longest common blocks; null if either text is.

    Python in Arrow batches, as no expression of Spark keeps the runs of a pair; time grows with the pairs of equal
    characters, so pages or passages are compared, not books.
    """

    @F.arrow_udf(OPERATIONS)
    def edits(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        names = [f.name for f in _KIND.value_type]
        for olds, news in batches:
            pairs = zip(olds.to_pylist(), news.to_pylist(), strict=True)
            yield pa.array([None if a is None or b is None else [dict(zip(names, o, strict=True)) for o in difflib.SequenceMatcher(None, a, b, False).get_opcodes()] for a, b in pairs], _KIND)

    return edits(old, new)


def _between(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def changes(ops: Column, old: Column, new: Column, terms: list[str], sensitive: str, most: int = 4, around: int = 3) -> Column:
    """array<struct<at, end, old, new, proposed, flagged>> of all operations but the equal ones.

    An edit is proposed only if it replaces at most `most` characters by as many at most, holds nothing sensitive (a pattern), and
    stands inside a known term of the new text, at most `around` characters away from its ends. Others are flagged for a reader
    if they are longer than one character or sensitive.
    """

    def known(start: Column, end: Column) -> Column:
        first = F.greatest(start - around, F.lit(0))
        window = _between(new, first, end + around)
        at = F.lit(False)
        for term in terms:
            place = F.position(F.lit(term), window) - 1
            at = at | ((place >= 0) & (first + place <= start) & (end <= first + place + len(term)))
        return at

    def change(o: Column) -> Column:
        was, now = _between(old, o["a_start"], o["a_end"]), _between(new, o["b_start"], o["b_end"])
        risky = F.concat(was, now).rlike(sensitive)
        short = (o["tag"] == "replace") & (F.char_length(was) <= most) & (F.char_length(now) <= most)
        proposed = short & ~risky & known(o["b_start"], o["b_end"])
        flagged = ~proposed & ((F.char_length(was) > 1) | (F.char_length(now) > 1) | risky)
        return F.struct(o["a_start"].alias("at"), o["a_end"].alias("end"), was.alias("old"), now.alias("new"), proposed.alias("proposed"), flagged.alias("flagged"))

    return F.transform(F.filter(ops, lambda o: o["tag"] != "equal"), change)
