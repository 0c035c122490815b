"""Where a pattern matches: all its matches in a text, from left to right, with their places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.extract import offsets
from .text import let

#: Two characters for private use; texts that hold them lose only these, in the quote.
_OPEN, _CLOSE = "\ue000", "\ue001"


def places(text: Column, pattern: str | Column) -> Column:
    """array<struct<start, end, quote>> of the matches, places from 0, the end excluded. Empty matches don't count; null of null.

    Matches are marked by one replacement, and the pieces between marks give the places by a running sum, so time is
    linear in the text.
    """
    whole = F.concat(F.lit("("), pattern, F.lit(")")) if isinstance(pattern, Column) else F.lit(f"({pattern})")
    clean = lambda x: F.when(F.contains(x, F.lit(_OPEN)) | F.contains(x, F.lit(_CLOSE)), F.translate(x, _OPEN + _CLOSE, "  ")).otherwise(x)
    marked = F.regexp_replace(let(text, clean), whole, F.lit(f"{_OPEN}$1{_CLOSE}"))

    def place(p: Column, at: Column) -> Column:
        quote = F.substring_index(p, _CLOSE, 1)
        return F.struct((at - 1).alias("start"), (at - 1 + F.char_length(quote)).alias("end"), quote.alias("quote"))

    def placed(pieces: Column) -> Column:
        # Two characters stand before the text, and two less of each piece count: its mark, and the line end that `offsets` adds.
        starts = offsets(F.transform(pieces, lambda p: F.substring(p, F.lit(3), F.char_length(p))))
        return F.slice(F.zip_with(pieces, starts, place), F.lit(2), F.size(pieces) - 1)

    return let(F.split(F.concat(F.lit("xx"), marked), _OPEN), placed)
