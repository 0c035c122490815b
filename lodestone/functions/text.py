"""Text as column expressions: normal forms, tokens, hashes, lines, paging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "[a-z]+"
#: What ends a line where CR LF, LF, CR, VT, FF, FS, GS, RS, NEL, LS and PS all do.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def canonical_json(c: Column) -> Column:
    """JSON with sorted keys and no blanks: object keys of a variant are in order."""
    return F.to_json(F.parse_json(F.to_json(c, {"ignoreNullFields": "false"})))


def split_lines(c: Column) -> Column:
    """Lines under all line ends, without the empty one after a last end."""
    parts = F.split(c, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def tokens(c: Column, pattern: str = LETTERS) -> Column:
    if pattern == LETTERS:  # cutting at what lies between is cheaper than finding each run
        return F.array_remove(F.split(F.lower(c), "[^a-z]+"), "")
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def query_terms(c: Column, stop: list[str], most: int = 50) -> Column:
    """The first `most` distinct tokens that are no stop words, in order."""
    return F.slice(F.array_distinct(F.filter(tokens(c), lambda t: ~t.isin(stop))), 1, most)


def plain(c: Column) -> Column:
    """No markdown images, links as their label, no tags, entities of markup decoded, runs of blanks and marks as one blank."""
    c = F.regexp_replace(c, r"!\[[^\]]*\]\([^)]*\)", " ")
    c = F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1")
    c = F.regexp_replace(c, r"<[^>]*>", "")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(c, r"[\s*_`\\]+", " "))


def let(value: Column, use) -> Column:
    """use(value), the value worked out once however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalized(c: Column) -> Column:
    """Letters, digits and underscores of the plain text, in lower case."""
    return F.lower(F.regexp_replace(plain(c), r"(?U)[^\w一-鿿]", ""))


def escaped(c: Column) -> Column:
    """Markup signs as entities; bars and line ends made safe for a table cell."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("|", "\\|"), ("\n", " ")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def char_page(c: Column, offset: Column | int, size: int) -> Column:
    return F.substring(c, (offset if isinstance(offset, Column) else F.lit(offset)) + 1, F.lit(size))


def best_topic(c: Column, topics: dict[str, list[str]]) -> Column:
    """The topic with the most keywords in the text; the first of equals; null without any."""
    low = F.lower(c)
    counts = [sum((F.contains(low, F.lit(k)).cast("int") for k in keys), F.lit(0)) for keys in topics.values()]
    best = F.greatest(*counts) if len(counts) > 1 else counts[0]
    out = F.lit(None).cast("string")
    for name, n in reversed(list(zip(topics, counts))):
        out = F.when(n == best, F.lit(name)).otherwise(out)
    return F.when(best > 0, out)


def negated(c: Column, negators: list[str], terms: list[str]) -> Column:
    """Phrases of a negator and one of the terms."""
    return F.regexp_extract_all(F.lower(c), F.lit(rf"\b(?:{'|'.join(negators)}) +(?:{'|'.join(terms)})\b"), F.lit(0))


def paragraphs_within(c: Column, most: int = 1400) -> Column:
    """struct(quote, has_more): whole paragraphs while they fit; the first always stands."""
    parts = F.split(c, "\n\n")
    start = F.struct(F.lit("").alias("q"), F.lit(0).alias("n"), F.lit(True).alias("go"))

    def add(s: Column, p: Column) -> Column:
        fits = s["go"] & ((s["n"] == 0) | (F.char_length(s["q"]) + 2 + F.char_length(p) <= most))
        return F.struct(F.when(fits, F.when(s["n"] == 0, p).otherwise(F.concat(s["q"], F.lit("\n\n"), p))).otherwise(s["q"]).alias("q"), (s["n"] + fits.cast("int")).alias("n"), fits.alias("go"))

    return F.aggregate(parts, start, add, lambda s: F.struct(s["q"].alias("quote"), (s["n"] < F.size(parts)).alias("has_more")))
