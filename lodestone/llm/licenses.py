"""License detection with ordered signature rules, in DataFrame expressions only.

A text is folded to its words with one space between them. Rules are regexes over the folded text, built for each
license of a table from templates (identifier tags, grants, versioned names, plain mentions); each has a keyword, and
only texts that hold one of the keywords meet any regex, and there only the rules whose keyword they hold. Of
overlapping detections an interval goes if one of better priority, or an equal or longer one of the same, contains
it. What is left gives the labels; base phrases are counted at all places and always keep their label.

Defined results: a null text is an empty one: no words, no places, null first and last word, no labels, score 0;
repeated rows are marked alike; no rows give none; input columns named as one of ours (COLUMNS) are replaced, all others
kept. A text is scanned whole, whatever its length, in time that grows with it and its matches.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.places import places

# Phrases that the contract counts, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# License families by keyword: label, names as regexes over folded words, and versions.
FAMILIES = [
    ("apache", "apache", ["apache(?: software)? license", "apache"], ["1 0", "1 1", "2 0", "2"]),
    ("mit", "mit", ["mit license", "mit"], []),
    ("gpl", "gpl", ["gpl", "gnu gpl"], ["1", "1 0", "2", "2 0", "3", "3 0"]),
    ("gplv2", "gpl", ["gplv2"], []),
    ("gplv3", "gpl", ["gplv3"], []),
    ("general", "gpl", ["(?:gnu )?general public license"], ["1", "1 0", "2", "2 0", "3", "3 0"]),
    ("lgpl", "lgpl", ["lgpl", "gnu lgpl"], ["2", "2 0", "2 1", "3", "3 0"]),
    ("lesser", "lgpl", ["(?:gnu )?lesser general public license"], ["2 1", "3", "3 0"]),
    ("library", "lgpl", ["(?:gnu )?library general public license"], ["2", "2 0"]),
    ("affero", "agpl", ["(?:gnu )?affero general public license"], ["1", "1 0", "3", "3 0"]),
    ("agpl", "agpl", ["agpl", "gnu agpl"], ["1 0", "3", "3 0"]),
    ("documentation", "gfdl", ["(?:gnu )?free documentation license"], ["1 1", "1 2", "1 3"]),
    ("bsd", "bsd", ["bsd license", "bsd"], ["1 clause", "2 clause", "3 clause", "4 clause", "zero clause"]),
    ("mozilla", "mpl", ["mozilla public license"], ["1 0", "1 1", "2 0"]),
    ("mpl", "mpl", ["mpl"], ["1 0", "1 1", "2 0"]),
    ("eclipse", "epl", ["eclipse public license"], ["1 0", "2 0"]),
    ("epl", "epl", ["epl"], ["1 0", "2 0"]),
    ("cddl", "cddl", ["cddl", "common development and distribution license"], ["1 0", "1 1"]),
    ("cc", "cc", ["cc by", "cc by sa", "cc by nd", "cc by nc", "cc by nc sa", "cc by nc nd"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("creative", "cc", ["creative commons(?: attribution)?(?: noncommercial| non commercial)?(?: sharealike| share alike| noderivatives| noderivs)?"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc0", "cc0", ["cc0"], ["1 0"]),
    ("isc", "isc", ["isc license", "isc"], []),
    ("zlib", "zlib", ["zlib license", "zlib"], []),
    ("boost", "bsl", ["boost software license"], ["1 0"]),
    ("unlicense", "unlicense", ["unlicense"], []),
    ("wtfpl", "wtfpl", ["wtfpl", "do what the fuck you want to public license"], ["2"]),
    ("artistic", "artistic", ["artistic license"], ["1 0", "2 0"]),
    ("postgresql", "postgresql", ["postgresql license"], []),
    ("python", "psf", ["python software foundation license", "psf license"], ["2"]),
    ("european", "eupl", ["european union public licen[cs]e"], ["1 0", "1 1", "1 2"]),
    ("eupl", "eupl", ["eupl"], ["1 0", "1 1", "1 2"]),
    ("openssl", "openssl", ["openssl license"], []),
    ("sil", "ofl", ["sil open font license"], ["1 0", "1 1"]),
    ("ofl", "ofl", ["ofl"], ["1 0", "1 1"]),
    ("proprietary", "proprietary", ["proprietary(?: and confidential)?"], []),
    ("reserved", "copyright", ["all rights reserved"], []),
]

_V = "(?: |v| v| version | ver )"
#: Priority (1 is the best), template, weight. {n}: a name of the license; {v}: one of its versions.
TEMPLATES = [
    (1, "spdx license identifier {n}(?: {v})?(?: only| or later)?", 0.99),
    (2, "(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?{n}(?: license)?" + "{w}", 0.97),
    (3, "{n}(?: license)?{w}(?: only| or later| or any later version)", 0.9),
    (4, "{n}(?: license)?{w}", 0.85),
    (5, "{n}", 0.5),
]
PRIORITIES = 5
COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "matches", "score")


def rules() -> list[dict]:
    """All rules: label, keyword, the name as it stands in a match (a blank if it has forms), pattern over folded words (spaces at both ends), priority, weight."""
    out = []
    for keyword, label, names, versions in FAMILIES:
        for name in names:
            for priority, template, weight in TEMPLATES:
                many = versions if "{w}" in template else [None] if not versions or "{v}" not in template else versions
                for version in many or [None]:
                    if version is None and priority in (3, 4):
                        continue
                    # A name that is a word of other uses counts only in a grant or a tag.
                    if priority == 5 and " license" not in name and keyword not in ("gplv2", "gplv3", "cc0", "unlicense", "wtfpl", "reserved"):
                        continue
                    body = template.replace("{n}", name).replace("{w}", f"(?:,)?{_V}{version}" if version else "").replace("{v}", version or "0")
                    plain = f" {name}" if name.replace(" ", "").isalnum() else " "
                    out.append({"label": label, "keyword": f" {keyword} ", "name": plain, "pattern": f" {body}(?= )", "priority": priority, "weight": weight})
    return out


_RULE = "array<struct<label:string,keyword:string,name:string,pattern:string,priority:int,weight:double>>"
_SPAN = "array<struct<start:int,less:int,priority:int,label:string,weight:double>>"


def _lower(x: Column) -> Column:
    """A-Z in lower case and nothing else; texts of ASCII alone take the short way."""
    return F.when(F.char_length(x) == F.octet_length(x), F.lower(x)).otherwise(F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _spaces(x: Column) -> Column:
    return F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit("")))


def _places(text: Column, rule: Column) -> Column:
    """Intervals of all matches of a rule, as (start, -end, priority, label, weight)."""
    return F.transform(places(text, rule["pattern"]), lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("less"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["weight"].alias("weight")))


#: Spans that are folded at a time: appending to an array copies it.
RUN = 128


def _kept(spans: Column) -> Column:
    """Spans, in order of start, without those that one of no worse priority contains (itself or its equal comes first)."""
    none = F.from_json(F.lit("[]"), _SPAN)

    def step(s: Column, x: Column) -> Column:
        contained = F.array_max(F.slice(s["ends"], F.lit(1), x["priority"])) >= -x["less"]
        ends = F.transform(s["ends"], lambda e, i: F.when(i + 1 == x["priority"], F.greatest(e, -x["less"])).otherwise(e))
        return F.struct(ends.alias("ends"), F.when(contained, s["kept"]).otherwise(F.array_append(s["kept"], x)).alias("kept"))

    def run(ordered: Column):
        def part(s: Column, i: Column) -> Column:
            own = F.aggregate(F.slice(ordered, i * RUN + 1, F.lit(RUN)), F.struct(s["ends"].alias("ends"), none.alias("kept")), step)
            return F.struct(own["ends"].alias("ends"), F.array_append(s["kept"], own["kept"]).alias("kept"))

        return part

    state = F.struct(F.array_repeat(F.lit(-1), PRIORITIES).alias("ends"), F.from_json(F.lit("[]"), f"array<{_SPAN}>").alias("kept"))
    bound = F.transform(F.array(F.sort_array(spans)), lambda o: F.aggregate(F.sequence(F.lit(0), F.floor(F.size(o) / RUN).cast("int")), state, run(o), lambda s: F.flatten(s["kept"])))
    return F.get(bound, F.lit(0))


def detected(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and: n_words, n_base, first_word, last_word, base_labels, labels (arrays), matches (spans of the folded text), score."""
    table = rules()
    words = sorted({r["keyword"].strip() for r in table} | {"license"})
    raw = F.coalesce(F.col(text), F.lit(""))
    folded = F.trim(_lower(F.regexp_replace(raw, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")))
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in COLUMNS)).alias("_own")
    out = docs.select(own, folded.alias("_f")).withColumn("n_words", F.when(F.col("_f") == "", 0).otherwise(_spaces(F.col("_f")) + 1).cast("long"))
    # The sign in front lets a match begin at the first word.
    out = out.withColumn("_t", F.when(F.col("_f").rlike(rf"(?:^| )(?:{'|'.join(words)})(?: |$)"), F.concat(F.lit("| "), F.col("_f"), F.lit(" ")))).drop("_f")
    t = F.col("_t")
    parts = F.split(t, rf"(?= (?:{'|'.join(BASE)}) )", -1)
    out = out.withColumn("_p", F.coalesce(parts, F.array(F.lit("|"))))
    p = F.col("_p")
    some = F.size(p) > 1
    base = F.array_sort(F.filter(F.array(*(F.when(F.contains(t, F.lit(f" {k} ")), F.lit(v)) for k, v in BASE.items())), lambda x: x.isNotNull()))
    # Most rules whose keyword stands in a text don't match it: one look decides that, before places are sought.
    held = F.filter(F.from_json(F.lit(json.dumps(table)), _RULE), lambda r: F.contains(t, r["keyword"]) & F.contains(t, r["name"]) & F.rlike(t, r["pattern"]))
    spans = F.when(t.isNotNull(), _kept(F.flatten(F.transform(held, lambda r: _places(t, r)))))
    out = out.select(
        "_own.*",
        "n_words",
        (F.size(p) - 1).cast("long").alias("n_base"),
        F.when(some, _spaces(F.get(p, F.lit(0)))).cast("long").alias("first_word"),
        F.when(some, F.col("n_words") - _spaces(F.element_at(p, -1)) + 1).cast("long").alias("last_word"),
        base.alias("base_labels"),
        F.coalesce(spans, F.from_json(F.lit("[]"), _SPAN)).alias("matches"),
    )
    own = F.transform("matches", lambda m: m["label"])
    return out.withColumn("labels", F.array_sort(F.array_distinct(F.concat("base_labels", own)))).withColumn(
        "score", F.greatest(F.when(F.col("n_base") > 0, 0.9).otherwise(0.0), F.coalesce(F.array_max(F.transform("matches", lambda m: m["weight"])), F.lit(0.0)))
    )
