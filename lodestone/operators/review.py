"""Review checks in full: what triggers each of a chart's checks, and what to ask the sources for.

One row a check, expressions over a chart's six lines alone. Places are those of `chart.patterns`: 1..6 lines, 10 + p changed
lines, 20 + p hidden ones. Nothing here decides a matter; a query only says where to read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from . import chart

# Words of the queries.
ASKED = ("生", "克", "冲", "合")
BOUNDS, USE, STRENGTH = "适用条件", "用神", "旺衰 条件"
_CHECK = "array<struct<check_id:string,places:array<int>,queries:array<string>>>"


def _words(*parts: Column | str) -> Column:
    """Parts with blanks between them; empty ones don't count."""
    return F.array_join(F.filter(F.array(*(F.lit(p) if isinstance(p, str) else p for p in parts)), lambda x: x.isNotNull() & (x != "")), " ")


def _branch(b: Column) -> Column:
    return chart.branch_name(b)


def _element(e: Column) -> Column:
    return T.pick(list(T.ELEMENTS), e, "string")


def _found(when: Column, check: str | Column, places: Column, queries: Column) -> Column:
    one = F.struct((F.lit(check) if isinstance(check, str) else check).alias("check_id"), places.cast("array<int>").alias("places"), F.array_distinct(queries).alias("queries"))
    return F.when(when, F.array(one)).otherwise(F.array().cast(_CHECK))


def details(casts: DataFrame, labels: dict[str, str] | None = None, selection: DataFrame | None = None, sources: bool = True) -> DataFrame:
    """(chart_id, check_id, places, queries) of all checks; labels: what a pattern is called in a query, by default its id.

    Without `sources` no pattern is formed, and checks of their sources aren't there.

    selection: lines that a reader has selected (chart_id, position, layer), which are key lines too.
    """
    line = F.col("l")
    moved, hid = F.col("moved"), F.col("hid")
    at = lambda m: m["position"].cast("string")
    shi = F.col("shi")
    trigram = lambda bits: T.pick([T.TRIGRAMS[T.trigram(b)] for b in range(8)], bits, "string")
    palace = T.pick([T.TRIGRAMS[T.palaces()[c][0]] for c in range(64)], F.col("code"), "string")
    void = chart.void_branches(F.col("day60"))
    stages = T.array(T.LIFE, "string")
    tomb = T.array([T.BRANCHES.index(T.TOMB[e]) for e in T.ELEMENTS])

    # Key lines: of the key positions first, then the selected ones of any layer.
    as_key = lambda m: F.struct(m["position"].alias("position"), m["branch"].alias("branch"), m["element"].alias("element"), m["relative"].alias("relative"), m["spirit"].alias("spirit"), m["position"].alias("r"), F.lit("primary").alias("layer"))
    own = F.array_sort(F.filter(line, lambda m: m["is_shi"] | m["is_ying"]), lambda a, b: F.when(a["is_shi"], -1).otherwise(1))
    key_lines = F.concat(F.transform(own, as_key), F.filter("sel", lambda s: ~F.exists(own, lambda m: (s["layer"] == "primary") & (m["position"] == s["position"]))))
    keys = F.col("keys")

    def images(k: Column) -> Column:
        return _words(F.concat(F.lit("第"), at(k), F.lit("爻")), k["relative"], _element(k["element"]), k["spirit"], "取象")

    heading = _words(F.concat(palace, F.lit("宫")), trigram(F.shiftright("code", 3)), trigram(F.col("code").bitwiseAND(7)), "卦象", "取象")
    checks = [_found(F.lit(True), "key_images", F.transform(keys, lambda k: k["r"]), F.concat(F.array(heading), F.transform(keys, images)))]

    def single(m: Column) -> Column:
        role = F.when(m["is_shi"], "世爻").when(m["is_ying"], "应爻").otherwise(F.concat(F.lit("第"), at(m), F.lit("爻")))
        towards = F.transform(F.filter(chart.relations(m["branch"], shi["branch"]), lambda r: r.isin(*ASKED)), lambda r: F.concat(r, F.lit("世")))
        empty = F.when((m["new_branch"] == void[0]) | (m["new_branch"] == void[1]), "化空")
        asks = F.array(_words(role, m["relative"], "独发", F.when(~m["is_shi"], F.array_join(towards, " "))), _words("独发", "动爻", _branch(m["branch"]), F.concat(F.lit("化"), _branch(m["new_branch"])), empty, "作用条件"))
        hidden = F.transform(hid, lambda h: _words("伏神", h["pure_relative"], _element(T.pick(chart._ELEMENT, h["pure_branch"])), F.get(stages, chart.life(T.pick(chart._ELEMENT, h["pure_branch"]), m["branch"])), "独发", _branch(m["branch"]), BOUNDS))
        return F.struct(F.concat(F.lit("single_moving:primary:"), at(m)).alias("check_id"), F.concat(F.array(m["position"], m["position"] + 10), F.transform(hid, lambda h: h["position"] + 20)).cast("array<int>").alias("places"), F.array_distinct(F.concat(asks, hidden)).alias("queries"))

    checks.append(F.when(F.size(moved) == 1, F.transform(moved, single)).otherwise(F.array().cast(_CHECK)))
    # Hidden lines that nobody has selected stand beside the matter.
    beside = F.filter(hid, lambda h: ~F.exists("sel", lambda s: (s["layer"] == "hidden") & (s["position"] == h["position"])))
    pairs = F.flatten(F.transform(moved, lambda a: F.transform(beside, lambda h: _words(F.concat(a["relative"], F.lit("动")), F.concat(F.lit("伏神"), h["pure_relative"]), F.array_join(chart.relations(a["branch"], h["pure_branch"]), " "), BOUNDS))))
    many = F.when(F.size(moved) > 1, F.array(F.lit("多动 世应 用神 生克 变爻 作用范围"))).otherwise(F.array().cast("array<string>"))
    checks.append(_found((F.size(moved) > 1) | ((F.size(moved) > 0) & (F.size(beside) > 0)), "moving_relationships", F.concat(F.transform(moved, lambda m: m["position"]), F.transform(beside, lambda h: h["position"] + 20)), F.concat(pairs, many)))

    def clash(m: Column) -> Column:
        return F.struct(F.concat(F.lit("static_day_clash:primary:"), at(m)).alias("check_id"), F.array(m["position"]).cast("array<int>").alias("places"), F.array(_words(m["relative"], "静爻 日冲 暗动 日破"), _words(m["relative"], "暗动 用神 生克 条件")).alias("queries"))

    checks.append(F.transform(F.filter(line, lambda m: ~m["moving"] & m["day_clash"]), clash))

    def buried(k: Column) -> Column:
        """A key line with what its tomb branch comes from: month, day, another moving line, its own change; only a primary line changes."""
        grave, first = F.get(tomb, k["element"]), k["layer"] == "primary"
        others = F.exists(moved, lambda o: (o["branch"] == grave) & ~(first & (o["position"] == k["position"])))
        change = first & F.exists(moved, lambda o: (o["position"] == k["position"]) & (o["new_branch"] == grave))
        kinds = _words(F.when(F.col("month") == grave, "月墓"), F.when(F.col("dayb") == grave, "日墓"), F.when(others, "动墓"), F.when(change, "化墓"))
        asks = F.array(_words(k["relative"], _branch(k["branch"]), kinds, STRENGTH), _words(k["relative"], k["spirit"], "墓库 理法 象法"))
        return F.struct(kinds.alias("kinds"), F.struct(F.concat(F.lit("tomb_candidate:"), k["layer"], F.lit(":"), at(k)).alias("check_id"), F.array(k["r"]).cast("array<int>").alias("places"), asks.alias("queries")).alias("check"))

    checks.append(F.transform(F.filter(F.transform(keys, buried), lambda x: x["kinds"] != ""), lambda x: x["check"]))

    def six(side: str) -> list[tuple[Column, str]]:
        ends = [(F.get(line, F.lit(i))[side], F.get(line, F.lit(i + 3))[side]) for i in range(3)]
        clashes, joins = F.lit(True), F.lit(True)
        for a, b in ends:
            clashes &= F.pmod(a - b, F.lit(12)) == 6
            joins &= T.pick(T.pairs(T.HARMONY), a * 12 + b) == 1
        return [(clashes, "六冲"), (joins, "六合")]

    states = [F.when(flag & ((F.size(moved) > 0) | F.lit(side == "branch")), _words(word, which, "用神 适用 应期")) for side, which in (("branch", "本卦"), ("new_branch", "变卦")) for flag, word in six(side)]
    stage = {"primary": F.col("stage"), "changed": F.when(F.size(moved) > 0, T.pick([T.palaces()[c][1] for c in range(64)], F.col("changed")))}
    for scope, which in (("primary", "本卦"), ("changed", "变卦")):
        checks.append(_found(F.coalesce(stage[scope] >= 6, F.lit(False)), f"palace_stage:{scope}", F.array(), F.array(_words(T.pick(T.STAGES, stage[scope], "string"), which, "用神", BOUNDS))))
    said = F.array_compact(F.array(*states))
    checks.append(_found(F.size(said) > 0, "six_relations", F.array(), said))

    # Facts with a key, moving or changed line, by their source.
    focus = F.array_distinct(F.concat(F.transform(keys, lambda k: k["r"]), F.flatten(F.transform(moved, lambda m: F.array(m["position"], m["position"] + 10)))))
    called = (lambda p: F.coalesce(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))[p], p)) if labels else (lambda p: p)
    seen = F.filter("facts", lambda f: ((f["scope"] != "changed") | (F.size(moved) > 0)) & ((F.size(f["refs"]) == 0) | F.arrays_overlap(f["refs"], focus)))

    def source(s: Column) -> Column:
        held = F.filter(seen, lambda f: f["source"] == s)
        return F.struct(F.concat(F.lit("pattern_source:"), s).alias("check_id"), F.array_distinct(F.flatten(F.transform(held, lambda f: F.array_intersect(f["refs"], focus)))).alias("places"), F.array_distinct(F.transform(held, lambda f: F.concat_ws(" ", called(f["pattern_id"]), F.lit(BOUNDS)))).alias("queries"))

    if sources:
        checks.append(F.transform(F.array_distinct(F.transform(seen, lambda f: f["source"])), source))
    x = chart._parts(chart._selected(chart._boards(casts), selection)).withColumn("keys", key_lines).withColumn("facts", chart._facts(None if sources else set()))
    # Outer, as every chart has a check: the other form has Catalyst work out all checks once more to filter by their number.
    return x.select("chart_id", F.inline_outer(F.concat(*checks)))
