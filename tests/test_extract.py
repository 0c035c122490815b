"""Extraction, groups and segmentation on small rows."""

import difflib

from pyspark.sql import functions as F

from lodestone.functions import segment
from lodestone.operators import extract, graph


def test_spans_and_edits(spark):
    df = spark.createDataFrame([("ab甲c\ndef\nghi",)], "t string")
    pick = lambda *a: df.select(extract.resolved(F.col("t"), *map(F.lit, a)).alias("x")).first().x
    assert pick(1, 1, 1, 3) == "b甲" and pick(1, 3, 2, 1) == "甲c\ndef\ng" and pick(1, 9, 0, 1) is None and pick(2, 1, 0, 1) is None
    assert df.select(extract.offsets(F.split("t", "\n")).alias("x")).first().x == [0, 5, 9]
    texts = [None, "", "\n", "一\n\n𠀀b\n", "\n".join("x" * (i % 7) for i in range(256)), "\n".join("é" * (i % 5) for i in range(1000))]
    found = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", extract.offsets(F.split("t", "\n")).alias("x"))
    for i, x in found.collect():
        parts = texts[i].split("\n") if texts[i] is not None else []
        assert x == (None if texts[i] is None else [sum(len(p) + 1 for p in parts[:k]) for k in range(len(parts))])
    edits = F.array(*(F.struct(F.lit(a).alias("at"), F.lit(o).alias("old"), F.lit(n).alias("new")) for a, o, n in ((0, "a", "AAA"), (2, "甲", ""), (5, "x", "y"))))
    assert df.select(extract.edited(F.col("t"), edits).alias("x")).first().x == "AAAbc\ndef\nghi"


def test_symbols_and_panels(spark):
    signs = spark.createDataFrame([("父母 ━━━ ×",), ("子孙 - -",), ("x ○",), ("none",)], "t string")
    assert [r.v for r in signs.select(extract.symbol(F.col("t")).alias("v")).collect()] == [0, 2, 3, None]
    rows = spark.createDataFrame([("a", i, i in (2, 3, 4, 5, 6, 7, 20, 21)) for i in range(25)], "s string, n int, hit boolean")
    assert [tuple(r) for r in extract.panels(rows, "s", "n", F.col("hit")).collect()] == [("a", 2, 7, 6)]
    assert spark.range(1).select(extract.outcome(F.lit("x 反馈：好。y"), "反馈：[^。]*。", "没有反馈").alias("o")).first().o == "反馈：好。"
    assert spark.range(1).select(extract.role(F.lit("a short"), "q", "z").alias("o")).first().o == "heading_only"


def test_groups(spark):
    nodes = spark.range(50).withColumnRenamed("id", "k")
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 30)] + [(40, 45), (45, 49)], "a long, b long")
    got = {r.k: r.group for r in graph.grouped(nodes, "k", edges).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[49] == got[45] == 40 and got[35] == 35
    df = spark.createDataFrame([(1, "x", 5), (2, "x", 6), (3, "y", 5), (4, None, 5), (5, None, 5)], "k int, b string, n int")
    assert [tuple(r) for r in graph.blocked_pairs(df, "k", ["b"], F.abs(F.col("x.n") - F.col("y.n")) < 2).collect()] == [(1, 2)]


def test_segmentation(spark):
    words = {"六爻": 1000, "世爻": 1000, "六": 10, "爻": 10, "动": 50, "发动": 500}
    df = spark.createDataFrame([("六爻世爻发动 ABC1，",), (None,), ("",)], "t string")
    got = [r.w for r in df.select(segment.segmented(F.col("t"), words).alias("w")).collect()]
    assert got == [["六爻", "世爻", "发动", "abc1"], [], []]
    cut = df.limit(1).select(segment.segmented(F.col("t"), words).alias("w"))
    x = cut.select(segment.expanded(F.col("w"), ["爻世", "缺"], {"发动": "动"}).alias("w")).first().w
    assert x == ["六爻", "世爻", "发动", "abc1", "爻世", "动"]
    pairs = spark.createDataFrame([("abcd", "bcde"), ("", ""), (None, "a")], "a string, b string")
    got = [r.r for r in pairs.select(segment.ratio(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got == [difflib.SequenceMatcher(None, "abcd", "bcde", autojunk=False).ratio(), 1.0, None]
