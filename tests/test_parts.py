"""Text, sources, records, structure and streaming on small rows."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import records, search, spans, structure, trees, vectors
from lodestone.sources import registry as R
from lodestone.streaming import incremental


def one(spark, c, value):
    return spark.createDataFrame([(value,)], "t string").select(c(F.col("t")).alias("x")).first().x


def test_text(spark):
    assert one(spark, X.split_lines, " 甲\r\r\n乙 \r丙\n\n丁 x y\n") == [" 甲", "", "乙 ", "丙", "", "丁 x y"]
    assert one(spark, X.plain, "![i](u) a [b](c) <i>d</i> &lt;e&gt; **f** `g`") == "a b d <e> f g"
    assert one(spark, X.normalized, "Ab-Ç 中，文!") == "abç中文"
    assert one(spark, lambda c: X.query_terms(c, ["the"], 2), "The fox the dog fox cat") == ["fox", "dog"]
    assert one(spark, X.escaped, "a|<b>\n&") == "a\\|&lt;b&gt; &amp;"
    assert one(spark, lambda c: X.best_topic(c, {"a": ["x", "y"], "b": ["z", "w"]}), "z y") == "a"
    assert one(spark, lambda c: X.best_topic(c, {"a": ["x"], "b": ["z"]}), "q") is None
    assert one(spark, lambda c: X.paragraphs_within(c, 6), "abcdefgh\n\nij") == ("abcdefgh", True)
    assert one(spark, lambda c: X.paragraphs_within(c, 9), "abc\n\nij\n\nxyz") == ("abc\n\nij", True)
    assert spark.range(1).select(X.canonical_json(F.struct(F.lit(1).alias("b"), F.lit("é").alias("a"))).alias("j")).first().j == '{"a":"é","b":1}'
    assert one(spark, X.digest, None) is None


def test_sources(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"source_id":"a","title":"T"}\n{"source_id":"b"}\n')
    assert R.registry(spark, str(tmp_path / "s.jsonl")).count() == 2
    (tmp_path / "d.jsonl").write_text('{"source_id":"a"}\n{"source_id":"a"}\n')
    for bad in ("d.jsonl", "e.jsonl"):
        (tmp_path / "e.jsonl").write_text("")
        with pytest.raises(ValueError):
            R.registry(spark, str(tmp_path / bad))
    (tmp_path / "n.txt").write_bytes("甲\r\n乙".encode())
    got = R.native_text(spark, [str(tmp_path / "n.txt")]).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in got] == [(1, "甲"), (2, "乙")] and got[0].sha256 == hashlib.sha256("甲\r\n乙".encode()).hexdigest()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    page = lambda n, t, h, m: {"source_id": "a", "page": n, "text": t, "text_sha256": h, "provenance": {"method": m}}
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, [page(2, "x\ny", sha("x\ny"), "ocr"), page(3, "z", "0", None), page(9, "q", sha("q"), "ocr"), page(9, "q", sha("q"), "ocr")])))
    pages = R.pages(spark, str(tmp_path / "p.jsonl"))
    assert {(r.page, r.problem) for r in R.page_problems(pages, 4).collect()} == {(3, "hash"), (3, "provenance"), (9, "range"), (9, "repeated")}
    assert {r.page for r in R.missing_pages(pages, spark.createDataFrame([("a", 4)], "source_id string, pdf_pages int")).collect()} == {1, 4}
    body = R.body_lines(pages.where("page < 9")).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in body] == [(1, "[page 2]"), (2, "x"), (3, "y"), (4, "[page 3]"), (5, "z")]


def test_structure(spark):
    df = spark.createDataFrame([(1, [3, 1], ["a", "b"], "x"), (2, None, ["a"], "y"), (3, [], [], None)], "k int, p array<int>, l array<string>, s string")
    ints = lambda *v: F.array(*map(F.lit, v)).cast("array<int>")
    got = {r.k: r for r in structure.scored(df, "k", {"p_positions": structure.compare(ints(1, 3), F.col("p"), "p_positions", "list"), "l": structure.compare(F.array(F.lit("a")), F.col("l"), "l", "list"), "s": structure.compare(F.lit("x"), F.col("s"), "s", "text")}).collect()}
    assert (got[1].score, got[1].unknown) == (1.0, []) and (got[2].matched, got[2].different, got[2].unknown) == (["l"], ["s"], ["p_positions"])
    assert 3 not in got


def test_budget_skips_and_goes_on(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 1, 50), (1, 2, 4), (1, 3, 1), (1, 4, 1)], "g int, o int, n int")
    got = search.packed(df, "g", ["o"], F.col("n"), 3, 10).orderBy("o").collect()
    assert [r.taken for r in got] == [True, False, True, True, False] and got[-1].used == 10


def test_spans_and_trees(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 3, 8), (1, 10, 12), (2, 1, 2)], "g int, s int, e int")
    assert {tuple(r) for r in spans.merged(df, ["g"], "s", "e").collect()} == {(1, 0, 8), (1, 10, 12), (2, 1, 2)}
    a = spark.createDataFrame([(1, 1, 0, 25), (1, 2, 40, 41)], "g int, a_id int, a_start int, a_end int")
    b = spark.createDataFrame([(1, 7, 20, 39), (1, 8, 25, 60)], "g int, b_id int, b_start int, b_end int")
    assert sorted((r.a_id, r.b_id) for r in spans.overlapping(a, b, ["g"], 10).collect()) == [(1, 7), (1, 8), (2, 8)]
    nodes = spark.createDataFrame([(1, 1, 1, 100), (1, 5, 2, 100), (1, 9, 2, 100), (1, 20, 1, 100)], "g int, start int, depth int, last int")
    assert {r.start: r.end for r in trees.node_ends(nodes, "g", "start", "depth", "last").collect()} == {1: 19, 5: 8, 9: 19, 20: 100}
    deep = spark.createDataFrame([(1, 1, 9, 50), (1, 4, 12, 50), (1, 8, 11, 50), (1, 9, 0, 50)], "g int, start int, depth int, last int")
    assert {r.start: r.end for r in trees.node_ends(deep, "g", "start", "depth", "last").collect()} == {1: 8, 4: 7, 8: 8, 9: 50}
    assert trees.node_ends(deep.where("g = 2"), "g", "start", "depth", "last").count() == 0
    points = spark.createDataFrame([(1, 6), (1, 2)], "g int, line int")
    tree = spark.createDataFrame([(1, 1, 19, 1, 10), (1, 5, 8, 2, 11)], "g int, s int, e int, depth int, node int")
    assert {r.line: r.node for r in trees.deepest(points, tree, "g", "line", "s", "e", "depth", "node").collect()} == {6: 11, 2: 10}
    v = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0],), (None,)], "v array<float>")
    assert [bool(r.x) for r in v.select(vectors.valid(F.col("v"), 2).alias("x")).collect()] == [True, False, False, False, False]


def test_records(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, h string")
    new = spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "k int, h string")
    assert {r.k: r.change for r in records.changes(old, new, "k", "h").collect()} == {1: "removed", 2: "same", 3: "changed", 4: "added"}
    held = spark.createDataFrame([("b", 7), ("b", 7)], "h string, e int")
    assert {r.k: r.e for r in records.reused(new, held, "h", "e").collect()} == {2: 7, 3: None, 4: None}


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "one two one", "2024-01-01 00:00:00"), (2, "one two one", "2024-01-01 00:00:01"), (3, "three", "2024-01-01 00:00:02")], "k int, t string, at string").withColumn("at", F.col("at").cast("timestamp")).write.parquet(src)
    stream = spark.readStream.schema("k int, t string, at timestamp").parquet(src)
    q = incremental.new_postings(stream, "k", "t", "1 hour", "at").writeStream.format("memory").queryName("fresh").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.term for r in spark.table("fresh").collect()) == ["one", "one", "three", "two"]
    write = incremental.extend(str(tmp_path / "out"), "k", F.array(), X.tokens(F.col("t")))
    for _ in range(2):
        write(spark.read.parquet(src), 0)
    assert spark.read.parquet(str(tmp_path / "out")).where("term = 'one'").agg(F.sum("tf_body")).first()[0] == 4
