"""The tools over a small corpus, the calendar, and text overlap."""

import pytest
from pyspark.sql import functions as F

from lodestone.api import Engine
from lodestone.functions import calendar
from lodestone.functions import tables as T
from lodestone.operators import overlap


@pytest.fixture(scope="module")
def engine(spark):
    rows = [
        ("e1", "case", "s1", "lifa", "A", "topic", True, True, "g1", "river stone", "river river stone bank", 1),
        ("e2", "case", "s1", "mixed", "B", "topic", True, True, "g1", "river", "river of stone", 5),
        ("e3", "case", "s2", "xiangfa", "A", "common", True, False, "g3", "fire", "river and fire", 2),
        ("e4", "case", "s2", "lifa", "A", "topic", False, True, "g4", "river", "river", 3),
        ("e5", "rule", "s2", "lifa", "A", "topic", True, False, "g5", "stone", "stone rule", 9),
        *((f"x{i}", "rule", "s3", "lifa", "A", "topic", True, False, f"x{i}", "other", "other words here", i) for i in range(8)),
    ]
    evidence = spark.createDataFrame(rows, "evidence_id string, kind string, source_id string, method string, author string, scope string, searchable boolean, chart_valid boolean, group_id string, focus string, body string, start_line int")
    vectors = spark.createDataFrame([("e1", 1, [1.0, 0.0]), ("e3", 2, [0.0, 1.0]), ("e4", 3, [0.0, 1.0])], "evidence_id string, vec_id int, embedding array<float>")
    topics = spark.createDataFrame([("t1", None, "one"), ("t2", "t1", "two")], "topic string, parent string, title string")
    outline = spark.createDataFrame([("n1", None, "s1", 1, "book"), ("n2", "n1", "s1", 2, "chapter")], "node string, parent string, source_id string, start int, title string")
    return Engine(evidence, spark.createDataFrame([("e1", "t2")], "evidence_id string, topic string"), topics, outline, spark.createDataFrame([("n2", "e3")], "node string, evidence_id string"), spark.createDataFrame([("s1", "S", "body text")], "source_id string, title string, body string"), vectors)


def ids(df):
    return [r.evidence_id for r in df.where("taken").orderBy("rank").collect()]


def test_search(spark, engine):
    assert len(ids(engine.search("the river"))) == 2  # one of each group, nothing unsearchable
    assert set(ids(engine.search("river"))) & {"e1", "e2"} and "e3" in ids(engine.search("river"))
    assert ids(engine.search("river", method="xiangfa"))[-1] == "e3"
    assert ids(engine.search("river", exclude_ids=["e1"])) == ["e3"]
    assert ids(engine.search("", nodes=["n2"])) == ["e3"]
    assert ids(engine.search("river", include_common=False, author="A")) == ["e1"]
    assert ids(engine.search("river", topic="t2")) == ["e1", "e3"]
    q = spark.createDataFrame([(0, [0.0, 1.0])], "q int, qv array<float>")
    assert ids(engine.search("", query_vectors=q, require_valid_chart=False))[0] == "e3"
    assert ids(engine.search("stone", kind="rule")) == ["e5"]
    for bad in ({"kind": "x"}, {"limit": 0}, {"max_chars": 1}):
        with pytest.raises(ValueError):
            engine.search("river", **bad)
    with pytest.raises(ValueError):
        engine.search("the")


def test_find(spark, engine, tmp_path):
    from dataclasses import replace

    from lodestone.functions.lexicon import Lexicon
    from lodestone.operators import index

    index.stored(engine.evidence, "evidence_id", F.split("focus", " "), F.split("body", " "), str(tmp_path))
    cells = spark.createDataFrame([("e1", "a", "number", ["1.0"]), ("e1", "b_positions", "list", ["2.0", "3.0"]), ("e1", "c", "text", ["x"]), ("e2", "a", "text", ["1.0"]), ("e2", "d", "list", ["p", "q"]), ("e3", "a", "number", ["1.0"])], "evidence_id string, feature string, kind string, items array<string>")
    rule_spans = spark.createDataFrame([("e5", "g5", "s2", 0, 10, "stone rule"), ("x1", "x1", "s2", 20, 30, " " * 10)], "evidence_id string, group_id string, source_id string, start int, end int, text string")
    case_spans = spark.createDataFrame([("g3", "s2", 5, 25)], "group_id string, source_id string, start int, end int")
    own = replace(engine, lexicon=Lexicon(["river", "stone", "fire"]), stored=index.Stored(spark, str(tmp_path), "evidence_id"), cells=cells, rule_spans=rule_spans, case_spans=case_spans)
    found = lambda *a, **b: [r.evidence_id for r in own.find(*a, **b).items.orderBy("rank").collect()]
    plain = lambda *a, **b: [r.evidence_id for r in engine.find(*a, **b).items.orderBy("rank").collect()]
    for args in ({"query": "river"}, {"query": "river stone"}, {"query": "fire", "author": "A"}):
        assert found(kind="case", **args) == plain(kind="case", **args)
    assert found("stone") == ["e5"] and found("stone", exclude_case_ids=["e3"]) == [] and found("other", exclude_case_ids=["e3"], limit=100)[0] == "x0"
    got = own.find("river zebra", kind="case", limit=1)
    assert got.envelope["unmatched_query_terms"] == ["zebra"] and got.envelope["has_more"] and got.envelope["returned"] == 1
    assert found("", kind="case", features={"a": True, "b_positions": [3.0, 2.0], "c": "y"}) == ["e1"]  # cases without a valid chart don't count
    assert found("", kind="case", features={"d": ["q"]}) == ["e2"] and found("", kind="case", features={"a": "1.0"}) == ["e2"]
    assert found("", kind="case", topic="t2") == ["e1", "e3"] and found("", kind="case", topic="t2", include_common=False) == ["e1"]
    # e2 stands for its group, which is formed before tiers; it has no topic and comes after what is common.
    assert found("river", kind="case", topic="t2", include_unknown=True) == ["e3", "e2"]
    assert {r.category_match for r in own.find("", kind="case", topic="t2").items.collect()} == {"same_topic", "common"}
    windows = spark.createDataFrame([("e3", 0.9), ("e3", 0.1), ("e1", 0.5)], "evidence_id string, score double")
    assert found("river", kind="case", mode="hybrid_rerank", windows=windows)[0] == "e3"
    assert found("", kind="case", nodes=["n2"]) == ["e3"]
    for bad in ({"nodes": ["zz"]}, {"mode": "x"}, {"limit": 0}, {"max_chars": 5}, {"case_text_scope": "full"}, {"query": " "}):
        with pytest.raises(ValueError):
            own.find(**({"query": "river"} | bad))


def test_lines_and_checks(spark, engine):
    from dataclasses import replace

    evidence = spark.createDataFrame([("e", "s", 3, 4)], "evidence_id string, source_id string, start_line int, end_line int")
    sources = spark.createDataFrame([("s", "\n".join(f"line {i}" for i in range(1, 300)))], "source_id string, body string")
    own = replace(engine, evidence=evidence, sources=sources)
    assert own.source_lines("e").first().text == "line 3\nline 4" and own.source_lines("e", 5).first().start_line == 1
    row = own.source_lines("e", 200, 0, 1000).first()
    assert len(row.text) == 1000 and row.has_more and row.next_offset == 1000 and row.end_line == 204
    with pytest.raises(ValueError):
        own.source_lines("e", 201)
    casts = spark.createDataFrame([(1, [0, 3, 2, 1, 2, 1], 3, 36), (2, [9] * 6, 3, 36)], "chart_id long, v array<int>, month int, day int")
    (checks,) = engine.inspect_chart(casts, 2).collect()
    assert len(checks.checks) == 2 and checks.has_more


def test_other_tools(spark, engine):
    assert {r.topic: r.n_evidence for r in engine.get_topics().collect()} == {"t1": 0, "t2": 1}
    assert [(r.node, r.n_children) for r in engine.browse_outline(None).collect()] == [("n1", 1)]
    assert engine.get_source("s1", 0, 4).first().asDict() == {"id": "s1", "page": "body", "has_more": True}
    assert engine.get_source("nothing").count() == 0
    casts = spark.createDataFrame([(1, [2] * 6, 3, 36), (2, [9] * 6, 3, 36), (3, [1], 3, 36)], "chart_id long, v array<int>, month int, day int")
    assert engine.build_chart(casts)["lines"].count() == 6


def test_calendar(spark):
    t = spark.sql("SELECT timestamp'2026-09-04 17:27:00+00:00' AS t UNION ALL SELECT timestamp'2024-02-04 08:20:00+00:00' UNION ALL SELECT timestamp'2024-02-04 08:40:00+00:00'")
    got = t.select("t", *(c.alias(k) for k, c in calendar.pillars(F.col("t")).items())).orderBy("t").collect()
    name = lambda i: T.STEMS[i % 10] + T.BRANCHES[i % 12]
    assert [name(got[2][k]) for k in ("year", "month", "day", "hour")] == ["丙午", "丙申", "壬午", "辛丑"]
    assert (name(got[0].year), name(got[1].year)) == ("癸卯", "甲辰")  # the start of spring fell at 16:27 in Shanghai


def test_overlap(spark):
    text = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJ"
    q = spark.createDataFrame([(1, text), (2, "short")], "q_id int, q string")
    d = spark.createDataFrame([(7, "xx" + text[:41] + "!!"), (8, "nothing at all of the sort in this text, is there?")], "d_id int, d string")
    assert [tuple(r) for r in overlap.overlaps(q, d).collect()] == [(1, 7, 2, 41)]


def test_overlap_longest_against_brute_force(spark):
    import os.path
    import random

    rng = random.Random(7)
    text = "".join(rng.choice("ab一𠀀 \n") for _ in range(700))
    queries = [text[:32], text[100:180], text[300:], text[40:75] + "z" + text[76:200], "𠀀" * 40]
    docs = [text, text[90:400], "x" + text[:33], text[:120] + "#" + text[121:], "𠀀" * 35]
    q = spark.createDataFrame(list(enumerate(queries)), "q_id int, q string")
    d = spark.createDataFrame(list(enumerate(docs)), "d_id int, d string")
    expected = set()
    for i, a in enumerate(queries):
        for j, b in enumerate(docs):
            hits = [at for at in range(0, len(a) - 31, 8) if a[at : at + 32] in b]
            if hits:
                expected.add((i, j, len(hits), max(len(os.path.commonprefix([a[at:], b[b.index(a[at : at + 32]) :]])) for at in hits)))
    assert {tuple(r) for r in overlap.overlaps(q, d).collect()} == expected and len(expected) > 8


def test_overlap_in_long_texts(spark):
    import random

    rng = random.Random(3)
    text = "".join(rng.choice("abc𠀀é ") for _ in range(20_000))
    places = [0, 1, 7, 8, 9, 231, 249, 255, 256, 8165, 8185, 8191, 8192, 8193, 16_383, 19_900, 19_968]
    queries = ["#" * (i % 9) + text[at : at + 60 + i] for i, at in enumerate(places)]
    docs = [(0, text), (0, text), (1, text[3:9_000]), (2, text[8_170:8_202]), (3, text[8_170:8_201]), (4, "")]
    q = spark.createDataFrame(list(enumerate(queries)), "q_id int, q string")
    d = spark.createDataFrame(docs, "d_id int, d string")
    for size, step in ((32, 8), (20, 5), (16, 1)):
        expected = {(i, j, n) for i, a in enumerate(queries) for j, b in docs if (n := sum(a[at : at + size] in b for at in range(0, len(a) - size + 1, step)))}
        # An id that stands for two rows counts a window once.
        assert sorted(map(tuple, overlap.overlaps(q, d, size, step, longest=False).collect())) == sorted(expected) and len(expected) > 20
