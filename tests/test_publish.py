"""Generations, packages, shards, prompts; the stored index and the marks of a chart."""

import hashlib
import json

import pytest
from lodestone.functions import text as X
from lodestone.operators import chart, gates, index
from lodestone.sources import publish
from pyspark.sql import functions as F


def test_generations(spark, tmp_path):
    root = str(tmp_path)
    a, b = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(2, "b")], "k int, v string")
    with pytest.raises(FileNotFoundError):
        publish.active(spark, root, ["t"])
    one = publish.generation("c1", {"model": "m", "path": "/x", "parts": [{"root": 1, "z": 2}]}, "all")
    assert one == publish.generation("c1", {"path": "/y", "parts": [{"z": 2}], "model": "m"}, "all") != publish.generation("c2", {"model": "m", "parts": [{"z": 2}]}, "all")
    publish.publish(spark, root, one, {"t": a}, {"corpus": "c1"}, ["t"])
    publish.publish(spark, root, "two", {"t": b}, {"corpus": "c2"}, activate=False)
    assert publish.active(spark, root, ["t"], {"corpus": "c1"})["t"].first().v == "a"
    with pytest.raises(gates.Incomplete):
        publish.publish(spark, root, "three", {"t": a.limit(0)}, {}, ["t"])
    assert publish.active(spark, root, ["t"])["t"].first().v == "a"
    publish.publish(spark, root, "two", {"t": b}, {"corpus": "c2"})
    with pytest.raises(ValueError, match="corpus"):
        publish.active(spark, root, ["t"], {"corpus": "c1"})
    with pytest.raises(FileNotFoundError, match="u"):
        publish.active(spark, root, ["t", "u"])


def test_lines_shards_and_replicas(spark, tmp_path):
    df = spark.createDataFrame([("u1", "x", False), ("u2", None, True)], "id string, t string, draft boolean")
    publish.write_lines(df, str(tmp_path / "l"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "l")).collect()) == ['{"draft":false,"id":"u1","t":"x"}', '{"draft":true,"id":"u2","t":null}']
    seeds = spark.createDataFrame([("u1", "seed", False), ("u2", "seed", False)], df.schema)
    assert {r.id: r.t for r in publish.merged_shards(seeds, df, "id", F.col("draft")).collect()} == {"u1": "x", "u2": "seed"}
    with pytest.raises(gates.Incomplete):
        publish.merged_shards(seeds, df.union(df), "id", F.col("draft"))
    assert sorted(r.id for r in publish.replicas(df, "id", "t", 3).collect()) == ["u1", "u1#1", "u1#2", "u2", "u2#1", "u2#2"]


def test_packages(tmp_path):
    root, out = tmp_path / "r", tmp_path / "o"
    (root / "d").mkdir(parents=True)
    (root / "d" / "a.txt").write_text("a")
    (root / "b.txt").write_text("b")
    one = publish.package(root, ["d/a.txt", "b.txt"], tmp_path / "1.zip")
    assert one == publish.package(root, ["b.txt", "d/a.txt", "b.txt"], tmp_path / "2.zip")
    assert publish.restore(tmp_path / "1.zip", one, out) == ["b.txt", "d/a.txt"] and (out / "d" / "a.txt").read_text() == "a"
    publish.restore(tmp_path / "1.zip", one, out)
    (out / "b.txt").write_text("mine")
    with pytest.raises(ValueError, match="changed"):
        publish.restore(tmp_path / "1.zip", one, out)
    with pytest.raises(ValueError, match="hash"):
        publish.restore(tmp_path / "1.zip", "0", out)
    with pytest.raises(ValueError, match="outside"):
        publish.package(root, ["../1.zip"], tmp_path / "3.zip")
    assert publish.cleanup(root, ["b.txt", "d/a.txt", "../1.zip"], ["d/a.txt"]) == ["b.txt"] and (tmp_path / "1.zip").exists()


def test_prompts_and_archives(spark, tmp_path):
    text = "é" * 30
    (tmp_path / "p.md").write_text(text, encoding="utf-8")
    (tmp_path / "q.md").write_text(text, encoding="utf-8")
    held = {"p.md": hashlib.sha256(text.encode()).hexdigest(), "q.md": "0"}
    row = publish.prompt_page(spark, str(tmp_path), "p.md", held, 5, 10).first()
    assert (len(row.text), row.has_more, row.next_offset, row.total) == (10, True, 15, 30)
    for bad in ("q.md", "../p.md", "none.md"):
        with pytest.raises(ValueError):
            publish.prompt_page(spark, str(tmp_path), bad, held)
    (got,) = publish.archive(spark, str(tmp_path), "*.md").collect()
    assert got.path.endswith("p.md") and got.sha256 == held["p.md"]


def test_stored_index_equals_the_scan(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i % 5} x", " ".join(f"w{j % 7}" for j in range(i % 11))) for i in range(60)], "id int, f string, b string")
    focus, body = F.split("f", " "), F.split("b", " ")
    index.stored(docs, "id", focus, body, str(tmp_path))
    held = index.Stored(spark, str(tmp_path), "id")
    terms = ["w1", "w6", "zz", "x"]
    want = {r.id: round(r.score, 9) for r in index.bm25(docs, "id", focus, body, terms, 8.0).collect()}
    assert {r.id: round(r.score, 9) for r in held.bm25(terms, 8.0).collect()} == want and len(want) == 60
    some = docs.where("id < 5").select("id")
    assert {r.id for r in held.bm25(terms, 8.0, some).collect()} == set(range(5))
    assert held.unmatched(["w6", "zz", "x"], some) == ["w6", "zz"]
    assert "bucket" in held._of(held.postings, ["w1"])._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]


def test_texts_are_tokenized_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "c a c"), (1, "b", "a"), (2, "", "c"), (3, None, None), (None, "a", "b b")], "id int, f string, b string")
    focus, body = X.tokens(F.col("f")), X.tokens(F.col("b"))
    scan = index.bm25(docs, "id", focus, body, ["a", "c"], 2.0, F.coalesce("id", F.lit(0)) < 9)
    want = {}
    for r in scan.collect():
        want[r.id] = want.get(r.id, 0) + r.score
    plan = scan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and set(want) == {1, 2, None}
    # Rows of one id are counted as the scan counts them.
    index.stored(docs, "id", focus, body, str(tmp_path))
    held = index.Stored(spark, str(tmp_path), "id")
    assert {r.id: r.score for r in held.bm25(["a", "c"], 2.0).collect()} == pytest.approx(want)
    assert held.statistics.first().n == 5 and {r.term: r.df for r in held.terms.collect()} == {"a": 3, "b": 3, "c": 2}
    assert spark.range(1).select(X.tokens(F.lit("1aB\u00e9c, d."))).first()[0] == ["ab", "c", "d"]


def test_day_stars_and_labels(spark):
    stems, branches = "甲乙丙丁戊己庚辛壬癸", "子丑寅卯辰巳午未申酉戌亥"
    triads = {"寅午戌": "申卯", "申子辰": "寅酉", "巳酉丑": "亥午", "亥卯未": "巳子"}
    blades = dict(zip("甲丙戊庚壬", "卯午午酉子"))
    for r in spark.range(60).select(F.col("id"), chart.day_stars(F.col("id").cast("int")).alias("s")).collect():
        horse, blossom = next(v for k, v in triads.items() if branches[r.id % 12] in k)
        assert (r.s.yangren, r.s.yima, r.s.xianchi) == (blades.get(stems[r.id % 10]), horse, blossom)
    df = spark.createDataFrame([("乾", True, False, 0), ("坤", False, True, 6), ("离", False, False, 7)], "p string, c boolean, h boolean, s int")
    assert [r[0] for r in df.select(chart.palace_label(F.col("p"), F.col("c"), F.col("h"), F.col("s"))).collect()] == ["乾宫·六冲", "坤宫·六合·游魂", "离宫·归魂"]
    assert json.dumps(publish.portable({"path": 1, "a": [{"root": 2, "b": 3}]})) == '{"a": [{"b": 3}]}'


def test_ablation_in_one_aggregation(spark):
    from lodestone.operators import evaluate

    rows = [("m", 1, r, i, s, 5, 7) for r, i, s in ((1, 4, 7), (2, 5, 8), (3, None, 8), (4, 5, 9))] + [("m", 2, 1, 1, None, 5, 7), ("n", 1, 1, None, 7, 5, 7)]
    runs = spark.createDataFrame(rows, "mode string, q int, rank int, id int, source int, anchor_id int, anchor_source int")
    out = evaluate.ablation(runs, "mode", "q", [1, 3])
    got = {(r.mode, r.k): (r.n, r.anchor_rate, r.source_rate, r.mean_sources) for r in out.collect()}
    assert got == {("m", 1): (2, 0.0, 0.5, 0.5), ("m", 3): (2, 0.5, 0.5, 1.0), ("n", 1): (1, 0.0, 1.0, 1.0), ("n", 3): (1, 0.0, 1.0, 1.0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Expand" not in plan
