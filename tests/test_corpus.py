"""Building a corpus from texts: cases, chunks, edits, duplicates, trees, anchors, spans and matches, against loops."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import diff
from lodestone.functions.places import places
from lodestone.operators import cases, chunking, graph, matching, spans, trees

ROWS = ["子孙巳火′ 动 父母子水″应", "妻财未土″世 动 妻财戌土′", "官鬼酉金′ 动 官鬼申金″", "妻财辰土″ 兄弟卯木″世", "兄弟寅木″应 子孙巳火″", "父母子水′ 动 妻财未土″"]


def lines(spark, text, source="b"):
    return spark.createDataFrame([(source, i + 1, t) for i, t in enumerate(text.split("\n"))], "source string, n int, text string")


def read(spark, text):
    return [r.asDict(recursive=True) for r in cases.validated(cases.extracted(lines(spark, text))).orderBy("start").collect()]


def test_two_cases_of_one_day(spark):
    text = "\n".join(["卯月乙丑日占求婚成否", *ROWS, "", "断曰：以妻财为用神。果于午日允婚。", "例二，另占", "同日，妹占文书得泽火革", *ROWS[:4], ROWS[4].replace("应", "世"), ROWS[5], "不以父母为用神，官鬼为用神之墓。父母爻为用神", "反伏章第二十五", "卦有卦变。"])
    one, two = read(spark, text)
    assert (one["start"], one["end"], two["start"], two["end"]) == (1, 10, 10, 19)
    assert one["line_values"] == two["line_values"] == [3, 2, 2, 3, 0, 3]
    assert (one["question"], one["month"], one["day"], one["validation"], one["issues"]) == ("卯月乙丑日占求婚成否", "卯", "乙丑", "calculated", [])
    assert [c["relative"] for c in one["choices"]] == ["妻财"] and one["outcomes"] == ["断曰：以妻财为用神。果于午日允婚。"]
    assert two["calendar_basis"] == "explicit_same_day_previous_case" and (two["month"], two["day"]) == ("卯", "乙丑")
    assert two["names"] == ["革"] and two["validation"] == "conflict" and two["issues"] == ["reported_primary_conflicts_with_line_values", "reported_line_2_shi_conflicts_with_position"]
    assert [(c["relative"], c["line"]) for c in two["choices"]] == [("父母", 18)]


def test_quoted_lines_split_headers_and_drawings(spark):
    quoted = "\n>\n".join("> " + t for t in ["卯月乙丑日占求婚成否", *ROWS])
    assert read(spark, quoted)[0]["line_values"] == [3, 2, 2, 3, 0, 3]
    drawn = ["占事：测某类股票走势", "起卦方式：手工", "公历时间：2006年5月23日14时7分", "干支：丙戌年癸巳月壬子日　(旬空：寅卯)", "坤宫：地雷复（六合）", "六神　伏神　【本卦】",
             "白虎　▅▅　▅▅　子孙癸酉金", "螣蛇　▅▅　▅▅　妻财癸亥水", "勾陈　▅▅　▅▅　兄弟癸丑土　应", "朱雀　▅▅　▅▅　兄弟庚辰土", "青龙　父母乙巳火　▅▅　▅▅　官鬼庚寅木", "玄武　▅▅▅▅▅　妻财庚子水　世"]
    (one,) = read(spark, "\n".join(drawn))
    assert one["line_values"] == [1, 2, 2, 2, 2, 2] and (one["month"], one["day"], one["void"]) == ("巳", "壬子", "寅卯")
    assert one["question"] == "测某类股票走势" and one["names"] == ["复"] and one["validation"] == "calculated" and (one["date"], one["time"]) == ("2006-05-23", "14:07:00")
    assert one["labels"][4] == {"relative": "官鬼", "branch": "寅", "value": 2}  # the hidden line before the drawing doesn't count


@pytest.mark.parametrize(("row", "want"), [("妻财子水、、应", ("妻财", "子", 2)), ("兄弟戌土、 白虎", ("兄弟", "戌", 1)), ("妻财木′", ("", "", 1)), ("官鬼巳火× 父母辰土", ("官鬼", "巳", 0)), ("nothing", ("", "", None)), ("", ("", "", None))])
def test_rows(spark, row, want):
    (got,) = spark.createDataFrame([(row,)], "t string").select(cases.main_row(F.col("t"), cases.drawn_first(F.col("t"))).alias("r")).collect()
    assert tuple(got.r) == want


def test_partial_cases_stay_with_their_issues(spark):
    (one,) = read(spark, "\n".join(["占文书得泽火革", *ROWS]))
    assert one["validation"] == "not_run" and "missing_valid_month_or_day" in one["issues"] and one["status"] == "partial"
    assert read(spark, "\n".join(ROWS)) == [] and read(spark, "卯月乙丑日占事\n" + "\n".join(ROWS[:4])) == []
    assert cases.extracted(lines(spark, "x").where("false")).collect() == []
    long = read(spark, "\n".join(["卯月乙丑日占事", *ROWS, *["话。"] * 400]))[0]
    assert long["end"] == 221 and "case_narrative_boundary_limited" in long["issues"]


def test_every_line_has_one_case_at_most(spark):
    """Starts and ends of random books against a loop over their lines."""
    r = random.Random(2)
    kinds = ["第三章 论", "求测人某", "例三", "话。", "", "卯月乙丑日占财", "同日，占病", "=+ PDF 第 1 页 / 共 2 页 =+"]
    text = []
    for _ in range(60):
        text += [r.choice(kinds) for _ in range(r.randrange(0, 14))] + ROWS[: r.choice([6, 6, 5, 3])]
    got = cases.segmented(lines(spark, "\n".join(text))).orderBy("n").collect()
    assert [g.n for g in got] == list(range(1, len(text) + 1))
    own = [g.case and g.case.start for g in got]
    for i, g in enumerate(got):
        if g.case:
            assert g.case.start <= g.n and g.case.start <= g.case.anchor < g.case["first"] and g.n < g.case.anchor + cases.LONGEST
            between = text[g.case.anchor : g.n]
            assert not any(re.match(cases.HEADING, t.strip()) or t.startswith("求测人") for t in between)  # nothing that ends a case stands before
    starts = [s for i, s in enumerate(own) if s and (i == 0 or own[i - 1] != s)]
    assert starts == sorted(set(starts))  # a case is one range
    runs, hit = [], None
    for i, t in enumerate([*text, "end"]):
        if t in ROWS:
            hit = [i + 1, i + 1] if hit is None else [hit[0], i + 1]
            size = size + 1 if hit[0] != i + 1 else 1
        elif t and not re.search(cases.PAGE, t) and hit:
            runs += [tuple(hit)] if size in (5, 6) else []
            hit = None
    assert {(g.case["first"], g.case["last"]) for g in got if g.case} <= set(runs)


def test_places(spark):
    texts = ["", "aXbXX", "XX", "no", "日X本X", None, "XX", "X" * 2000]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", places(F.col("t"), "X").alias("p")).collect()
    for row in got:
        t = texts[row.i]
        assert row.p is None if t is None else [(p.start, p.end, p.quote) for p in row.p] == [(m.start(), m.end(), m[0]) for m in re.finditer("X", t)]


def test_chunks_account_for_each_line(spark):
    r = random.Random(3)
    kinds = ["第二节 论", "", "", "话" * 30, "话" * 700, "12", "![a](b)", "=+ PDF 第 1 页 / 共 2 页 =+", "```", "[x](#y)"]
    text = [r.choice(kinds) for _ in range(700)] + ["## 原文逐段校核副本", "话", ""]
    made = chunking.accounted(lines(spark, "\n".join(text)), border=F.col("n") % 97 == 0, kept=F.col("n") % 5 == 0)
    got = {g.n: g for g in made.collect()}
    assert len(got) == len(text) and all((g.chunk is None) != (g.reason is None) for g in got.values())
    chunk, size, want = None, 0, {}
    for i, t in enumerate(text):
        n, g = i + 1, got[i + 1]
        if n % 97 == 0:
            chunk = None
        if g.reason:
            chunk = chunk if g.reason == "blank" else None
            continue
        if chunk is None or g.heading or (size >= chunking.SIZE and n % 5 and (i == 0 or not text[i - 1].strip())):
            chunk, size = n, 0
        size += len(t)
        want[n] = chunk
    assert {n: g.chunk for n, g in got.items() if g.chunk} == want
    assert all(got[n].reason == "validation_copy" for n in range(701, 704))
    (account,) = chunking.account(made).collect()
    assert (account.total_lines, account.covered_lines, account.unaccounted) == (703, 703, 0)
    texts = {c.chunk: c for c in chunking.chunks(made).collect()}
    assert set(texts) == set(want.values())
    for k, c in texts.items():
        last = max(n for n, x in want.items() if x == k)
        assert c.text.split("\n") == [t for n, t in enumerate(text, 1) if k <= n <= last] and c.end == last
    ranges = [n for e in chunking.excluded(made).collect() for n in range(e.start, e.end + 1)]
    assert sorted(ranges) == sorted(n for n, g in got.items() if g.reason)
    assert chunking.accounted(lines(spark, "x").where("false")).collect() == []


def test_edit_operations(spark):
    r = random.Random(4)
    pairs = [("", ""), ("a", None), (None, "b"), ("abc", ""), ("", "abc")] + [tuple("".join(r.choice("abc ") for _ in range(r.randrange(40))) for _ in range(2)) for _ in range(200)]
    got = spark.createDataFrame(list(enumerate(pairs)), "i int, p struct<a:string,b:string>").select("i", diff.edit_operations(F.col("p.a"), F.col("p.b")).alias("o")).collect()
    for g in got:
        a, b = pairs[g.i]
        assert g.o is None if a is None or b is None else [tuple(o) for o in g.o] == difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    rebuilt = spark.createDataFrame([("官鬼特世，子水", "官鬼持世，予水")], "a string, b string").withColumn("o", diff.edit_operations(F.col("a"), F.col("b")))
    (row,) = rebuilt.select(diff.changes(F.col("o"), F.col("a"), F.col("b"), ["持世"], "[子丑]").alias("c")).collect()
    assert [(c.at, c.old, c.new, c.proposed, c.flagged) for c in row.c] == [(2, "特", "持", True, False), (5, "子", "予", False, True)]


def test_similar_pairs(spark):
    r = random.Random(5)
    base = ["".join(r.choice("甲乙丙丁戊己") for _ in range(30)) for _ in range(6)]
    rows = []
    for i in range(80):
        t = list(r.choice(base))
        for _ in range(r.randrange(4)):
            t[r.randrange(len(t))] = r.choice("甲乙庚")
        rows.append((i, r.choice(["x", "y", None]), "".join(t), r.choice([None, "2001-01-01", "2001-01-02"])))
    rows += [(90, "x", None, None), (91, "x", "", None), (92, "x", base[0], None), (93, "x", base[0], None)]
    df = spark.createDataFrame(rows, "k int, block string, text string, date string")
    pairs = {(p.a, p.b): p.ratio for p in graph.similar_pairs(df, "k", ["block"], "text", "date").collect()}
    want = {}
    for a, x, s, d in rows:
        for b, y, t, e in rows:
            if a < b and x and x == y and s and t and not (d and e and d != e):
                q = difflib.SequenceMatcher(None, s, t, autojunk=False).ratio()
                if q >= (0.85 if d and d == e else 0.97):
                    want[a, b] = q
    text = {k: (b, t, d) for k, b, t, d in rows}
    assert all(want.get(p, want.get((p[1], p[0]))) is not None or text[p[0]] == text[p[1]] for p in pairs)

    def groups(edges):
        root = {k: k for k in text}
        for _ in range(len(text)):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert groups(pairs) == groups(want) and len(set(groups(pairs).values())) < len(text)


def test_closure(spark):
    edges = [(i, i - 1) for i in range(1, 300)] + [(1000, 5), (1001, 1000), (0, None), (2000, None)]
    got = {(p.ancestor, p.descendant): p.distance for p in trees.closure_of(spark.createDataFrame(edges, "child int, parent int")).collect()}
    assert got[0, 299] == 299 and got[5, 1001] == 2 and got[0, 1001] == 7 and len(got) == 299 * 300 // 2 + 6 + 7
    assert trees.closure_of(spark.createDataFrame([(1, None)], "child int, parent int")).collect() == []
    for loop in ([(1, 1)], [(1, 2), (2, 3), (3, 1)]):
        with pytest.raises(ValueError, match="cycle"):
            trees.closure_of(spark.createDataFrame(loop, "child int, parent int")).collect()


def test_anchors(spark):
    text = spark.createDataFrame([("a", i + 1, t) for i, t in enumerate(["x", "y", "x", "z", "x", None])] + [("b", 1, "x")], "source string, n int, text string")
    asked = [("a", "1", 1, "x"), ("a", "2", 2, "x"), ("a", "3", 4, "y"), ("a", "4", 2, "q"), ("a", "5", 9, "x"), ("a", "6", None, "x"), ("c", "7", 1, "x"), ("b", "8", 1, "x"), ("a", "9", 2, "x"), ("a", "10", 6, None)]
    got = {r.key: (r.verdict, r["at"]) for r in trees.anchored(spark.createDataFrame(asked, "source string, key string, line int, anchor string"), text).collect()}
    assert got == {"1": ("held", 1), "2": ("moved", 1), "3": ("moved", 2), "4": ("lost", None), "5": ("out_of_range", 5), "6": ("out_of_range", None) if got["6"][1] is None else ("out_of_range", got["6"][1]), "7": ("no_source", None), "8": ("held", 1), "9": ("moved", 1), "10": ("held", 6)}


def test_difference(spark):
    r = random.Random(6)
    made = lambda n: [(r.randrange(4), (s := r.randrange(60)), s + r.randrange(-1, 12)) for _ in range(n)] + [(None, 1, 5), (1, None, 5)]
    a, b = made(60), made(25)
    frame = lambda x: spark.createDataFrame(x, "k int, start int, end int")
    got = [(g.k, g.start, g.end) for g in spans.difference(frame(a), frame(b), ["k"], "start", "end").collect()]
    covered = lambda x: {(k, p) for k, s, e in x if s is not None for p in range(s, e)}
    assert {(k, p) for k, s, e in got for p in range(s, e)} == covered(a) - covered(b)
    assert len({(k, e) for k, _, e in got} & {(k, s) for k, s, _ in got}) == 0  # merged
    assert spans.difference(frame(a).where("false"), frame(b), ["k"], "start", "end").collect() == []


def test_late_spans_never_enter_the_first_text(spark):
    rows = [("u", "question", 0, 10, False), ("u", "background", 10, 30, None), ("u", "background", 12, 15, True), ("u", "feedback", 40, 50, False), ("v", "question", 0, 5, False), ("v", "background", 5, 9, True), ("w", "question", 3, 4, True)]
    got = {(r.unit, r.start, r.end, r.overlapped) for r in spans.disclosed(spark.createDataFrame(rows, "unit string, role string, start int, end int, late boolean"), ["unit"], ["question", "background"]).collect()}
    assert got == {("u", 0, 12, True), ("u", 15, 30, True), ("v", 0, 5, False)}


def test_matching(spark):
    pairs = [("a", 1, 2, 0), ("a", 2, 1, 1), ("b", 3, 1, 0), ("b", 4, 1, 0), ("c", 5, 0, 0), ("d", 6, 1, 2), ("e", 7, 1, 0), ("f", 7, 1, 0), ("g", None, 1, 0), ("h", 8, None, None)]
    got = matching.matched(spark.createDataFrame(pairs, "l string, r int, evidence int, conflicts int"), spark.createDataFrame([(x,) for x in "abcdefgh"] + [("a",)], "l string"), "l", "r")
    assert {(x.l, x.r, x.status) for x in got.collect()} == {("a", 1, "matched"), ("b", None, "ambiguous"), ("c", None, "insufficient_evidence"), ("d", None, "conflict"), ("e", None, "ambiguous"), ("f", None, "ambiguous"), ("g", None, "missing"), ("h", None, "insufficient_evidence")}


def test_matching_of_alike_candidates(spark):
    rows = [("a", 1, 2, 0, 1), ("a", 2, 2, 1, 4), ("b", 3, 1, 0, 3), ("c", 6, 0, 0, 2), ("d", 7, 1, 2, 5), ("e", 1, 0, 1, 1), ("f", None, 1, 0, 2)]
    wanted = spark.createDataFrame([(x,) for x in "abcdefg"], "l string")
    alike = matching.matched(spark.createDataFrame(rows, "l string, r int, evidence int, conflicts int, n int"), wanted, "l", "r", "n").collect()
    pairs = spark.createDataFrame([(p, r and r + 10 * i, e, c) for p, r, e, c, n in rows for i in range(n)], "l string, r int, evidence int, conflicts int")
    assert sorted(map(tuple, alike)) == sorted(map(tuple, matching.matched(pairs, wanted, "l", "r").collect()))
    assert {x.l: (x.status, x.n_candidates, x.n_compatible) for x in alike}["b"] == ("ambiguous", 3, 3)


def test_text_coverage_takes_linear_time(spark, tmp_path):
    import time

    from lodestone.plans import catalogue

    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab é𝒳\n\u00a0") for _ in range(n)) for n in (1, 59, 60, 61, 99, 100, 255, 256, 257, 1_000, 1_000_000)] + ["", " " * 300, None]
    spark.createDataFrame([*enumerate(texts)], "doc_id int, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    began = time.perf_counter()
    got = {r.doc_id: (r.total, r.covered, r.gaps) for r in catalogue.QUERIES["text_coverage"](spark, str(tmp_path)).collect()}
    took = time.perf_counter() - began
    solid = lambda t: len(re.sub(r"\s", "", t))
    cut = lambda t, at, size: [t[i + at : i + at + size] for i in range(0, len(t) + 1, 100)]
    assert got == {i: (solid(t), sum(map(solid, cut(t, 0, 60))), sum(solid(x) > 0 for x in cut(t, 60, 40))) for i, t in enumerate(texts) if t is not None}
    assert took < 15  # each interval once read the whole text


def test_tree_hash(spark):
    import hashlib

    from lodestone.operators import records

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [(i, f"text {i}") for i in range(300)] + [(None, "x"), (5, None), (5, ""), (5, ""), (0, "text 0")]
    marked = lambda v: sha("0" if v is None else f"1{v}")
    nodes = {}
    for k, v in rows:
        nodes.setdefault(marked(k)[:3], []).append(marked(k) + marked(v))
    for level in (2, 1, 0):
        up = {}
        for p, h in nodes.items():
            up.setdefault(p[:level], []).append(p + sha("".join(sorted(h))))
        nodes = up
    got = lambda r: records.tree_hash(spark.createDataFrame(r, "k int, v string"), F.col("k"), F.col("v")).collect()
    assert [x.tree_hash for x in got(rows)] == [sha("".join(sorted(nodes[""])))] == [x.tree_hash for x in got(rows[::-1])]
    assert got(rows) != got(rows[:-1]) and got([]) == []


def test_instants_by_terms(spark):
    from lodestone.functions import calendar

    terms = spark.sql("SELECT * FROM VALUES (TIMESTAMP '2024-02-04 08:27:00', 2), (TIMESTAMP '2024-03-05 02:23:00', 3), (TIMESTAMP '2024-05-05 08:10:00', 5), (TIMESTAMP '2024-06-05 12:10:00', 6) t(instant, branch)")
    times = ["2024-02-04 08:26:59", "2024-02-04 08:27:00", "2024-02-29 23:59:59", "2024-03-05 02:22:59", "2024-03-05 02:23:00", "2024-04-15 00:00:00", "2024-05-05 08:09:59", "2024-06-05 12:09:59", "2024-06-05 12:10:00", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t string").select("i", F.to_timestamp("t").alias("at"), F.lit(1).alias("_m"))
    got = {r.i: r.branch for r in calendar.by_terms(df, "at", terms).collect()}
    assert [got[i] for i in range(10)] == [None, 2, 2, 2, 3, 3, 3, 5, None, None]


def test_case_cards(spark):
    text = "\n".join(["卯月乙丑日占求婚成否", *ROWS, "断曰：以妻财为用神。", "", "话" * 1395, "", "果于午日允婚。", "结果如此。"])
    made = cases.validated(cases.extracted(lines(spark, text)))
    (card,) = cases.cards(made).collect()
    assert card.interpretation.has_more and card.interpretation.quote == "断曰：以妻财为用神。" and card.quality == "pending"
    assert (card.question, card.cast.day, card.choices, card.outcome.status, card.extraction.validation) == ("卯月乙丑日占求婚成否", "乙丑", ["妻财"], "reported_explicit", "calculated")
    assert (card.span.start_line, card.span.end_line) == (1, 13)
    reviewed = spark.createDataFrame([(card.case_id, "eligible", "read")], "case_id string, quality string, reason string")
    assert [(c.quality, c.reason) for c in cases.cards(made, reviewed).collect()] == [("eligible", "read")]


def test_steps_of_a_question_are_worked_out_once(spark):
    """what is read several times is bound; written in line, the cast's pattern stood in the expression dozens of times."""
    size = lambda c: c._jc.toString().count("占得|得")
    assert size(cases.question(F.col("h"), F.col("a"))) <= 2
    assert places(F.upper("t"), "A+")._jc.toString().count("regexp_replace") == 1


@pytest.mark.parametrize("row, value", [("父母子孙子水′", 1), ("子孙巳火 官鬼午火○", 3), ("官鬼午火′ 动", 3), ("父母 官鬼午火×", 0)])
def test_rows_of_one_and_more_labels(spark, row, value):
    (got,) = spark.createDataFrame([(row,)], "t string").select(cases.main_row(F.col("t"), cases.drawn_first(F.col("t"))).alias("r")).collect()
    assert got.r.value == value


def test_rules_of_cases_that_meet_often(spark):
    """a rule meets a block's covered places once, not each case; blank places don't count."""
    from lodestone.operators import search

    rules = spark.createDataFrame([("a", 1, "s", 0, 130, "x" * 70 + " " * 60), ("b", 2, "s", 60, 70, "  y       "), ("c", 3, "s", 100, 103, "zzz"), ("d", 3, "t", 0, 5, "wwwww")], "evidence_id string, group_id int, source_id string, start long, end long, text string")
    cases_ = spark.createDataFrame([("s", 75, 90)] * 50 + [("s", 62, 63), ("s", 102, 200)], "source_id string, start long, end long")
    out = search.blocked_rules(rules, cases_)
    assert {r.evidence_id for r in out.collect()} == {"a", "b", "c", "d"}
    assert {r.evidence_id for r in search.blocked_rules(rules, cases_.where("start = 75")).collect()} == set()
    assert "_covered" in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_span_without_an_end_makes_no_gap(spark):
    """spans of unknown place come last, as in SQL; before, a gap began at null."""
    own = spark.createDataFrame([(1, None, None), (1, 0, 3), (1, 5, 6)], "k int, s long, e long")
    assert [tuple(r) for r in spans.gaps(own, ["k"], "s", "e").collect()] == [(1, 3, 5)]


def test_topics_that_are_not_known_agree_as_in_sql(spark, tmp_path):
    """lines without number or part come last, and unknown topics leave `topk` open; equal lines are in table order."""
    import duckdb

    from lodestone.plans import catalogue

    rows = [(1, 1, 1, None), (1, 2, 1, 2), (2, 1, 3, None), (2, 1, 4, 5), (3, 1, None, 1), (3, None, None, 1), (4, 1, 4, 1), (None, 1, 4, 1), (5, 2, 5, None), (5, 2, 5, 1), (5, 2, 5, 2), (5, 2, 6, 3), (5, 2, 5, 4), (6, 3, 7, 1), (6, 3, 6, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"SET threads = 1; CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(catalogue.ORACLE_SQL["topic_agreement"]).fetchall()
    got = {tuple(r) for r in catalogue.QUERIES["topic_agreement"](spark, str(tmp_path)).collect()}
    assert got == set(want) and (3, False, None) in got and (6, False, True) in got


def test_unions_by_rows_of_a_task_equal_sql(spark, tmp_path, monkeypatch):
    """tasks grow in number with the rows, and no union is hashed; unknown numbers and equal lines as in SQL."""
    import random

    import duckdb

    from lodestone.plans import catalogue

    monkeypatch.setattr(spans, "TASK_ROWS", 50)
    r = random.Random(13)
    rows = [(r.choice([1, 2, None]), r.choice([None, *range(200)]), r.choice([None, -9, 1, 2, 7])) for _ in range(700)]
    rows += [(1, None, 1), (1, None, 1), (3, 5, None), (3, 5, None), (4, 5, None), (4, 5, 2), (5, 1, 9), (5, 20, None), (6, 5, -9), (6, 5, -9)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_linenumber int").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"SET threads = 1; CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(catalogue.ORACLE_SQL["range_merge"]).fetchall()
    out = catalogue.QUERIES["range_merge"](spark, str(tmp_path))
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "RepartitionByExpression" in plan


def test_orders_without_date_stay_apart_as_in_sql(spark, tmp_path):
    """each order without a date is a span of its own; equal dates are one span, and unknown customers are one group."""
    import datetime
    from collections import Counter

    import duckdb

    from lodestone.plans import catalogue

    day = lambda n: None if n is None else datetime.datetime(1996, 1, 1) + datetime.timedelta(n)
    rows = [(1, None), (1, None), (1, None), (1, 5), (1, 5), (1, 35), (1, 66), (2, None), (2, None), (None, None), (None, None), (None, 3), (None, 3), (3, 9)]
    spark.createDataFrame([(i, k, day(n)) for i, (k, n) in enumerate(rows)], "o_orderkey long, o_custkey long, o_orderdate timestamp").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"SET threads = 1; CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    for name in ("span_merge", "coverage_gaps"):
        want = con.sql(catalogue.ORACLE_SQL[name]).fetchall()
        assert Counter(map(tuple, catalogue.QUERIES[name](spark, str(tmp_path)).collect())) == Counter(want), name


@pytest.mark.parametrize("name", ["case_segments", "case_conflicts"])
def test_books_are_cut_into_cases_on_one_shuffle(spark, tmp_path, name):
    """lines are made, windowed and gathered where their source's orders are; none are shuffled, joined or written between."""
    import os

    from lodestone.plans import catalogue

    day = F.to_timestamp(F.lit("1996-01-01")) + F.expr("make_dt_interval(cast(o_orderkey as int))")
    keys = spark.range(60).select(F.col("id").alias("o_orderkey"), F.when(F.col("id") % 11 != 0, F.col("id") % 4).alias("o_custkey"))
    keys.select("*", day.alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority")).write.parquet(f"{tmp_path}/orders.parquet")
    written = lambda: {x for top, _, _ in os.walk(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) for x in [top]}
    before = written()
    out = catalogue.QUERIES[name](spark, str(tmp_path))
    got = out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange ") == 1 and "Join" not in plan and written() == before
    own = [r for r in got if (r.source if name == "case_segments" else r.case_id) is None]
    assert len(own) == 4 and len(got) == 45  # orders without a customer are one book: 0, 22, 33 and 44 show six rows, 11 and 55 four
