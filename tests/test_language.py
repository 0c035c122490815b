"""Tokens, windows and topics of texts in the corpus's own language."""

import json

import pytest
from lodestone.functions import lexicon
from lodestone.operators import classify
from pyspark.sql import functions as F

CATALOGUE = {
    "study": ("学业", "考试 学习 学业", {"exam": ("考试成绩", "考试 考试成绩"), "progress": ("学业进展", "学习")}),
    "health": ("健康", "病 身体 医院 手术", {"course": ("病情变化", "病情"), "treatment": ("就医治疗", "手术 医院 看病 医生")}),
    "job": ("工作", "工作 求职 班主任", {"offer": ("录用", "录用 应聘"), "change": ("变动", "调动")}),
    "wealth": ("财运", "求财 生意 店", {"debt": ("借贷", "还钱 借款"), "income": ("收入", "财运 求财")}),
    "property": ("房产", "房子 住房 分房", {"allocation": ("住房分配", "分房 申请住房 要住房")}),
    "lost": ("失物", "丢失 走失 失物", {"person": ("寻人", "走失 出走")}),
    "travel": ("出行", "出行 出差 回来", {"return": ("归期", "回来 回家 何时回")}),
    "weather": ("天气", "天气 下雨", {"weather": ("天气变化", "天气 下雨")}),
    "affairs": ("事务", "比赛", {"competition": ("比赛", "比赛"), "assistance": ("求助", "帮忙")}),
    "cooperation": ("合作", "合作 合同", {"partner": ("合作对象", "合伙人")}),
    "relationship": ("感情", "男友 感情", {"separation": ("分离", "离婚")}),
}


@pytest.fixture(scope="module")
def catalogue(spark, tmp_path_factory):
    rows = []
    for r, (title, aliases, children) in CATALOGUE.items():
        rows.append({"id": r, "parent": None, "title": title, "aliases": aliases.split()})
        rows += [{"id": f"{r}/{k}", "parent": r, "title": t, "aliases": a.split()} for k, (t, a) in children.items()]
    path = tmp_path_factory.mktemp("catalogue") / "topics.json"
    path.write_text("\n".join(json.dumps(x, ensure_ascii=False) for x in rows), encoding="utf-8")
    return classify.Catalogue.read(spark, str(path))


@pytest.mark.parametrize(("text", "roots"), [
    ("借出去的钱什么时候能收回来？", {"wealth"}),
    ("借出去的钱什么时候能收回来？另外问出差的丈夫何时回来", {"wealth", "travel"}),
    ("某女测工作单位分房可得到否", {"property"}),
    ("身体有病会不会影响考试", {"health", "study"}),
    ("工作发展和申请住房都顺利吗", {"job", "property"}),
    ("看病时把钱包丢失", {"lost"}),
    ("当时跟随我学习，测雨何时停", {"weather"}),
    ("先测学习进展，再问比赛名次", {"study", "affairs"}),
    ("孩子走失后没有消息，问安危与下落", {"lost"}),
    ("女儿走失三天，问何时能回来", {"lost", "travel"}),
    ("男友怎么样", {"relationship"}),
    ("官鬼不见，求测人：男", set()),
    ("问风水如何", set()),
])
def test_classify(catalogue, text, roots):
    assert set(catalogue.classify(text)["roots"]) == roots


def test_background_and_order(catalogue):
    assert catalogue.classify("工作单位分房")["background"] == ["工作单位"]
    assert "看病时" in catalogue.classify("看病时把钱包丢失")["background"]
    got = catalogue.classify("行舟占顺风")
    assert got["topic_ids"] == ["weather", "weather/weather"] and got["topic"] == "weather"
    assert catalogue.classify(None)["status"] == "unknown"


def test_rules_and_names(catalogue):
    rule = lambda *a: catalogue.classify_rule(*a)["scope"]
    assert rule("日辰与月建", "这里讨论日月生克", [], "lifa") == "common" and rule("第三章 冲", "text", [], "lifa") == "common"
    assert rule("未识别标题", "不明内容", [], "lifa") == "unknown" and rule("朱雀", "文书", [], "xiangfa") == "scene"
    assert rule("考试", "x", [], "lifa") == "subtopic" and rule("y", "", ["能否录用"], "lifa") == "example"
    assert rule("x", "关于下雨的事", [], "lifa") == "subtopic"
    assert catalogue.resolve("学业", "exam") == ("study", "study/exam") and catalogue.resolve(None, "分离") == ("relationship", "relationship/separation")
    assert catalogue.resolve() == (None, None)
    for bad in (("study", "health/course"), ("none", None), ("study/exam", None), (None, "study")):
        with pytest.raises(ValueError):
            catalogue.resolve(*bad)


def test_tiers_and_declared(spark, catalogue):
    rows = [("a", "topic", ["study"], ["study", "study/exam"]), ("b", "topic", ["study"], ["study"]), ("c", "common", [], []), ("d", "unknown", [], []), ("e", "topic", ["job"], ["job"])]
    df = spark.createDataFrame(rows, "id string, scope string, roots array<string>, topic_ids array<string>")
    got = {r.id: (r.x, r.y, r.z) for r in df.select("id", classify.tier(F.col("scope"), F.col("roots"), F.col("topic_ids"), "study", "study/exam").alias("x"), classify.tier(F.col("scope"), F.col("roots"), F.col("topic_ids"), "study", None, False).alias("y"), classify.tier(F.col("scope"), F.col("roots"), F.col("topic_ids"), None, None, False).alias("z")).collect()}
    assert got == {"a": (0, 0, 0), "b": (1, 0, 0), "c": (2, None, None), "d": (3, 3, 0), "e": (None, None, 0)}
    own = classify.declared(spark.createDataFrame([(1, ["study/exam", "study"]), (2, None)], "id int, topic_ids array<string>"), catalogue)
    assert {r.id: (r.roots, r.status) for r in own.collect()} == {1: (["study"], "declared"), 2: ([], "unknown")}
    with pytest.raises(ValueError):
        classify.declared(spark.createDataFrame([(1, ["nope"])], "id int, topic_ids array<string>"), catalogue)


def test_classified_column(spark, catalogue):
    df = spark.createDataFrame([(1, "能否录用"), (2, None), (3, "")], "id int, q string").select("id", classify.classified(F.col("q"), catalogue).alias("c"))
    got = {r.id: r.c for r in df.collect()}
    assert got[1].topic == "job" and got[1].evidence[0].terms == ["录用"] and got[2].status == got[3].status == "unknown"


LEXICON = lexicon.Lexicon(["父母", "生世", "旬空", "官鬼", "工作", "发动"], {"空亡": "旬空", "求职": "工作"}, ["发动", "旬空", "空亡", "生世"], {"我们": 50, "今天": 40})


def test_tokens(spark):
    assert LEXICON.tokens("**父母生世** &amp; <b>官鬼</b>未发动") == ["父母", "生世", "官鬼", "未发动", "未发动"]
    assert LEXICON.tokens("求职 [遇](x) 空亡") == ["求职", "遇", "空亡", "工作", "旬空"]
    assert LEXICON.tokens("并非空亡") == ["并非空亡", "未空亡"] and LEXICON.negations("并非空亡，官鬼") == ["并非空亡"]
    assert LEXICON.query_terms("请问我的工作工作") == ["问", "工作"]
    assert LEXICON.query_terms("的 了") == [] and LEXICON.tokens(None) == []
    got = spark.createDataFrame([("求职", ), (None,)], "t string").select(lexicon.tokenized(F.col("t"), LEXICON).alias("x")).collect()
    assert [r.x for r in got] == [["求职", "工作"], []]
    (row,) = spark.createDataFrame([("a<br>b &eacute; ![x](y) _z_",)], "t string").select(lexicon.plain_text(F.col("t")).alias("x")).collect()
    assert row.x == "a b é z"


def test_windows_cover_the_text(spark):
    text = "x" * 1000
    got = lexicon.bisected(text, len, 200)
    assert got[0][0] == 0 and got[-1][1] == 1000 and all(b - a <= 200 for a, b in got)
    assert all(c <= b for (_, b), (c, _) in zip(got, got[1:])) and got == sorted(got)
    for bad in ((text, len, 7, ""), (text, len, 20, "q" * 20), ("y" * 9, lambda t: 99, 50, "")):
        with pytest.raises(ValueError):
            lexicon.bisected(*bad)
    (row,) = spark.createDataFrame([(text,)], "t string").select(lexicon.text_windows(F.col("t"), len, 200).alias("w")).collect()
    assert [(w.start, w.end) for w in row.w] == got


def test_search_texts(spark):
    df = spark.createDataFrame([("case", "q", '["a"]', None, ["f1"], "ch", "t", ["c1"], ["p", "r"], ["h"]), ("rule", None, None, "1", [], "ch", "t", [], ["p"], [])], "kind string, q string, x string, y string, facts array<string>, chapter string, text string, contexts array<string>, titles array<string>, hints array<string>")
    case = lexicon.case_text(F.col("q"), {"X": F.col("x"), "Y": F.col("y")}, F.col("facts"))
    got = df.select(case.alias("c"), lexicon.document_text(F.col("kind"), F.col("chapter"), F.col("text"), F.col("contexts"), case).alias("d"), lexicon.navigation_text(F.col("titles"), F.col("hints")).alias("n")).collect()
    assert got[0].c == 'q\nX：["a"]\nf1' and got[0].d == got[0].c and got[0].n == "p r h"
    assert got[1].d.startswith("ch\nt") and got[1].n == "p"
