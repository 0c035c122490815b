"""The pipeline on a small corpus: each stage's decisions take effect, and clean documents stay."""

import random

import corpus_pipeline
import pytest
from lodestone.llm import queries

WORDS = "amber birch cedar delta ember frost grove heath inlet jetty knoll larch maple north ocean pearl quill ridge shore thorn".split()


def text(r, n, line=12):
    w = [r.choice(WORDS) + str(r.randrange(400)) for _ in range(n)]
    return "\n".join(" ".join(w[i : i + line]) for i in range(0, n, line))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d, r = str(tmp_path_factory.mktemp("corpus")), random.Random(4)
    docs, labels = [], []
    for i in range(300):
        t = text(r, r.randrange(40, 90))
        if i % 4 == 0:
            w = t.split(" ")
            for _ in range(5):
                w.insert(r.randrange(len(w)), r.choice(["vilex", "grubno", "snarlo"]))
            t = " ".join(w)
        docs.append(t)
        labels.append((i, 1, int(i % 4 == 0)))
    bench = [text(r, 30, 30) for _ in range(5)]
    docs += [docs[1], docs[2].replace("\n", " \n"), "a b\n" + bench[0] + " tail", docs[5] + "\nextra line at the end of it", None, ""]
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs


def test_stages(spark, corpus):
    d, docs = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "packing"]
    own = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = own.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        own = stage(spark, own, d)
        assert own.columns == columns
        path = f"{d}/{name}"
        own.write.parquet(path)
        own = spark.read.parquet(path)
        seen.append({r.doc_id: r.text for r in own.collect()})
    toxic, lines, groups, clean = seen
    bad = {i for i in range(300) if i % 4 == 0}
    assert len(bad & toxic.keys()) <= 2 and len(set(range(len(docs))) - bad - toxic.keys()) <= 2
    assert lines.keys() == toxic.keys()
    assert lines[300] == lines[301] == "" and lines[303] == "extra line at the end of it" and lines[1] == docs[1] and lines[304] is None
    assert groups.keys() == lines.keys()  # what the lines left differs
    assert groups.keys() - clean.keys() == {302}
    packed = corpus_pipeline.STAGES[-1][1](spark, own, d).toPandas()
    assert set(packed.doc_id) == clean.keys() and packed.groupby("sequence_id").length.sum().max() <= 2048
    assert {r.doc_id for r in corpus_pipeline.run(spark, d).select("doc_id").distinct().collect()} == clean.keys()


def test_one_of_each_group_stays(spark, corpus):
    d, docs = corpus
    own = spark.read.parquet(f"{d}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, own, d).collect()}
    assert set(range(len(docs))) - kept == {300, 301, 303}


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)} and len(queries.QUERIES) == 13
