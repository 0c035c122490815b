"""The registered queries on a folder of tables: contract columns, and SQL where there is some."""

import glob
import os
import zlib

import duckdb
import pandas as pd
import pytest

from lodestone.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

COLUMNS = {
    "op1_quality": ["doc_id", "held_out", "score", "predicted"],
    "op2_embedding_near_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op3_token_counts": ["doc_id", "n_tokens", "score"],
    "op4_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op5_ngram_jaccard": ["doc_id", "n_shingles", "component_id"],
    "op6_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op7_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op8_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op9_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op10_line_dedup": ["doc_id", "n_removed", "n_chars", "text_sha256"],
    "op12_embedding_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    "op13_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="module")
def results(spark):
    return {name: query(spark, DATA).toPandas() for name, query in queries.QUERIES.items()}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(results, duck, name):
    got = results[name]
    assert set(COLUMNS[name]) <= set(got.columns)
    key = COLUMNS[name][0]
    table = {"vec_id": "embeddings", "page_id": "pages"}.get(key, "documents")
    ids = sorted(r[0] for r in duck.execute(f"SELECT {key} FROM {table}").fetchall())
    assert sorted(got[key].unique() if name in ("op4_packing", "op12_embedding_whitening") else got[key]) == ids


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(results, duck, name):
    got, want = results[name], duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    own, other = (sorted(map(tuple, x[sorted(x.columns)].astype(str).to_numpy().tolist())) for x in (got, want))
    assert own == other


@pytest.mark.parametrize(("name", "mod", "rest"), [("op1_quality", 5, 0), ("op6_toxicity", 4, 2)])
def test_scores(results, duck, name, mod, rest):
    got = results[name]
    assert (got.held_out == [zlib.crc32(str(i).encode()) % mod == rest for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    label = {"op1_quality": "quality", "op6_toxicity": "toxic"}[name]
    y = pd.Series(dict(duck.execute(f"SELECT doc_id, {label} FROM labels WHERE {label} IS NOT NULL").fetchall()))
    seen = got[got.doc_id.isin(y.index)]
    assert ((seen.score >= 0.5) == (y[seen.doc_id].to_numpy() == 1)).mean() > 0.8


def test_lists_and_lengths(results):
    licenses, pages = results["op7_license_scan"], results["op8_html_extraction"]
    assert all(x == ",".join(sorted(set(x.split(",")))) for x in licenses.labels) and all(set(b.split(",")) <= set(own.split(",")) for b, own in zip(licenses.base_labels, licenses.labels) if b)
    assert (licenses.first_word.isna() == (licenses.n_base == 0)).all() and licenses.score.between(0, 1).all()
    assert (pages.n_chars == pages.text.str.len()).all()


def test_pieces_fill_sequences(results):
    got = results["op4_packing"].sort_values(["sequence_id", "offset"])
    ends = got.offset + got.length
    same = got.sequence_id.eq(got.sequence_id.shift())
    assert (got.offset[~same] == 0).all() and (got.offset[same] == ends.shift()[same]).all() and ends.max() <= 2048
    assert (got.groupby("doc_id").length.sum() == got.groupby("doc_id").doc_tokens.first()).all()


def test_language_model(results):
    got = results["op13_lm_scoring"]
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 10 == 0 for i in got.doc_id]).all()
    assert got[~got.held_out].n_tokens.sum() == got.train_tokens[0] and (got[~got.held_out].n_known == got[~got.held_out].n_tokens).all()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() * 0.9


def test_variants_and_whitening(results):
    words, white = results["op11_spelling_variants"], results["op12_embedding_whitening"]
    assert set(words.columns) == {"word", "form", "root", "n", "n_near", "form_n"} and words.word.is_unique and (words.n >= 2).all() and (words.word.str.len() >= 7).all()
    assert (words.form_n.dropna() >= 10 * words.n[words.form_n.notna()]).all() and (white.identity_error < 1e-4).all() and (white.groupby("vec_id").size() == 8).all()
