"""Every registered query against its DuckDB SQL, on the smallest tables."""

import glob
import hashlib
import math
import os

import duckdb
import pandas as pd
import pytest

from lodestone.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return ""
        return str(round(float(v), 5)) if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind in "fiu" or isinstance(v, int) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def test_each_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL) and len(catalogue.QUERIES) >= 45


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_line_split_takes_all_documents(spark, tmp_path):
    """Against str.splitlines, which has the same line ends."""
    ends = ["\r\n", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
    texts = ["", "one", "\n", "\n\r", *(f"a{e}{e} b{e}" for e in ends), *(f"{e}a{e}b" for e in ends), "a\r\n\r\nb\n\r", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_blank, r.first_sha256) for r in catalogue.QUERIES["line_split"](spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        if text is not None:
            lines = text.splitlines()
            first = hashlib.sha256(lines[0].encode()).hexdigest() if lines else None
            assert got[i] == (len(lines), sum(not v.strip(" ") for v in lines), first), repr(text)
    assert len(got) == len(texts)


def test_reuse_in_other_case_and_punctuation_is_found(spark, tmp_path):
    passage = "The quick brown fox jumps over the lazy dog, while five boxing wizards jump quickly by 已 and 戍."
    reused = "So: " + passage.upper().replace(" ", "\n- ").replace("已", "巳").replace("戍", "戌") + " End."
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(7, reused), (8, "nothing of the kind stands here, not at all, in no way")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    norm = "".join(c for c in passage.lower() if c.isalnum())
    (got,) = catalogue.QUERIES["shingle_overlap_normalized"](spark, str(tmp_path)).collect()
    assert (got.q_id, got.d_id, got.n_windows, got.longest) == (1, 7, (len(norm) - 32) // 8 + 1, len(norm))
