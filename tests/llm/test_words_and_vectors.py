"""Spelling variants, whitening and language-model scoring against brute-force versions, with nulls, empties, ties, repeats and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import elias_fano, ngram_lm, spelling, whitening
from lodestone.llm.common import crc32_mod

DOCS = "doc_id long, text string, word string, n int, block int, rank string, key int, count int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, 2, "r", 3, 4) for i, t in rows], DOCS)


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- spelling variants


def variants_by_hand(rows):
    c = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = folded(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            c[w] += 1
    c = {w: n for w, n in c.items() if len(w) >= 7 and n >= 2}
    near = defaultdict(set)
    same = defaultdict(set)
    for w in c:
        for i in range(len(w)):
            same[w[:i], w[i + 1 :]].add(w)
            if (u := w[:i] + w[i + 1 :]) in c:
                near[w].add(u)
                near[u].add(w)
    for group in same.values():
        for w in group:
            near[w] |= group - {w}

    def form(w):
        best = min(near[w], key=lambda u: (-c[u], u), default=None)
        return best if best and c[best] >= 10 * c[w] else None

    out = set()
    for w, n in c.items():
        root = w
        while form(root):
            root = form(root)
        f = form(w)
        out.add((w, n, len(near[w]), f, c.get(f), root))
    return out


def spelled(seed):
    """Words of few letters in any order, so that many share a key; chains of forms; ties."""
    r = random.Random(seed)
    base = ["".join(r.choice("abcé") for _ in range(r.randrange(6, 10))) for _ in range(120)]
    words = []
    for w in base:
        words += [w] * r.choice([1, 2, 3, 40])
        for _ in range(3):
            i = r.randrange(len(w))
            words += [r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abcÿ") + w[i + 1 :], w[:i] + r.choice("ab") + w[i:]])] * r.choice([2, 3, 30, 400])
    words += ["mississippi"] * 500 + ["mississippii"] * 40 + ["mississippiii"] * 3 + ["STRASSE" + "É", "STRASSE" + "é"] * 3
    r.shuffle(words)
    rows = [(i, " ".join(words[i::40])) for i in range(40)]
    return [*rows, (3, rows[3][1]), (None, "mississippi abcabca-abcabca"), (77, None), (78, ""), (79, "12 日本 34"), (80, "x" * 30_000), (81, "x" * 30_000), (82, "x" * 29_999 + "y")]


@pytest.mark.parametrize("crowd", [1, 64])
def test_variants(spark, monkeypatch, crowd):
    monkeypatch.setattr(spelling, "CROWD", crowd)
    rows = spelled(crowd)
    got = [tuple(r) for r in spelling.variants(frame(spark, rows)).select("word", "n", "n_near", "form", "form_n", "root").collect()]
    want = variants_by_hand(rows)
    assert len(got) == len(want) and set(got) == want
    assert any(r[5] not in (r[0], r[3]) for r in got)  # a chain of two steps


def test_no_variants(spark):
    for rows in ([], [(1, None)], [(1, "short words")]):
        out = spelling.variants(frame(spark, rows))
        assert out.columns == ["word", "n", "n_near", "form", "form_n", "root"] and not out.collect()


def test_counts_come_out_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "DISTINCT", 3)
    rows = spelled(5)
    assert {(r.word, r.n) for r in spelling.words(frame(spark, rows)).collect()} == {w[:2] for w in variants_by_hand(rows)}


# --- whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "c") for i, v in rows], "vec_id long, embedding array<float>, x0 int, component string")


def test_whitening(spark):
    g = np.random.default_rng(0)
    v = (g.normal(size=(300, 12)) @ g.normal(size=(12, 12)) / 8).astype(np.float32)
    v[7] = v[8]
    bad = [(900, None), (901, []), (902, [1.0] * 5 + [None] * 7), (903, [float("nan")] * 12), (904, [float("inf")] + [0.0] * 11), (905, [1.0, 2.0])]
    rows = [(i % 290, list(map(float, x))) for i, x in enumerate(v)] + [(None, [0.0] * 12)]
    got = whitening.whiten(vectors(spark, rows + bad)).toPandas()
    x = np.floor(np.array([r[1] for r in rows]).astype(np.float32).astype(float) * 1024).astype(np.int64) + 100000
    n, s = len(x), x.sum(0)
    centred = x - s / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    assert len(got) == 8 * n and got.vec_id.isna().sum() == 8 and set(got.n) == {n}
    assert sorted(got[got.component == 1].deviation) == sorted(((n * x - s) ** 2).sum(1))
    for k in range(8):
        own = got[got.component == k + 1].sort_values(["vec_id", "deviation"])
        assert np.allclose(own.explained, e[k] / e.sum(), rtol=1e-9)
        want = centred @ axes[:, k] / np.sqrt(e[k])
        assert np.allclose(sorted(np.abs(own.whitened)), sorted(np.abs(want)), atol=1e-9)
        assert min(np.abs(np.sort(own.whitened) - np.sort(want)).max(), np.abs(np.sort(own.whitened) + np.sort(want)[::-1]).max()) < 1e-9
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_whitening_without_variance(spark):
    got = whitening.whiten(vectors(spark, [(1, [1.0, 2.0, 0.5]), (2, [2.0, 4.0, 0.5]), (3, [3.0, 6.0, 0.5])])).toPandas()
    assert len(got) == 9 and got[got.component == 1].whitened.notna().all() and got[got.component > 1].whitened.isna().all() and got.identity_error[0] < 1e-9
    alone = whitening.whiten(vectors(spark, [(1, [1.0, 2.0])])).toPandas()
    assert list(alone.deviation) == [0, 0] and alone[["whitened", "explained", "identity_error"]].isna().all().all()
    assert whitening.whiten(vectors(spark, [])).collect() == [] and whitening.whiten(vectors(spark, [(1, None), (2, [])])).columns == list(got.columns)
    huge = whitening.whiten(vectors(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])])).toPandas()
    assert huge.deviation.isna().any() and huge[huge.component == 1].whitened.notna().all()


# --- Elias-Fano lists and language-model scoring


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 1), (1, 10**12), (5, 3), (1000, 10**6), (20000, 2**45), (20000, 20001), (3000, 10)])
def test_sequences(n, top):
    g = np.random.default_rng(n)
    v = np.sort(g.integers(0, top, n))
    s = elias_fano.Sequence(elias_fano.encode(v))
    assert (s.at(np.arange(n)) == v).all()
    asked = np.concatenate([v, g.integers(0, top + 5, 500), [3 * top]])
    assert (s.successor(asked) == np.searchsorted(v, asked)).all()
    assert ((s.find(asked) >= 0) == np.isin(asked, v)).all()


def test_lists():
    r = random.Random(1)
    for _ in range(40):
        lists = [sorted(r.sample(range(50), r.randrange(12))) for _ in range(r.randrange(1, 40))]
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        held = elias_fano.Lists(elias_fano.Lists.encode(owner, np.array(sum(lists, []), np.int64), len(lists)))
        asked = np.array([(i, x) for i in range(len(lists)) for x in range(60)])
        place, within = held.find(asked[:, 0], asked[:, 1])
        assert within.tolist() == [lists[i].index(x) if x in lists[i] else -1 for i, x in asked.tolist()] and ((place < 0) == (within < 0)).all()


class Discounting:
    """The same model by dictionaries."""

    def __init__(self, texts):
        self.one, self.two, self.three = Counter(), Counter(), Counter()
        for t in texts:
            self.one.update(t)
            for i in range(1, len(t)):
                self.two[t[i - 1], t[i]] += 1
                self.three[t[i - 2] if i > 1 else None, t[i - 1], t[i]] += 1
        self.n, self.v = sum(self.one.values()), len(self.one)
        self.d = [self.discount(c) for c in (self.two, self.three)]
        self.sums = {}
        for c in (self.two, self.three):
            for k, x in c.items():
                total, kinds = self.sums.get(k[:-1], (0, 0))
                self.sums[k[:-1]] = total + x, kinds + 1

    @staticmethod
    def discount(c):
        a, b = (sum(x == k for x in c.values()) for k in (1, 2))
        return min(max(a / (a + 2 * b), 0.05), 0.95) if a else 0.5

    def p(self, u, v, w, first=False):
        out = (self.one[w] + 0.1) / (self.n + 0.1 * (self.v + 1))
        for d, c, key in () if first else ((self.d[0], self.two, (v, w)), (self.d[1], self.three, (u, v, w))):
            total, kinds = self.sums.get(key[:-1], (0, 0))
            if total:
                out = max(c[key] - d, 0) / total + d * kinds / total * out
        return out


def test_scores(spark):
    r = random.Random(4)
    pool = ["a", "B", "c-d", "Été", "e", "f", "g1", "h", "i", "j"]
    rows = [(i, r.choice([" ", "\t", " \n"]).join(r.choice(pool[: r.randrange(1, 11)]) + r.choice(["", "", "", str(r.randrange(30))]) for _ in range(r.randrange(60)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n "), (203, "a b e " * 4000), (5, rows[5][1]), (None, "a b c"), (204, "never seen words only")]
    tokens = [[*re.findall("[^\x20\x09-\x0d]+", folded(t)), "\n"] for _, t in rows]
    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    m = Discounting([t for t, h in zip(tokens, held) if not h])
    want = []
    for (i, _), t, h in zip(rows, tokens, held):
        ps = [m.p(t[k - 2] if k > 1 else None, t[k - 1], t[k], k == 0) for k in range(len(t))]
        want.append((i, h, len(t), sum(m.one[w] > 0 for w in t), m.n, sum(math.log10((m.one[w] + 0.1) / (m.n + 0.1 * (m.v + 1))) for w in t), sum(map(math.log10, ps))))
    for options in ({}, {"block": 300}):
        got = [tuple(x) for x in ngram_lm.score(frame(spark, rows), crc32_mod(F.col("doc_id"), 10) == 0, **options).collect()]
        order = lambda x: (x[0] is None, x[0] or 0, x[2], x[5])
        assert len(got) == len(want)
        for a, b in zip(sorted(got, key=order), sorted(want, key=order)):
            assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and abs(a[6] - b[6]) <= 0.0016 * b[2], (a, b)
    # every context gives a distribution: what may follow and the share of a word never seen add up
    for u, v in [("a", "b"), (None, "a"), ("f", "never"), ("e", "zzz")]:
        assert math.isclose(sum(m.p(u, v, w) for w in [*m.one, "unseen"]), 1, rel_tol=1e-9)


def test_shards_leave_counts_and_stay_near(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["x", "x", "x", f"w{r.randrange(40)}"]) for _ in range(80))) for i in range(60)]
    held = crc32_mod(F.col("doc_id"), 10) == 0
    one = ngram_lm.score(frame(spark, rows), held).toPandas().sort_values("doc_id")
    many = ngram_lm.score(frame(spark, rows), held, block=500, shard=600).toPandas().sort_values("doc_id")  # x is dealt by the word before it
    assert np.allclose(one.base_score, many.base_score) and (one.n_known == many.n_known).all()
    assert np.allclose(one.score, many.score, rtol=0.15) and (many.score > many.base_score * 1.2).all()


def test_a_trie_is_a_distribution_in_each_class():
    g = np.random.default_rng(3)
    (v, u, w), _ = ngram_lm.distinct(*(g.integers(0, 9, 400) for _ in range(3)), 9)
    n = g.integers(1, 6, len(v))
    shares = np.full(9, 1 / 9)
    trie = ngram_lm.Trie(ngram_lm.build(v, u, w, n, shares[w]))
    for a in range(10):
        for b in range(10):
            codes = trie.ask(np.full(9, a), np.full(9, b), np.arange(9), ngram_lm._quantised(shares))
            assert abs((10.0 ** (-codes / ngram_lm.STEPS)).sum() - 1) < 0.003


def test_scores_without_training_or_rows(spark):
    got = ngram_lm.score(frame(spark, [(1, "a b"), (2, None)]), F.lit(True)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [(1, 3, 0, 0, 0, 0), (2, 1, 0, 0, 0, 0)]
    none = ngram_lm.score(frame(spark, []), F.lit(False))
    assert none.collect() == [] and none.columns[0] == "doc_id"
    texts = spark.createDataFrame([("x", "a a"), ("y", "a b")], "doc_id string, text string")
    assert {r.doc_id for r in ngram_lm.score(texts, F.lit(False)).collect()} == {"x", "y"}
