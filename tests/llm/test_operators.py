"""Each operator against a brute-force version on small fixtures, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, embeddings, html_text, licenses, line_dedup, ngram_join, packing, quality, token_counts, toxicity
from lodestone.llm.components import components

WORDS = "the of and model data river stone idea quick brown fox jumps over lazy dog paper token merge graph plan".split()
DOCS = "doc_id long, text string, lang string, key string, size int"


def made(seed, n, lo=3, hi=40):
    r = random.Random(seed)
    return [" ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(r.randrange(lo, hi))) for _ in range(n)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "x", 1) for i, t in enumerate(texts)], DOCS)


def edited(text, r, share):
    w = text.split()
    for i in range(len(w)):
        if r.random() < share:
            w[i] = "new" + str(r.randrange(10**6))
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    base = made(1, 60) + made(2, 6, 150, 300)
    out = list(base)
    for t in base:
        out += [edited(t, r, s) for s in (0.0, 0.01, 0.02, 0.05, 0.2)]
    family = made(3, 1, 80, 81)[0]
    out += [edited(family, r, r.choice([0.005, 0.01, 0.03, 0.1])) for _ in range(60)]
    return out + [None, "", "  \n\t ", "one", "ONE", "one two", "Å é 中文", "a " * 500, None]


def closed(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_sets(texts):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    out = []
    for t in texts:
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def test_ngram_join_equals_brute_force(spark, texts):
    sets = shingle_sets(texts)
    links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = closed(range(len(sets)), links)
    got = {r.doc_id: r for r in ngram_join.similar_documents(frame(spark, texts)).collect()}
    assert len(links) > 100 and len(got) == len(texts)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in enumerate(sets)}
    assert ngram_join.similar_documents(frame(spark, texts[:1]).limit(0)).count() == 0


def test_keys_of_similar_sets_meet():
    """The pigeonhole itself: any two sets at the threshold share a key, whatever their sizes."""
    s, r = ngram_join.Scheme(80), np.random.default_rng(3)
    for n in [1, 2, 3, 4, 5, 7, 9, 12, 20, 33, 64, 65, 100, 250, 700, 2000]:
        for _ in range(40):
            a = r.integers(0, 1 << 63, n).astype(np.uint64)
            gone = int(r.integers(0, n // 9 + 1))
            more = max(0, int(math.floor((n - gone) / 0.8)) - n)
            b = np.concatenate([a[gone:], r.integers(0, 1 << 63, int(r.integers(0, more + 1))).astype(np.uint64)])
            if 100 * (n - gone) >= 80 * (len(b) + gone):
                assert np.intersect1d(s.keys(np.unique(a)), s.keys(np.unique(b))).size
                x, y = ngram_join.sketch(a), ngram_join.sketch(b)
                while len(x) != len(y):
                    x, y = (x.reshape(2, -1)[0] ^ x.reshape(2, -1)[1], y) if len(x) > len(y) else (x, y.reshape(2, -1)[0] ^ y.reshape(2, -1)[1])
                assert int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) <= n + len(b) - 2 * (n - gone)


def test_line_dedup_equals_brute_force(spark, texts):
    r = random.Random(8)
    docs = ["\n".join(r.choice(texts) or "" for _ in range(r.randrange(1, 6))) for _ in range(120)] + [None, "", "\n\n", "Same line here again", "same LINE here again\nrest"]
    rows, gone = [], set()
    for i, t in enumerate(docs):
        for n, line in enumerate((t or "").split("\n")):
            s = {w for w in re.split("[ \t\r\x0b\x0c]+", line.lower()) if w}
            if s:
                if any(100 * len(s & o) >= 80 * len(s | o) for o in rows):
                    gone.add((i, n))
                rows.append(s)
    got = {x.doc_id: x for x in line_dedup.without_repeated_lines(frame(spark, docs), out="n_removed").collect()}
    assert len(got) == len(docs) and len(gone) > 50
    for i, t in enumerate(docs):
        assert got[i].n_removed == sum(g[0] == i for g in gone)
        assert got[i].text == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone))
    assert line_dedup.without_repeated_lines(frame(spark, ["x"]).limit(0)).count() == 0


def test_line_dedup_links_three_and_four_tokens_at_75(spark):
    docs = ["one two three", "one two three four", "five six", "five six seven", "p q r s", "r q p"]
    assert {x.doc_id for x in line_dedup.removed_lines(frame(spark, docs), 75).collect()} == {1, 5}
    assert not line_dedup.removed_lines(frame(spark, docs), 76).collect()


def test_line_dedup_of_any_ids(spark):
    """Rows of one id are different documents unless their texts agree; ids may be strings or null; other columns stay."""
    one, two = "alpha beta gamma delta epsilon", "zeta eta theta iota kappa"
    rows = [("b", one + "\n" + two, 1, 2), ("b", "rest of b here alone\n" + one, 3, 4), ("a", two, 5, 6), ("a", two, 7, 8), (None, "new words of no id\n" + one + "\n" + two, 9, 10), ("c", None, 11, 12), ("d", "own\tline\r\nown line", 13, 14), ("e", one.upper() + " " + " ".join(one.split()[::-1]), 15, 16)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, th int, id int")
    got = {x.id: (x.doc_id, x.text, x.th, x.n) for x in line_dedup.without_repeated_lines(docs, out="n").collect()}
    # both rows of `a` are one document and the first; of the rows of `b`, the one of the smaller text hash is first
    assert got[6] == ("a", two, 5, 0) and got[8] == ("a", two, 7, 0) and got[10] == (None, "new words of no id", 9, 2)
    assert {got[2][1], got[4][1]} in ({one, "rest of b here alone"}, {"", "rest of b here alone\n" + one})
    assert got[12] == ("c", None, 11, 0) and got[14] == ("d", "own\tline\r", 13, 1) and got[16][1] == ""
    assert line_dedup.without_repeated_lines(docs, out="th").columns == ["doc_id", "text", "id", "th"]
    assert not line_dedup.removed_lines(spark.createDataFrame([(1, None), (2, ""), (3, " \n\t")], "doc_id long, text string")).collect()


def test_line_dedup_without_broadcasts(spark, texts, monkeypatch):
    r = random.Random(12)
    docs = frame(spark, ["\n".join(r.choice(texts) or "" for _ in range(3)) for _ in range(80)])
    few = {(x.doc_id, x.no) for x in line_dedup.removed_lines(docs).collect()}
    monkeypatch.setattr(line_dedup, "BROADCAST", 0)
    assert few and {(x.doc_id, x.no) for x in line_dedup.removed_lines(docs).collect()} == few


def test_line_dedup_numbers_lines_in_their_order(spark):
    """One number tells a line's place among all: (doc_id, text hash, line number), null ids last; repeated rows count once."""
    rows = [(i % 40, f"a{i}\n\nÄ{i}\tx") for i in range(150)] + [(None, "of no id\nB"), (7, "twice\nover"), (7, "twice\nover"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = line_dedup.lines(docs).orderBy("id").collect()
    assert [(x.doc_id is None, x.doc_id or 0, x.th, x.no) for x in got] == sorted((x.doc_id is None, x.doc_id or 0, x.th, x.no) for x in got)
    assert sorted(x.line for x in got) == sorted([w for i in range(150) for w in (f"a{i}", f"ä{i} x")] + ["of no id", "b", "twice", "over"])
    assert len({x.id for x in got}) == len(got)


def test_line_dedup_broadcasts_few_lines_only(spark, monkeypatch):
    """The bound is on lines, not on the documents that have them."""

    def counted(df):
        sent.append(df.selectExpr("sum(size(_nos))").first()[0] or 0)
        return df

    sent = []
    one = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(20)]
    docs = frame(spark, ["\n".join(one), "\n".join(x + " more" for x in one)])
    monkeypatch.setattr(line_dedup, "BROADCAST", 10)
    monkeypatch.setattr(line_dedup.F, "broadcast", counted)
    assert {(x.doc_id, x.no) for x in line_dedup.removed_lines(docs).collect()} == {(1, i) for i in range(20)}
    assert all(n <= 10 for n in sent)


def test_held_is_bounded():
    from lodestone.llm.common import Held

    made_ = []
    held = Held(lambda k: made_.append(k) or len(k), size=3, longest=4)
    assert [held[k] for k in ("a", "bb", "a", "longer", "longer", "c", "d", "a")] == [1, 2, 1, 6, 6, 1, 1, 1]
    assert made_ == ["a", "bb", "longer", "longer", "c", "d", "a"] and len(held) <= 3


def test_token_ids_of_long_blanks():
    ids = packing.TokenIds(public_tokenizers.path("byte_bpe_50k.json"))
    assert ids.fast
    for text in ("a" + " " * 1_200_000 + "b", "\n \t" * 400_000 + "end"):
        assert ids(text) == packing._packed(ids.tok.encode(text, add_special_tokens=False).ids)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(1, 50)] + [(5, 5)]
    want = closed({x for e in edges if e[0] != e[1] for x in e}, [e for e in edges if e[0] != e[1]])
    got = {x.node: x.component for x in components(spark.createDataFrame([*edges, (None, 3)], "u long, v long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 40)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 16))
    v = [b + rng.normal(size=16) * s for b in base for s in (0.0, 0.0, 0.05, 0.15, 0.25, 0.35)] + [base[0] + rng.normal(size=16) * 0.02 for _ in range(90)]
    rows = [(i, [float(np.float32(x)) for x in e], 0) for i, e in enumerate(v)]
    bad = [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 16, 1), (1003, [float("nan")] * 16, 1), (1004, [1.0, None] + [0.0] * 14, 1), (1005, [float("inf")] * 16, 2), (1006, [1.0, 2.0], 3), (1007, [2.0, 4.0], 3)]
    got = {x.vec_id: x for x in embeddings.near_duplicates(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")).collect()}
    m = np.array([r[1] for r in rows])
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= 0.95
    links = [(i, j) for i, j in itertools.combinations(range(len(m)), 2) if near[i, j]]
    want = closed(range(len(m)), links)
    assert {i: got[i].component_id for i in range(len(m))} == want
    assert {i: got[i].n_links for i in range(len(m))} == {i: int(near[i].sum()) - 1 for i in range(len(m))}
    assert all(got[i].kept == (want[i] == i) for i in want)
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in range(1000, 1006))
    assert (got[1006].n_links, got[1007].component_id) == (1, 1006)


def test_packing_round_trip(spark, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = [*texts, "x<|endoftext|>y", "tab\x1cweird\x85 　 text", "long words " * 4000]
    tok = Tokenizer.from_file(path)
    ids = [np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for t in own]
    got = packing.pack(frame(spark, own), path).toPandas()
    for i, g in got.groupby("doc_id"):
        at = 0
        for r in g.sort_values("start").itertuples():
            assert (r.start, r.doc_tokens) == (at, len(ids[i]))
            assert r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[i])
    assert got.doc_id.nunique() == len(own)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *itertools.accumulate(g.length)][:-1] and g.length.sum() <= 2048
    total = got.length.sum()
    assert got.sequence_id.nunique() <= -(-total // 2048) + 1
    assert packing.pack(frame(spark, ["x"]).limit(0), path).count() == 0


def test_fill_is_the_best_subset():
    r = random.Random(1)
    for _ in range(200):
        counts = {r.randrange(1, 30): r.randrange(1, 4) for _ in range(5)}
        room = r.randrange(1, 90)
        best = max(s for s in (sum(k * n for k, n in zip(counts, c)) for c in itertools.product(*(range(v + 1) for v in counts.values()))) if s <= room)
        got, used = packing.fill(room, counts, sorted(counts, reverse=True))
        assert got == best == sum(k * v for k, v in used.items()) and all(v <= counts[k] for k, v in used.items())


def test_decontamination_equals_brute_force(spark):
    r = random.Random(9)
    items = made(20, 25, 5, 40) + ["", None, "short item", "ends. here"]
    texts = []
    for i in range(80):
        w = made(100 + i, 1, 5, 60)[0].split()
        if i % 2:
            it = (items[i % 25]).split()
            a = r.randrange(len(it))
            w[3:3] = [x.upper() + "," for x in it[a : a + r.randrange(10, 25)]]
        texts.append("; ".join(w))
    texts += [None, "", "...", "a short  ITEM! ends", "Éa short item"]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)] + [(0, items[0], 2), (None, "x y", 1)], "item_id long, text string, n_words int")
    got = {x.doc_id: x.c for x in decontaminate.decontaminated(frame(spark, texts), bench, out="c").collect()}
    some = 0
    for i, t in enumerate(texts):
        w, hit, ids = split(t), set(), set()
        for k, it in enumerate(items):
            b = split(it)
            for a in range(max(1, len(b) - 12)) if b else []:
                win = b[a : a + 13]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        ids.add(str(k))
        c = got[i]
        assert (c.n_words, c.n_hit, c["items"]) == (len(w), len(hit), sorted(ids))
        assert c.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
        assert sum(len(split(t[s.start : s.end])) for s in c.spans) == len(hit)
        some += bool(hit)
    assert some > 15
    parts = decontaminate.decontaminated(frame(spark, texts), bench, out="c", block_words=40, held=1, gathered=1000)
    assert {x.doc_id: x.c for x in parts.collect()} == got  # several automata, each in turn
    empty = decontaminate.decontaminated(frame(spark, texts), bench.limit(0), out="key")
    assert {x.key.n_hit for x in empty.collect()} == {0} and empty.columns == frame(spark, []).columns
    assert decontaminate.decontaminated(frame(spark, ["x"]).limit(0), bench).count() == 0


def test_token_counts_equal_the_tokenizer(spark, texts):
    from tokenizers import Tokenizer, models

    path = public_tokenizers.path("piece_bpe_32k.model")
    vocab = token_counts.vocabulary(path)
    tok = Tokenizer(models.Unigram(vocab, 0, True))
    own = [*texts, "tie aaaa  bbbb   \n\n x▁y <0x41> <s>", "日本語 ȿ 🎉🎉", "".join(map(chr, range(32, 700)))]
    got = {x.doc_id: x.t for x in frame(spark, own).select("doc_id", token_counts.token_counts(F.col("text"), path).alias("t")).collect()}
    for i, t in enumerate(own):
        assert got[i].n_tokens == (len(tok.encode("▁" + t.replace(" ", "▁")).ids) if t else 0), t
    with pytest.raises(ValueError):
        token_counts.Counter([("a", -1.0)])


def test_known_characters_take_the_short_count():
    """op3: it equals the count for any characters, ties included, in less than two thirds of the time."""
    r = random.Random(3)
    vocab = [(f"<0x{b:02X}>", -9.0) for b in range(256)] + [(c, -3.0) for c in "abcd"]
    vocab += [(p, float(r.choice([-2, -3, -4, -6]))) for p in {"".join(r.choices("abcd", k=r.randint(2, 6))) for _ in range(600)}]
    held = token_counts.Counter(vocab)
    chunks = ["".join(r.choices("abcd", k=r.randint(1, 30))) for _ in range(3000)]
    took = []
    for count in (held.viterbi_unknown, held.viterbi):
        began = time.process_time()
        got = [count(c) for c in chunks]
        took.append((time.process_time() - began, got))
    assert took[0][1] == took[1][1] and took[1][0] < took[0][0] * 2 / 3
    assert held.viterbi("abé") == held.viterbi_unknown("abé")


def test_license_scan(spark):
    phrases = licenses.BASE
    r = random.Random(3)
    texts = [None, "", "MIT License", "the mit-license", "permit license", "General Public License, the Apache   License; mit license MIT LICENSE", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "SPDX-License-Identifier: LGPL-2.1-or-later", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "mit İ license", "apache license " * 300]
    texts += [" ".join(r.choice(["mit", "license", "apache", "general", "public", "x", "Gnu"]) for _ in range(60)) for _ in range(40)]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = {x.doc_id: x for x in licenses.detected(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = sorted((p, lab) for ph, lab in phrases.items() for p in range(len(w)) if w[p : p + len(ph.split())] == ph.split())
        g = got[i]
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None), t
        assert g.base_labels == sorted({lab for _, lab in at}) and set(g.base_labels) <= set(g.labels) and g.labels == sorted(set(g.labels))
        assert 0 <= g.score <= 1 and (not g.labels or g.score > 0)
    assert got[8].labels == ["lgpl"] and got[9].labels == ["cc"] and got[10].labels == ["gpl"] and got[6].labels == ["apache"] and got[4].labels == []
    assert len({tuple(x.items()) for x in licenses.rules()}) > 200
    # Containment: the grant covers the plain name, which goes.
    assert [m.priority for m in got[7].matches] == [2]


def test_license_labels_equal_brute_force(spark):
    """All matches of all rules by Python's engine, then the containment rule by comparing every pair."""
    r = random.Random(31)
    parts = ["licensed under the mit license", "apache license version 2.0", "gpl v3 or later", "GNU General Public License", "bsd 3 clause", "SPDX-License-Identifier: Apache-2.0", "all rights reserved", "Ünder the MIT", "mozilla public license 2 0", "cc by sa 4 0", "lesser general public license version 2.1 only", "license", "isc", "word"]
    texts = [", ".join(r.choice(parts) for _ in range(r.randrange(0, 9))) for _ in range(150)] + [None, ""]
    rows = [(i, t, "x", [1], 5.0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string, _f array<int>, n_words double")
    out = licenses.detected(docs)
    assert sorted(out.columns) == sorted(["doc_id", "text", "_f", *licenses.COLUMNS])
    got, some = {x.doc_id: x for x in out.collect()}, set()
    rules = [(x, re.compile(x["pattern"])) for x in licenses.rules()]
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        t = "| " + " ".join(words) + " "
        found = sorted({(m.start(), -m.end(), x["priority"], x["label"]) for x, p in rules if x["keyword"] in t for m in p.finditer(t)})
        kept = [a for k, a in enumerate(found) if not any(b[2] <= a[2] and b[0] <= a[0] and b[1] <= a[1] for b in found[:k])]
        base = {v for k, v in licenses.BASE.items() if f" {k} " in t}
        assert got[i].n_words == len(words) and set(got[i].labels) == base | {x[3] for x in kept}, text
        some |= set(got[i].labels)
    assert len(some) >= 8 and licenses.detected(docs.limit(0)).count() == 0


def test_html(spark):
    art = "<html><head><title>t</title></head><body><nav><a>Home</a></nav><div class='ad'>buy</div><article><h1>T &amp; U</h1><p>one&nbsp; two<br>three<script>x<p></script><p><b>open<div id=comments>no</div><p>end</article><footer>&copy; us all rights reserved by us</footer>"
    bare = "<div>Common menu of this host with many words {}</div><div>Unique text {} of page {} alone here now yes</div>"
    rows = [(0, "http://a.com/0", art), (1, "http://b.com/1", None), (2, "http://b.com/2", ""), (3, None, "plain < text"), (4, "x", "<p")]
    rows += [(10 + i, "http://h.com/%d" % i, bare.format("now", i, i)) for i in range(4)] + [(10, "http://h.com/0", bare.format("now", 0, 0))]
    got = {}
    for x in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got.setdefault(x.page_id, x.text)
    assert got[0] == "T & U\none two three\nopen\nend"
    assert got[1] == got[2] == "" and got[3] == "plain < text"
    assert [got[10 + i] for i in range(4)] == [f"Unique text {i} of page {i} alone here now yes" for i in range(4)]
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_drops_by_whole_names_only():
    def main(page):
        return [text for part, text in html_text.blocks(page) if part == "main"]

    for around in ("class='content no-sidebar'", "class=has-sidebar", "class='sidebar'", "id=nav", "title='a hidden place'", "data-id=comments", "data-role='menu'", "class=ad-hoc"):
        assert main(f"<div {around}><article><p>kept</p></article></div>") == ["kept"], around
    for own in ("<h1 class='post-header'>", "<h1 class='page-header'>", "<p class='share-price'>", "<div id='related-work'>", "<p title='a hidden place'>", "<p data-id='ad'>", "<p data-hidden='x'>"):
        assert main(f"<article>{own}kept</article>") == ["kept"], own
    for own in ("<div class='x ad'>", "<div id=comments>", "<p hidden>", "<p hidden=''>", "<div style='color:red; display: none'>", "<div aria-hidden=true>", "<div role=navigation>", "<div class=ad-slot>", "<ul class='share-buttons'>", "<div class='cookie_banner'>"):
        assert main(f"<article>kept{own}gone</article>") == ["kept"], own
    assert main("<article>kept</article><div class=comments><article>gone</article></div>") == ["kept"]
    assert main("<article><p class=ad>gone<p>kept</article>") == ["kept"]


def test_html_host_repeats(spark):
    """Menus and short notices go, also in part; what stands on a few pages or on mirrors of one page stays."""
    words = lambda n: " ".join(f"w{n}x{i}" for i in range(12))
    menu = "<div>Home</div><div>About us</div><div>Contact</div><div>Site map and help</div><div>We value you</div>"
    pages = [(i, f"http://h.com/{i}", f"{menu}<div>{words(i)}</div><div>Read all the news of the day here by {words(100 + i).split()[0]} only</div>") for i in range(8)]
    pages += [(8, "http://h.com/8?print", f"{menu}<div>{words(0)}</div><p>printed</p>"), (9, "http://h.com/9", pages[1][2]), (10, "http://h.com/10", pages[1][2])]
    pages += [(20 + i, f"http://two.com/{i}", f"<p>{words(50)}</p>") for i in range(5)]
    got = {x.page_id: x.text for x in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert got[i] == f"{words(i)}\nw{100 + i}x0 only"
    assert got[8] == f"{words(0)}\nprinted" and got[9] == got[10] == got[1]
    assert {got[20 + i] for i in range(5)} == {words(50)}


def test_html_repeats_equal_brute_force(spark):
    """Long repeats found by comparing all pages of a host with each other, extended token by token."""
    r, pages = random.Random(21), []
    parts = [" ".join(f"b{k}t{i}" for i in range(r.randrange(3, 20))) for k in range(6)]
    for i in range(24):
        divs = [" ".join(f"p{i}d{k}x{j}" for j in range(r.randrange(2, 15))) for k in range(3)] + [x for x in parts if r.random() < 0.6]
        r.shuffle(divs)
        if r.random() < 0.3:
            divs.append(parts[0] + f" own{i} tail{i}")
        art = f"<article>{' '.join(f'a{i}w{j}' for j in range(r.choice([2, 90])))}</article>" if i % 3 == 0 else ""
        pages.append((i, "http://x.org/a", f"<nav>menu of all</nav>{art}" + "".join(f"<div>{d}</div>" for d in divs)))
    got = {x.page_id: x.text for x in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    own = {i: html_text.blocks(h) for i, _, h in pages}
    streams = {i: [t for part, text in b if part != "main" for t in text.split(" ")] for i, b in own.items()}
    bare = {i for i, b in own.items() if all(p != "main" for p, _ in b)}
    inside = lambda run, s: any(s[k : k + len(run)] == run for k in range(len(s) - len(run) + 1))

    def often(holders):
        return len(holders) >= 3 and (2 * len(holders) >= len(pages) or (len(holders & bare) >= 3 and 2 * len(holders & bare) >= len(bare)))

    cut = 0
    for i, b in own.items():
        s, marked, at, out = streams[i], set(), 0, []
        for k in range(len(s) - 5):
            if often({j for j, o in streams.items() if inside(s[k : k + 6], o)}):
                marked |= set(range(k, k + 6))
        for part, text in b:
            if part == "main":
                out.append((part, text))
                continue
            w = text.split(" ")
            if len(w) < 6 and often({j for j, o in own.items() if (text in [t for p, t in o if p != "main"])}):
                marked |= set(range(at, at + len(w)))
            left = [t for k, t in enumerate(w, at) if k not in marked]
            at += len(w)
            if part == "open":
                cut += len(w) != len(left)
                out.append((part, " ".join(left) if 2 * (len(w) - len(left)) >= len(w) else text))
        main, rest = (sum(len(t) for p, t in out if p == part) for part in ("main", "open"))
        assert got[i] == "\n".join(t for p, t in out if t and (p == "main" or not main or rest > main)), i
    assert cut > 20


def test_html_teasers_and_pages_without_host(spark):
    words = " ".join(f"w{i}" for i in range(30))
    body = f"<h1>Head</h1><div class=content>{words}</div><article>teaser</article>"
    rows = [(1, "http://a.org/1", body, "x"), (2, None, f"<p>{words}</p>", "y"), (3, None, f"<div><p>{words}</p></div>", "z"), (4, "", f"<p>{words}</p><p>more</p>", None), (4, "", f"<p>{words}</p><p>more</p>", None)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text"]
    assert sorted((x.page_id, x.text) for x in got.collect()) == [(1, f"Head\n{words}\nteaser"), (2, words), (3, words), (4, f"{words}\nmore"), (4, f"{words}\nmore")]


def test_segments_are_maximal():
    """Against the definition: repeatedly take the best run and go on left and right of it."""
    rng = np.random.default_rng(0)

    def brute(s, at):
        if not (s > 0).any():
            return []
        c = np.concatenate([[0], np.cumsum(s)])
        i, j = max(((i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), key=lambda x: (round(c[x[1]] - c[x[0]], 9), -(x[1] - x[0])))
        return brute(s[:i], at) + [(at + i, at + j)] + brute(s[j:], at + j)

    for _ in range(150):
        s = np.where(rng.random(25) < 0.4, rng.random(25) * 4, -rng.random(25) * 3)
        assert [x[:2] for x in toxicity.segments(s)] == brute(s, 0)


def test_toxicity_held_out(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(500):
        w = made(1000 + i, 1, 30, 90)[0].split()
        bad = i % 4 == 0
        if bad:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["vilex", "grubno", "snarlo"]) + r.choice(["", "ba", "ti"]))
        rows.append(" ".join(w))
        labels.append((i, int(bad)))
    labels += [(None, 1), (3, None)]
    docs = frame(spark, [*rows, None, ""])
    lex = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), "toxic", 4, 2)
    got = {x.doc_id: x.toxicity for x in toxicity.score(docs, lex).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i].score >= 0.3) == (i % 4 == 0) for i in held)
    assert right >= 0.97 * len(held) and got[500].score == got[501].score < 0.3 and got[500].segments == []
    assert toxicity.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), "toxic", 4, 2) is None
    assert {x.toxicity.score for x in toxicity.score(docs, None).collect()} == {0.0}
    # Labels that leave the curve without a class: texts without segments are clean.
    few = toxicity.fit(docs, spark.createDataFrame(labels[:6], "doc_id long, toxic int"), "toxic", 4, 2)
    assert few is None or max(x.toxicity.score for x in toxicity.score(docs, few).collect()) < 0.3
    assert toxicity.Lexicon({}).probability(0.0) < 0.3
    assert toxicity.score(docs.limit(0), lex).count() == 0


def test_quality(spark):
    rows = [t if i % 5 else t.upper().replace(" ", "!! ") for i, t in enumerate(made(50, 500))]
    docs = frame(spark, [*rows, None, ""]).withColumn("n_chars", F.char_length("text"))
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(500)] + [(None, 0), (7, None)], "doc_id long, quality int")
    m = quality.fit(docs, labels, "quality", 5, 0, ("n_chars",))
    got = {x.doc_id: x.score for x in quality.score(docs, m, ("n_chars",)).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.3) == (i % 5 > 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s in got.values())
    # The identity: the pairwise sum itself.
    at, x = quality.features("Some words, some WORDS!")
    small = quality.Machine(quality.WORD_BINS + 1000)
    z, _ = small.margins(at, x, np.zeros(1, int))
    pairs = sum(x[i] * x[j] * (small.v[at[i]] @ small.v[at[j]]) for i, j in itertools.combinations(range(len(at)), 2))
    assert z[0] == pytest.approx(pairs + small.w[at] @ x)
    assert quality.fit(docs, labels.limit(0), "quality", 5, 0) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}


def test_many_license_words_take_linear_time(spark):
    """57 KB of license words, and twice as many: places are as in one piece, and twice the text takes about twice the time."""
    import time

    piece, took = "mit license gpl v2 ", []
    for n in (3000, 6000):
        began = time.perf_counter()
        (row,) = licenses.detected(frame(spark, [piece * n])).collect()
        took.append(time.perf_counter() - began)
        assert row.n_base == n and (row.first_word, row.last_word) == (0, 4 * n - 4) and len(row.matches) >= 2 * n - 1
        assert sorted(m.start for m in row.matches) == [m.start for m in row.matches]
    assert took[1] < 20, took


def test_unclosed_elements_take_linear_time():
    import time

    began = time.perf_counter()
    assert html_text.blocks("<div></p>" * 50_000 + "<article>the text</article>") == [("main", "the text")]
    assert time.perf_counter() - began < 5


def test_an_id_with_several_texts_is_one_node(spark):
    r = random.Random(8)
    a, b = (" ".join(f"{k}{r.randrange(10**6)}" for _ in range(60)) for k in "xy")
    near_a, near_b = a.rsplit(" ", 1)[0] + " z1", b.rsplit(" ", 1)[0] + " z2"
    rows = spark.createDataFrame([(1, a), (1, b), (2, near_b), (3, near_a), (4, "other words"), (1, a)], "doc_id long, text string")
    got = {(x.doc_id, x.component_id) for x in ngram_join.similar_documents(rows).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_windows_of_an_item_without_id_hit(spark):
    words = " ".join(f"word{i}" for i in range(20))
    docs, bench = spark.createDataFrame([(1, words), (2, "clean text")], "doc_id long, text string"), spark.createDataFrame([(None, words), (7, "clean text")], "item_id long, text string")
    got = {r.doc_id: r.contamination for r in decontaminate.decontaminated(docs, bench).collect()}
    assert (got[1].n_hit, got[1]["items"], got[1].contaminated) == (20, [], True) and (got[2].n_hit, got[2]["items"]) == (2, ["7"])


def test_recall_with_long_keys(spark, monkeypatch):
    """Keys of eight bits and more, so that pairs can be missed: recall of linked pairs against brute force."""
    monkeypatch.setattr(embeddings, "BUCKET", 2)
    bits, tables = embeddings.tables(700, 0.95)
    assert bits >= 8 and tables > 1
    g = np.random.default_rng(5)
    base = g.normal(size=(350, 24))
    v = np.concatenate([base, base + g.normal(size=base.shape) * g.uniform(0.05, 0.4, (350, 1))])
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    near = np.triu(unit @ unit.T >= 0.95, 1)
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()}
    found, wanted = sum(got.values()), 2 * int(near.sum())
    print(f"recall {found / wanted:.4f} of {wanted // 2} pairs with keys of {bits} bits in {tables} tables")
    assert wanted > 200 and 0.99 * wanted <= found <= wanted
    assert all(got[i] <= n for i, n in enumerate((near | near.T).sum(1)))


def test_suffixes_of_a_host_are_ordered_to_any_depth(spark):
    """F8: each depth holds the suffixes of intervals on enough pages, in the order of their tokens, up to the longest common run."""
    r = random.Random(8)
    common = [f"w{r.randrange(9)}" for _ in range(60)]
    streams = {("a", p): [f"u{p}{i}" for i in range(r.randrange(4))] + common[: r.choice([30, 45, 60])] + [r.choice("xy") for _ in range(r.randrange(30))] for p in range(8)}
    streams |= {("b", p): common[: 5 + p] for p in range(5)}
    rows = [(h, p, p % 2 == 0, True, at, size, key) for (h, p), tokens in streams.items() for at, size, key in html_text.places([" ".join(tokens)], 6)]
    own = spark.createDataFrame(rows, "host string, page long, found boolean, open boolean, at int, size int, key string")
    totals = spark.createDataFrame([("a", 8, 4), ("b", 5, 2)], "host string, pages long, bare long")
    levels = html_text.suffix_array(own, totals, 6)
    assert len(levels) == 5 and levels[-1].isEmpty()  # 6, 12, 24, 48 tokens, and none of 96
    for depth, level in enumerate(levels):
        n = 6 << depth
        pages = {}
        for (h, p), tokens in streams.items():
            for at in range(len(tokens) - n + 1):
                pages.setdefault((h, tuple(" ".join(tokens[i : i + 6]) for i in range(at, at + n, 6))), set()).add((p, at))
        bare = lambda places: len({p for p, _ in places if p % 2})
        often = lambda h, places: len({p for p, _ in places}) >= 3 and (2 * len({p for p, _ in places}) >= {"a": 8, "b": 5}[h] or (bare(places) >= 3 and 2 * bare(places) >= {"a": 4, "b": 2}[h]))
        want = [sorted(places) for (h, k), places in sorted(pages.items()) if often(h, places)]
        got = {}
        for x in level.where(f"size = {n}").collect():
            got.setdefault(x["rank"], []).append((x.page, x.at))
        assert [sorted(v) for _, v in sorted(got.items())] == want


def test_suffix_array_is_built_for_hosts_without_open_blocks(spark):
    """what a host repeats is found on pages of semantic elements alone, against a count of all runs; texts stay."""
    r = random.Random(5)
    menu = [f"m{k}" for k in range(17)]
    pages = []
    for i in range(30):
        nav = menu[r.randrange(8) :] if i % 3 else [f"n{i}x{k}" for k in range(9)]
        foot = r.choice(["All rights reserved", f"own {i}", "so it is on every page of this host"])
        pages.append((i, f"http://h{i % 2}.org/{i}" if i < 28 else "http://two.org/x", f"<nav>{' '.join(nav)}</nav><article>Text {i}</article><footer>{foot}</footer>"))
    out = html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string"), repeated="n_repeated")
    assert out.columns == ["page_id", "url", "text", "n_repeated"]
    got = {x.page_id: x for x in out.collect()}
    streams = {i: [t for part, text in html_text.blocks(h) if part != "main" for t in text.split(" ")] for i, _, h in pages}
    inside = lambda run, s: any(s[k : k + len(run)] == run for k in range(len(s) - len(run) + 1))
    for i, url, h in pages:
        own = [j for j, u, _ in pages if u.split("/")[2] == url.split("/")[2]]
        often = lambda n: n >= 3 and 2 * n >= len(own)  # noqa: E731, B023
        marked, at = set(), 0
        for k in range(len(streams[i]) - 5):
            if often(sum(inside(streams[i][k : k + 6], streams[j]) for j in own)):
                marked |= set(range(k, k + 6))
        for part, text in html_text.blocks(h):
            if part != "main":
                n = len(text.split(" "))
                if n < 6 and often(sum((part, text) in html_text.blocks(pages[j][2]) for j in own)):
                    marked |= set(range(at, at + n))
                at += n
        assert (got[i].text, got[i].n_repeated) == (f"Text {i}", len(marked)), i
    assert len({x.n_repeated for x in got.values()}) > 2
