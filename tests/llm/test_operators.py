"""Edge cases of every operator (nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns) and plain versions."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexa.llm import jaccard, licenses, mixing, packing, quality, rules, sharding, topk, toxicity, urls

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
TEXT = " ".join(WORDS[(i * i) % 10] + str(i % 37) for i in range(120))
SCHEMA = "doc_id long, text string, lang string, source string, k string, size long, sub int, name string, row long, shard string, h long"
ROWS = [(1, TEXT), (2, TEXT), (2, TEXT), (3, TEXT + " x"), (4, ""), (5, None), (6, "only two"), (7, "word " * 5000), (8, "Licensed under CC BY 4.0. All rights reserved"), (9, TEXT.upper()), (10, " \t\n"), (11, "\n".join(TEXT.split()))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None if i == 4 else "en", None if i % 3 == 0 else f"s{i % 2}", "k", -1, 0, "n", 5, "zz", 9) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(r.taken <= 3 * r["size"] for r in got)
    for source in {r.source for r in got}:
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r["size"] for r in mine)
    assert mixing.mixed_rows(docs).count() == sum(r.copies for r in got) and mixing.mixed_rows(docs).columns == docs.columns
    assert mixing.mix(none).count() == 0


def test_sharding(docs, none):
    got = sharding.shard(docs, limit=3000).collect()
    assert len(got) == len(ROWS)
    for s in {r.shard for r in got}:
        mine = [r for r in got if r.shard == s]
        assert sum(r.bytes for r in mine) <= 3000 or len(mine) == 1
    same = docs.limit(1).select(F.lit(1).cast("long").alias("doc_id"), "text").unionByName(docs.where("doc_id < 4").select(F.lit(1).cast("long").alias("doc_id"), "text"))
    assert max(r.depth for r in sharding.shard(same, limit=1500).collect()) > 60
    assert sharding.shard(none).count() == 0


def test_classifiers(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        got = module.classify(docs, labels).collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
        assert module.classify(none, labels).count() == 0
        assert module.classify(docs, labels.where("false")).count() == len(ROWS)


def test_chain_is_that_of_plain_sums():
    rng = np.random.default_rng(1)
    e, trans, start = rng.normal(0, 2, 150), np.array([[0.9, 0.1], [0.4, 0.6]]), np.array([0.8, 0.2])
    first = np.zeros(150, bool)
    first[[0, 3, 77]] = True
    got = toxicity.chain(e, first, trans, start)[0]
    for a, b in ((0, 3), (3, 77), (77, 150)):
        f, beta = [], [np.ones(2)]
        for t in range(a, b):
            f.append((start if t == a else f[-1] @ trans) * [1, np.exp(e[t])])
        for t in range(b - 1, a, -1):
            beta.append(trans @ (beta[-1] * [1, np.exp(e[t])]))
        m = np.array(f) * np.array(beta[::-1])
        assert np.allclose(m[:, 1] / m.sum(1), got[a:b])


def test_toxic_spans_are_found(spark):
    rows = [(i, f"{WORDS[i % 10]} {WORDS[i % 7]} word{i} " + ("vile thing" if i % 3 == 0 else "kind thing"), int(i % 3 == 0)) for i in range(90)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = toxicity.classify(docs, spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")).collect()
    assert all(r.predicted == rows[r.doc_id][2] for r in got)
    assert all(rows[r.doc_id][1][s.start : s.end] == "vile" for r in got for s in r.spans)


def test_topk(spark):
    vecs = [(i, [float(((i * 7 + j * 3) % 11) - 5) / 4 for j in range(6)]) for i in range(60)] + [(60, None), (61, [1.0, None] * 3), (62, [float("nan")] * 6), (None, [1.0] * 6), (10, [0.25] * 6), (63, [])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>").withColumn("row", F.lit(3))
    got = sorted(map(tuple, topk.topk(df, F.col("vec_id") % 10 == 0).collect()))
    good = [(i, np.floor(np.array(v) * 256).astype(int)) for i, v in vecs if i is not None and i < 60 and v]
    want = []
    for a, (i, v) in enumerate(good):
        if i % 10 == 0:
            best = sorted((-int(v @ w), j) for b, (j, w) in enumerate(good) if b != a)[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert topk.topk(df.where("false"), F.lit(True)).count() == 0


@pytest.mark.parametrize("n,t", [(3, 90), (5, 80)])
def test_jaccard(docs, none, n, t):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs, n=n, threshold=t).collect()}
    sets = {}
    for i, text in ROWS:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert got == {(i, len(s), root[i]) for i, s in sets.items()}
    assert jaccard.join(none).count() == 0


def test_rules(docs, none):
    def plain(text):
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        again = {j for i, x in enumerate(win) if win.count(x) > 1 for j in (i, i + 1, i + 2)} if len(set(win)) > 3 else set(range(len(w))) if len(set(win)) < len(win) else set()
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)

    for r in rules.judge(docs).collect():
        assert tuple(r[1:6]) == plain(dict(ROWS)[r.doc_id]), r.doc_id
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) and not (r.base_failed and r.kept)
    assert rules.judge(none).count() == 0


def test_urls(spark):
    link = lambda h: f'<a href="http://{h}/x">x</a>'
    rows = [(1, "http://A.com/en/1", link("b.org")), (2, "http://b.org/fr/1", link("a.com")), (3, "https://c.net/de/1?x", link("d.net")), (4, "http://d.net/x#y", None), (5, None, link("a.com")), (6, "no url", ""), (7, "x://example.com/en/7q", None), (8, "http://example.net/de/8", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("h"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert got == {1: ("a.com", "/en/1", "com/en/", "block"), 2: ("b.org", "/fr/1", None, "block"), 3: ("c.net", "/de/1", "net/de/", "allow"), 4: ("d.net", "/x", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("example.com", "/en/7q", "example.com/en/7", "allow"), 8: ("example.net", "/de/8", "example.net/de/8", "block")}
    assert urls.judge(pages.where("false")).count() == 0


def test_packing(docs, none):
    got = packing.pack(docs, length=64, keep_ids=True).collect()
    bins = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + len(r.ids)
    assert max(bins.values()) <= 64 and len(bins) == -(-sum(bins.values()) // 64)
    assert sum(len(r.ids) for r in got if r.doc_id == 5) == 1 and packing.pack(none).count() == 0
    # the pair 5 + 4 replaces 6 in the bin of 10
    assert packing.best_two_fit({10: 1, 6: 1, 5: 1, 4: 1}, 19)[0] == (1, [(10, 1), (5, 1), (4, 1)])


def test_ids_are_the_tokenizers():
    encode = packing.Encoder(packing.default_tokenizer())
    for text in ["It's I'LL don't 'tis A1b2 x'sy", "Été, straße ŒUVRE! ñ3 Ёлка's", "J\u030c I\u0307 \u0130x ΟΔΟΣ 中文\r\x0bx\u00a0y", "a\tb\n\nc", "\x1c%%%…''", "", "a <|endoftext|> b", "x<|startoftext|>y <|ENDOFTEXT|>", "<|endoftext", "<|endoftext|>"]:
        assert encode([text])[0] == np.array(encode.known.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(3)
    for size in (1, 20, 400):
        a, b = (rng.integers(0, 600, size) for _ in "ab")
        a, b = np.unique(a), np.unique(b)
        differ = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(jaccard.bitmap(a), jaccard.bitmap(b), strict=True))
        assert differ <= len(np.setxor1d(a, b)) and jaccard.bitmap(a) == jaccard.bitmap(a[::-1])


def test_licenses(docs, none):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    r = got[8]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == (9, 2, 2, 6, "cc-by,reserved", "cc-by,cc-by-4.0,reserved")
    assert (got[5].n_words, got[5].n_base, got[5].first_word, got[5].labels, got[5].score) == (0, 0, None, "", 0.0)
    assert licenses.scan(none).count() == 0 and len(licenses.rules()) > 200
