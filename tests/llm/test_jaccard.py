"""The n-gram join against brute force: cases without shared n-grams, hubs, clashing names, graphs in rounds, whole small tables."""

import random
import re

import numpy as np
import pandas as pd
import pytest

from codexa.llm import jaccard
from codexa.llm.common import table


def plain(rows, n, t):
    """{doc_id: (size, smallest id of its component)}, pairs found by an inverted index of all n-grams."""
    sets, where = {}, {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
        for g in sets[i]:
            where.setdefault(g, []).append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        shared = {}
        for g in sets[a]:
            for b in where[g]:
                if b > a:
                    shared[b] = shared.get(b, 0) + 1
        for b, k in shared.items():
            if 100 * k >= t * (len(sets[a]) + len(sets[b]) - k):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(s), find(i)) for i, s in sets.items()}


def found(spark, rows, n, t, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs, n=n, threshold=t, **options).collect()}


def words(rng, k, of=10**6):
    return [f"w{rng.randrange(of)}" for _ in range(k)]


def test_texts_that_share_nothing(spark):
    rng = random.Random(1)
    one = [(1, " ".join(words(rng, 30)))]
    for rows in (one, [*one, (2, " ".join(words(rng, 30)))], [*one, (2, one[0][1].upper()), (3, "a"), (4, ""), (5, None)]):
        assert found(spark, rows, 3, 90) == plain(rows, 3, 90)


def near(rng, w, changes):
    w = list(w)
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("n,t", [(3, 90), (5, 80)])
def test_hub_of_near_copies_chains_and_outliers(spark, n, t):
    rng = random.Random(7)
    hub = words(rng, 150)
    rows = [(i, near(rng, hub, i % 6)) for i in range(500)]
    chain = words(rng, 90)
    for i in range(500, 560):  # each like its neighbours, the ends unlike each other
        rows.append((i, " ".join(chain)))
        chain = chain[2:] + words(rng, 2)
    rows += [(i, " ".join(words(rng, rng.randrange(1, 60)))) for i in range(560, 640)]
    assert found(spark, rows, n, t) == plain(rows, n, t)


def test_clashing_names_and_graphs_in_rounds_change_nothing(spark):
    rng = random.Random(3)
    rows = []
    for g in range(40):
        w = words(rng, 60)
        rows += [(10 * g + i, near(rng, w, i % 3)) for i in range(6)]
    want = plain(rows, 3, 80)
    assert found(spark, rows, 3, 80, name_bits=9, in_task=3) == want
    assert len({root for _, root in want.values()}) < 200


@pytest.mark.parametrize("in_task", [3, 1 << 20])
def test_components(spark, in_task):
    rng = np.random.default_rng(in_task)
    path = [(i, i + 1) for i in range(100, 160)]
    edges = path + [(int(a), int(b)) for a, b in rng.integers(0, 90, (40, 2))] + [(-5, 3000), (3000, -5)]
    got = {r.name: r.root for r in jaccard.components(spark.createDataFrame(edges, "a long, b long"), in_task).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: r for x, r in root.items() if x not in alone}


def test_packed_hashes_come_back():
    rng = np.random.default_rng(5)
    for h in (np.sort(rng.integers(0, 1 << 58, 1000, dtype=np.uint64)), np.array([7], np.uint64), np.array([0, 1 << 57], np.uint64), np.arange(5, dtype=np.uint64) << np.uint64(47)):
        assert np.array_equal(jaccard._unpacked(jaccard._packed(h), len(h)), h)


@pytest.mark.parametrize("n,t", [(3, 90), (5, 80)])
def test_whole_table_is_as_by_brute_force(spark, n, t):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], n, t)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs, n=n, threshold=t).collect()} == want
    assert pd.Series([root for _, root in want.values()]).nunique() < len(want)
