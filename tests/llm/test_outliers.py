"""op6's estimates and verdicts against plain numpy versions."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexa.llm import rules

FLOOR = np.diag([f**2 for f in rules.FLOORS.values()])


def _cov(x):
    return np.cov(x.T, bias=True).reshape(4, 4) + FLOOR


def _groups():
    rng = np.random.default_rng(5)
    spread = np.array([0.3, 0.2, 0.4, 0.3])
    out = {}
    for g in ("a", "b", "c"):
        x = rng.normal(size=(12, 4)) * spread
        x[:3] += rng.choice([-6, 6], size=(3, 4)) * spread
        out[g] = x
    out["one"], out["same"] = rng.normal(size=(1, 4)), np.repeat(rng.normal(size=(1, 4)), 7, axis=0)
    return out


def _frame(spark, groups):
    return spark.createDataFrame([(g, *map(float, r)) for g, x in groups.items() for r in x], "g string, x0 double, x1 double, x2 double, x3 double")


def test_least_determinant_is_that_of_all_subsets(spark):
    groups = _groups()
    got = {r.g: r for r in rules.least_determinant(_frame(spark, groups)).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        h = int(np.ceil(rules.SHARE * len(x)))
        best = min((x[list(at)] for at in combinations(range(len(x)), h)), key=lambda s: np.linalg.det(_cov(s)))
        assert got[g].logdet == pytest.approx(np.log(np.linalg.det(_cov(best))), abs=1e-6), g
        assert got[g].mean == pytest.approx(list(best.mean(0)))
        z = x - best.mean(0)
        d2 = np.sort(np.einsum("ij,jk,ik->i", z, np.linalg.inv(_cov(best)), z))
        scale = max(1.0, d2[int(np.ceil(len(x) / 2)) - 1] / rules.MEDIAN)
        assert got[g].cov == pytest.approx(list((_cov(best) * scale)[np.tril_indices(4)])), g
        assert got[g].n == len(x)


def test_salted_joins_give_the_same(spark, monkeypatch):
    rows = _frame(spark, _groups())
    key = lambda t: [(r.g, r.n, pytest.approx(r.mean), pytest.approx(r.cov)) for r in t.orderBy("g").collect()]
    plain = rules.least_determinant(rows).orderBy("g").collect()
    monkeypatch.setattr(rules, "ESTIMATES", 0)
    assert [(r.g, r.n, r.mean, r.cov) for r in plain] == key(rules.least_determinant(rows))


def test_mixture_is_that_of_the_rows(spark):
    rng = np.random.default_rng(3)
    own, parent = rng.normal(size=(60, 4)) + 1, rng.normal(size=(rules.PRIOR, 4)) * 2
    low = np.tril_indices(4)
    schema = "mean array<double>, cov array<double>"
    pair = lambda x: ([*map(float, x.mean(0))], [*map(float, np.cov(x.T, bias=True)[low])])
    a = spark.createDataFrame([("g", 60, *pair(own))], "g string, n long, " + schema)
    b = spark.createDataFrame([pair(parent)], "pmean array<double>, pcov array<double>")
    got, both = rules.mixture(a, b, []).first(), np.vstack([own, parent])
    assert got.mean == pytest.approx(list(both.mean(0))) and got.cov == pytest.approx(list(np.cov(both.T, bias=True)[low]))


def test_verdicts_follow_the_distance(spark):
    """Each document's distance, computed again from the estimates of its groups; null and clashing names are groups of their own."""
    rng = np.random.default_rng(1)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("n", "rst", "lomp", "tikasu")]
    rows = []
    for i in range(90):
        text = " ".join(rng.choice(words, 80))
        if i % 15 == 0:
            text = "\n".join(" ".join(w + "|#" for w in rng.choice(words, 8)) for _ in range(9))
        rows.append((f"d{i}", ["x", "x:s", None][i % 3], [None, "s:t", "t"][i // 3 % 3], text, "kept"))
    docs = spark.createDataFrame(rows, "doc_id string, lang string, source string, text string, g string")
    got = {r.doc_id: r for r in rules.judge(docs).collect()}
    assert len(got) == 90 and not any(r.base_failed for r in got.values()) and all(not got[f"d{i}"].kept for i in range(0, 90, 15)) and sum(r.kept for r in got.values()) >= 80
    stats = {r.doc_id: r for r in rules.statistics(docs).collect()}
    x = {k: np.array([np.log((1 + r.word_chars) / r.n_words), *(np.sqrt(v / r.n_words) for v in (r.n_symbols, r.n_dup_lines, r.n_repeat_words))]) for k, r in stats.items()}
    long = [(k, *map(float, v)) for k, v in x.items()]
    frame = spark.createDataFrame(long, "doc_id string, x0 double, x1 double, x2 double, x3 double")
    names = docs.select("doc_id", "lang", "source", F.array(F.lit("all"), F.to_json(F.struct("lang")), F.to_json(F.struct("lang", "source", F.lit(1)))).alias("gs"))
    fits = {r.g: r for r in rules.least_determinant(frame.join(names, "doc_id").select(F.explode("gs").alias("g"), "x0", "x1", "x2", "x3")).collect()}

    def mix(n, own, other):
        (m, c), (pm, pc), w = own, other, n / (n + rules.PRIOR)
        return w * m + (1 - w) * pm, w * c + (1 - w) * pc + w * (1 - w) * np.outer(m - pm, m - pm)

    def full(r):
        c = np.zeros((4, 4))
        c[np.tril_indices(4)] = r.cov
        return np.array(r.mean), c + np.tril(c, -1).T

    for r in names.collect():
        fit = full(fits[r.gs[0]])
        for g in r.gs[1:]:
            fit = mix(fits[g].n, full(fits[g]), fit)
        z = x[r.doc_id] - fit[0]
        d2 = z @ np.linalg.inv(fit[1]) @ z
        assert got[r.doc_id].d2 == pytest.approx(d2, rel=1e-6, abs=1e-9) and got[r.doc_id].kept == (d2 <= rules.CUTOFF)
