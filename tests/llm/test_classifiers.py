"""Plain versions of what the classifiers compute: scores word by word, gradients by finite differences, training on whole texts."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexa.llm import quality, toxicity


def test_quality_score_is_the_mean_of_a_texts_features():
    rng = np.random.default_rng(2)
    weights = rng.normal(0, 2, quality.BUCKETS)
    scorer = quality.Scorer(weights, 0.3)
    for text in ["", "one", "one one", "ÉTÉ a b b a", "x " * 300]:
        words = text.split()
        ids = [i for w in words for i in quality.features([w])[0]] + [quality.SAME if a == b else quality.OTHER for a, b in itertools.pairwise(words)]
        z = 0.3 + (np.mean(weights[ids]) if ids else 0.0)
        assert scorer([text])[0] == pytest.approx(1 / (1 + np.exp(-z)))
        found, times = quality.counted(text)
        assert sorted(np.repeat(found, times.astype(int))) == sorted(ids)


def test_quality_learns_from_the_end_of_long_texts(spark):
    plain = " ".join(f"w{i % 97}" for i in range(6000))
    docs = spark.createDataFrame([(f"d{i}", plain + (" junk" * 400 if i % 2 else " fine" * 400)) for i in range(40)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", 1 - i % 2) for i in range(40)], "doc_id string, quality int")
    got = {r.doc_id: r.predicted for r in quality.classify(docs, labels).collect()}
    assert got == {f"d{i}": 1 - i % 2 for i in range(40)}


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_ids_of_any_type_repeated_rows_and_clashing_columns(spark, module, label):
    rows = [(f"d{i}", f"a{i} {'vile' if i % 3 == 0 else 'kind'} b{i * 7} words c{i * 3} here", "x", 1) for i in range(60)]
    rows += [rows[3], (None, None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, quality_score string, y int")
    labels = spark.createDataFrame([(f"d{i}", int(i % 3 == 0)) for i in range(60)] * 2, f"doc_id string, {label} int")
    got = module.classify(docs, labels).collect()
    assert len(got) == 62 and sum(r.doc_id == "d3" for r in got) == 2
    assert all(r.predicted == int(int(r.doc_id[1:]) % 3 == 0) for r in got if r.doc_id)


def _log_likelihood(e, first, label, logit, start):
    """Minus the log of the share of ``label`` among all labellings, one by one."""
    trans = np.exp(logit)

    def weight(ys):
        out = 1.0
        for t, y in enumerate(ys):
            out *= np.exp(e[t] * y) * (start[y] if first[t] else trans[ys[t - 1], y])
        return out

    return -np.log(weight([int(x) for x in label]) / sum(weight(ys) for ys in itertools.product((0, 1), repeat=len(e))))


def test_gradients_are_those_of_the_likelihood():
    rng = np.random.default_rng(4)
    e, logit, start = rng.normal(0, 1, 9), rng.normal(0, 1, (2, 2)), np.array([0.9, 0.1])
    first = np.array([1, 0, 0, 0, 1, 1, 0, 0, 0], bool)
    label = np.array([0, 1, 1, 0, 0, 1, 0, 0, 1], bool)
    by_word, by_step = toxicity.gradients(e, first, label, logit, start)
    f, d = lambda e, g: _log_likelihood(e, first, label, g, start), 1e-5
    for t in range(9):
        up, down = e.copy(), e.copy()
        up[t], down[t] = e[t] + d, e[t] - d
        assert by_word[t] == pytest.approx((f(up, logit) - f(down, logit)) / (2 * d), abs=1e-6)
    for i, j in itertools.product((0, 1), repeat=2):
        up, down = logit.copy(), logit.copy()
        up[i, j], down[i, j] = logit[i, j] + d, logit[i, j] - d
        assert by_step[i, j] == pytest.approx((f(e, up) - f(e, down)) / (2 * d), abs=1e-6)


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text of number "), "id", F.when(F.col("id") % 4 == 0, " vile").otherwise(" kind")).alias("text"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0).alias("toxic"))
    one, many = ({r.doc_id: r.score for r in toxicity.classify(docs.repartition(n), labels).collect()} for n in (1, 7))
    assert one == pytest.approx(many)
