"""Quality classifier: averaged subword embeddings with a softmax on top, trained by stochastic gradient descent in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexa.llm.learning import bounded_batches, fold, tidy, trained, training_rows

HASHED, DIM, NGRAMS = 1 << 16, 8, (3, 4)
#: Word bigrams have a vector by their pattern: two times one word, or two words.
SAME, OTHER = HASHED, HASHED + 1
BUCKETS = HASHED + 2
#: Bound of the training sample, in rows; whole texts are learned from.
SAMPLE_ROWS = 4000
EPOCHS, LEAST_STEPS, BATCH, RATE, SEED = 12, 1500, 32, 0.5, 11
CACHE_WORDS, BLOCK_WORDS = 100_000, 100_000
THRESHOLD = 0.3


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of its word) of each word and of the byte n-grams of ``<word>``."""
    raw = [b"<" + w.encode("utf-8", "surrogatepass") + b">" for w in words]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(raw)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))  # bytes from here to the end of the word
    ids = [np.array([zlib.crc32(r) for r in raw], dtype=np.uint32)]
    owners = [np.arange(len(raw))]
    for n in NGRAMS:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, 2166136261 + n, dtype=np.uint32)
        for i in range(n):
            h = (h ^ data[i : len(data) - n + 1 + i]) * np.uint32(16777619)
        inside = left[: len(h)] >= n
        ids.append(h[inside])
        owners.append(owner[: len(h)][inside])
    mixed = np.concatenate(ids) * np.uint32(2654435761)
    return (mixed >> np.uint32(16)).astype(np.int64) % HASHED, np.concatenate(owners)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, times) of all features of a whole text; at most BUCKETS of them, however long it is."""
    words, total = text.split(), None
    for at in range(0, len(words), BLOCK_WORDS):
        some = np.bincount(features(words[at : at + BLOCK_WORDS])[0], minlength=BUCKETS)
        total = some if total is None else total + some
    if len(words) > 1:
        same = sum(map(eq, words, words[1:]))
        total[SAME], total[OTHER] = same, len(words) - 1 - same
    ids = np.empty(0, np.int64) if total is None else np.flatnonzero(total)
    return ids.astype(np.int32), np.zeros(0, np.int32) if total is None else total[ids].astype(np.int32)


def train(xs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> tuple[np.ndarray, float]:
    """(a weight for each bucket, bias) by stochastic gradient descent over embeddings and softmax together.

    For two classes a feature's vector enters a score only by its product with the difference of the softmax rows, so
    that product is all that scoring needs. Without rows of both labels the weights are 0 and the bias follows the
    labels seen.
    """
    if len(set(y.tolist())) < 2:
        rate = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return np.zeros(BUCKETS), float(np.log(rate / (1 - rate)))
    rng = np.random.default_rng(SEED)
    E = rng.uniform(-1 / DIM, 1 / DIM, (DIM, BUCKETS))
    V, b = rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    epochs = max(EPOCHS, -(-LEAST_STEPS // -(-len(xs) // BATCH)))
    steps, done = epochs * -(-len(xs) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(xs))
        for at in range(0, len(xs), BATCH):
            pick = [i for i in order[at : at + BATCH] if len(xs[i][0])]
            rate = RATE * (1 - done / steps)
            done += 1
            if not pick:
                continue
            ids = np.concatenate([xs[i][0] for i in pick])
            sizes = np.array([len(xs[i][0]) for i in pick])
            share = np.concatenate([xs[i][1] / xs[i][1].sum() for i in pick])
            mean = np.add.reduceat(E[:, ids] * share, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=1).T
            z = mean @ V + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            grad = p @ V.T
            V -= rate * mean.T @ p / len(pick)
            b -= rate * p.mean(0)
            for d in range(DIM):
                E[d] -= np.bincount(ids, weights=np.repeat(grad[:, d], sizes) * share * (rate * 10), minlength=BUCKETS)
    return (V[:, 1] - V[:, 0]) @ E, float(b[1] - b[0])


def fit(docs: DataFrame, labels: DataFrame, keep=None) -> tuple[np.ndarray, float]:
    """(a weight for each bucket, bias): the log-odds of label 1 is their mean over a text's features, plus the bias.

    Learned from SAMPLE_ROWS labelled rows at most. Ids may be of any type; rows with repeated ids are samples each.
    """
    keep = F.lit(True) if keep is None else keep

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [counted(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "facts": [i.tobytes() + n.tobytes() for i, n in found]})

    def learn(rows: pd.DataFrame) -> bytes:
        both = [np.frombuffer(x, dtype=np.int32) for x in rows["facts"]]
        xs = [(x[: len(x) // 2], x[len(x) // 2 :]) for x in both]
        weights, bias = train(xs, rows["y"].to_numpy(dtype=np.int64))
        return np.append(weights, bias).tobytes()

    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = training_rows(docs, labels, "quality", keep, SAMPLE_ROWS).mapInPandas(tidy(gather), f"doc_id {kind}, y int, facts binary")
    model = np.frombuffer(trained(rows, "facts", SAMPLE_ROWS, learn), dtype=np.float64)
    return model[:-1], float(model[-1])


class Scorer:
    """Scores whole texts; words seen before are looked up as (sum of weights, number of features) in one complex number."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = [w for w in {w for words in texts for w in words} if w not in self.known]
        if new:
            ids, owner = features(new)
            total = np.bincount(owner, weights=self.weights[ids], minlength=len(new))
            self.known.update(zip(new, (total + 1j * np.bincount(owner, minlength=len(new))).tolist(), strict=True))

    def __call__(self, texts: list[str]) -> list[float]:
        out = []
        for at in range(0, len(texts), 100):
            split = [t.split() for t in texts[at : at + 100]]
            self.learn(split)
            for words in split:
                same = sum(map(eq, words, words[1:]))
                pairs = complex(same * self.weights[SAME] + (len(words) - 1 - same) * self.weights[OTHER], len(words) - 1)
                s = sum(map(self.known.__getitem__, words), pairs)
                z = self.bias + (s.real / s.imag if words else 0.0)
                out.append(float(1 / (1 + np.exp(-np.clip(z, -50, 50)))))
        return out


def score(docs: DataFrame, model: tuple[np.ndarray, float], column: str = "quality_score") -> DataFrame:
    """``docs`` with ``column`` (0 to 1, higher: label 1 likelier). Null and empty texts get the bias alone.

    The model is an array of fixed size (one weight a bucket), so it travels with the tasks.
    """
    weights, bias = model[0].astype(np.float64), model[1]

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(weights, bias)
        for texts in batches:
            yield pd.Series(scorer(texts.fillna("").tolist()), dtype="float64")

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidy(scores)(batches)

    bounded_batches(docs.sparkSession)
    return docs.withColumn(column, run(F.col("text")))


def classify(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; labels of held-out rows are not seen.

    Null and empty texts: the score of the bias alone. A null id is in the fold of ''. Repeated rows are scored each;
    texts of any length are scored whole; an empty table gives no rows. Ids may be of any type. Other columns of
    ``docs`` are not read, whatever their names.
    """
    model = fit(docs, labels, fold(F.col("_id"), mod) != held)
    rows = score(docs.select("doc_id", "text"), model)
    high = F.col("quality_score") >= THRESHOLD
    return rows.select("doc_id", (fold(F.col("doc_id"), mod) == held).alias("held_out"), F.col("quality_score").alias("score"), high.cast("int").alias("predicted"))
