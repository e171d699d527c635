"""Toxic spans by a linear-chain conditional random field over words; documents are scored from its marginals."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexa.llm.learning import bounded_batches, fold, tidy, trained, training_rows

#: Bound of the training sample, in rows (whole texts are learned from), and the most of them toxic.
SAMPLE_ROWS, TOXIC_SHARE = 5000, 0.4
#: A marker (a word or the beginning of words) needs LEAST toxic texts, and RATIO times the frequency that it has in other texts.
LEAST, RATIO = 5, 50.0
EPOCHS, STEP_TOKENS, RATE, L2, SEED = 12, 60_000, 0.5, 1e-5, 5
CACHE_WORDS, BLOCK, SPAN = 100_000, 64, 0.5
THRESHOLD = 0.3
EDGE = re.compile(r"^\W+|\W+$")


def folded(word: str) -> str:
    return EDGE.sub("", word.lower())


def chain(emission: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over texts laid end to end: P(toxic) of each word, P(previous, this) of each word as (n, 2, 2).

    ``emission``: log-odds of each word; ``first``: whether it begins a text. At such a word the step does not depend
    on the state before, so texts do not influence each other. Rows of BLOCK words run side by side; their products
    link them up.
    """
    n = len(emission)
    rows = -(-n // BLOCK)
    pad = rows * BLOCK - n
    e = np.exp(np.clip(np.concatenate([emission, np.zeros(pad)]), -30, 30)).reshape(rows, BLOCK)
    f = np.concatenate([first, np.ones(pad, bool)]).reshape(rows, BLOCK)
    step = np.where(f[:, :, None, None], np.broadcast_to(start, (2, 2)), trans)  # rows, BLOCK, from, to
    step = step * np.stack([np.ones_like(e), e], -1)[:, :, None, :]
    product = np.broadcast_to(np.eye(2), (rows, 2, 2))
    for k in range(BLOCK):
        product = product @ step[:, k]
        product = product / product.sum((1, 2), keepdims=True)
    ahead, after = np.empty((rows, 2)), np.empty((rows, 2))
    a0, a1 = 1.0, 0.0
    for r, ((p, q), (s, t)) in enumerate(product.tolist()):
        ahead[r] = a0, a1
        a0, a1 = a0 * p + a1 * s, a0 * q + a1 * t
        a0, a1 = a0 / (a0 + a1), a1 / (a0 + a1)
    b0, b1 = 0.5, 0.5
    for r in range(rows - 1, -1, -1):
        after[r] = b0, b1
        (p, q), (s, t) = product[r].tolist()
        b0, b1 = p * b0 + q * b1, s * b0 + t * b1
        b0, b1 = b0 / (b0 + b1), b1 / (b0 + b1)
    alpha, beta = np.empty((rows, BLOCK + 1, 2)), np.empty((rows, BLOCK, 2))
    alpha[:, 0] = ahead
    for k in range(BLOCK):
        a = (alpha[:, k, :, None] * step[:, k]).sum(1)
        alpha[:, k + 1] = a / a.sum(1, keepdims=True)
    b = after
    for k in range(BLOCK - 1, -1, -1):
        beta[:, k] = b
        b = (step[:, k] * b[:, None, :]).sum(2)
        b = b / b.sum(1, keepdims=True)
    pair = alpha[:, :-1, :, None] * step * beta[:, :, None, :]
    pair = (pair / pair.sum((2, 3), keepdims=True)).reshape(-1, 2, 2)[:n]
    return pair[:, :, 1].sum(1), pair


def beginnings(word: str) -> list[str]:
    return ["p " + word[:k] for k in range(3, min(7, len(word)))]


def token_features(word: str) -> list[str]:
    """A word's own features; what it gives its neighbours is named ``< word`` (for the next) and ``> word``."""
    return ["w " + word, *beginnings(word), "s " + word[-4:]] if word else []


def markers(texts: list[np.ndarray], toxic: list[bool], vocabulary: list[str]) -> np.ndarray:
    """Which words of ``vocabulary`` mark toxic texts (arrays of places in it), by themselves or by their beginnings.

    First a greedy cover: always the marker (a word, or a beginning of words) that explains most toxic texts not
    explained so far, so that words which only stand beside a marker are not taken for one. Then all others that are
    as exclusive and in 2 % of the toxic texts. Near copies, which share the four lowest word hashes, count once.
    """
    names: dict[str, int] = {}
    of_word = [np.array([names.setdefault(f, len(names)) for f in ("w " + w, *beginnings(w))] if len(w) > 1 else [], dtype=np.int32) for w in vocabulary]
    hashes = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in vocabulary], dtype=np.int64)
    seen, n_good, n_bad = set(), 0, 0
    good, bad = np.zeros(len(names), np.int64), []
    for ids, t in zip(texts, toxic, strict=True):
        have = np.unique(ids)
        sign = tuple(np.sort(hashes[have])[:4].tolist())
        if sign in seen:
            continue
        seen.add(sign)
        found = np.unique(np.concatenate([of_word[i] for i in have])) if len(have) else np.empty(0, np.int32)
        if t:
            bad.append(found)
        else:
            good[found] += 1
            n_good += 1
    n_bad, n_good = max(len(bad), 1), max(n_good, 1)
    count = lambda sets: np.bincount(np.concatenate(sets), minlength=len(names)) if sets else np.zeros(len(names), np.int64)
    counts = count(bad)
    sharp = (counts >= LEAST) & (counts / n_bad >= RATIO * (good + 0.5) / n_good)
    order = sorted(names, key=lambda f: (len(f), f))  # of equal gains the longest, last name wins
    rank = np.empty(len(names), np.int64)
    rank[[names[f] for f in order]] = np.arange(len(names))
    chosen = sharp & (counts >= max(2 * LEAST, 0.02 * n_bad))
    left = [fs[sharp[fs]] for fs in bad]
    while True:
        gain = count(left)
        worth = np.where(gain > 0, gain - 10 * good, -(1 << 40))
        top = np.flatnonzero(worth == worth.max()) if len(worth) else worth
        if not len(top) or worth[top[0]] == -(1 << 40):
            break
        best = top[np.argmax(rank[top])]
        if gain[best] < LEAST:
            break
        chosen[best] = True
        left = [fs for fs in left if best not in fs]
    return np.array([bool(chosen[fs].any()) for fs in of_word], dtype=bool)


def gradients(emission: np.ndarray, first: np.ndarray, label: np.ndarray, logit: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of minus the log-likelihood of ``label``: by each word's emission, and by the (2, 2) logs of the transitions' potentials."""
    p, pair = chain(emission, first, np.exp(logit), start)
    inner = ~first
    seen = np.zeros((2, 2))
    np.add.at(seen, (np.concatenate([[0], label[:-1]]).astype(int)[inner], label.astype(int)[inner]), 1)
    return p - label, pair[inner].sum(0) - seen


def train(texts: Iterable[list[str]], y: list[int]) -> dict:
    """Weights by feature, bias, transitions and start, from folded words of labelled texts.

    Documents carry the labels, so words are labelled first: in a toxic text each word with a marker, every other word
    is clean. Without markers all weights are 0.
    """
    place: dict[str, int] = {}
    texts = [np.array([place.setdefault(w, len(place)) for w in words], dtype=np.int32) for words in texts]
    vocabulary = list(place)
    marked = markers(texts, [bool(t) for t in y], vocabulary)
    model = {"weights": {}, "bias": 0.0, "trans": np.full((2, 2), 0.5), "start": np.array([1.0, 0.0])}
    if not marked.any():
        return model
    names: dict[str, int] = {}
    own_ids = np.full((len(vocabulary), 6), -1, dtype=np.int32)
    for i, w in enumerate(vocabulary):
        found = [names.setdefault(f, len(names)) for f in token_features(w)]
        own_ids[i, : len(found)] = found
    own = len(names)
    for side in "<>":
        for w in vocabulary:
            names[f"{side} {w}"] = len(names)
    docs = [(ids, bool(t)) for ids, t in zip(texts, y, strict=True) if len(ids)]
    weights, squares = np.zeros(len(names) + 1), np.full(len(names) + 1, 1e-8)  # the last one stands for no feature
    none = len(names)
    own_ids[own_ids < 0] = none
    bias, logit = -4.0, np.log(np.array([[0.99, 0.01], [0.9, 0.1]]))
    start = np.array([0.99, 0.01])
    rng = np.random.default_rng(SEED)

    def packed(part):
        at = np.concatenate([ids for ids, _ in part])
        first = np.zeros(len(at), bool)
        first[np.cumsum([0, *[len(ids) for ids, _ in part[:-1]]])] = True
        label = marked[at] & np.repeat([t for _, t in part], [len(ids) for ids, _ in part])
        before = np.where(first, none, own + np.concatenate([[0], at[:-1]]))
        behind = np.where(np.append(first[1:], True), none, own + len(vocabulary) + np.append(at[1:], 0))
        return np.column_stack([own_ids[at], before.astype(np.int32), behind.astype(np.int32)]), first, label

    parts, size, part = [], 0, []
    for i in rng.permutation(len(docs)):
        part.append(docs[i])
        size += len(docs[i][0])
        if size >= STEP_TOKENS:
            parts.append(packed(part))
            size, part = 0, []
    if part:
        parts.append(packed(part))
    for _ in range(EPOCHS):
        for ids, first, label in parts:
            delta, turn = gradients(weights[ids].sum(1) + bias, first, label, logit, start)
            grad = np.bincount(ids.ravel(), weights=np.repeat(delta, ids.shape[1]), minlength=len(weights)) + L2 * len(delta) * weights
            grad[none] = 0.0
            squares += grad**2
            weights -= RATE * grad / np.sqrt(squares)
            bias -= RATE * delta.sum() / max(10.0, np.abs(delta).sum())
            logit = np.clip(logit - RATE * turn / max(1.0, float(label.sum())), -8, 8)
    kept = {f: float(weights[i]) for f, i in names.items() if abs(weights[i]) > 0.02 and (i < own or abs(weights[i]) > 0.2)}
    return {"weights": kept, "bias": float(bias), "trans": np.exp(logit), "start": start}


def fit(docs: DataFrame, labels: DataFrame, keep=None) -> dict:
    """The model that ``train`` learns from the whole texts of SAMPLE_ROWS labelled rows at most. Ids may be of any type."""
    keep = F.lit(True) if keep is None else keep
    bounded_batches(docs.sparkSession)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "words": [" ".join(folded(w) or "." for w in t.split()) for t in b["text"]]})

    def learn(rows: pd.DataFrame) -> bytes:
        model = train((w.split() for w in rows["words"]), rows["y"].tolist())
        return json.dumps(model | {"trans": model["trans"].tolist(), "start": model["start"].tolist()}).encode()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = training_rows(docs, labels, "toxic", keep, SAMPLE_ROWS, TOXIC_SHARE).mapInPandas(tidy(gather), f"doc_id {kind}, y int, words string")
    model = json.loads(trained(rows, "words", SAMPLE_ROWS, learn))
    return model | {"trans": np.array(model["trans"]), "start": np.array(model["start"])}


class Tagger:
    """P(toxic) of each word of whole texts. A word seen before is looked up by its number."""

    def __init__(self, model: dict):
        self.model, self.known = model, {}
        self.clear()

    def clear(self) -> None:
        self.known.clear()
        self.values = np.zeros((4096, 3))  # own, for the next word, for the word before
        self.used = 1  # number 0: no learned feature

    def learn(self, words: set[str]) -> None:
        if len(self.known) > CACHE_WORDS:
            self.clear()
        get = self.model["weights"].get
        for w in [w for w in words if w not in self.known]:
            c = folded(w) or "."
            if self.used == len(self.values):
                self.values = np.concatenate([self.values, np.zeros_like(self.values)])
            own = sum(get(f, 0.0) for f in token_features(c))
            after, before = get("< " + c, 0.0), get("> " + c, 0.0)
            if own or after or before:
                self.values[self.used] = own, after, before
                self.known[w] = self.used
                self.used += 1
            else:
                self.known[w] = 0

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Marginals by text."""
        if not self.model["weights"]:
            return [np.zeros(len(t.split())) for t in texts]
        split = [t.split() for t in texts]
        self.learn({w for words in split for w in words})
        sizes = [len(words) for words in split]
        at = np.fromiter((i for words in split for i in map(self.known.__getitem__, words)), dtype=np.int64, count=sum(sizes))
        if not len(at):
            return [np.zeros(0) for _ in texts]
        first = np.zeros(len(at) + 1, bool)
        first[np.cumsum([0, *sizes])] = True
        v = self.values[at]
        e = v[:, 0] + self.model["bias"]
        e[1:] += np.where(first[1:-1], 0.0, v[:-1, 1])
        e[:-1] += np.where(first[1:-1], 0.0, v[1:, 2])
        p = chain(e, first[:-1], self.model["trans"], self.model["start"])[0]
        return np.split(p, np.cumsum(sizes)[:-1])


def spans(text: str, p: np.ndarray) -> list[dict]:
    """Runs of words with P(toxic) of SPAN or more, as character offsets with their highest probability."""
    out: list[dict] = []
    open_ = False
    for m, q in zip(re.finditer(r"\S+", text), p.tolist(), strict=True):
        if q < SPAN:
            open_ = False
        elif open_:
            out[-1] |= {"end": m.end(), "p": max(out[-1]["p"], q)}
        else:
            out.append({"start": m.start(), "end": m.end(), "p": q})
            open_ = True
    return out


def score(docs: DataFrame, model: dict, column: str = "toxicity") -> DataFrame:
    """``docs`` with ``column``: struct(score, spans). The score is the highest marginal of a word, 0 for null and empty texts."""

    def tagged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(model)
        for batch in batches:
            texts = batch.fillna("").tolist()
            found = [p for at in range(0, len(texts), 100) for p in tagger(texts[at : at + 100])]
            top = [float(p.max()) if len(p) else 0.0 for p in found]
            yield pd.DataFrame({"score": top, "spans": [spans(t, p) if s >= SPAN else [] for t, p, s in zip(texts, found, top, strict=True)]})

    @F.pandas_udf("score double, spans array<struct<start:int,end:int,p:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from tidy(tagged)(batches)

    bounded_batches(docs.sparkSession)
    return docs.withColumn(column, run(F.col("text")))


def classify(docs: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of every document; labels of held-out rows are not seen.

    Null and empty texts: score 0, no spans. A null id is in the fold of ''. Repeated rows are scored each; texts of any
    length are tagged whole; an empty table gives no rows. Ids may be of any type. Other columns of ``docs`` are not
    read, whatever their names.
    """
    model = fit(docs, labels, fold(F.col("_id"), mod) != held)
    rows = score(docs.select("doc_id", "text"), model)
    s = F.col("toxicity.score")
    return rows.select("doc_id", (fold(F.col("doc_id"), mod) == held).alias("held_out"), s.alias("score"), (s >= THRESHOLD).cast("int").alias("predicted"), F.col("toxicity.spans").alias("spans"))
