"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexa.llm.common import discard, written
from codexa.llm.learning import bounded_batches, give_back, tidy

#: Five words and 0.8, the defaults; a contract may ask for others.
N, THRESHOLD = 5, 80
#: N-grams in at least COMMON different texts rank alike, behind all rarer ones (6 bits of an n-gram's key).
COMMON = 64
#: Bits of an n-gram's hash: the rest of its key. Two n-grams of a pair of 1000 each fall together once in 10 ** 11 pairs.
BITS = 58
#: N-grams that a worker gathers before it deals them out, and about as many go to one reducing group.
BUFFER, GROUP = 250_000, 600_000
#: Words whose hashes, and texts whose names a worker keeps.
CACHE_WORDS = 100_000
#: Partitions that groups are dealt over, at most; more groups share partitions.
PARTITIONS = 50_000
#: Rounds in which each n-gram whose texts are not all connected links them by one of them, before all its pairs meet.
STARS = 2
#: A graph of no more links is finished by one task (16 bytes a link); larger ones contract in rounds until it is one.
LINKS_IN_TASK = 1 << 20
#: Columns of a text's bitmap, 64 bits each.
MAP = [f"m{i}" for i in range(4)]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Grams:
    """Sorted distinct n-gram hashes of texts; hashes of words seen before are looked up."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def __call__(self, text: str) -> np.ndarray:
        # of bytes, lower() changes A-Z alone, and split() takes the blank and 9 to 13 alone
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        try:
            h = np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            known.update({w: xxhash.xxh64_intdigest(w) for w in set(words) if w not in known})
            h = np.array([known[w] for w in words], dtype=np.uint64)
        n = min(self.n, len(words))
        out = np.full(len(words) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
        return np.unique(out)


def signature(grams: np.ndarray) -> bytes:
    """16 bytes of a set of n-grams; they identify its class."""
    return blake2b(grams.tobytes(), digest_size=16).digest()


def named(sig: bytes, bits: int = 64, again: int = 0) -> int:
    """A class's name: 8 bytes of its signature, or of a hash of it drawn ``again``."""
    head = blake2b(sig + again.to_bytes(4, "little"), digest_size=8).digest() if again else sig[:8]
    return int.from_bytes(head, "little", signed=True) >> 64 - bits


def needed(size, t: int):
    """Least overlap with any set that is similar enough: ceil(t * size / 100)."""
    return -(-t * size // 100)


def overlap(a, b, t: int):
    """Least overlap of two sets of sizes a and b for a Jaccard similarity of t / 100."""
    return -(-t * (a + b) // (100 + t))


def hamming_bound(x: np.ndarray, y: np.ndarray, depth: int) -> int:
    """A lower bound of the symmetric difference: both sorted suffixes are split at a middle element, some times over."""
    if depth == 0 or not len(x) or not len(y):
        return abs(len(x) - len(y))
    pivot = y[len(y) // 2]
    i, j = int(np.searchsorted(x, pivot)), len(y) // 2
    same = i < len(x) and x[i] == pivot
    return hamming_bound(x[:i], y[:j], depth - 1) + hamming_bound(x[i + same :], y[j + 1 :], depth - 1) + (not same)


def bitmap(grams: np.ndarray) -> list[int]:
    """Each bit tells whether an odd number of n-grams falls on it: where two bitmaps differ in k bits, the sets differ in k n-grams at least."""
    bits = np.bincount((_mix(grams.astype(np.uint64)) & np.uint64(64 * len(MAP) - 1)).astype(np.int64), minlength=64 * len(MAP)) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def texts(docs: DataFrame, doc_id: str, n: int) -> DataFrame:
    """(doc_id, n_shingles, sig): sig is null for a text without words."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams(n)
        for b in batches:
            found = [grams(t) for t in b["text"].fillna("")]
            out = pd.DataFrame({"doc_id": b["doc_id"], "n_shingles": [len(g) for g in found], "sig": [signature(g) if len(g) else None for g in found]})
            yield out.astype({"doc_id": "Int64"}) if str(out["doc_id"].dtype).startswith("float") else out

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).alias("doc_id"), "text").mapInPandas(tidy(run), f"doc_id {kind}, n_shingles long, sig binary")


def names_of(sig: str, bits: int, again: dict[bytes, int]) -> Column:
    drawn = dict(again)

    @F.pandas_udf("long")
    def name(sigs: pd.Series) -> pd.Series:
        return pd.Series([named(bytes(s), bits, drawn.get(bytes(s), 0)) for s in sigs], dtype="int64")

    return name(sig)


def clashes(classes: DataFrame, bits: int) -> dict[bytes, int]:
    """By signature, how often a class's name has to be drawn anew so that all names differ.

    Of N classes about N * N / 2 ** 65 share a name with another: 27 of 10 ** 10.5. So the driver holds a few only.
    """
    again: dict[bytes, int] = {}
    while True:
        names = classes.select("sig", names_of("sig", bits, again).alias("name"))
        twice = names.groupBy("name").agg(F.count("*").alias("k"), F.min("sig").alias("first")).where("k > 1")
        more = names.join(twice, "name").where("sig <> first").select("sig").take(1_000_001)
        if len(more) > 1_000_000:
            raise ValueError("more names clash than signatures can")
        if not more:
            return again
        for row in more:
            again[bytes(row.sig)] = again.get(bytes(row.sig), 0) + 1


def _packed(h: np.ndarray) -> bytes:
    """Sorted hashes: the first, and 6 bytes for each step to the next one; 8 bytes each where a step is larger."""
    steps = np.diff(h)
    if len(steps) and int(steps.max()) >> 48:
        return h.astype("<u8").tobytes()
    return h[:1].astype("<u8").tobytes() + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    if len(blob) == 8 * n:
        return np.frombuffer(blob, dtype="<u8")
    steps = np.zeros((n, 8), np.uint8)
    steps[0] = np.frombuffer(blob, dtype=np.uint8, count=8)
    steps[1:, :6] = np.frombuffer(blob, dtype=np.uint8, offset=8).reshape(-1, 6)
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before; none of no rows."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    differs = np.zeros(len(columns[0]), bool)
    differs[0] = True
    for c in columns:
        differs[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(differs)


def _runs(starts: np.ndarray, end: int) -> list[tuple[int, int]]:
    return list(zip(starts.tolist(), [*starts.tolist()[1:], end] if len(starts) else [], strict=True))


PACKED = "kind int, key long, n int, h binary, ref binary, sigs binary, sizes binary"


def _deal(docs: DataFrame, n: int, groups: int, bits: int, again: dict[bytes, int]) -> DataFrame:
    """Rows of packed n-grams, each distinct text once per task.

    kind 0 (key: range of hashes): ``n`` hashes in ``h`` and the index of their text in ``ref``, of which ``sigs``
    tells the name; kind 1 (key: owner of a text): ``sigs`` and ``sizes`` of texts, and their n-grams that are
    common already in this buffer, in ``h`` with the index of their text in ``ref``.
    An n-gram that COMMON or more texts of the buffer hold goes to its range once, with ref -1 (65535 in two bytes).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, seen = Grams(n), set()
        sets: list[np.ndarray] = []
        names: list[int] = []

        def flush() -> pd.DataFrame:
            sizes = np.array([len(g) for g in sets], dtype=np.int64)
            h = np.concatenate(sets) >> np.uint64(64 - BITS)
            ref = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
            sig = np.array(names, dtype=np.int64)
            order = np.argsort(h, kind="stable")
            h, ref = h[order], ref[order]
            start = _starts(h)
            count = np.diff(np.append(start, len(h)))
            hot = np.repeat(count >= COMMON, count)
            owner = sig % groups
            hot_h, hot_ref = h[hot], ref[hot]
            hot_owner = owner[hot_ref]
            rows = []
            for o in np.unique(owner):
                mine = np.flatnonzero(owner == o)
                new = np.full(len(sig), -1, np.int32)
                new[mine] = np.arange(len(mine))
                pick = hot_owner == o
                rows.append((1, int(o), int(pick.sum()), hot_h[pick].tobytes(), new[hot_ref[pick]].tobytes(), sig[mine].tobytes(), sizes[mine].tobytes()))
            once = ~hot
            once[start] = True
            h, ref = h[once], np.where(hot[once], np.int32(-1), ref[once])
            part = ((h >> np.uint64(BITS - 32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
            for a, b in _runs(_starts(part), len(part)):
                r = ref[a:b]
                held = np.unique(r[r >= 0])
                place = np.where(r >= 0, np.searchsorted(held, r), -1)
                refs = place.astype(np.uint16) if len(held) < 65535 else place.astype(np.int32)
                rows.append((0, int(part[a]), b - a, _packed(h[a:b]), refs.tobytes(), sig[held].tobytes(), b""))
            sets.clear()
            names.clear()
            return pd.DataFrame(rows, columns=["kind", "key", "n", "h", "ref", "sigs", "sizes"])

        held = 0
        for b in batches:
            for t in b["text"].fillna(""):
                g = grams(t)
                if not len(g):
                    continue
                sig = signature(g)
                name = named(sig, bits, again.get(sig, 0))
                if name in seen:
                    continue
                if len(seen) > CACHE_WORDS:
                    seen.clear()
                seen.add(name)
                sets.append(g)
                names.append(name)
                held += len(g)
                if held >= BUFFER:
                    yield flush()
                    held = 0
        if sets:
            yield flush()

    bounded_batches(docs.sparkSession)
    return docs.select("text").mapInPandas(tidy(run), PACKED)


def _refs(row) -> np.ndarray:
    """Of each hash of a kind 0 row the index of its text, -1 for common ones."""
    if len(row.ref) == 2 * row.n:
        short = np.frombuffer(row.ref, dtype=np.uint16).astype(np.int64)
        return np.where(short == 65535, -1, short)
    return np.frombuffer(row.ref, dtype=np.int32).astype(np.int64)


def ordered_texts(docs: DataFrame, n: int, t: int, total: int, bits: int = 64, again: dict[bytes, int] | None = None) -> DataFrame:
    """(name, size, unique, grams): the texts that can have a partner, with their shared n-grams, rarest first.

    An n-gram's rank is its number of different texts (COMMON at most), then its hash; both make up its key. N-grams of
    one text alone come first in that order and match nothing, so only their number counts; a text with a prefix of
    nothing else is dropped.
    """
    groups = max(1, -(-total // GROUP))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["kind"].iloc[0] == 1:  # on to their owner as they are
            return pdf
        hs, refs, names = [], [], []
        for row in pdf.itertuples():
            ref, sig = _refs(row), np.frombuffer(row.sigs, dtype=np.int64)
            hs.append(_unpacked(row.h, row.n))
            refs.append(ref)
            names.append(sig[ref] if len(sig) else np.zeros(len(ref), np.int64))  # a common one's name is not used
        flat_h, hot, sig = np.concatenate(hs), np.concatenate(refs) < 0, np.concatenate(names)
        common = np.unique(flat_h[hot])
        flat_h, sig = flat_h[~hot], sig[~hot]
        order = np.lexsort((sig, flat_h))
        flat_h, sig = flat_h[order], sig[order]
        new = _starts(flat_h, sig)  # the rest are copies in another task
        flat_h, sig = flat_h[new], sig[new]
        start = _starts(flat_h)
        times = np.diff(np.append(start, len(flat_h))).astype(np.int64)
        df = np.where(np.isin(flat_h[start], common), COMMON, np.minimum(times, COMMON))
        df = np.repeat(df, times)
        keep = df >= 2
        flat_h, sig, df = flat_h[keep], sig[keep], df[keep].astype(np.uint8)
        owner = sig % groups
        order = np.lexsort((sig, owner))
        flat_h, sig, df, owner = flat_h[order], sig[order], df[order], owner[order]
        rows = []
        for a, b in _runs(_starts(owner), len(owner)):
            u, each = np.unique(sig[a:b], return_counts=True)
            rows.append((2, int(owner[a]), b - a, flat_h[a:b].tobytes(), df[a:b].tobytes(), u.tobytes(), each.astype(np.int32).tobytes()))
        give_back()
        return pd.DataFrame(rows, columns=pdf.columns)

    # the number of partitions follows the number of n-grams, so that tasks stay as large as they are
    dealt = _deal(docs, n, groups, bits, again or {}).repartition(min(2 * groups, PARTITIONS), "kind", "key")
    back = dealt.groupBy("kind", "key").applyInPandas(count, PACKED).repartition(min(groups, PARTITIONS), "key")

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        size_of: dict[int, int] = {}
        hs, sigs, dfs = [], [], []
        for row in pdf.itertuples():
            sig, h = np.frombuffer(row.sigs, dtype=np.int64), np.frombuffer(row.h, dtype=np.uint64)
            hs.append(h)
            if row.kind == 1:
                size_of.update(zip(sig.tolist(), np.frombuffer(row.sizes, dtype=np.int64).tolist(), strict=True))
                sigs.append(sig[np.frombuffer(row.ref, dtype=np.int32)])
                dfs.append(np.full(len(h), COMMON, np.uint8))
            else:
                sigs.append(np.repeat(sig, np.frombuffer(row.sizes, dtype=np.int32)))
                dfs.append(np.frombuffer(row.ref, dtype=np.uint8))
        h, sig, df = np.concatenate(hs), np.concatenate(sigs), np.concatenate(dfs).astype(np.uint64)
        key = df - np.uint64(1) << np.uint64(BITS) | h
        order = np.lexsort((key, sig))
        sig, key = sig[order], key[order]
        new = _starts(sig, key)
        sig, key = sig[new], key[new]
        rows = []
        for a, b in _runs(_starts(sig), len(sig)):
            size = size_of[int(sig[a])]
            unique = size - (b - a)
            if unique <= size - needed(size, t):  # else its prefix holds n-grams of this text alone
                rows.append((int(sig[a]), size, unique, key[a:b].astype("<u8").tobytes()))
        if not rows:
            return pd.DataFrame({c: pd.Series(dtype="object" if c == "grams" else "int64") for c in ("name", "size", "unique", "grams")})
        return pd.DataFrame(rows, columns=["name", "size", "unique", "grams"])

    return written(back.groupBy("key").applyInPandas(gather, "name long, size long, unique long, grams binary"), "ordered")


def _prefixes(rows: DataFrame, t: int) -> DataFrame:
    """(gram, name, size, pos, index, own, bitmap): the prefix n-grams with their place; ``index``: in the shorter prefix for equal or longer partners.

    ``own`` is the number of n-grams of this text alone; the bitmap tells of the others.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, size, unique, blob in zip(b["name"], b["size"], b["unique"], b["grams"], strict=True):
                long_, short = size - needed(size, t) + 1, size - overlap(size, size, t) + 1
                every = np.frombuffer(blob, dtype="<u8")
                g = every[: max(0, long_ - unique)].view(np.int64)
                pos = unique + np.arange(len(g))
                out.append(pd.DataFrame({"gram": g, "name": name, "size": size, "pos": pos, "index": pos < short, "own": unique} | dict(zip(MAP, bitmap(every), strict=True))))
            if out:
                yield pd.concat(out).astype({c: "int64" for c in ["gram", "name", "size", "pos", "own", *MAP]} | {"index": "bool"})

    schema = "gram long, name long, size long, pos long, index boolean, own long, " + ", ".join(f"{m} long" for m in MAP)
    return rows.select("name", "size", "unique", "grams").mapInPandas(tidy(run), schema)


def _verified(pairs: DataFrame, rows: DataFrame, t: int) -> DataFrame:
    """The pairs (a, b) that are similar, each looked at once: suffix filter, then the exact overlap.

    ``a`` may be a text with very many partners: its n-grams are joined last, where a skewed partition is split and
    nothing is shuffled afterwards.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            keep = []
            for x, y, n, m in zip(p["x"], p["y"], p["n"], p["m"], strict=True):
                x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
                least = overlap(n, m, t)
                own = (n - len(x)) + (m - len(y))  # n-grams of one text alone differ
                ok = own + hamming_bound(x, y, 3) <= n + m - 2 * least
                keep.append(bool(ok) and len(np.intersect1d(x, y, assume_unique=True)) >= least)
            yield p.loc[np.array(keep, bool), ["a", "b"]]

    one = rows.select(F.col("name").alias("a"), F.col("size").alias("n"), F.col("grams").alias("x"))
    two = rows.select(F.col("name").alias("b"), F.col("size").alias("m"), F.col("grams").alias("y"))
    return pairs.join(two, "b").join(one, "a").mapInPandas(tidy(run), "a long, b long")


def union_find(edges: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(name, root) of all names of ``edges`` (a, b), with the smallest name of each component, by numpy in one task."""
    parts = list(edges)
    if not parts:
        return
    a, b = (np.concatenate([p[c].to_numpy(dtype=np.int64) for p in parts]) for c in "ab")
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for side in (a, b):  # roots hook onto the least root beside them, then all names follow their roots to the end
            np.minimum.at(new, root[side], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, root):
            break
        root = new
    yield pd.DataFrame({"name": names, "root": names[root]})


def components(edges: DataFrame, in_task: int = LINKS_IN_TASK) -> DataFrame:
    """(name, root): every name of ``edges`` (a, b) with the smallest name of its component.

    A graph of at most ``in_task`` links is finished by one task. A larger one is contracted first: every name takes the
    smallest of its neighbours, and twice that one's own; links between what is left are the next, smaller graph. So no
    task holds more than ``in_task`` links, and the rounds grow with the logarithm of the graph. All are written tables.
    """
    live = lambda pairs: pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, steps = written(live(edges), "links"), []
    while edges.count() > in_task:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("name")).agg(F.least(F.min("b"), F.col("name")).alias("root"))
        for _ in range(2):
            step = written(step, "step")
            step = step.join(step.select(F.col("name").alias("root"), F.col("root").alias("far")), "root").select("name", F.col("far").alias("root"))
        steps.append(written(step, "step"))
        to = lambda c: steps[-1].select(F.col("name").alias(c), F.col("root").alias("to_" + c))
        smaller = written(live(edges.join(to("a"), "a").join(to("b"), "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))), "links")
        discard(edges)
        edges = smaller
    out = edges.coalesce(1).mapInPandas(tidy(union_find), "name long, root long")
    for step in reversed(steps):
        ends = out.select(F.col("name").alias("root"), F.col("root").alias("far"))
        out = step.join(ends, "root", "left").select("name", F.coalesce("far", "root").alias("root"))
    return written(out, "roots")


def links(rows: DataFrame, t: int, in_task: int = LINKS_IN_TASK) -> DataFrame:
    """(name, root): of each text of ``rows`` the smallest name of its component.

    First each prefix n-gram's shortest text meets the others that share it: within a group of near copies this
    links most at a cost in proportion to the group. The shortest may be an outlier: STARS rounds more let each n-gram
    that is still open link its texts by one drawn by hash. Then all pairs that share a prefix n-gram meet, but for
    those that are connected already. Length and positional filters stand in the join, and so does a bound of the sets'
    difference by bitmaps: it looks at whole sets, where the suffix filter after the join looks more closely.

    One table of roots is carried along: a round's links between roots are a small graph, whose components rename them.
    """
    facts = ["size", "name", "pos", "own", *MAP]
    both = F.col("a_size") + F.col("size")
    least = F.ceil(both * t / (100 + t) - 1e-6)
    differ = sum((F.bit_count(F.col("a_" + m).bitwiseXOR(F.col(m))) for m in MAP), F.col("a_own") + F.col("own"))
    long_enough = F.least("a_size", "size") * 100 >= F.greatest("a_size", "size") * t
    enough = long_enough & (1 + F.least(F.col("a_size") - F.col("a_pos") - 1, F.col("size") - F.col("pos") - 1) >= least) & (differ <= both - 2 * least)

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs (a_name, name) those that are similar; each is looked at once, from the side that met it."""
        once = pairs.groupBy(F.least("a_name", "name").alias("lo"), F.greatest("a_name", "name").alias("hi")).agg(F.min("a_name").alias("a"))
        return written(_verified(once.select("a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b")), rows, t), "verified")

    def connected(label: DataFrame, found: DataFrame) -> DataFrame:
        """``label`` with the roots that the links ``found`` connect made one."""
        root = lambda c: label.select(F.col("name").alias(c), F.col("root").alias("r" + c))
        between = found.join(root("a"), "a").join(root("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        ends = components(between, in_task)
        new = label.join(ends.select(F.col("name").alias("root"), F.col("root").alias("to")), "root", "left").select("name", F.coalesce("to", "root").alias("root"))
        new = written(new, "label")
        discard(label, found, ends)
        return new

    def still_open(live: DataFrame, label: DataFrame) -> DataFrame:
        """Rows of n-grams whose texts are not all connected, with the texts' roots; others have nothing left to join."""
        live = live.join(label, "name")
        open_ = live.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("gram")
        return written(live.join(open_, "gram", "left_semi"), "live")

    pre = written(_prefixes(rows, t), "prefixes")
    leads = pre.groupBy("gram").agg(F.count("*").alias("k"), F.min(F.when(F.col("index"), F.struct(*facts))).alias("lead")).where("k > 1 and lead is not null")
    leads = written(leads, "leads")
    star = pre.join(leads.select("gram", *[F.col("lead." + c).alias("a_" + c) for c in facts]), "gram")
    label = written(rows.select("name", F.col("name").alias("root")), "label")
    label = connected(label, verified(star.where((F.col("name") != F.col("a_name")) & enough)))
    live = still_open(pre.join(leads.where("k > 2").select("gram"), "gram", "left_semi"), label)
    discard(pre, leads)
    for salt in range(STARS):
        if live.isEmpty():
            break
        drawn = F.struct(F.xxhash64("gram", "name", F.lit(salt)).alias("h"), "root", *facts)
        lead = live.groupBy("gram").agg(F.min(drawn).alias("lead")).select("gram", *[F.col("lead." + c).alias("a_" + c) for c in [*facts, "root"]])
        label = connected(label, verified(live.join(lead, "gram").where((F.col("a_root") != F.col("root")) & enough)))
        before, live = live, still_open(live.drop("root"), label)
        discard(before)
    if not live.isEmpty():
        one = live.where("index").select("gram", *[F.col(c).alias("a_" + c) for c in [*facts, "root"]])
        shorter = (F.col("a_size") < F.col("size")) | ((F.col("a_size") == F.col("size")) & (F.col("a_name") < F.col("name")))
        label = connected(label, verified(one.join(live, "gram").where((F.col("a_root") != F.col("root")) & shorter & enough)))
    discard(live)
    return label


def join(docs: DataFrame, doc_id: str = "doc_id", n: int = N, threshold: int = THRESHOLD, in_task: int = LINKS_IN_TASK, name_bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id): the components of texts linked by a Jaccard similarity of threshold / 100.

    Words are runs of anything but blanks and the characters 9 to 13, A-Z lower-cased; a set holds a text's distinct
    n-word shingles, or the whole sequence if it has fewer words. Texts with equal sets form a class, and only classes
    are joined. Null and empty texts have no shingles and are linked with nothing, not even each other. Repeated rows
    are linked. Component: the smallest doc_id; a null doc_id is passed over for it. Texts may be of any length. Empty
    table: no rows. Other columns are not read, whatever their names.

    Any two sets that are similar share an n-gram within their prefixes in one common order of all n-grams; in
    rare-first order few others do. The order needs each n-gram's number of texts: hashes are dealt out by range as
    packed arrays, counted, and those of two or more texts go back to the owner of the text. N-grams that are common
    within a buffer are known to be common without that, so no range holds a frequent one many times.

    Classes are told apart by 16 bytes, and travel by a name of 8 (``name_bits``) that is drawn anew where two share it.
    ``in_task``: links of a graph that one task may finish.
    """
    base = written(texts(docs, doc_id, n), "texts")
    classes = base.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"))
    classes = written(classes, "classes")
    total = classes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    again = clashes(classes, name_bits)
    rows = ordered_texts(docs, n, threshold, total, name_bits, again)
    found = links(rows, threshold, in_task)
    label = classes.select("sig", "rep", names_of("sig", name_bits, again).alias("name")).join(found, "name", "left").select("sig", "rep", F.coalesce("root", "name").alias("root"))
    label = written(label, "named")
    least = label.groupBy("root").agg(F.min("rep").alias("component_id"))
    members = label.join(least, "root").select("sig", "component_id")
    own = base.where("sig is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = base.join(members, "sig").select("doc_id", "n_shingles", "component_id").unionByName(own)
    discard(rows, found, classes)
    return out
