"""Best-two-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from struct import pack as pack_ids

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codexa.llm.common import written
from codexa.llm.learning import bounded_batches, tidy

LENGTH, END = 4096, 1
CACHE_WORDS = 100_000
#: Letters beyond ASCII that stand as they are in NFC and have one lower case, a letter of the same kind (no İ).
LETTERS = "À-ÖØ-öø-įı-ſА-яЁё"
#: What no PLAIN text holds, which is made of such letters, printable ASCII and what separates words.
ODD = re.compile(rf"[^ \n\t!-~{LETTERS}]")
#: The atoms of a lower-cased PLAIN text, as the tokenizer splits it (its own pattern, fixed), but for runs of letters: those lie between.
MARK = re.compile(r"[!-@\[-`{-~](?:(?<=[0-9])|(?<=')(?:s|t|re|ve|m|ll|d)|[!-/:-@\[-`{-~]*)")

#: The pattern, as a tokenizer that splits so states it; others get whole words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Byte-level models name bytes by characters: those that print by themselves, others by characters from 256 on (the alphabet of such models, fixed).
BYTES = {b: b + 162 for b in range(127, 161)} | {173: 323}
#: The names of the bytes of each character that PLAIN texts may hold.
NAMED = {c: c.encode().decode("latin-1").translate(BYTES) for c in map(chr, range(ord("ё") + 1))}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Atoms(dict):
    """Ids of the atoms of PLAIN texts, as little-endian bytes, found by the tokenizer's model alone when first asked for.

    Once there are CACHE_WORDS of them the next generation begins: it takes over what is asked for again, the rest is forgotten with
    the generation after it. So frequent atoms stay.
    """

    def __init__(self, model, old: dict[str, bytes]):
        super().__init__()
        self.model, self.old = model, old

    def __missing__(self, atom: str) -> bytes:
        ids = self.old.get(atom)
        if ids is None:
            found = [t.id for t in self.model.tokenize(atom if atom.isascii() else "".join(map(NAMED.__getitem__, atom)))]
            ids = pack_ids(f"<{len(found)}I", *found)
        if len(atom) <= 32:
            self[atom] = ids
        return ids

    def next(self) -> Atoms:
        self.old = {}
        return Atoms(self.model, self)


class Words(dict):
    """Ids of what stands between blanks and goes to the tokenizer; what is PLAIN is put together from its atoms."""

    def __init__(self, tokenizer):
        super().__init__()
        self.atoms, self.tokenizer = Atoms(tokenizer.model, {}), tokenizer
        self.split = SPLIT in str(tokenizer.pre_tokenizer).replace("\\\\", "\\") and "Lowercase" in str(tokenizer.normalizer)

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def plain(self, text: str) -> Iterator[bytes]:
        return map(self.atoms.__getitem__, MARK.sub(r" \g<0> ", text.lower()).split())

    def parts(self, text: str) -> Iterable[bytes]:
        if len(self) > CACHE_WORDS:
            self.clear()
        if len(self.atoms) > CACHE_WORDS:
            self.atoms = self.atoms.next()
        if not self.split:
            return map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").split(" "))
        odd, at, out = ODD.search(text), 0, []
        if not odd:
            return self.plain(text)
        text = text.replace("\n", " ").replace("\t", " ")
        while odd:
            first, last = max(text.rfind(" ", at, odd.start()) + 1, at), text.find(" ", odd.end())
            last = len(text) if last < 0 else last
            out += self.plain(text[at:first])
            out.append(self[text[first:last]])
            odd, at = ODD.search(text, last), last
        out += self.plain(text[at:])
        return out


class Encoder:
    """Token ids of a text as little-endian bytes.

    The tokenizer never joins what a blank, tab or line end separates, and lower-cases and splits
    PLAIN words as MARK does, so ids are looked up by atom, and by word where one is not PLAIN. Tokens that were added to the
    vocabulary stand before all that, anywhere in a text: a text that holds one goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Words(self.tokenizer)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [self.whole(t) if self.added is not None and self.added.search(t) else b"".join(self.known.parts(t)) for t in texts]


def pieces(docs: DataFrame, doc_id: str = "doc_id", path: str | None = None, length: int = LENGTH, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): a document's ids and ``end``, cut where longer than ``length``."""
    path, tail = path or default_tokenizer(), np.array([end], dtype="<u4").tobytes()
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(path)
        for batch in batches:
            ids_of, texts = batch["doc_id"].tolist(), batch["text"].fillna("").tolist()
            for at in range(0, len(texts), 100):
                rows = []
                for i, ids in zip(ids_of[at : at + 100], encode(texts[at : at + 100]), strict=True):
                    ids += tail
                    for p, a in enumerate(range(0, len(ids), 4 * length)):
                        part = ids[a : a + 4 * length]
                        rows.append((i, p, a // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, dtype="<u4").astype(np.int32)] if keep_ids else [])))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)
                if str(out["doc_id"].dtype).startswith("float"):  # null ids beside whole numbers
                    out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).alias("doc_id"), "text").mapInPandas(tidy(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def best_two_fit(counts: dict[int, int], length: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(number of bins, [(item length, items of it in such a bin), ...]), ...] for items given by their number of each length.

    A bin takes the longest item that fits until none does; then its smallest item gives way to the two items whose sum
    fills the widened gap best, if that is tighter. Bins come out alike as long as no length runs short, so
    they are made many at a time: the work depends on the number of lengths, not of items.
    """
    left = np.zeros(length + 1, dtype=np.int64)
    for size, n in counts.items():
        left[size] = n
    at, out = np.arange(length + 1), []
    remaining = int(left.sum())
    while remaining:
        free, used, gap = left.copy(), {}, length
        longest = np.maximum.accumulate(np.where(free > 0, at, 0))
        size = int(longest[gap])
        while size:
            n = min(gap // size, int(free[size]))
            used[size] = n
            free[size] -= n
            gap -= n * size
            size = int(longest[min(gap, size - 1)])
        final, small = dict(used), min(used)
        if gap and sum(used.values()) > 1:
            wide = gap + small
            avail = np.where(free > 0, at, 0)
            best = np.maximum.accumulate(avail)
            a = np.flatnonzero(free[:wide] > 0)
            a = a[a > 0]
            b = best[np.minimum(a, wide - a)]
            short = (b == a) & (free[a] < 2)  # the pair would need one item twice
            b = np.where(short, best[np.maximum(np.minimum(a, wide - a) - 1, 0)], b)
            total = np.where(b > 0, a + b, 0)
            if len(total) and total.max() > small:
                i = int(np.argmax(total))
                final[small] -= 1
                for x in (int(a[i]), int(b[i])):
                    final[x] = final.get(x, 0) + 1
                final = {s: n for s, n in final.items() if n}
        bins = min((int(left[s]) - max(n, used.get(s, 0))) // n + 1 for s, n in final.items())
        for s, n in final.items():
            left[s] -= bins * n
            remaining -= bins * n
        out.append((bins, sorted(final.items(), reverse=True)))
    return out


def slots(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """By item length, rows (first rank, items a bin, first bin, place of the first item): where the items of each rank go."""
    found: dict[int, list] = {}
    used: dict[int, int] = {}
    first_bin = 0
    for bins, items in plan:
        place = 0
        for size, n in items:
            found.setdefault(size, []).append((used.get(size, 0), n, first_bin, place))
            used[size] = used.get(size, 0) + n * bins
            place += size * n
        first_bin += bins
    return {size: np.array(rows, dtype=np.int64) for size, rows in found.items()}


def pack(docs: DataFrame, doc_id: str = "doc_id", path: str | None = None, length: int = LENGTH, end: int = END, keep_ids: bool = False) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    The plan is made on the driver from the number of pieces of each length (at most ``length`` rows). A piece finds
    its slot by its rank among those of its length; ranks add up over about sqrt(n) sub-buckets of a length's n
    pieces, so that no task holds all pieces of a frequent length.

    Null and empty texts are one piece, ``end`` alone; repeated rows are packed each; an empty table gives no rows.
    Other columns of ``docs`` are not read.
    """
    made = written(pieces(docs, doc_id, path, length, end, keep_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    hist = made.groupBy("length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in hist.collect()}
    plan = slots(best_two_fit(counts, length))
    subs = made.sparkSession.createDataFrame([(s, int(np.ceil(np.sqrt(n)))) for s, n in sorted(counts.items())], "length long, subs long")
    rows = made.join(F.broadcast(subs), "length").withColumn("sub", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.col("subs")))
    tally = rows.groupBy("length", "sub").agg(F.count("*").alias("m"))
    tally = tally.select("length", "sub", F.coalesce(F.sum("m").over(W.partitionBy("length").orderBy("sub").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy("length", "sub").orderBy("doc_id", "piece", "row")))
    rows = rows.join(tally, ["length", "sub"]).withColumn("rank", F.col("ahead") + F.col("place") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def seat(sizes: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        size, rank = sizes.to_numpy(), ranks.to_numpy()
        seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for s in np.unique(size):
            pick = size == s
            t = plan[int(s)]
            k = np.searchsorted(t[:, 0], rank[pick], side="right") - 1
            nth = rank[pick] - t[k, 0]
            seq[pick] = t[k, 2] + nth // t[k, 1]
            off[pick] = t[k, 3] + nth % t[k, 1] * s
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    out = rows.withColumn("seat", seat("length", "rank"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("seat.sequence_id").alias("sequence_id"), F.col("seat.offset").alias("offset"), *(["ids"] if keep_ids else []))
