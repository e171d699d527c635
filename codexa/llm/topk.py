"""Exact top-k inner products by norm-bucketed retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codexa.llm.common import written
from codexa.llm.learning import bounded_batches

K = 5
#: Vectors of lengths within a factor of 2 ** (1 / PER_OCTAVE) share a bucket; a bucket is dealt into blocks of about BLOCK vectors.
PER_OCTAVE, BLOCK, QUERY_BLOCK, SEEDS = 16, 4096, 1024, 2048
#: From this local cosine threshold on, coordinates prune; below, only lengths do. FOCUS: coordinates looked at.
COORDINATE_FROM, FOCUS = 0.7, 4
NONE = -(1 << 62)


def quantized(embedding: Column, scale: int = 256) -> Column:
    """ARRAY<LONG> of floor(scale * x); null for a null or empty vector and for one with null or non-finite components."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(embedding.isNotNull() & (F.size(embedding) > 0) & ~bad, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)))


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where all sums are below 2 ** 53, else in 64-bit integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def best(scores: np.ndarray, ids: np.ndarray, k: int, least: int) -> np.ndarray:
    """Indexes of the k highest scores of ``least`` or more, ties to smaller ids."""
    if len(scores) > k:
        least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
    pick = np.flatnonzero(scores >= least)
    return pick[np.lexsort((ids[pick], -scores[pick]))[:k]]


def probe(q: np.ndarray, q_rows: np.ndarray, floor: np.ndarray, v: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's index, indexes of its best vectors in the block, scores), from ``floor`` (each query's score to reach) on."""
    length = np.sqrt((v.astype(np.float64) ** 2).sum(1))
    order = np.argsort(-length, kind="stable")
    v, rows, ids, length = v[order], rows[order], ids[order], length[order]
    q_len = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    unit = v / np.maximum(length, 1e-300)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(q_len * length[0] > 0, floor / (q_len * length[0]), np.where(floor > 0, 2.0, -2.0))
    alive = local <= 1 + 1e-9  # longer products don't exist in this block
    by_coordinate = alive & (local >= COORDINATE_FROM)
    by_length = np.flatnonzero(alive & ~by_coordinate)
    if len(by_length):
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(floor[by_length] > 0, floor[by_length] / q_len[by_length], -1.0).min()
        cut = int(np.searchsorted(-length, -(need - 1e-6), side="right")) if need > 0 else len(length)
        scores = products(q[by_length], v[:cut])
        for i, s in zip(by_length, scores, strict=True):
            s = np.where(rows[:cut] == q_rows[i], NONE, s)
            pick = best(s, ids[:cut], k, max(int(floor[i]), NONE + 1))
            yield i, order[pick], s[pick]
    for i in np.flatnonzero(by_coordinate):
        angle = np.arccos(np.clip(local[i] - 1e-9, -1, 1))
        focus = np.argsort(-np.abs(q[i]))[:FOCUS]
        phi = np.arccos(np.clip(q[i][focus] / q_len[i], -1, 1))
        low, high = np.cos(np.minimum(np.pi, phi + angle)) - 1e-7, np.cos(np.maximum(0, phi - angle)) + 1e-7
        c = unit[:, focus]
        left = np.flatnonzero(((c >= low) & (c <= high)).all(1) & (rows != q_rows[i]))
        if len(left):
            s = products(q[i : i + 1], v[left])[0]
            pick = best(s, ids[left], k, int(floor[i]))
            yield i, order[left[pick]], s[pick]


def topk(vectors: DataFrame, queries: Column, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``queries`` admits, its k highest integer inner products with all other rows.

    Each query first gets a score to reach: its k-th best product with SEEDS of the longest vectors. Vectors are
    grouped by length and dealt into blocks by a hash of their row, query rows likewise; each block of queries meets each
    block of vectors once, by an equi-join on the block. There the score to reach gives a local cosine threshold, which
    rules the block out, or prunes by a few coordinates, or by length; what is left is multiplied out. A pair of blocks
    returns at most k rows a query.

    Ties go to the smaller vec_id. Rows with a null id, and vectors that are null, empty, or hold null or non-finite
    components, take no part; vectors of other dimensions are no candidates. Repeated rows are candidates each (a query
    leaves out its own row only). Empty table: no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    base = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), quantized(F.col(embedding), scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query"), F.monotonically_increasing_id().alias("row"))
    base = base.where("v is not null").withColumns({"dim": F.size("v"), "norm2": F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)})
    base = written(base.withColumn("bucket", F.when(F.col("norm2") > 0, F.floor(F.log2("norm2") / 2 * PER_OCTAVE)).otherwise(-1)), "vectors")
    seeds = base.select("dim", "row", "vec_id", "v").orderBy(F.desc("norm2"), "row").limit(SEEDS).toPandas()
    by_dim = {int(d): (np.array(s["v"].tolist(), dtype=np.int64), s["row"].to_numpy()) for d, s in seeds.groupby("dim")}
    n_queries = base.where("is_query").count()
    q_blocks = max(1, -(-n_queries // QUERY_BLOCK))

    @F.pandas_udf("long")
    def reach(dims: pd.Series, rows: pd.Series, vs: pd.Series) -> pd.Series:
        out = []
        for d, r, v in zip(dims, rows, vs, strict=True):
            s, own = by_dim.get(int(d), (np.zeros((0, int(d)), np.int64), np.zeros(0, np.int64)))
            s = products(np.array(v, dtype=np.int64)[None], s)[0][own != r] if len(s) else np.zeros(0)
            out.append(int(np.partition(s, len(s) - k)[len(s) - k]) if len(s) >= k else NONE + 1)
        return pd.Series(out, dtype="int64")

    # a few rows: buckets are as many as octaves of length times PER_OCTAVE
    sizes = base.groupBy("dim", "bucket").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    blob = lambda group: F.collect_list(group)
    cand = base.join(F.broadcast(sizes), ["dim", "bucket"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))
    cand = cand.groupBy("dim", "bucket", "block").agg(blob(F.struct("row", "vec_id", "v")).alias("c"))
    asked = base.where("is_query").withColumns({"reach": reach("dim", "row", "v"), "q_block": F.pmod(F.xxhash64("row"), F.lit(q_blocks))})
    asked = asked.groupBy("dim", "q_block").agg(blob(F.struct("row", "vec_id", "v", "reach")).alias("q"))
    meets = sizes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).join(asked, "dim").drop("blocks")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for qs, cs in zip(batch["q"], batch["c"], strict=True):
                q, v = np.array([x["v"] for x in qs], dtype=np.int64), np.array([x["v"] for x in cs], dtype=np.int64)
                q_rows, q_ids, floor = (np.array([x[n] for x in qs], dtype=np.int64) for n in ("row", "vec_id", "reach"))
                rows, ids = (np.array([x[n] for x in cs], dtype=np.int64) for n in ("row", "vec_id"))
                out = [(q_rows[i], q_ids[i], ids[j], s) for i, js, ss in probe(q, q_rows, floor, v, rows, ids, k) for j, s in zip(js, ss, strict=True)]
                yield pd.DataFrame(out, columns=["q_row", "query_id", "vec_id", "score"]).astype("int64")

    bounded_batches(spark)  # by bytes, as a row is a block of vectors
    found = written(meets.join(cand, ["dim", "bucket", "block"]).select("q", "c").mapInPandas(run, "q_row long, query_id long, vec_id long, score long"), "found")
    rank = F.row_number().over(W.partitionBy("q_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOPK_SQL = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p QUALIFY rank <= {K}"""
