"""Exact and approximate cosine search."""

from __future__ import annotations

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codexa.functions.text import dot, norm

#: Queries that are broadcast, at most.
QUERIES = 10_000


def cosine_top(vectors: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(query_id, id, cos, rank): the n nearest of each query by cosine rounded to 9 places, ties by id.

    ``vectors``: id, embedding; ``queries``: query_id, qvec, a stated set that meets all vectors; it is broadcast up to
    QUERIES rows, beyond which Spark picks the strategy. Norms are computed once a vector, not once a pair.
    """
    unit = lambda c: F.explode(F.array(F.struct(F.transform(c, lambda x: x.cast("double")).alias("v"), norm(c).alias("norm"))))
    asked = queries.select("query_id", unit("qvec").alias("q"))
    asked = F.broadcast(asked) if asked.limit(QUERIES + 1).count() <= QUERIES else asked
    pairs = vectors.select("id", unit("embedding").alias("e")).join(asked, how="cross")
    cos = F.when(F.col("e.norm") * F.col("q.norm") > 0, dot("e.v", "q.v") / (F.col("e.norm") * F.col("q.norm")))
    scored = pairs.select("query_id", "id", F.round(cos, 9).alias("cos"))
    order = W.partitionBy("query_id").orderBy(F.desc("cos"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def cosine_top_lsh(vectors: DataFrame, qvec: list[float], n: int, tables: int = 12, width: float = 1.2, seed: int = 7) -> DataFrame:
    """Approximate mode: random projections on unit vectors, candidates ranked by distance; (id, distance)."""
    data = vectors.select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", numHashTables=tables, bucketLength=width, seed=seed).fit(data)
    from pyspark.ml.linalg import Vectors

    found = model.approxNearestNeighbors(model.transform(data), Vectors.dense(qvec), n, distCol="distance")
    return found.select("id", F.col("distance").cast("double"))
