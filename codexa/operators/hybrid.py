"""Weighted reciprocal-rank fusion of a semantic and a lexical list, filters after the candidate cut, tail-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codexa.functions.text import contains_folded

# The defaults of the search.
TOP_K, OVERFETCH, RRF_K, W_SEMANTIC, W_LEXICAL = 15, 4, 60, 0.6, 0.4


def fuse(semantic: DataFrame, lexical: DataFrame, w_semantic: float = W_SEMANTIC, w_lexical: float = W_LEXICAL, k: int = RRF_K) -> DataFrame:
    """(query_id, id, score, fuse_ord) of the union of both lists (query_id, id, rank from 1).

    fuse_ord is the order of first insertion: the semantic list, then what only the lexical list has; it breaks ties.
    """
    both = semantic.select("query_id", "id", F.col("rank").alias("r_s")).join(lexical.select("query_id", "id", F.col("rank").alias("r_l")), ["query_id", "id"], "full_outer")
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (k + F.col(r)), F.lit(0.0))
    return both.select("query_id", "id", (part(w_semantic, "r_s") + part(w_lexical, "r_l")).alias("score"), F.coalesce(F.col("r_s"), 1_000_000 + F.col("r_l")).alias("fuse_ord"))


def metadata_filter(document: Column | str | None, hierarchy: Column | str | None) -> Column:
    """Substring filters joined by AND; None or '' lets all pass."""
    keep = F.lit(True)
    for needle, column in ((document, "documento"), (hierarchy, "jerarquia")):
        if needle is None or isinstance(needle, str) and needle == "":
            continue
        n = F.lit(needle) if isinstance(needle, str) else needle
        keep = keep & F.when(F.coalesce(n, F.lit("")) == "", True).otherwise(contains_folded(column, n))
    return keep


def hybrid_search(semantic: DataFrame, lexical: DataFrame, index: DataFrame, top_k: int = TOP_K, document=None, hierarchy=None, w_semantic: float = W_SEMANTIC, w_lexical: float = W_LEXICAL) -> DataFrame:
    """Hits (query_id, position, id, texto, puntuacion_rrf, documento, articulo, jerarquia), ascending: the best is last.

    ``index``: id, text, documento, articulo, jerarquia. The filter comes after the candidate cut, so fewer than
    top_k hits can remain although more rows of the corpus would qualify.
    """
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    fused = fuse(semantic, lexical, w_semantic, w_lexical)
    rows = index.join(fused, "id").where(metadata_filter(document, hierarchy))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("fuse_ord"))
    kept = rows.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top_k)
    up = W.partitionBy("query_id").orderBy(F.desc("r"))
    nd = lambda c: F.coalesce(c, F.lit("N/D")).alias(c)
    return kept.select("query_id", F.row_number().over(up).alias("position"), "id", F.col("text").alias("texto"), F.col("score").alias("puntuacion_rrf"), nd("documento"), nd("articulo"), nd("jerarquia"))
