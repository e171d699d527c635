"""Chunks to index rows: ids, normalised metadata, batches, the embedder plug-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexa.functions.text import _col, strip, underscore

BATCH = 128
ID_HIERARCHY = 30


def clean_meta(c) -> Column:
    """Any value as a stripped string; null gives ''."""
    return F.coalesce(strip(_col(c).cast("string")), F.lit(""))


def chunk_id(document, article, hierarchy, index) -> Column:
    text = lambda c: F.coalesce(_col(c), F.lit(""))
    return F.concat_ws("__", underscore(text(document)), underscore(text(article)), underscore(text(hierarchy), ID_HIERARCHY), _col(index).cast("string"))


def prepare(chunks: DataFrame) -> DataFrame:
    """Index rows (id, ins_ord, batch, text, documento, articulo, jerarquia).

    The id carries the chunk's place in its document, counted before chunks without text are left out.
    """
    m = "metadatos."
    rows = chunks.where(strip(F.coalesce("texto_busqueda", F.lit(""))) != "")
    return rows.select(
        chunk_id(m + "documento", m + "articulo", m + "jerarquia", "chunk_ord").alias("id"),
        F.col("chunk_ord").alias("ins_ord"),
        F.floor(F.col("chunk_ord") / BATCH).alias("batch"),
        strip("texto_busqueda").alias("text"),
        *[clean_meta(m + c).alias(c) for c in ("documento", "articulo", "jerarquia")],
    )


def repeated_ids(rows: DataFrame) -> DataFrame:
    """(id, n) of ids that more than one row has; an index must have none."""
    return rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def embed(rows: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], text: str = "text", model: str = "") -> DataFrame:
    """With ``embedding`` from a plug-in: ``load()`` runs once in each worker and returns a function from texts to vectors.

    A name given as ``model`` is kept with the rows, for ``check_model``.
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            out: list[list[float]] = []
            for at in range(0, len(texts), BATCH):
                out += model(texts.iloc[at : at + BATCH].fillna("").tolist())
            yield pd.Series(out, index=texts.index)

    out = rows.withColumn("embedding", run(F.col(text)))
    return out.withColumn("model", F.lit(model)) if model else out


def embed_queries(queries: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], query_id: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, qvec) of (query_id, text) by the plug-in that embedded the index."""
    asked = queries.select(_col(query_id).alias("query_id"), _col(text).alias("text"))
    return embed(asked, load).select("query_id", F.col("embedding").alias("qvec"))


def check_model(index: DataFrame, model: str) -> None:
    """Raises where a row of ``index`` was embedded by another model than ``model``; rows without a name count as ''."""
    name = F.coalesce("model", F.lit("")) if "model" in index.columns else F.lit("")
    other = index.select(name.alias("model")).where(F.col("model") != model).first()
    if other:
        raise ValueError(f"the index was embedded by {other[0]!r}, queries would be by {model!r}")
