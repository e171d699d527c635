"""What both classifiers share: the bounded training sample, batches, held-out folds."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexa.llm.common import hash_bits


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1000 rows and 2 MB from now on, so that long texts don't add up in a worker."""
    for name, most, default in (("maxRecordsPerBatch", 1000, 10_000), ("maxBytesPerBatch", 2 << 20, 64 << 20)):
        name = f"spark.sql.execution.arrow.{name}"
        set_to = spark.conf.get(name, str(default)).lower().removesuffix("b")
        if not set_to.isdigit() or not 0 < int(set_to) <= most:
            spark.conf.set(name, str(most))


def give_back() -> None:
    """Memory that was freed goes back to the system: a worker process lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps it
        return


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches; what it held is freed once it ends, and goes back to the system."""

    def held(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        give_back()

    return held


def training_rows(docs: DataFrame, labels: DataFrame, label: str, keep: Column, limit: int, least_share: float = 0.0) -> DataFrame:
    """(doc_id, text, y): at most ``limit`` labelled rows that ``keep`` admits, by the hash of their id; whole texts.

    Up to ``least_share`` of them are taken from label 1 first, for rare classes. The sample's ids, at most ``limit``
    rows, are broadcast; the documents are read once and not shuffled. Where rows of documents share an id, the limit
    holds for the rows found as well. Null ids and null labels are no samples.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y")).where(F.col("_id").isNotNull() & F.col("y").isNotNull()).where(keep).distinct()
    order = hash_bits(F.col("_id").cast("string"))
    first = known.where("y = 1").orderBy(order, "_id").limit(int(limit * least_share))
    rest = known.where("y = 0").orderBy(order, "_id").limit(limit - int(limit * least_share)) if least_share else known.orderBy(order, "_id", "y").limit(limit)
    ids = first.unionByName(rest) if least_share else rest
    return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y")


def trained(rows: DataFrame, facts: str, limit: int, train: Callable[[pd.DataFrame], bytes]) -> bytes:
    """``train`` of the first ``limit`` of ``rows`` (doc_id, y, and the column ``facts``) by hash of their id, in one task.

    So the driver holds the model alone, and a lost executor costs a rerun, which learns the same from rows in the same order.
    """
    rows = rows.orderBy(hash_bits(F.col("doc_id").cast("string")), "doc_id", "y", F.xxhash64(facts)).limit(limit)
    columns = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        yield pd.DataFrame({"model": [train(pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=columns))]})

    found = rows.mapInPandas(tidy(run), "model binary").first()
    return bytes(found[0]) if found else train(pd.DataFrame(columns=columns))
