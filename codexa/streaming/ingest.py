"""Structured Streaming ingest: statute files as they arrive, through the same narrow transformations as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexa.functions.text import file_stem, read_name, short_hash
from codexa.operators.chunks import enriched, flatten_articles
from codexa.operators.structure import structure


def statute_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """(document, text, arrived) of text files."""
    rows = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(folder, wholetext=True)
    return rows.select(file_stem(read_name()).alias("document"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("arrived"))


def chunk_stream(docs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Deduplicated chunks of a stream of documents; the state of seen hashes is dropped behind the watermark."""
    arts = structure(docs.withColumn("document", F.struct("document", "arrived")))
    flat = flatten_articles(arts).select("document.document", "document.arrived", "art_ord", "sub_ord", "articulo", "etiqueta", enriched("document.document", "articulo", "etiqueta", "texto").alias("texto_busqueda"))
    return flat.withColumn("h", short_hash("texto_busqueda")).withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["document", "h"]).drop("h")
