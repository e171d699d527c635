"""Run totals and index cardinalities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexa.operators.chunks import dedup_counts


def run_totals(chunks: DataFrame, kept: DataFrame) -> DataFrame:
    """Per document and overall (document null): chunks, duplicates, indexed."""
    per = chunks.groupBy("document").agg(F.count("*").alias("chunks")).join(kept.groupBy("document").agg(F.count("*").alias("kept")), "document", "left")
    return per.rollup("document").agg(F.sum("chunks").alias("chunks"), F.sum(F.col("chunks") - F.coalesce("kept", F.lit(0))).alias("duplicates"), F.sum(F.coalesce("kept", F.lit(0))).alias("indexed"))


def run_totals_of(chunks: DataFrame) -> DataFrame:
    """``run_totals`` of chunks whose kept ones are the first of each text in its document: counted, not marked, in one pass."""
    per = dedup_counts(chunks, "document", "texto_busqueda")
    return per.rollup("document").agg(F.sum("total").alias("chunks"), F.sum("removed").alias("duplicates"), F.sum("kept").alias("indexed"))


def cardinalities(index: DataFrame) -> DataFrame:
    value = lambda c: F.count_distinct(F.when(F.col(c) != "", F.col(c)))
    return index.agg(F.count("*").alias("n_rows"), value("documento").alias("n_documents"), value("jerarquia").alias("n_hierarchies"))
