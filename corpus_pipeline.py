"""From raw documents to packed sequences: ``run(spark, sf_dir)`` applies STAGES to ``documents``, each stage's rows written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexa.llm import jaccard, mixing, packing, quality, toxicity
from codexa.llm.common import free_name, table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; learned from the labels of ``docs``.

    Rows are judged each, repeated ones too. Null and empty texts have the score that the shares of the labels give.
    Columns of ``docs`` stay as they are, whatever their names. Empty table: no rows.
    """
    model, score = quality.fit(docs, table(spark, sf_dir, "labels")), free_name(docs, "quality_score")
    return quality.score(docs, model, score).where(F.col(score) >= quality.THRESHOLD).select(*_all(docs))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below the threshold; learned from the labels of ``docs``.

    Rows are judged each, repeated ones too. Null and empty texts are not toxic. Columns of ``docs`` stay as they are,
    whatever their names. Empty table: no rows.
    """
    model, found = toxicity.fit(docs, table(spark, sf_dir, "labels")), free_name(docs, "toxicity")
    return toxicity.score(docs, model, found).where(F.col(f"{found}.score") < toxicity.THRESHOLD).select(*_all(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the first one of the smallest doc_id (null last), of each component of similar texts (five words, 0.8).

    Rows are joined by number, so ids may repeat or be null. Texts without words are linked with nothing, and all stay.
    Columns of ``docs`` stay as they are, whatever their names. Empty table: no rows.
    """
    row = free_name(docs, "_row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = jaccard.join(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)
    keep = rows.select("doc_id", row).join(found, row).groupBy("component_id").agg(F.min(order).alias("first")).select(F.col(f"first.{row}").alias(row))
    return rows.join(keep, row, "left_semi").select(*_all(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; null sources are one source, texts without words are taken or left without effect."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and place in it; null and empty texts are one piece, the end alone."""
    return packing.pack(docs)


STAGES = [("quality classifier", good_quality), ("toxicity", not_toxic), ("n-gram Jaccard join", near_duplicates), ("mixing", mixture), ("best-fit packing", packed)]

#: Trained models, hashes of n-grams and a tokenizer are beyond SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def _all(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
