"""From a folder of statutes to a searchable index: ``python -m codexa.sources.build CORPUS FOLDER [MODULE:LOADER]``."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from codexa.operators import chunks as C
from codexa.operators import index as I
from codexa.operators import stats as S
from codexa.operators import structure as A
from codexa.sources import files
from codexa.sources.cli import loader


def build(spark: SparkSession, corpus: str, folder: str, load=None, model: str = "", readers=None, mode: str = "compat", json: bool = False) -> DataFrame:
    """Scans, extracts, structures, chunks, deduplicates and indexes ``corpus``; totals per document and overall.

    Below ``folder``: texts (with the error of each file that failed), structured, chunks, kept, index and lexical, each
    written before the next one reads it, so that extraction and embedding run once. ``load`` is the plug-in of
    ``index.embed``, importable where the workers run; without it the index has no vectors. With ``json``, the article records and the kept chunks are
    written as an array a document too. Repeated ids are an error, raised before an index is replaced.
    """

    def put(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    texts = put(files.extract(files.latest(files.scan(spark, corpus)), readers), "texts")
    articles = put(A.structure(texts, mode=mode), "structured")
    made = put(C.chunks(articles), "chunks")
    kept = put(C.dedup_first(made, "document", "chunk_ord", "texto_busqueda"), "kept")
    if json:
        files.write_arrays(articles, texts, f"{folder}/json", "art_ord", files.ARTICLE_T.fieldNames(), "_estructurado")
        files.write_arrays(kept, texts, f"{folder}/json", "chunk_ord", files.CHUNK_T.fieldNames(), "_chunks")
    rows = I.prepare(kept)
    if twice := I.repeated_ids(rows).first():
        raise ValueError(f"{twice.n} chunks have the id {twice.id!r}")
    files.write_index(I.embed(rows, load, model=model) if load else rows, f"{folder}/index")
    files.write_lexical(files.read_index(spark, f"{folder}/index"), f"{folder}/lexical")
    return S.run_totals(made, kept)


def main(corpus: str, folder: str, plugin: str = "") -> None:
    spark = SparkSession.builder.getOrCreate()
    build(spark, corpus, folder, loader(plugin) if plugin else None, plugin).orderBy("document").show(1000, False)


if __name__ == "__main__":
    main(*sys.argv[1:4])
