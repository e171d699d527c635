"""A prompt over what ``codexa.sources.build`` made: ``python -m codexa.sources.cli FOLDER [MODULE:LOADER]``.

It prints; all work is in the operators. Without a loader of the embedding model the search is lexical only.
"""

from __future__ import annotations

import sys
from importlib import import_module

from pyspark.sql import SparkSession

from codexa.operators import hybrid, lexical, querylang, vector
from codexa.operators import index as rows
from codexa.sources import files


def loader(name: str):
    """The function that ``module:function`` names."""
    module, _, function = name.partition(":")
    return getattr(import_module(module), function)


def by_vectors(spark: SparkSession, index, load, model: str = ""):
    """A ``semantic`` for ``search``: queries are embedded by the plug-in, which must be the model of the index."""
    rows.check_model(index, model)

    def run(text: str, n: int):
        asked = rows.embed_queries(spark.createDataFrame([(0, text)], "query_id long, text string"), load)
        return vector.cosine_top(index, asked, n).select("query_id", "id", "rank")

    return run


def search(spark: SparkSession, index, line: str, semantic=None, top_k: int = hybrid.TOP_K, kept=None):
    """(parsed line, hits or None). ``semantic``: function from (query text, n) to (query_id, id, rank); none: lexical only.

    ``kept``: the tables of ``files.read_lexical``; without them the texts of ``index`` are tokenised for each line.
    """
    docs = querylang.catalog(index, "documento")
    parsed = querylang.parse(spark.createDataFrame([(0, line)], "query_id long, raw string"), docs).first()
    if parsed.command or not parsed.consulta:
        return parsed, None
    queries = spark.createDataFrame([(0, parsed.consulta)], "query_id long, text string")
    terms = lexical.query_terms(queries)
    if kept is None:
        posts, lengths = lexical.postings(index), lexical.doc_lengths(index)
        stats = lexical.corpus_stats(lengths)
        scores = lexical.bm25(posts, lengths, lexical.idf_floored(lexical.document_frequency(posts), stats), stats, terms)
    else:
        words = [r.term for r in terms.collect()]  # of one typed line
        scores = lexical.bm25(lexical.only_terms(kept["postings"], words), kept["lengths"], lexical.only_terms(kept["idf"], words), kept["stats"], terms)
    lex = lexical.top_padded(scores, index, queries, hybrid.OVERFETCH * top_k)
    sem = semantic(parsed.consulta, hybrid.OVERFETCH * top_k) if semantic else lex.select("query_id", "id", "rank").where("false")
    return parsed, hybrid.hybrid_search(sem, lex, index, top_k, parsed.filtro_documento, parsed.filtro_jerarquia)


def main(folder: str, plugin: str = "") -> None:
    spark = SparkSession.builder.getOrCreate()
    index, kept = files.read_index(spark, f"{folder}/index"), files.read_lexical(spark, f"{folder}/lexical")
    semantic = by_vectors(spark, files.read_index(spark, f"{folder}/index", vectors=True), loader(plugin), plugin) if plugin else None
    for raw in sys.stdin:
        if not (line := raw.strip()):
            continue
        parsed, hits = search(spark, index, line, semantic, kept=kept)
        if parsed.command == "quit":
            break
        if parsed.command == "catalog":
            for column in ("documento", "jerarquia"):
                querylang.catalog(index, column).show(1000, False)
        elif hits is None:
            print("Give a query beside the filters.")
        else:
            for row in files.console_lines(hits).toLocalIterator():
                print(row.line)


if __name__ == "__main__":
    main(*sys.argv[1:3])
