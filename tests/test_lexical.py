"""BM25 without a row a posting or a pair, against the joins."""

import pytest

from codexa.operators import lexical as L

TEXTS = ["agua agua dulce", "agua salada", "aire", "el agua y el aire", "fuego", "", None, "agua agua dulce", "el el el fuego", "tierra y fuego"]
ASKED = [(1, "agua agua"), (2, "el"), (3, "nada"), (4, ""), (5, "aire fuego fuego"), (6, "tierra agua el"), (1, "dulce")]


def rows(df, *columns):
    return sorted((tuple(round(r[c], 8) if c == "score" else r[c] for c in columns) for r in df.collect()), key=str)


def joined(docs, queries):
    posts, lengths = L.postings(docs), L.doc_lengths(docs)
    stats = L.corpus_stats(lengths)
    return L.bm25(posts, lengths, L.idf_floored(L.document_frequency(posts), stats), stats, L.query_terms(queries))


@pytest.mark.parametrize("ids", ["unique", "strings", "repeated", "null"])
def test_same_as_the_joins(spark, monkeypatch, ids):
    name = {"unique": lambda i: 9 - i, "strings": lambda i: f"d{i * 7 % 10}", "repeated": lambda i: i // 2, "null": lambda i: i or None}[ids]
    docs = spark.createDataFrame([(name(i), t) for i, t in enumerate(TEXTS)], f"id {'string' if ids == 'strings' else 'long'}, text string")
    queries = spark.createDataFrame(ASKED, "query_id long, text string")
    assert rows(L.term_frequency(docs), "term", "df") == rows(L.document_frequency(L.postings(docs)), "term", "df")
    want = joined(docs, queries)
    assert rows(L.scores(docs, queries), "query_id", "id", "score") == rows(want, "query_id", "id", "score")
    for most, asked, few in ((16384, 262144, 1000),) if ids in ("repeated", "null") else ((3, 2, 0),):
        for k, v in (("DOCUMENTS", most), ("ASKED", asked), ("FEW", few)):
            monkeypatch.setattr(L, k, v)
        assert rows(L.top(docs, queries, 4), "query_id", "rank", "id", "score") == rows(L.top_padded(want, docs, queries, 4), "query_id", "rank", "id", "score")


def test_no_row_a_posting_is_shuffled(spark):
    docs = spark.createDataFrame([(i, "el agua y el fuego " + t) for i, t in enumerate("abcdefgh" * 200)], "id long, text string").repartition(2)
    assert "array_distinct" in L.term_frequency(docs)._jdf.queryExecution().optimizedPlan().toString()
    plan = L.scores(docs, spark.createDataFrame([(0, "agua")], "query_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("LeftSemi") > plan.index("tf#")
