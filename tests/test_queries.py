"""Registered queries of the library against DuckDB on the smallest tables."""

import pytest

from codexa.plans.queries import ORACLE, QUERIES
from compare import difference

NAMES = ["normalize_text", "tokenize_counts", "bm25_topn_padded", "dedup_first", "gazette_clean_body", "fractions", "chunk_ids", "parse_query_filters", "hybrid_search", "hybrid_filtered", "rrf_fusion", "json_round_trip", "corrupt_tolerance"]


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, name):
    assert difference(spark, name, QUERIES[name], ORACLE[name], "/root/testdata/sf0.001") is None


def test_json_round_trip_and_corrupt_files(spark, tmp_path):
    from codexa.sources import files

    (tmp_path / "a_chunks.json").write_text('[{"texto_busqueda": "x", "metadatos": {"documento": "a", "articulo": "1", "jerarquia": null}}]')
    (tmp_path / "b_chunks.json").write_text("[{broken")
    (tmp_path / "c_chunks.json").write_text("[]")
    good, bad = files.read_chunks(spark, str(tmp_path))
    assert [r.document for r in good.collect()] == ["a"] and {r.document for r in bad.collect()} == {"b", "c"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "ley.txt").write_text("Artículo 1. x")
    (tmp_path / "in" / "rota.docx").write_bytes(b"no zip")
    rows = {r.document: r for r in files.extract(files.scan(spark, str(tmp_path / "in"))).collect()}
    assert rows["ley"].text == "Artículo 1. x" and rows["rota"].text == "" and "BadZipFile" in rows["rota"].error
