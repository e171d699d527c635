"""A folder of statutes to an index and answers from it."""

import json

import pytest

from codexa.operators import index as I
from codexa.operators import lexical as L
from codexa.sources import build, cli, files

LAW = "CAPÍTULO I\nArtículo 1. Del agua\nI. agua dulce\nII. agua salada\nArtículo 2. Del aire\na) aire limpio\na) aire limpio"


load = lambda: lambda texts: [[float(t.count("agua")), float(t.count("aire")), 1.0] for t in texts]  # noqa: E731 (a lambda travels by value)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    corpus, out = tmp_path_factory.mktemp("corpus"), tmp_path_factory.mktemp("out")
    (corpus / "ley.txt").write_text(LAW)
    (corpus / "otra.txt").write_text("Artículo 1. Del fuego y del agua")
    (corpus / "rota.docx").write_bytes(b"no zip")
    (corpus / "doble.docx").write_bytes(b"no zip")
    (corpus / "doble.txt").write_text("Artículo 1. Del suelo")
    totals = build.build(spark, str(corpus), str(out), load, "counts", json=True)
    return str(out), {r.document: (r.chunks, r.duplicates, r.indexed) for r in totals.collect()}


def test_totals_and_files(spark, made):
    folder, totals = made
    texts = {r.document: r for r in spark.read.parquet(f"{folder}/texts").collect()}
    assert set(texts) == {"ley", "otra", "rota", "doble"} and "BadZipFile" in texts["rota"].error
    assert texts["doble"].text == "Artículo 1. Del suelo"  # the later suffix wins
    assert totals["otra"] == totals["doble"] == (1, 0, 1) and totals["ley"][1] == 1 and "rota" not in totals
    assert totals[None] == tuple(map(sum, zip(*(v for k, v in totals.items() if k), strict=True)))
    index = files.read_index(spark, f"{folder}/index")
    assert index.count() == totals[None][2] and I.repeated_ids(index).count() == 0
    good, bad = files.read_chunks(spark, f"{folder}/json")
    assert good.count() == totals[None][2] and [r.document for r in bad.collect()] == ["rota"]
    with open(f"{folder}/json/ley_estructurado.json", encoding="utf-8") as f:
        assert [a["articulo"] for a in json.load(f)] == [r.articulo for r in spark.read.parquet(f"{folder}/structured").where("document = 'ley'").orderBy("art_ord").collect()]


def test_kept_tables_answer_as_texts_do(spark, made):
    folder, _ = made
    index, kept = files.read_index(spark, f"{folder}/index"), files.read_lexical(spark, f"{folder}/lexical")
    assert "In(term" in L.only_terms(kept["postings"], ["agua", "aire"])._jdf.queryExecution().toString()
    for line in ("agua agua dulce", "nada", "aire documento:ley"):
        want, got = (cli.search(spark, index, line, kept=k)[1].orderBy("position").collect() for k in (None, kept))
        assert want == got and want


def test_queries_are_embedded_by_the_model_of_the_index(spark, made):
    folder, _ = made
    index = files.read_index(spark, f"{folder}/index", vectors=True)
    semantic = cli.by_vectors(spark, index, load, "counts")
    best = semantic("agua agua", 1).join(index, "id").first()
    assert best.text.count("agua") >= 2
    hits = cli.search(spark, index.drop("embedding"), "agua", semantic, kept=files.read_lexical(spark, f"{folder}/lexical"))[1]
    assert "agua" in hits.orderBy("position").collect()[-1].texto
    with pytest.raises(ValueError, match="embedded by 'counts'"):
        cli.by_vectors(spark, index, load, "another")


def test_repeated_ids_are_found(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("a",)], "id string")
    assert [tuple(r) for r in I.repeated_ids(rows).collect()] == [("a", 2)]
