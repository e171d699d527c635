"""Literal edge cases of the statute parser, chunking, index preparation and query language."""

import pytest
from pyspark.sql import functions as F

from codexa.functions import text as T
from codexa.operators import chunks as C
from codexa.operators import hybrid as H
from codexa.operators import index as I
from codexa.operators import querylang as Q
from codexa.operators import structure as A

CASES = {
    "E1": "TÍTULO PRIMERO\nArtículo 1. x", "E2": "título de propiedad\nArtículo 2. x", "E3": "Título I\nCapítulo II\nArtículo 1. x",
    "E4": "Artículo 1. z\nI. a\nII.- b\nIII. c", "E5": "Artículo 1. \nI.- a\nII.- b", "E6": "Artículo 1. x\n- y\nI. a", "E7": "Artículo 1. q\nC. Juan\nz",
    "E8": "Artículo 1.\n  Artículo 2. x\nArtículo 3. y", "E9": "Artículo 1.\nArtículo 2. x", "E10": "Artículo 10 Terreno", "E11": "Artículo 1. conforme al artículo 27 otorga",
    "E12": "Artículo 1. los artículos 3 y 4", "E13": "Artículo 5. artículo 5 Bis, artículo 5o, artículo 50", "E14": "Artículo 1. a\nFracción reformada DOF 01-01-2000",
    "E15": "Artículo 1. a\nPárrafo reformado DOF 01-01-2000\n15 días", "blank": " \n", "null": None,
}


@pytest.fixture(scope="module")
def arts(spark):
    rows = A.structure(spark.createDataFrame(list(CASES.items()), "document string, text string")).orderBy("document", "art_ord").collect()
    out = {}
    for r in rows:
        out.setdefault(r.document, []).append(r)
    return out


def test_headings(arts):
    assert arts["E1"][0].jerarquia == "Titulo " and arts["E2"][0].jerarquia == "Titulo " and arts["E3"][0].jerarquia == "Capitulo II"
    assert "blank" not in arts and "null" not in arts


def test_fractions(arts):
    assert [(f.fraccion, f.texto_general) for f in arts["E4"][0].fracciones] == [("I", "a"), ("III", "c")]
    assert arts["E5"][0].fracciones == [] and arts["E5"][0].texto_general == "I.- a II.- b"
    assert arts["E6"][0].texto_general == "x" and [(f.fraccion, f.texto_general) for f in arts["E6"][0].fracciones] == [("I", "a")]
    assert [(f.fraccion, f.texto_general) for f in arts["E7"][0].fracciones] == [("C", "Juan z")]


def test_headers(arts):
    assert [(a.articulo, a.texto_general) for a in arts["E8"]] == [("Artículo 1.", "Artículo 2. x"), ("Artículo 3.", "y")]
    assert [(a.articulo, a.texto_general) for a in arts["E9"]] == [("Artículo 1.", ""), ("Artículo 2.", "x")]
    assert (arts["E10"][0].articulo, arts["E10"][0].texto_general) == ("Artículo 10 Ter", "reno")


def test_references_and_notes(arts):
    refs = lambda k: arts[k][0].referencias_articulos
    assert refs("E11") == ["Artículo 27 o"] and refs("E12") == [] and refs("E13") == ["Artículo 50", "Artículo 5o"]
    assert arts["E14"][0].historial_dof == []
    assert arts["E15"][0].historial_dof == ["Párrafo reformado DOF 01-01-2000 15"] and arts["E15"][0].texto_general == "a días"


def test_chunk_labels_and_dedup(spark):
    text = "Artículo 1. a\nI. b\nI. b"
    made = C.chunks(A.structure(spark.createDataFrame([("d", text)], "document string, text string")))
    assert [r.metadatos.jerarquia for r in made.orderBy("chunk_ord").collect()] == ["", "Fraccion I", "Fraccion I"]
    assert C.dedup_first(made, "document", "chunk_ord", "texto_busqueda").count() == 2
    assert C.dedup_counts(made, "document", "texto_busqueda").first().removed == 1


def test_prepare_skips_empty_but_counts_it(spark):
    rows = spark.createDataFrame([("d", 0, "a", ("d", "x y", None)), ("d", 1, " ", ("d", "x", "")), ("d", 2, "b", ("d", "x", "j"))], "document string, chunk_ord long, texto_busqueda string, metadatos struct<documento:string,articulo:string,jerarquia:string>")
    got = I.prepare(rows).orderBy("ins_ord").collect()
    assert [r.id for r in got] == ["d__x_y____0", "d__x__j__2"] and got[0].jerarquia == ""


def test_tokens(spark):
    assert spark.range(1).select(T.tokens(F.lit("¿Qué? [X-1] 10.-Foo"))).first()[0] == ["¿qué", "x1", "10foo"]
    assert spark.range(1).select(T.tokens(F.lit(None).cast("string"))).first()[0] == []


def test_query_line(spark):
    docs = spark.createDataFrame([(1, "A"), (2, "B")], "ord int, value string")
    got = Q.parse(spark.createDataFrame([(0, "derecho ley:2 jerarquia:capitulo"), (1, "x ley:9")], "query_id long, raw string"), docs).orderBy("query_id").collect()
    assert (got[0].consulta, got[0].filtro_documento, got[0].filtro_jerarquia) == ("derecho", "B", "capitulo")
    assert got[1].filtro_documento is None


def test_fusion_keeps_ties_and_order(spark):
    s = spark.createDataFrame([(0, "a", 1), (0, "b", 2)], "query_id int, id string, rank int")
    lex = spark.createDataFrame([(0, "b", 1), (0, "c", 2)], "query_id int, id string, rank int")
    index = spark.createDataFrame([(x, x, "d", "a", None) for x in "abc"], "id string, text string, documento string, articulo string, jerarquia string")
    got = H.hybrid_search(s, lex, index, 2).orderBy("position").collect()
    assert [r.id for r in got] == ["a", "b"] and got[1].puntuacion_rrf == 0.6 / 62 + 0.4 / 61 and got[0].jerarquia == "N/D"
    with pytest.raises(ValueError):
        H.hybrid_search(s, lex, index, 0)
