"""Queries against DuckDB on documents that the given tables don't have: lines that look like markers, empty texts."""

import duckdb
import pytest

from codexa.plans.queries import ORACLE, QUERIES
from compare import TABLES, difference

LINES = ["a b", "uno dos", "tres x", "cuatro", "cinco", "seis", "siete", "ocho", "h", "nueve y", "diez", "once", "doce", "trece", "catorce", "quince"]
ODD = ["C.", "C. Juan", "I. foo", "V-", "- foo", "a) foo", "Ter foo", "- Bis foo", "Artículo 5. foo", "foo art. 5 y artículo 1", "CAPÍTULO V", "Título", "reformado DOF 1-1-2000", "x artículo"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """A folder of tables whose documents have each odd line in each place, at the end of the text too."""
    d = tmp_path_factory.mktemp("odd")
    for t in TABLES:
        (d / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    texts = ["", "x", "x\ny"]
    for n in (1, 2, 5, 7, 9, 10, 13, 15):
        for x in ODD:
            lines = LINES[:n] + [x] + LINES[n + 1 :]
            texts += ["\n".join(lines), "\n".join(lines[: n + 1])]
    (d / "documents.parquet").unlink()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, 'en', 'src1', ?)", [(i, t, len(t)) for i, t in enumerate(texts)])
    con.execute(f"COPY documents TO '{d}/documents.parquet'")
    return str(d)


NAMES = ["statute_headings", "fractions", "direct_items", "article_references", "article_record_json", "chunks_all", "chunk_labels", "mini_batches", "index_cardinalities"]


@pytest.mark.parametrize("name", NAMES)
def test_lines_have_the_role_of_their_place(spark, odd, name):
    assert difference(spark, name, QUERIES[name], ORACLE[name], odd) is None


def test_files_without_bytes_are_documents(spark, odd, tmp_path):
    from codexa.sources import files

    assert difference(spark, "corrupt_tolerance", QUERIES["corrupt_tolerance"], ORACLE["corrupt_tolerance"], odd) is None
    for name in ("leér 100% a+b %20.txt", "x.pdf", "y.json"):
        (tmp_path / name).write_text("")
    rows = files.scan(spark, str(tmp_path)).orderBy("document").collect()
    assert [(r.document, r.kind, r.length, bytes(r.content)) for r in rows] == [("leér 100% a+b %20", "txt", 0, b""), ("x", "pdf", 0, b"")]


def test_each_pattern_goes_over_a_text_once(spark):
    from pyspark.sql import functions as F

    from codexa.operators import structure as A

    text = "x\nTÍTULO I\n\n  Artículo 1.\n  Artículo 2. a\nArtículo 3 Bis.- b\n\nCAPÍTULO II z\nArtículo 4. c\n"
    docs = spark.createDataFrame([("d", text)], "document string, text string")
    rows = A.split_articles(docs).orderBy("art_ord").collect()
    assert [(text[r.pos :].lstrip()[:10], r.articulo, r.cuerpo, r.jerarquia) for r in rows] == [("Artículo 1", "Artículo 1.", "Artículo 2. a", "Titulo I"), ("Artículo 3", "Artículo 3 Bis.-", "b\n\nCAPÍTULO II z", "Titulo I"), ("Artículo 4", "Artículo 4.", "c", "Capitulo II")]
    plan = docs.select(A.headings(F.col("text")).alias("h"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and plan.count("split(") == 1


def test_totals_are_counted_in_one_pass(spark):
    from codexa.operators import stats as S

    chunks = spark.createDataFrame([("d", 0, "a"), ("d", 1, "a"), ("d", 2, "b"), ("e", 0, "a"), ("e", 1, None)], "document string, chunk_ord long, texto_busqueda string")
    assert {r.document: (r.chunks, r.duplicates, r.indexed) for r in S.run_totals_of(chunks).collect()} == {"d": (3, 1, 2), "e": (2, 0, 2), None: (5, 1, 4)}
    assert "Window" not in S.run_totals_of(chunks)._jdf.queryExecution().optimizedPlan().toString()
