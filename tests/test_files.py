"""Sources and sinks: indented JSON files, good and broken DOCX, streams against batch, unique ids, recall of the approximate search."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from codexa.operators import chunks as C
from codexa.operators import index as I
from codexa.operators import structure as A
from codexa.operators import vector as V
from codexa.sources import files
from codexa.streaming import ingest

LAW = "TÍTULO I\nArtículo 1. Uno\nI. a\nII. b\nArtículo 2. Dos conforme al artículo 1\na) x\nb) y"


def test_indented_chunk_files_are_read_whole(spark, tmp_path):
    one = [{"texto_busqueda": f"t{i}", "metadatos": {"documento": "a", "articulo": str(i), "jerarquia": None}} for i in range(3)]
    (tmp_path / "a_chunks.json").write_text(json.dumps(one, ensure_ascii=False, indent=4))
    (tmp_path / "b_chunks.json").write_text('[\n  {\n "texto_busqueda"')
    (tmp_path / "c_chunks.json").write_text("[]")
    good, bad = files.read_chunks(spark, str(tmp_path))
    assert [(r.document, r.chunk_ord, r.texto_busqueda, r.metadatos.articulo) for r in good.orderBy("chunk_ord").collect()] == [("a", i, f"t{i}", str(i)) for i in range(3)]
    assert sorted(r.document for r in bad.collect()) == ["b", "c"]


def test_structured_and_chunk_files_come_back(spark, tmp_path):
    docs = spark.createDataFrame([("ley", LAW), ("vacía", "nada")], "document string, text string")
    arts = A.structure(docs)
    fields = [f.name for f in files.ARTICLE_T]
    files.write_arrays(arts, docs, str(tmp_path / "s"), "art_ord", fields, "_estructurado")
    raw = json.loads((tmp_path / "s" / "ley_estructurado.json").read_text())
    (tmp_path / "s" / "ley_estructurado.json").write_text(json.dumps(raw, ensure_ascii=False, indent=2))
    back = files.read_structured(spark, str(tmp_path / "s"))
    key = lambda df: [r.asDict(True) for r in df.select("document", "art_ord", *fields).orderBy("art_ord").collect()]
    assert key(back) == key(arts) and len(key(arts)) == 2
    made = C.chunks(arts)
    files.write_arrays(made, docs, str(tmp_path / "c"), "chunk_ord", ["texto_busqueda", "metadatos"], "_chunks")
    assert (tmp_path / "c" / "vacía_chunks.json").read_text() == "[]"
    good, bad = files.read_chunks(spark, str(tmp_path / "c"))
    assert [r.texto_busqueda for r in good.orderBy("chunk_ord").collect()] == [r.texto_busqueda for r in made.orderBy("chunk_ord").collect()]
    assert [r.document for r in bad.collect()] == ["vacía"]


def test_names_with_blanks_and_signs(spark, tmp_path):
    names = ["Ley del agua", "50% + 1", "añ o#1", "a%20b"]
    for n in names:
        (tmp_path / f"{n}_chunks.json").write_text('[{"texto_busqueda": "x"}]')
        (tmp_path / f"{n}.txt").write_text("Artículo 1. x")
    assert {r.document for r in files.read_chunks(spark, str(tmp_path))[0].collect()} == set(names)
    assert {r.document for r in files.scan(spark, str(tmp_path)).collect()} == set(names)


def test_good_docx_is_read(spark, tmp_path):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in ("Artículo 1. Uno", " ", "dos"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>tabla</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "Ley.DOCX.docx").write_bytes(out.getvalue())
    (tmp_path / "other.csv").write_text("x")
    got = files.extract(files.scan(spark, str(tmp_path))).collect()
    assert [(r.document, r.text, r.error) for r in got] == [("Ley.DOCX", "Artículo 1. Uno\ndos", None)]


def test_stream_gives_what_batch_gives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "ley.txt").write_text(LAW)
    (tmp_path / "in" / "otra.txt").write_text("Artículo 1. a\nI. b\nI. b")
    query = ingest.chunk_stream(ingest.statute_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("chunks").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(r.texto_busqueda for r in spark.table("chunks").collect())
    docs = spark.createDataFrame([("ley", LAW), ("otra", "Artículo 1. a\nI. b\nI. b")], "document string, text string")
    want = C.dedup_first(C.chunks(A.structure(docs)), "document", "chunk_ord", "texto_busqueda")
    assert got == sorted(r.texto_busqueda for r in want.collect()) and len(got) > 6


def test_extended_headings_read_digits_and_ordinals(spark):
    docs = spark.createDataFrame([("d", "CAPÍTULO 3\nArtículo 1. x\nTÍTULO SEGUNDO\nArtículo 2. y")], "document string, text string")
    assert [r.jerarquia for r in A.structure(docs, mode="extended").orderBy("art_ord").collect()] == ["Capitulo 3", "Titulo SEGUNDO"]


def test_ids_are_unique_and_embeddings_follow_their_rows(spark):
    docs = spark.createDataFrame([(f"ley {i}", LAW) for i in range(4)], "document string, text string")
    rows = I.prepare(C.chunks(A.structure(docs)))
    assert rows.count() == rows.select("id").distinct().count() > 20
    got = I.embed(rows, lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()
    assert all(r.embedding == [float(len(r.text)), 1.0] for r in got)


def test_recall_of_the_approximate_search(spark):
    vecs = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    asked = [(r.id, r.embedding) for r in vecs.where("id % 100 = 0").collect()]
    queries = spark.createDataFrame(asked, "query_id long, qvec array<double>")
    exact = {}
    for r in V.cosine_top(vecs, queries, 10).collect():
        exact.setdefault(r.query_id, set()).add(r.id)
    hits = sum(len(exact[i] & {r.id for r in V.cosine_top_lsh(vecs, q, 10).collect()}) for i, q in asked)
    assert hits >= 0.9 * 10 * len(asked)
