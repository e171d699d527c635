"""The registered queries: QUERIES by name, ORACLE with the DuckDB SQL of each where SQL can express it."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexa.functions import text as T
from codexa.operators import chunks as C
from codexa.operators import hybrid as H
from codexa.operators import index as I
from codexa.operators import lexical as L
from codexa.operators import querylang as Q
from codexa.operators import stats as S
from codexa.operators import structure as A
from codexa.operators import vector as V
from codexa.plans.statute import plain, plain_records, statutes
from codexa.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TEXT_QUERY = "The and attion, to thanedble the anea! Eriner"
VECTOR_QUERY = [math.sin(i) for i in range(1, 65)]
TOP_N = H.OVERFETCH * H.TOP_K


def _fill(sql: str, **values) -> str:
    for k, v in values.items():
        sql = sql.replace("{" + k + "}", str(v))
    return sql


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- scalars and corpus statistics

NORM = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
TOKENS = r"list_filter(string_split_regex(regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda x: x <> '')"
TOK = f"tok AS (SELECT doc_id AS id, unnest({TOKENS.format('text')}) AS term FROM documents)"
IDF = f"""tok AS MATERIALIZED (SELECT DISTINCT doc_id AS id, unnest({TOKENS.format("text")}) AS term FROM documents),
raws AS MATERIALIZED (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM tok GROUP BY 1),
mean AS MATERIALIZED (SELECT avg(raw) AS mean_raw FROM raws)"""
BM25 = f"""{TOK}, posts AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL),
lens AS (SELECT doc_id AS id, len({TOKENS.format("text")})::BIGINT AS dl FROM documents),
st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM lens),
dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY 1),
raws AS MATERIALIZED (SELECT term, df, ln((n_docs - df + 0.5) / (df + 0.5)) AS raw FROM dfs, st),
mean AS MATERIALIZED (SELECT avg(raw) AS mean_raw FROM raws),
idfs AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean_raw ELSE raw END AS idf FROM raws, mean),
scores AS (SELECT query_id, id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM (SELECT query_id, term, count(*) AS qtf FROM qtok GROUP BY ALL) JOIN idfs USING (term) JOIN posts USING (term) JOIN lens USING (id), st GROUP BY ALL)"""
ONE = f"qs AS (SELECT 0::BIGINT AS query_id, '{TEXT_QUERY}' AS text)"
QTOK = f"qtok AS (SELECT query_id, unnest({TOKENS.format('text')}) AS term FROM qs)"
LEX = """lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM (SELECT q.query_id, d.doc_id AS id, round(coalesce(score, 0), 9) AS score FROM (SELECT DISTINCT query_id FROM qs) q, documents d LEFT JOIN scores s ON s.query_id = q.query_id AND s.id = d.doc_id)
  QUALIFY rank <= {n})"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vecs = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    rows = docs.join(vecs, F.col("doc_id") == F.col("vec_id"))
    return rows.select(F.col("doc_id").alias("id"), "text", F.col("source").alias("documento"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("articulo"), F.col("lang").alias("jerarquia"), "embedding")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _one_query(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("query_id"), F.lit(TEXT_QUERY).alias("text"))


def _one_vector(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("query_id"), F.array(*[F.lit(x) for x in VECTOR_QUERY]).alias("qvec"))


def _lexical(docs: DataFrame, queries: DataFrame, n: int = TOP_N) -> DataFrame:
    return L.top(docs, queries, n)


@query(f"SELECT doc_id, {NORM.format('text')} AS norm FROM documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize("text").alias("norm"))


@query("SELECT doc_id, left(md5(text), 12) AS h FROM documents")
def short_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", T.short_hash("text").alias("h"))


@query(f"SELECT doc_id, len({TOKENS.format('text')})::BIGINT AS n_tokens FROM documents")
def tokenize_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.tokens("text")).cast("long").alias("n_tokens"))


@query(f"WITH {TOK} SELECT term, count(*) AS n FROM tok GROUP BY 1 ORDER BY n DESC, term LIMIT 100")
def term_frequency_topk(spark, d):
    return _docs(spark, d).select(F.explode(T.tokens("text")).alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(100)


@query(f"WITH {TOK} SELECT term, count(DISTINCT id) AS df FROM tok GROUP BY 1")
def document_frequency(spark, d):
    return L.term_frequency(_docs(spark, d))


@query(f"WITH {TOK}, lens AS (SELECT len({TOKENS.format('text')}) AS dl FROM documents) SELECT (SELECT count(*) FROM lens) AS n_docs, (SELECT round(avg(dl), 6) FROM lens) AS avgdl, (SELECT count(DISTINCT term) FROM tok) AS n_terms, (SELECT count(DISTINCT source) FROM documents) AS n_sources, (SELECT count(DISTINCT lang) FROM documents) AS n_langs")
def corpus_stats(spark, d):
    docs = _docs(spark, d)
    base = L.corpus_stats(L.doc_lengths(docs)).select("n_docs", F.round("avgdl", 6).alias("avgdl"))
    terms = docs.select(F.explode(T.tokens("text")).alias("term")).agg(F.count_distinct("term").alias("n_terms"))
    cards = table(spark, d, "documents").agg(F.count_distinct("source").alias("n_sources"), F.count_distinct("lang").alias("n_langs"))
    return base.join(terms, how="cross").join(cards, how="cross")


@query(f"WITH {IDF} SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25 * mean_raw ELSE raw END, 6) AS idf FROM raws, mean")
def idf_with_floor(spark, d):
    docs = _docs(spark, d)
    idf = L.idf_floored(L.term_frequency(docs), L.corpus_stats(L.doc_lengths(docs)))
    return idf.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {ONE}, {QTOK}, {BM25} SELECT id, round(score, 6) AS score FROM scores")
def bm25_scores(spark, d):
    return L.scores(_docs(spark, d), _one_query(spark)).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {ONE}, {QTOK}, {BM25}, {LEX.format(n=TOP_N)} SELECT id, rank, round(score, 6) AS score FROM lex")
def bm25_topn_padded(spark, d):
    return _lexical(_docs(spark, d), _one_query(spark)).select("id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH qs AS (SELECT 0::BIGINT AS query_id, 'anea anea zzz eriner anea' AS text), {QTOK}, {BM25} SELECT id, round(score, 6) AS score FROM scores")
def bm25_repeated_query_terms(spark, d):
    queries = spark.range(1).select(F.col("id").alias("query_id"), F.lit("anea anea zzz eriner anea").alias("text"))
    return L.scores(_docs(spark, d), queries).select("id", F.round("score", 6).alias("score"))


@query(f"WITH qs AS (SELECT conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user'), {QTOK}, {BM25}, {LEX.format(n=5)} SELECT query_id, id, rank, round(score, 6) AS score FROM lex")
def bm25_batch_user_turns(spark, d):
    turns = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return _lexical(_docs(spark, d), turns, 5).select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source, left(md5(text), 12) ORDER BY doc_id) = 1")
def dedup_first(spark, d):
    return C.dedup_first(table(spark, d, "documents"), "source", "doc_id", "text").select("doc_id", "source")


@query("SELECT source, count(*) AS total, count(DISTINCT left(md5(text), 12)) AS kept, count(*) - count(DISTINCT left(md5(text), 12)) AS removed FROM documents GROUP BY 1")
def dedup_counts(spark, d):
    return C.dedup_counts(table(spark, d, "documents"), "source", "text")


# ---------------------------------------------------------------- structuring of the constructed statutes
# The SQL derives what is expected from line numbers (group g, role k of 8), never by parsing.

LINES = """lines AS (SELECT 'doc ' || doc_id AS document, n, x, n // 8 AS g, n % 8 AS k, (n // 8) % 2 = 1 AS odd
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents)),
roman AS (SELECT ['I','II','III','IV','V','VI','VII','VIII','IX','X'] AS r),
cell AS (SELECT document, g, (g % 2) = 1 AS odd, max(CASE WHEN k = 1 THEN x END) AS l1, max(CASE WHEN k = 2 THEN x END) AS l2, max(CASE WHEN k = 3 THEN x END) AS l3,
  max(CASE WHEN k = 4 THEN x END) AS l4, max(CASE WHEN k = 5 THEN x END) AS l5, bool_or(k = 6) AS note, max(CASE WHEN k = 7 THEN 'Conforme al artículo ' || (g + 2) || ', y al artículo ' || (g + 1) || ', ' || x END) AS l7,
  'Capitulo ' || r[g % 10 + 1] AS jer FROM lines, roman GROUP BY document, g, r),
grp AS (SELECT c.*, CASE WHEN h.document IS NOT NULL THEN 'CAPÍTULO ' || r[(c.g + 1) % 10 + 1] END AS nxt FROM roman, cell c LEFT JOIN (SELECT DISTINCT document, g FROM lines) h ON h.document = c.document AND h.g = c.g + 1 WHERE l1 IS NOT NULL),
art AS (SELECT document, g, odd, jer, 'Artículo ' || (g + 1) || '.' AS articulo, note, l7,
  trim(regexp_replace(CASE WHEN odd THEN concat_ws(' ', l1, l2) ELSE l1 END, '\\s+', ' ', 'g')) AS lead,
  CASE WHEN NOT odd AND l2 IS NOT NULL THEN trim(regexp_replace(l2, '\\s+', ' ', 'g')) END AS f1,
  CASE WHEN NOT odd AND l5 IS NOT NULL THEN trim(regexp_replace(concat_ws(' ', l5, l7, nxt), '\\s+', ' ', 'g')) END AS f2,
  CASE WHEN l3 IS NOT NULL THEN trim(regexp_replace(l3, '\\s+', ' ', 'g')) END AS ia,
  CASE WHEN l4 IS NOT NULL THEN trim(regexp_replace(CASE WHEN odd THEN concat_ws(' ', l4, l5, l7, nxt) ELSE l4 END, '\\s+', ' ', 'g')) END AS ib FROM grp)"""
FLAT = f"""{LINES}, flat AS (
  SELECT document, g, articulo, 0 AS sub, jer AS label, lead AS texto FROM art
  UNION ALL SELECT document, g, articulo, 1, jer || ' - Fraccion I', concat_ws(' ', nullif(lead, ''), f1) FROM art WHERE f1 IS NOT NULL
  UNION ALL SELECT document, g, articulo, 2, jer || ' - Fraccion I - Inciso a)', concat_ws(' ', nullif(lead, ''), nullif(f1, ''), ia) FROM art WHERE f1 IS NOT NULL AND ia IS NOT NULL
  UNION ALL SELECT document, g, articulo, 3, jer || ' - Fraccion I - Inciso b)', concat_ws(' ', nullif(lead, ''), nullif(f1, ''), ib) FROM art WHERE f1 IS NOT NULL AND ib IS NOT NULL
  UNION ALL SELECT document, g, articulo, 4, jer || ' - Fraccion II', concat_ws(' ', nullif(lead, ''), f2) FROM art WHERE f2 IS NOT NULL
  UNION ALL SELECT document, g, articulo, 2, jer || ' - Inciso a)', concat_ws(' ', nullif(lead, ''), ia) FROM art WHERE odd AND ia IS NOT NULL
  UNION ALL SELECT document, g, articulo, 3, jer || ' - Inciso b)', concat_ws(' ', nullif(lead, ''), ib) FROM art WHERE odd AND ib IS NOT NULL),
chunk AS (SELECT document, row_number() OVER (PARTITION BY document ORDER BY g, sub) - 1 AS chunk_ord, articulo, label, '[' || document || '] ' || articulo || ' - ' || label || ': ' || texto AS texto_busqueda FROM flat WHERE texto <> ''),
kept AS (SELECT * FROM chunk QUALIFY row_number() OVER (PARTITION BY document, left(md5(texto_busqueda), 12) ORDER BY chunk_ord) = 1),
idx AS (SELECT document || '' AS document, replace(document, ' ', '_') || '__' || replace(articulo, ' ', '_') || '__' || left(replace(label, ' ', '_'), 30) || '__' || chunk_ord AS id, chunk_ord, document AS documento, articulo, label AS jerarquia FROM kept)"""


def _articles(spark, d):
    return plain_records(A.structure(statutes(spark, d)))


def _kept(spark, d):
    return C.dedup_first(C.chunks(_articles(spark, d)), "document", "chunk_ord", "texto_busqueda")


def _prepared(spark, d):
    return I.prepare(_kept(spark, d))


@query(f"WITH {LINES} SELECT document, articulo, row_number() OVER (PARTITION BY document ORDER BY g) - 1 AS art_ord FROM art")
def statute_articles(spark, d):
    return A.split_articles(statutes(spark, d)).select("document", "articulo", F.col("art_ord").cast("long").alias("art_ord"))


@query(f"WITH {LINES} SELECT document, 'Capitulo ' || r[g % 10 + 1] AS label, row_number() OVER (PARTITION BY document ORDER BY g) - 1 AS ord FROM lines, roman WHERE k = 0")
def statute_headings(spark, d):
    return statutes(spark, d).select("document", F.posexplode(A.headings(F.col("text"))).alias("ord", "h")).select("document", "h.label", F.col("ord").cast("long").alias("ord"))


@query(f"WITH {LINES} SELECT document, a.articulo, h.label AS jerarquia FROM (SELECT document, articulo, g * 8 + 1 AS at FROM art) a ASOF LEFT JOIN (SELECT document AS hd, 'Capitulo ' || r[g % 10 + 1] AS label, n FROM lines, roman WHERE k = 0) h ON a.document = h.hd AND a.at >= h.n")
def article_hierarchy_asof(spark, d):
    return A.split_articles(statutes(spark, d)).select("document", "articulo", "jerarquia")


@query(f"WITH {LINES} SELECT document, articulo, CASE WHEN note THEN 'Párrafo reformado DOF 01-02-2003' ELSE '' END AS notes FROM art")
def gazette_notes(spark, d):
    return _articles(spark, d).select("document", "articulo", F.array_join("historial_dof", "|").alias("notes"))


@query(rf"WITH {LINES} SELECT document, articulo, trim(regexp_replace(concat_ws(' ', l1, CASE WHEN odd THEN l2 ELSE 'I. ' || l2 END, 'a) ' || l3, 'b) ' || l4, CASE WHEN odd THEN l5 ELSE 'II. ' || l5 END, l7, nxt), '\s+', ' ', 'g')) AS clean FROM (SELECT *, 'Artículo ' || (g + 1) || '.' AS articulo FROM grp)")
def gazette_clean_body(spark, d):
    return A.split_articles(statutes(spark, d)).select("document", "articulo", plain(T.normalize(A.without_notes(F.col("cuerpo")))).alias("clean"))


@query(f"WITH {LINES} SELECT document, articulo, 'I' AS fraccion, f1 AS texto FROM art WHERE f1 IS NOT NULL UNION ALL SELECT document, articulo, 'II', f2 FROM art WHERE f2 IS NOT NULL")
def fractions(spark, d):
    return _articles(spark, d).select("document", "articulo", F.explode("fracciones").alias("f")).select("document", "articulo", "f.fraccion", F.col("f.texto_general").alias("texto"))


@query(f"WITH {LINES} SELECT document, articulo, 'I' AS fraccion, 'a' AS inciso, ia AS texto FROM art WHERE f1 IS NOT NULL AND ia IS NOT NULL UNION ALL SELECT document, articulo, 'I', 'b', ib FROM art WHERE f1 IS NOT NULL AND ib IS NOT NULL")
def fraction_items(spark, d):
    rows = _articles(spark, d).select("document", "articulo", F.explode("fracciones").alias("f")).select("document", "articulo", "f.fraccion", F.explode("f.incisos").alias("i"))
    return rows.select("document", "articulo", "fraccion", "i.inciso", F.col("i.texto_general").alias("texto"))


@query(f"WITH {LINES} SELECT document, articulo, 'a' AS inciso, ia AS texto FROM art WHERE odd AND ia IS NOT NULL UNION ALL SELECT document, articulo, 'b', ib FROM art WHERE odd AND ib IS NOT NULL")
def direct_items(spark, d):
    return _articles(spark, d).select("document", "articulo", F.explode("incisos_directos").alias("i")).select("document", "articulo", "i.inciso", F.col("i.texto_general").alias("texto"))


@query(f"WITH {LINES} SELECT document, articulo, ref FROM (SELECT document, articulo, unnest(['Artículo ' || (g + 2), 'Artículo ' || (g + 1)]) AS ref FROM art WHERE l7 IS NOT NULL)")
def article_references(spark, d):
    arts = A.split_articles(statutes(spark, d))
    return arts.select("document", "articulo", F.explode(A.references(F.col("cuerpo"))).alias("ref"))


@query(f"WITH {LINES} SELECT document, articulo, CASE WHEN l7 IS NULL THEN '' ELSE 'Artículo ' || (g + 2) END AS refs FROM art")
def self_reference_filter(spark, d):
    return _articles(spark, d).select("document", "articulo", F.array_join("referencias_articulos", "|").alias("refs"))


@query(f"""WITH {LINES} SELECT document, articulo, jer AS jerarquia, md5(lead) AS h_general, note::INT::BIGINT AS n_notes, ((f1 IS NOT NULL)::INT + (f2 IS NOT NULL)::INT)::BIGINT AS n_fractions,
  CASE WHEN odd THEN (ia IS NOT NULL)::INT + (ib IS NOT NULL)::INT ELSE 0 END::BIGINT AS n_direct, (l7 IS NOT NULL)::INT::BIGINT AS n_refs FROM art""")
def article_record_json(spark, d):
    from codexa.sources.files import ARTICLE_T

    rows = _articles(spark, d).select("document", F.from_json(F.to_json(F.struct("articulo", "jerarquia", "texto_general", "historial_dof", "fracciones", "incisos_directos", "referencias_articulos")), ARTICLE_T).alias("a"))
    n = lambda c: F.size(f"a.{c}").cast("long")
    return rows.select("document", "a.articulo", "a.jerarquia", F.md5("a.texto_general").alias("h_general"), n("historial_dof").alias("n_notes"), n("fracciones").alias("n_fractions"), n("incisos_directos").alias("n_direct"), n("referencias_articulos").alias("n_refs"))


@query(f"WITH {FLAT} SELECT document, chunk_ord, texto_busqueda FROM chunk")
def chunks_all(spark, d):
    return C.chunks(_articles(spark, d)).select("document", "chunk_ord", "texto_busqueda")


@query(f"WITH {FLAT} SELECT label, count(*) AS n FROM chunk GROUP BY 1")
def chunk_labels(spark, d):
    return C.flatten_articles(_articles(spark, d)).groupBy(F.col("etiqueta").alias("label")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, '[' || source || '] doc ' || doc_id || CASE WHEN lang <> 'en' THEN ' - ' || lang ELSE '' END || ': ' || text AS enriched FROM documents")
def enriched_text(spark, d):
    name = F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", C.enriched("source", name, F.when(F.col("lang") != "en", F.col("lang")).otherwise(""), "text").alias("enriched"))


@query(f"WITH {FLAT} SELECT id FROM idx")
def chunk_ids(spark, d):
    return _prepared(spark, d).select("id")


@query("SELECT doc_id, trim(lang) AS lang, CASE WHEN lang = 'fr' THEN '' ELSE source END AS source, n_chars::VARCHAR AS n_chars FROM documents")
def metadata_normalized(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit(" "), "lang", F.lit("\n")).alias("lang"), F.when(F.col("lang") != "fr", F.col("source")).alias("source"), "n_chars")
    return rows.select("doc_id", *[I.clean_meta(c).alias(c) for c in ("lang", "source", "n_chars")])


@query("SELECT 'd__' || replace('doc ' || doc_id, ' ', '_') || '__' || lang || '__' || doc_id AS id FROM documents WHERE lang <> 'de'")
def chunk_skip_empty(spark, d):
    meta = F.struct(F.lit("d").alias("documento"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("articulo"), F.col("lang").alias("jerarquia"))
    rows = table(spark, d, "documents").select(F.lit("d").alias("document"), F.col("doc_id").alias("chunk_ord"), F.when(F.col("lang") != "de", F.col("text")).otherwise(" \n").alias("texto_busqueda"), meta.alias("metadatos"))
    return I.prepare(rows).select("id")


@query(f"WITH {FLAT} SELECT documento, (chunk_ord // 128)::BIGINT AS batch, count(*) AS n FROM idx GROUP BY ALL")
def mini_batches(spark, d):
    return _prepared(spark, d).groupBy("documento", "batch").agg(F.count("*").alias("n"))


@query(f"WITH {FLAT}, per AS (SELECT document, count(*) AS chunks FROM chunk GROUP BY 1), k AS (SELECT document, count(*) AS kept FROM kept GROUP BY 1) SELECT document, sum(chunks)::BIGINT AS chunks, sum(chunks - kept)::BIGINT AS duplicates, sum(kept)::BIGINT AS indexed FROM per JOIN k USING (document) GROUP BY ROLLUP (document)")
def run_totals(spark, d):
    return S.run_totals_of(C.chunks(_articles(spark, d)))


@query(f"WITH {FLAT} SELECT row_number() OVER (ORDER BY value) AS ord, value FROM (SELECT DISTINCT documento AS value FROM idx)")
def catalog_documents(spark, d):
    return Q.catalog(_prepared(spark, d), "documento").select(F.col("ord").cast("long").alias("ord"), "value")


@query(f"WITH {FLAT} SELECT row_number() OVER (ORDER BY value) AS ord, value FROM (SELECT DISTINCT jerarquia AS value FROM idx)")
def catalog_hierarchies(spark, d):
    return Q.catalog(_prepared(spark, d), "jerarquia").select(F.col("ord").cast("long").alias("ord"), "value")


@query(f"WITH {FLAT} SELECT count(*) AS n_rows, count(DISTINCT documento) AS n_documents, count(DISTINCT jerarquia) AS n_hierarchies FROM idx")
def index_cardinalities(spark, d):
    return S.cardinalities(_prepared(spark, d))


def _filter_query(name: str, where: str, document: str | None, hierarchy: str | None) -> None:
    def run(spark, d):
        return _prepared(spark, d).where(H.metadata_filter(document, hierarchy)).select("id")

    run.__name__ = name
    query(f"WITH {FLAT} SELECT id FROM idx WHERE {where}")(run)


_filter_query("filter_document", "contains(lower(documento), 'doc 1')", " DOC 1 ", None)
_filter_query("filter_hierarchy", "contains(lower(jerarquia), 'fraccion ii')", None, "Fraccion II")
_filter_query("filter_both", "contains(lower(documento), '7') AND contains(lower(jerarquia), 'inciso')", "7", "INCISO")
_filter_query("filter_none", "true", None, "")


# ---------------------------------------------------------------- query lines

RAW = ["derecho ley:2 jerarquia:capitulo", "x ley:99999", "LEY:Constitucion  Derecho a LA educacion", "ley: jerarquia: nada", "ley:1 ley:7777777 JERARQUIA:A jerarquia:b uno", "catalogo", " Salir ", "ley:src1 ley:3", "ley:99999999999999999999 z", "   "]


@query("""WITH cat AS (SELECT row_number() OVER (ORDER BY source) AS ord, source FROM (SELECT DISTINCT source FROM documents)),
pick AS (SELECT max(CASE WHEN ord = 1 THEN source END) AS s1, max(CASE WHEN ord = 2 THEN source END) AS s2, max(CASE WHEN ord = 3 THEN source END) AS s3 FROM cat)
SELECT unnest([0,1,2,3,4,5,6,7,8,9])::BIGINT AS query_id, unnest([s2, NULL, 'constitucion', '', s1, NULL, NULL, s3, NULL, NULL]) AS filtro_documento, unnest(['capitulo', NULL, NULL, '', 'b', NULL, NULL, NULL, NULL, NULL]) AS filtro_jerarquia,
unnest([NULL, NULL, NULL, NULL, NULL, 'catalog', 'quit', NULL, NULL, NULL]) AS command FROM pick""")
def parse_query_filters(spark, d):
    lines = spark.createDataFrame(list(enumerate(RAW)), "query_id long, raw string")
    docs = Q.catalog(table(spark, d, "documents").withColumn("documento", F.col("source")), "documento")
    return Q.parse(lines, docs).select("query_id", "filtro_documento", "filtro_jerarquia", "command")


@query("SELECT unnest([0,1,2,3,4,5,6,7,8,9])::BIGINT AS query_id, unnest(['derecho', 'x', 'Derecho a LA educacion', 'nada', 'uno', 'catalogo', 'Salir', '', 'z', '']) AS consulta")
def clean_query(spark, d):
    lines = spark.createDataFrame(list(enumerate(RAW)), "query_id long, raw string")
    docs = Q.catalog(table(spark, d, "documents").withColumn("documento", F.col("source")), "documento")
    return Q.parse(lines, docs).select("query_id", "consulta")


# ---------------------------------------------------------------- vectors, fusion, hybrid search

QV = "qv AS (SELECT 0::BIGINT AS query_id, list_transform(range(1, 65), lambda i: sin(i)) AS q)"
IDX = "idx AS (SELECT doc_id AS id, text, source AS documento, 'doc ' || doc_id AS articulo, lang AS jerarquia, embedding FROM documents JOIN embeddings ON doc_id = vec_id)"
SEM = f"{IDX}, sem AS (SELECT query_id, id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 9) AS cos, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, id) AS rank FROM idx, qv QUALIFY rank <= {TOP_N})"
# the lexical side sees the indexed documents only
HYB = f"{ONE}, {QV}, {SEM}, documents2 AS (SELECT id AS doc_id, text FROM idx), " + (f"{QTOK}, {BM25}, {LEX.format(n=TOP_N)}").replace("FROM documents", "FROM documents2").replace(", documents d", ", documents2 d")
FUSED = HYB + ", fused AS (SELECT id, coalesce({ws}::DOUBLE / (60 + s.rank), 0) + coalesce({wl}::DOUBLE / (60 + l.rank), 0) AS score, coalesce(s.rank, 1000000 + l.rank) AS fuse_ord FROM sem s FULL JOIN lex l USING (id))"
HITS = FUSED + ", hit AS (SELECT id, documento, articulo, jerarquia, text, score, row_number() OVER (ORDER BY score DESC, fuse_ord DESC) AS r FROM fused JOIN idx USING (id) WHERE {where} QUALIFY r <= {k})"
HIT_COLS = "SELECT id, row_number() OVER (ORDER BY r DESC) AS position, md5(text) AS h_texto, round(score, 9) AS puntuacion_rrf, documento, articulo, jerarquia FROM hit"


def _semantic(spark, index, n: int = TOP_N):
    return V.cosine_top(index, _one_vector(spark), n)


def _hits(spark, d, **more):
    index = _index(spark, d)
    hits = H.hybrid_search(_semantic(spark, index), _lexical(index.select("id", "text"), _one_query(spark)), index.drop("embedding"), **more)
    return hits.select("id", F.col("position").cast("long").alias("position"), F.md5("texto").alias("h_texto"), F.round("puntuacion_rrf", 9).alias("puntuacion_rrf"), "documento", "articulo", "jerarquia")


@query(f"WITH {QV} SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS cos, row_number() OVER (ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 9) DESC, vec_id) AS rank FROM embeddings, qv QUALIFY rank <= {TOP_N}")
def cosine_topk(spark, d):
    vecs = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return V.cosine_top(vecs, _one_vector(spark), TOP_N).select("id", F.round("cos", 6).alias("cos"), F.col("rank").cast("long").alias("rank"))


@query("WITH qv AS (SELECT s::BIGINT AS query_id, list_transform(range(1, 65), lambda i: sin(i * (s + 1))) AS q FROM range(8) t(s)) SELECT query_id, vec_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 9) DESC, vec_id) AS rank FROM embeddings, qv QUALIFY rank <= 10")
def cosine_topk_batch(spark, d):
    vecs = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    qs = spark.range(8).select(F.col("id").alias("query_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(i * (F.col("id") + 1))).alias("qvec"))
    return V.cosine_top(vecs, qs, 10).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query()
def cosine_ann_lsh(spark, d):
    vecs = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    norm = math.sqrt(sum(x * x for x in VECTOR_QUERY))
    return V.cosine_top_lsh(vecs, [x / norm for x in VECTOR_QUERY], 10).select("id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_fill(FUSED, ws=0.6, wl=0.4)} SELECT id, round(score, 9) AS score, fuse_ord FROM fused")
def rrf_fusion(spark, d):
    index = _index(spark, d)
    fused = H.fuse(_semantic(spark, index), _lexical(index.select("id", "text"), _one_query(spark)))
    return fused.select("id", F.round("score", 9).alias("score"), F.col("fuse_ord").cast("long").alias("fuse_ord"))


@query(f"WITH {_fill(HITS, ws=0.6, wl=0.4, where='true', k=15)} {HIT_COLS}")
def hybrid_search(spark, d):
    return _hits(spark, d)


@query(f"WITH {_fill(HITS, ws=0.6, wl=0.4, where=chr(39) + 'src1' + chr(39) + ' = left(documento, 4) AND contains(lower(jerarquia), ' + chr(39) + 'en' + chr(39) + ')', k=15)} {HIT_COLS}")
def hybrid_filtered(spark, d):
    return _hits(spark, d, document=" SRC1", hierarchy="EN")


@query(f"WITH {_fill(HITS, ws=0.6, wl=0.4, where='lower(documento) = ' + chr(39) + 'src13' + chr(39), k=15)} {HIT_COLS}")
def hybrid_underfill(spark, d):
    return _hits(spark, d, document="src13")


@query("WITH " + _fill(FUSED, ws=0.5, wl=0.5) + ", sweep AS (SELECT w, id, coalesce(w / 10.0::DOUBLE / (60 + s.rank), 0) + coalesce((10 - w) / 10.0::DOUBLE / (60 + l.rank), 0) AS score, coalesce(s.rank, 1000000 + l.rank) AS fuse_ord FROM (sem s FULL JOIN lex l USING (id)), range(0, 11) t(w)) SELECT w AS weight, id, row_number() OVER (PARTITION BY w ORDER BY round(score, 12) DESC, fuse_ord DESC) AS rank FROM sweep QUALIFY rank <= 5")
def hybrid_weight_sweep(spark, d):
    from pyspark.sql import Window as W

    index = _index(spark, d)
    sem, lex = _semantic(spark, index), _lexical(index.select("id", "text"), _one_query(spark))
    both = sem.select("id", F.col("rank").alias("r_s")).join(lex.select("id", F.col("rank").alias("r_l")), "id", "full_outer")
    rows = both.join(spark.range(11).select(F.col("id").alias("weight")), how="cross")
    part = lambda w, r: F.coalesce(w / 10 / (60 + F.col(r)), F.lit(0.0))
    scored = rows.select("weight", "id", F.round(part(F.col("weight"), "r_s") + part(10 - F.col("weight"), "r_l"), 12).alias("score"), F.coalesce("r_s", 1_000_000 + F.col("r_l")).alias("fuse_ord"))
    rank = F.row_number().over(W.partitionBy("weight").orderBy(F.desc("score"), F.desc("fuse_ord")))
    return scored.select("weight", "id", rank.cast("long").alias("rank")).where("rank <= 5")


@query("WITH qs AS (SELECT item_id AS query_id, text FROM benchmark), qv AS (SELECT item_id AS query_id, list_transform(range(1, 65), lambda i: sin(i * (item_id + 1))) AS q FROM benchmark), " + HYB.replace(f"{ONE}, {QV}, ", "") + ", hit AS (SELECT query_id, id, coalesce(0.6::DOUBLE / (60 + s.rank), 0) + coalesce(0.4::DOUBLE / (60 + l.rank), 0) AS score, coalesce(s.rank, 1000000 + l.rank) AS fuse_ord FROM sem s FULL JOIN lex l USING (query_id, id)) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fuse_ord DESC) AS r FROM hit QUALIFY r <= 15")
def hybrid_batch(spark, d):
    index, items = _index(spark, d), table(spark, d, "benchmark")
    queries = items.select(F.col("item_id").alias("query_id"), "text")
    vectors = items.select(F.col("item_id").alias("query_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(i * (F.col("item_id") + 1))).alias("qvec"))
    hits = H.hybrid_search(V.cosine_top(index, vectors, TOP_N), _lexical(index.select("id", "text"), queries), index.drop("embedding"))
    return hits.select("query_id", "id", (16 - F.col("position") - (15 - F.count("*").over(_by_query()))).cast("long").alias("r"))


def _by_query():
    from pyspark.sql import Window as W

    return W.partitionBy("query_id")


# ---------------------------------------------------------------- files written and read again


def _folder(spark: SparkSession) -> str:
    """A new folder where spark.checkpoint.dir is, or a local one where a local master has none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(shared or tempfile.gettempdir()).rstrip('/')}/files-{uuid.uuid4().hex}"


@query("SELECT 'doc ' || doc_id AS document, (i - 1)::BIGINT AS chunk_ord, xs[i] AS texto_busqueda, lang AS jerarquia FROM (SELECT doc_id, lang, xs, unnest(range(1, len(xs) + 1)) AS i FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS xs FROM documents))")
def json_round_trip(spark, d):
    """Each document's lines as a JSON array in a file of its own, and back."""
    docs = table(spark, d, "documents").withColumn("document", F.concat(F.lit("doc "), F.col("doc_id").cast("string")))
    lines = docs.select("document", "lang", F.posexplode(F.split("text", "\n", -1)).alias("chunk_ord", "texto_busqueda"))
    meta = F.struct(F.col("document").alias("documento"), F.lit(None).cast("string").alias("articulo"), F.col("lang").alias("jerarquia"))
    folder = _folder(spark)
    files.write_arrays(lines.withColumn("metadatos", meta), docs, folder, "chunk_ord", ["texto_busqueda", "metadatos"], "_chunks")
    return files.read_chunks(spark, folder)[0].select("document", "chunk_ord", "texto_busqueda", F.col("metadatos.jerarquia").alias("jerarquia"))


@query("SELECT 'doc ' || doc_id AS document, CASE WHEN doc_id % 10 = 0 THEN 'docx' ELSE 'txt' END AS kind, strlen(coalesce(text, ''))::BIGINT AS length, CASE WHEN doc_id % 10 = 0 THEN '' ELSE coalesce(text, '') END AS text, doc_id % 10 = 0 AS failed FROM documents")
def corrupt_tolerance(spark, d):
    """Each document as a file, scanned and extracted; every tenth has the suffix of a format that it isn't in, and fails alone."""
    kind = F.when(F.col("doc_id") % 10 == 0, "docx").otherwise("txt")
    rows = table(spark, d, "documents").select(F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit("."), kind).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    folder = _folder(spark)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pathlib import Path

        at = Path(folder.removeprefix("file://"))
        at.mkdir(parents=True, exist_ok=True)
        for batch in batches:
            for name, text in zip(batch["name"], batch["text"], strict=True):
                (at / name).write_bytes(text.encode("utf-8"))
            yield batch[["name"]]

    rows.mapInPandas(put, "name string").count()
    found = files.scan(spark, folder)
    read = files.extract(found).select("path", "text", F.col("error").isNotNull().alias("failed"))
    return found.select("document", "path", "kind", "length").join(read, "path").drop("path")
