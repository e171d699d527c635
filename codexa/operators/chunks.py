"""Article records to flat, context-carrying chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codexa.functions.text import _col, join_non_empty, short_hash, strip, strip_dashes


def enriched(document, article, hierarchy, text) -> Column:
    """``[document] article - hierarchy: text``; the hierarchy part is left out where it is empty."""
    document, article, hierarchy, text = map(_col, (document, article, hierarchy, text))
    return F.concat(F.lit("["), document, F.lit("] "), article, F.when(hierarchy != "", F.concat(F.lit(" - "), hierarchy)).otherwise(""), F.lit(": "), text)


def flatten_articles(articles: DataFrame) -> DataFrame:
    """(document, art_ord, sub_ord, articulo, etiqueta, texto) in the order general, fractions with their items, direct items.

    The record is bound once, as the variable of a lambda: what refers to its fields several times would otherwise
    repeat the whole parse in the plan for each.
    """
    val = lambda c: strip(F.coalesce(c, F.lit("")))
    piece = lambda label, text: F.struct(label.alias("etiqueta"), text.alias("texto"))
    none = F.array().cast("array<struct<etiqueta:string,texto:string>>")
    no_items = F.array().cast("array<struct<inciso:string,texto_general:string>>")

    def of_record(rec: Column) -> Column:
        label = lambda *parts: strip_dashes(F.concat(rec.base, *parts))

        def of_fraction(f: Column) -> Column:
            name = F.concat(F.lit(" - Fraccion "), f.fraccion)
            own = F.array(piece(label(name), join_non_empty(rec.general, val(f.texto_general))))
            of_item = lambda i: piece(label(name, F.lit(" - Inciso "), i.inciso, F.lit(")")), join_non_empty(rec.general, val(f.texto_general), val(i.texto_general)))
            return F.concat(own, F.transform(F.coalesce(f.incisos, no_items), of_item))

        direct = lambda i: piece(label(F.lit(" - Inciso "), i.inciso, F.lit(")")), join_non_empty(rec.general, val(i.texto_general)))
        parts = F.concat(
            F.array(piece(rec.base, rec.general)),
            F.coalesce(F.flatten(F.transform(rec.fracciones, of_fraction)), none),
            F.coalesce(F.transform(rec.incisos, direct), none),
        )
        return F.filter(parts, lambda p: p.texto != "")

    record = F.struct(val(F.col("texto_general")).alias("general"), val(F.col("jerarquia")).alias("base"), F.col("fracciones").alias("fracciones"), F.col("incisos_directos").alias("incisos"))
    rows = articles.select("document", "art_ord", F.coalesce("articulo", F.lit("Articulo Desconocido")).alias("articulo"), F.explode(F.array(record)).alias("rec"))
    rows = rows.select("document", "art_ord", "articulo", F.posexplode(F.get(F.transform(F.array("rec"), of_record), F.lit(0))).alias("sub_ord", "p"))
    return rows.select("document", "art_ord", "sub_ord", "articulo", "p.etiqueta", "p.texto")


def chunks(articles: DataFrame) -> DataFrame:
    """(document, chunk_ord, texto_busqueda, metadatos): chunk_ord counts a document's chunks from 0."""
    flat = flatten_articles(articles)
    order = W.partitionBy("document").orderBy("art_ord", "sub_ord")
    meta = F.struct(F.col("document").alias("documento"), "articulo", F.col("etiqueta").alias("jerarquia"))
    return flat.select("document", (F.row_number().over(order) - 1).cast("long").alias("chunk_ord"), enriched("document", "articulo", "etiqueta", "texto").alias("texto_busqueda"), meta.alias("metadatos"))


def dedup_first(df: DataFrame, group, order, text) -> DataFrame:
    """The first row by ``order`` of each (group, short content hash); ``removed`` counts the group's dropped rows.

    Null texts count as ''. One shuffle: the hash joins the key, so a large group is dealt over many tasks.
    """
    group = [group] if isinstance(group, str) else list(group)
    keyed = df.withColumn("_h", short_hash(F.coalesce(_col(text), F.lit(""))))
    return keyed.withColumn("_n", F.row_number().over(W.partitionBy(*group, "_h").orderBy(order))).where("_n = 1").drop("_n", "_h")


def dedup_counts(df: DataFrame, group, text) -> DataFrame:
    """Per group: rows, kept, removed."""
    group = [group] if isinstance(group, str) else list(group)
    per = df.groupBy(*group, short_hash(F.coalesce(_col(text), F.lit(""))).alias("_h")).agg(F.count("*").alias("n"))
    return per.groupBy(*group).agg(F.sum("n").alias("total"), F.count("*").alias("kept")).withColumn("removed", F.col("total") - F.col("kept"))
