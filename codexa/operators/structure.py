"""Statute text to nested article records; every step is narrow (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexa.functions import patterns as P
from codexa.functions.text import _col, capitalize, first_integer, normalize, strip, unaccent_heading


def _matches(text: Column, pattern: str) -> Column:
    """The texts of all matches: a pattern goes over a text once, its groups are read from the matches."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _groups(text: Column, pattern: str, parts: str, *names: str) -> Column:
    """ARRAY<STRUCT> with one field for each of the groups 1, 2, ... of ``parts`` in a match of ``pattern``."""
    return F.transform(_matches(text, pattern), lambda m: F.struct(*[F.regexp_extract(m, parts, i + 1).alias(n) for i, n in enumerate(names)]))


def headings(text: Column, mode: str = "compat") -> Column:
    """ARRAY<STRUCT<pos, label>> of book, title, chapter and section lines in text order.

    Positions are the lengths of what stands between matches and of the matches, summed up.
    """
    pattern = P.HEADING[mode]
    label = lambda m: F.concat(unaccent_heading(capitalize(F.regexp_extract(m, pattern, 1))), F.lit(" "), strip(F.regexp_extract(m, pattern, 2)))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    return F.aggregate(
        F.arrays_zip(gaps.alias("gap"), _matches(text, pattern).alias("hit")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<pos:int,label:string>>").alias("found")),
        lambda s, x: F.struct(
            (s.at + x.gap + F.coalesce(F.length(x.hit), F.lit(0))).alias("at"),
            F.when(x.hit.isNull(), s.found).otherwise(F.concat(s.found, F.array(F.struct((s.at + x.gap).alias("pos"), label(x.hit).alias("label"))))).alias("found"),
        ),
        lambda s: s.found,
    )


def _articles(text: Column) -> Column:
    """ARRAY<STRUCT<pos, title, body>>. A match ends where the next one begins or the text ends, so positions follow from lengths."""
    return F.aggregate(
        _matches(text, P.ARTICLE),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<pos:int,title:string,body:string>>").alias("found")),
        lambda s, m: F.struct(
            (s.at + F.length(m)).alias("at"),
            F.concat(s.found, F.array(F.struct(s.at.alias("pos"), F.regexp_extract(m, P.ARTICLE_PARTS, 1).alias("title"), F.regexp_extract(m, P.ARTICLE_PARTS, 2).alias("body")))).alias("found"),
        ),
        lambda s: F.transform(s.found, lambda a: F.struct((a.pos + F.length(text) - s.at).alias("pos"), a.title.alias("title"), a.body.alias("body"))),
    )


def gazette_notes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(P.GAZETTE), F.lit(0)), normalize)


def without_notes(text: Column) -> Column:
    return strip(F.regexp_replace(text, P.GAZETTE, ""))


def items(text: Column) -> Column:
    """ARRAY<STRUCT<inciso, texto_general>> of lettered items."""
    return F.transform(_groups(text, P.ITEM, P.ITEM_PARTS, "a", "b"), lambda m: F.struct(m.a.alias("inciso"), normalize(m.b).alias("texto_general")))


def before(text: Column, mark: str) -> Column:
    """What stands before the first marker, stripped; the stripped text where there is none."""
    return strip(F.split(text, mark, 2)[0])


def fractions(text: Column) -> Column:
    """ARRAY<STRUCT<fraccion, texto_general, incisos>>; matches with an empty numeral are dropped."""
    numbered = F.filter(_groups(text, P.FRACTION, P.FRACTION_PARTS, "num", "body"), lambda m: m.num != "")
    stripped = F.transform(numbered, lambda m: F.struct(m.num.alias("num"), strip(m.body).alias("body")))
    return F.transform(stripped, lambda m: F.struct(m.num.alias("fraccion"), normalize(before(m.body, P.ITEM_MARK)).alias("texto_general"), items(m.body).alias("incisos")))


def references(text: Column) -> Column:
    """Sorted distinct article references."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(P.REFERENCE), F.lit(1)), lambda m: F.concat(F.lit("Artículo "), normalize(m)))))


def drop_self(refs: Column, title: Column) -> Column:
    """Without references whose number, ending at a word boundary, is the title's first integer."""
    number = lambda r: F.regexp_extract(r, r"(?U)^Artículo\s+(\d+)\b", 1)
    return F.filter(refs, lambda r: (number(r) == "") | (number(r) != first_integer(title)))


def heading_at(pos: Column, found: Column) -> Column:
    """Backward as-of: label of the last heading at or before ``pos``, else ''."""
    return F.coalesce(F.try_element_at(F.filter(found, lambda h: h.pos <= pos), F.lit(-1))["label"], F.lit(""))


def split_articles(docs: DataFrame, document="document", text="text", mode: str = "compat") -> DataFrame:
    """(document, art_ord, pos, articulo, cuerpo, jerarquia): a row for each article header.

    Blank and null texts give no rows; text before the first header is dropped.
    """
    body = docs.select(_col(document).alias("document"), _col(text).alias("text")).where(strip(F.coalesce("text", F.lit(""))) != "")
    body = body.withColumns({"found": headings(F.col("text"), mode), "arts": _articles(F.col("text"))})
    rows = body.select("document", "found", F.posexplode("arts").alias("art_ord", "art"))
    return rows.select("document", "art_ord", F.col("art.pos").alias("pos"), normalize("art.title").alias("articulo"), strip("art.body").alias("cuerpo"), heading_at(F.col("art.pos"), F.col("found")).alias("jerarquia"))


def structure(docs: DataFrame, document="document", text="text", mode: str = "compat") -> DataFrame:
    """Article records: document, art_ord, pos, articulo, jerarquia, texto_general, historial_dof, fracciones, incisos_directos, referencias_articulos."""
    none = F.array().cast("array<struct<inciso:string,texto_general:string>>")
    out = split_articles(docs, document, text, mode)
    # explode of one element binds a value: the optimiser would put its expression wherever the column is used
    once = lambda c: F.explode(F.array(c))
    out = out.withColumn("historial_dof", gazette_notes(F.col("cuerpo"))).withColumn("limpio", once(without_notes(F.col("cuerpo"))))
    out = out.withColumn("fracciones", once(fractions(F.col("limpio"))))
    has = F.size("fracciones") > 0
    out = out.withColumn("incisos_directos", once(F.when(has, none).otherwise(items(F.col("limpio")))))
    lead = F.when(has, before(F.col("limpio"), P.FRACTION_MARK)).when(F.size("incisos_directos") > 0, before(F.col("limpio"), P.ITEM_MARK)).otherwise(F.col("limpio"))
    out = out.withColumn("lead", lead)
    text_of = lambda xs: F.array_join(F.transform(xs, lambda x: x.texto_general), " ")
    whole = F.concat_ws(" ", F.col("lead"), text_of(F.col("fracciones")), F.array_join(F.transform("fracciones", lambda f: text_of(f.incisos)), " "), text_of(F.col("incisos_directos")))
    refs = drop_self(references(whole), F.col("articulo"))
    return out.select("document", "art_ord", "pos", "articulo", "jerarquia", normalize("lead").alias("texto_general"), "historial_dof", "fracciones", "incisos_directos", refs.alias("referencias_articulos"))
