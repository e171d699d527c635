"""Scalar text functions as Column builders; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codexa.functions.patterns import PUNCTUATION


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Without Unicode white space at both ends (trim() takes blanks only)."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+\z", "")


def normalize(c) -> Column:
    """White space collapsed to single blanks and stripped; null gives ''."""
    return F.btrim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?U)\s+", " "))


def strip_dashes(c) -> Column:
    """Without blanks and dashes at both ends."""
    return F.btrim(_col(c), F.lit(" -"))


def capitalize(c) -> Column:
    """First character upper, all others lower."""
    c = _col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def unaccent_heading(c) -> Column:
    """The three accented heading words without their accents."""
    c = _col(c)
    for accented, plain in (("Título", "Titulo"), ("Capítulo", "Capitulo"), ("Sección", "Seccion")):
        c = F.replace(c, F.lit(accented), F.lit(plain))
    return c


def tokens(c) -> Column:
    """Lower case, ASCII punctuation deleted, split at white space; no empty tokens; null gives []."""
    flat = F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), PUNCTUATION, "")
    return F.filter(F.split(flat, r"(?U)\s+"), lambda x: x != "")


def short_hash(c) -> Column:
    """First 12 hexadecimal digits of the MD5 of the UTF-8 text."""
    return F.left(F.md5(_col(c)), F.lit(12))


def underscore(c, length: int | None = None) -> Column:
    """Blanks as underscores, then cut to ``length`` code points."""
    out = F.replace(_col(c), F.lit(" "), F.lit("_"))
    return F.left(out, F.lit(length)) if length is not None else out


def join_non_empty(*parts) -> Column:
    return F.array_join(F.filter(F.array(*[_col(p) for p in parts]), lambda x: x != ""), " ")


def contains_folded(value, needle) -> Column:
    """Case-insensitive substring test; the needle is stripped; no accent folding."""
    return F.contains(F.lower(F.coalesce(_col(value), F.lit(""))), F.lower(strip(needle)))


def first_integer(c) -> Column:
    return F.regexp_extract(_col(c), r"(?U)\d+", 0)


def read_name() -> Column:
    """The name of the file that a row was read from; Spark gives it with blanks and other characters percent-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def file_stem(path) -> Column:
    """File name without folder and last suffix."""
    return F.regexp_replace(F.regexp_extract(_col(path), r"([^/]*)$", 1), r"\.[^.]*$", "")


def suffix(path) -> Column:
    """Lower-cased last suffix without its dot; '' if there is none."""
    return F.lower(F.regexp_extract(_col(path), r"\.([^./]*)$", 1))


def dot(a, b) -> Column:
    """Inner product of two arrays in double arithmetic."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine similarity of two float arrays in double arithmetic; null where a norm is 0."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length)
