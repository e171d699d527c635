"""Statute patterns in the JVM dialect.

``d``: only a line feed ends a line; ``U``: Unicode classes and case; ``\\z``: absolute end of text.
"""

# The grammar of the statutes that the parser has to recognise.
ROMAN = r"(?:M{0,3})(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})"
LATIN = r"BIS|TER|QU[ÁA]TER|QUINQUIES|Bis|Ter|Qu[áa]ter|Quinquies"
HEADER = r"(?:ART[ÍI]CULO|Art[íi]culo)\s+\d+"
ORDINALS = r"PRIMERO|SEGUNDO|TERCERO|CUARTO|QUINTO|SEXTO|SÉPTIMO|OCTAVO|NOVENO|DÉCIMO"
HEADING_WORDS = r"LIBRO|TÍTULO|TITULO|CAPÍTULO|CAPITULO|SECCIÓN|SECCION"
PUNCTUATION = r"[!-/:-@\[-`{-~]"

TITLE = rf"{HEADER}(?:[oOaA]|\.)?(?:[\s.\-]*(?:{LATIN}))?[.\-]*"
ARTICLE = rf"(?msdU)^\s*({TITLE})\s*(.*?)(?=(?:^\s*{HEADER})|\z)"
FRACTION = rf"(?msdU)^\s*({ROMAN})[.\-]\s+(.*?)(?=(?:^\s*{ROMAN}[.\-])|\z)"
FRACTION_MARK = rf"(?mdU)^\s*{ROMAN}[.\-]\s+"
ITEM = r"(?msdU)^\s*([a-z])\)(.*?)(?=(?:^\s*[a-z]\))|\z)"
ITEM_MARK = r"(?mdU)^\s*[a-z]\)"
#: The groups of the three, from the text of one match.
ARTICLE_PARTS = rf"(?sdU)\A\s*({TITLE})\s*(.*)\z"
FRACTION_PARTS = rf"(?sdU)\A\s*({ROMAN})[.\-]\s+(.*)\z"
ITEM_PARTS = r"(?sdU)\A\s*([a-z])\)(.*)\z"
GAZETTE = r"(?imduU)^\s*(?:Párrafo|Artículo|Fracción|Inciso)?\s*(?:reformado|adicionado|derogado)\s+DOF[\s\d\-,.]*"
REFERENCE = rf"(?iduU)\b(?:art[íi]culo|art\.)\s*(\d+\s*(?:[oOaA°]\.?)?(?:\s*(?:{LATIN}))?)"
#: ``compat`` reads a numeral only where it is Roman, else as empty; ``extended`` reads digits and ordinals too.
HEADING = {
    "compat": rf"(?imduU)^\s*({HEADING_WORDS})\s+({ROMAN})\b[^\n]*",
    "extended": rf"(?imduU)^\s*({HEADING_WORDS})\s+(\d+|{ORDINALS}|{ROMAN})\b[^\n]*",
}
