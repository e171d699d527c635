"""License scans by ordered signature rules; DataFrame operations only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexa.llm.common import lower_ascii

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: (label, keywords, name as a pattern over words joined by blanks, address or None); versions stand as words: 2 0.
#: Every match of the pattern holds one of its keywords, divided by |, from the beginning of a word on, and the keyword's first word whole.
NAMES = [
    ("mit", "mit", r"mit(?: x11)?", "opensource org licenses mit"),
    ("mit-0", "mit 0|mit no", r"mit (?:0|no attribution)", "opensource org licenses mit 0"),
    ("isc", "isc|internet systems", r"(?:isc|internet systems consortium)", "opensource org licenses isc"),
    ("bsd-2-clause", "bsd|freebsd", r"(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)", "opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)", None),
    ("0bsd", "bsd|0bsd", r"(?:0bsd|bsd zero clause|zero clause bsd)", "opensource org licenses 0bsd"),
    ("bsd", "bsd", r"bsd(?: style)?", None),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?(?: version)? v?1 1", "apache org licenses license 1 1"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: license)?(?: version)? v?2(?: 0)?", "apache org licenses license 2 0"),
    ("apache", "apache", r"apache(?: software)?", "apache org licenses"),
    ("gpl-1.0", "general", r"(?:gnu )?general public license(?: version)? v?1(?: 0)?", None),
    ("gpl-2.0", "general", r"(?:gnu )?general public license(?: version)? v?2(?: 0)?", "gnu org licenses old licenses gpl 2 0"),
    ("gpl-3.0", "general", r"(?:gnu )?general public license(?: version)? v?3(?: 0)?", "gnu org licenses gpl 3 0"),
    ("gpl-2.0", "gpl|gpl2|gplv2|gplversion|gplersion", r"(?:gnu )?gpl ?v?(?:ersion )?2(?: 0)?", None),
    ("gpl-3.0", "gpl|gpl3|gplv3|gplversion|gplersion", r"(?:gnu )?gpl ?v?(?:ersion )?3(?: 0)?", None),
    ("gpl", "gpl", r"(?:gnu )?gpl", "gnu org licenses gpl"),
    ("lgpl-2.0", "lesser|library", r"(?:gnu )?(?:lesser|library) general public license(?: version)? v?2(?: 0)?", None),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public license(?: version)? v?2 1", "gnu org licenses old licenses lgpl 2 1"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public license(?: version)? v?3(?: 0)?", "gnu org licenses lgpl 3 0"),
    ("lgpl", "lgpl|lgpl2|lgpl3|lgplv2|lgplv3", r"(?:gnu )?lgpl(?: ?v?[23](?: [01])?)?", "gnu org licenses lgpl"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license(?: version)?(?: v?3(?: 0)?)?", "gnu org licenses agpl 3 0"),
    ("agpl-3.0", "agpl|agpl3|agplv3", r"(?:gnu )?agpl(?: ?v?3(?: 0)?)?", "gnu org licenses agpl"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation license(?: version)?(?: 1 [123])?", "gnu org licenses fdl"),
    ("mpl-1.1", "mozilla", r"mozilla public license(?: version)? v?1 1", "mozilla org mpl 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public license(?: version)? v?2(?: 0)?", "mozilla org mpl 2 0"),
    ("mpl", "mpl|mpl1|mpl2|mplv1|mplv2", r"mpl(?: ?v?[12] [01])?", "mozilla org mpl"),
    ("epl-1.0", "eclipse", r"eclipse public license(?: version)? v?1(?: 0)?", "eclipse org legal epl v10"),
    ("epl-2.0", "eclipse", r"eclipse public license(?: version)? v?2(?: 0)?", "eclipse org legal epl 2 0"),
    ("edl-1.0", "eclipse", r"eclipse distribution license(?: version)?(?: v?1(?: 0)?)?", None),
    ("cddl-1.0", "development", r"common development and distribution license(?: version)?(?: 1 [01])?", None),
    ("cddl-1.0", "cddl", r"cddl(?: 1 [01])?", "opensource org licenses cddl1"),
    ("cpl-1.0", "common public", r"common public license(?: version)?(?: 1 0)?", None),
    ("eupl-1.2", "european", r"european union public licen[cs]e(?: version)?(?: v?1 [12])?", "joinup ec europa eu collection eupl"),
    ("artistic-1.0", "artistic", r"artistic license(?: version)? 1 0", None),
    ("artistic-2.0", "artistic", r"artistic license(?: version)? 2(?: 0)?", "opensource org licenses artistic 2 0"),
    ("artistic", "artistic", r"artistic", None),
    ("bsl-1.0", "boost", r"boost software license(?: version)?(?: 1 0)?", "boost org license 1 0"),
    ("zlib", "zlib", r"zlib(?: libpng)?", "opensource org licenses zlib"),
    ("libpng", "libpng", r"libpng", None),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense org"),
    ("wtfpl", "wtfpl|wtfpl2|wtfplv2", r"wtfpl(?: ?v?2)?", "wtfpl net"),
    ("python-2.0", "python", r"python(?: software foundation)? license(?: version)? 2", "docs python org license"),
    ("psf", "python|psf", r"(?:psf|python software foundation)", None),
    ("php-3.01", "php", r"php license(?: version)?(?: 3 0?1)?", "php net license"),
    ("ruby", "ruby", r"ruby", None),
    ("perl", "perl", r"same terms as perl(?: itself)?", None),
    ("w3c", "w3c", r"w3c(?: software)?(?: notice and)?", "w3 org consortium legal"),
    ("ofl-1.1", "font", r"(?:sil )?open font license(?: version)?(?: 1 1)?", "scripts sil org ofl"),
    ("ms-pl", "microsoft", r"microsoft public license", None),
    ("ms-rl", "microsoft", r"microsoft reciprocal license", None),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?", None),
    ("openssl", "openssl", r"openssl", "openssl org source license"),
    ("postgresql", "postgresql", r"postgresql", "postgresql org about licence"),
    ("vim", "vim", r"vim", None),
    ("odbl-1.0", "database", r"open (?:data commons )?(?:open )?database license(?: v?1 0)?", "opendatacommons org licenses odbl"),
    ("odc-by-1.0", "commons attribution", r"open data commons attribution license(?: v?1 0)?", "opendatacommons org licenses by"),
    ("pddl-1.0", "dedication", r"public domain dedication and licen[cs]e(?: v?1 0)?", "opendatacommons org licenses pddl"),
    ("busl-1.1", "business", r"business source license(?: 1 1)?", "mariadb com bsl11"),
    ("sspl-1.0", "server side", r"server side public license(?: version)?(?: 1)?", "mongodb com licensing server side public license"),
    ("elastic-2.0", "elastic", r"elastic license(?: 2 0)?", "elastic co licensing elastic license"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", "creativecommons org publicdomain zero"),
]
#: Creative Commons: (part of the label, short form, spelled out, part of the address).
CC = [("by", "by", "attribution", "by"), ("by-sa", "by sa", "attribution share ?alike", "by sa"), ("by-nc", "by nc", "attribution non ?commercial", "by nc"), ("by-nd", "by nd", "attribution no ?deriv(?:ative|ate)?s?(?: works)?", "by nd"), ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike", "by nc sa"), ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative|ate)?s?(?: works)?", "by nc nd")]
#: (label, keywords, pattern, priority) of notices that name no license.
NOTICES = [
    ("public-domain", "public domain", r"(?:in|into|to) the public domain", 60),
    ("public-domain", "public domain", r"public domain (?:work|dedication|mark)", 70),
    ("copyright", "copyright", r"copyright(?: c)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*", 40),
    ("copyright", "copyrighted", r"copyrighted (?:material|work|by)", 40),
    ("proprietary", "proprietary", r"proprietary (?:and|or) confidential", 70),
    ("proprietary", "confidential", r"confidential and proprietary", 70),
    ("proprietary", "permission", r"(?:may not|no part (?:of this [a-z]+ )?may) be (?:reproduced|copied|redistributed|distributed)(?: [a-z]+){0,8} without (?:the )?(?:prior |express |written )*permission", 75),
    ("reserved", "rights", r"all rights reserved", 50),
    ("some-rights", "rights", r"some rights reserved", 50),
    ("no-warranty", "warranty", r"without (?:any )?warranty(?: of any kind)?", 30),
    ("no-warranty", "provided as", r"provided as is", 30),
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy", 90),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose", 90),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification", 90),
    ("zlib", "altered", r"altered source versions must be plainly marked", 90),
    ("wtfpl", "what the", r"do what the fuck you want to", 90),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain", 95),
]
#: Words that begin a grant.
VERBS = ["licensed", "released", "distributed", "available", "published", "provided", "covered", "governed", "shared", "redistribute", "redistributed"]
#: All priorities of rules.
LEVELS = (95, 90, 85, 75, 70, 65, 60, 50, 40, 30)


def rules() -> list[dict]:
    """All rules: for each name its SPDX tag, grant, address, and plain mention, and the notices."""
    out: list[dict] = []
    add = lambda label, kw, pattern, priority, grants=False: out.append({"kw": kw, "grants": grants, "pattern": f"(?<![^ ]){pattern}(?![^ ])", "label": label, "priority": priority})
    grant = rf"(?:{'|'.join(VERBS)})" r"(?: [a-z]+){0,3}? (?:under|by|with)(?: an?| the)?(?: terms(?: and conditions)? of(?: the)?)? "
    names = list(NAMES)
    for label, short, long_, _ in CC:
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            names.append((f"cc-{label}-{version}", "cc", rf"cc {short} {version.replace('.', ' ')}(?: international| unported)?", None))
            names.append((f"cc-{label}-{version}", "creative commons", rf"creative commons {long_} {version.replace('.', ' ')}(?: international| unported)?", f"creativecommons org licenses {short} {version.replace('.', ' ')}"))
        names.append((f"cc-{label}", "cc", rf"cc {short}", None))
        names.append((f"cc-{label}", "creative commons", rf"creative commons {long_}", f"creativecommons org licenses {short}"))
    for label, kw, name, url in names:
        tag = label.replace("-", " ").replace(".", " ")
        add(label, "spdx", rf"spdx license identifier {tag}(?: only| or later)?", 95)
        add(label, kw, rf"{grant}{name}(?: licen[cs]e)?", 85, True)
        plain = name if "licen" in name or name.startswith(("cc ", "creative", "same terms", "cc0", "(?:the )?unlicense", "wtfpl")) else rf"{name} licen[cs]e"
        add(label, "mit licen|mit x11" if kw == "mit" and plain.endswith("licen[cs]e") and name.startswith("mit(?: x11)") else kw, plain, 65)
        if url:
            add(label, url.split(" ")[0], url, 75)
    for label, kw, pattern, priority in NOTICES:
        add(label, kw, pattern, priority)
    return [r | {"id": i} for i, r in enumerate(out)]


def starts(text: Column, pattern: Column, hits: Column) -> Column:
    """Offsets of the matches ``hits`` of ``pattern``: lengths of what stands between them, summed up."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    sums = F.aggregate(
        F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("g"), F.transform(hits, lambda h: F.length(h)).alias("h")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("xs")),
        lambda s, x: F.struct((s.at + x.g + x.h).alias("at"), F.concat(s.xs, F.array(s.at + x.g)).alias("xs")),
    )
    return sums.xs


def detections(norm: Column, present: Column) -> Column:
    """ARRAY<STRUCT<start, stop, priority, label>> of all rules whose keywords are ``present``, in text order, longest first."""
    table = F.from_json(F.lit(json.dumps(rules())), "array<struct<kw:string,grants:boolean,pattern:string,label:string,priority:int,id:int>>")

    def found(r: Column) -> Column:
        hits = F.regexp_extract_all(norm, r.pattern, F.lit(0))
        return F.transform(F.arrays_zip(starts(norm, r.pattern, hits).alias("s"), hits.alias("h")), lambda x: F.struct(x.s.alias("start"), (-(x.s + F.length(x.h))).alias("minus_stop"), (-r.priority).alias("minus_priority"), r.label.alias("label")))

    return F.sort_array(F.flatten(F.transform(F.filter(table, lambda r: F.array_contains(present.keywords, r.kw) & (~r.grants | present.grant)), found)))


def surviving(found: Column) -> Column:
    """Detections that no other one of the same or a higher priority contains.

    One pass in the order of starts, longest first: of each priority it keeps the furthest end so far. Of equal
    intervals the higher priority stands first and suppresses the rest; of the same priority the first label stays.
    """
    zero = F.struct(*[F.lit(-1).alias(f"e{p}") for p in LEVELS], F.array().cast("array<struct<priority:int,label:string,start:int,stop:int>>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        stop, p = -x.minus_stop, -x.minus_priority
        ends = F.greatest(*[F.when(F.lit(level) >= p, s[f"e{level}"]).otherwise(-1) for level in LEVELS])
        new = [F.when(p == level, F.greatest(s[f"e{level}"], stop)).otherwise(s[f"e{level}"]).alias(f"e{level}") for level in LEVELS]
        one = F.array(F.struct(p.alias("priority"), x.label.alias("label"), x.start.alias("start"), stop.alias("stop")))
        return F.struct(*new, F.when(ends >= stop, s.kept).otherwise(F.concat(s.kept, one)).alias("kept"))

    return F.aggregate(found, zero, step, lambda s: s.kept)


def gated(rows: DataFrame) -> DataFrame:
    """(doc_id, n_words, norm, present) from (doc_id, norm): ``present`` has the keywords of the rules that may match, and whether a grant may begin."""
    table = rules()
    plain = {r["kw"] for r in table if not r["grants"]}
    parts = [(kw, k, k.split(" ")[0]) for kw in sorted({r["kw"] for r in table}) for k in kw.split("|")]
    firsts = sorted({first for _, _, first in parts} | set(VERBS))
    words = F.when(F.col("norm") != "", F.split("norm", " ")).otherwise(F.array().cast("array<string>"))
    seen = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.array_intersect(w, F.array(*[F.lit(k) for k in firsts])).alias("firsts")))
    rows = rows.withColumn("seen", F.get(seen, F.lit(0)))
    known = F.array(*[F.struct(F.lit(kw).alias("kw"), F.lit(k).alias("k"), F.lit(first).alias("first"), F.lit(kw in plain).alias("plain")) for kw, k, first in parts])
    grant = F.arrays_overlap("seen.firsts", F.array(*[F.lit(v) for v in VERBS]))
    held = F.filter(known, lambda x: F.array_contains("seen.firsts", x.first) & (x.plain | grant) & (F.col("norm").startswith(x.k) | F.contains("norm", F.concat(F.lit(" "), x.k))))
    held = F.when(F.size("seen.firsts") > 0, F.transform(held, lambda x: x.kw)).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", F.col("seen.n").alias("n_words"), "norm", F.struct(held.alias("keywords"), grant.alias("grant")).alias("present"))


def scan(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found).

    Texts are brought to words joined by blanks, in which base phrases are searched, then keywords, and then the rules
    whose keyword is there; all happens within the row, so nothing is shuffled. ``found`` holds
    the surviving detections with their places in the joined text. score: 0 without labels, else the highest priority
    found, a base phrase counting 60, over 100.

    Null and empty texts: 0 words, no labels (''). Repeated rows are scanned each; empty table: no rows. Other columns
    are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), lower_ascii(F.col("text")).alias("low"))
    rows = gated(rows.select("doc_id", F.btrim(F.regexp_replace("low", GAP, " ")).alias("norm")))
    spots = {}
    for phrase in BASE:
        pattern = F.lit(f"(?<![^ ]){phrase}(?![^ ])")
        spots[phrase] = F.when(F.contains("norm", F.lit(phrase)), starts(F.col("norm"), pattern, F.regexp_extract_all("norm", pattern, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    base = F.array(*[F.struct(s.alias("at"), F.lit(BASE[p]).alias("label")) for p, s in spots.items()])
    rows = rows.withColumns({"base": base, "found": F.when(F.size("present.keywords") > 0, surviving(detections(F.col("norm"), F.col("present"))))})
    rows = rows.withColumns({"at": F.flatten("base.at"), "base_set": F.array_sort(F.transform(F.filter("base", lambda b: F.size(b.at) > 0), lambda b: b.label))})
    word = lambda at: F.when(F.size("at") > 0, F.length(F.left("norm", at)) - F.length(F.replace(F.left("norm", at), F.lit(" "), F.lit("")))).cast("long")
    own = F.coalesce(F.transform("found", lambda x: x.label), F.array().cast("array<string>"))
    best = F.greatest(F.coalesce(F.array_max(F.transform("found", lambda x: x.priority)), F.lit(0)), F.when(F.size("at") > 0, 60).otherwise(0))
    return rows.select(
        "doc_id", "n_words", F.size("at").cast("long").alias("n_base"), word(F.array_min("at")).alias("first_word"), word(F.array_max("at")).alias("last_word"),
        F.array_join("base_set", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat("base_set", own))), ",").alias("labels"), (best / 100).cast("double").alias("score"), "found",
    )
