"""Every form that a license rule matches passes the rule's gate."""

import itertools
import random
import re
from re import _parser

from pyspark.sql import functions as F

from codexa.llm import licenses


def forms(parsed, n=40):
    """Strings that a pattern matches: every alternative and option of it, up to n by group; character classes by their first letter."""
    out = [""]
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            some = [chr(arg)]
        elif op == "IN":
            some = [chr(x[1] if str(x[0]) == "LITERAL" else x[1][0]) for x in arg]
        elif op == "SUBPATTERN":
            some = forms(arg[-1], n)
        elif op == "BRANCH":
            some = [x for branch in arg[1] for x in forms(branch, n)]
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            few = forms(inner, n)
            some = [x for times in sorted({low, min(int(high), low + 1)}) for x in ([""] if times == 0 else ["".join(y) for y in itertools.islice(itertools.product(few, repeat=times), n)])]
        else:
            assert op == "ASSERT_NOT", op
            some = [""]
        out = [a + b for b in some for a in out][:4000]
    return out


def test_every_form_of_a_rule_passes_its_gate(spark):
    # of the many beginnings of a grant one is enough: its verb is the gate's own
    grant = "licensed under the "
    rows = []
    for r in licenses.rules():
        pattern = r["pattern"]
        if r["grants"]:
            head = pattern.index("(?:the)?)? ") if "(?:the)?)? " in pattern else pattern.index("(?: the)?)? ") + len("(?: the)?)? ")
            texts = [grant + x for x in forms(_parser.parse(pattern[head:].removesuffix("(?![^ ])")))]
        else:
            texts = forms(_parser.parse(pattern))
        assert texts and all(re.search(pattern, x) for x in texts), r
        rows += [(r["id"], x) for x in texts]
    got = licenses.gated(spark.createDataFrame(rows, "doc_id long, norm string")).collect()
    table = {r["id"]: r for r in licenses.rules()}
    missed = [(table[r.doc_id]["label"], r.norm) for r in got if table[r.doc_id]["kw"] not in r.present.keywords or (table[r.doc_id]["grants"] and not r.present.grant)]
    assert not missed and len(got) == len(rows) > 1000


def test_glued_names_are_found(spark):
    want = {
        "licensed under the GPLv2": "gpl-2.0", "released under GPLv3": "gpl-3.0", "under LGPLv2.1 license": "lgpl", "under the AGPLv3 license": "agpl-3.0", "see WTFPLv2": "wtfpl", "the MPLv2.0 license": "mpl", "the FreeBSD license": "bsd-2-clause",
        "the 0BSD license": "0bsd", "copyrighted material": "copyright", "MIT No Attribution License": "mit-0", "MIT X11 License": "mit", "the PSF license": "psf", "Internet Systems Consortium license": "isc", "library general public license v2": "lgpl-2.0",
    }
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(want)], "doc_id long, text string").withColumn("lang", F.lit("en"))
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(docs).collect()}
    assert not [(t, got[i]) for i, (t, label) in enumerate(want.items()) if label not in got[i]]


def test_detections_are_those_of_a_plain_scan(spark):
    rng = random.Random(5)
    parts = ["licensed under the MIT License", "GNU General Public License version 3", "Apache License 2.0", "all rights reserved", "CC BY-SA 4.0", "Copyright 2011 2012", "BSD 3-clause license", "SPDX-License-Identifier: Apache-2.0", "released under the terms of the Mozilla Public License 2.0", "in the public domain", "http://creativecommons.org/licenses/by-sa/4.0", "proprietary and confidential", "without any warranty of any kind", "plain words", "by the", "under", "zlib license", "may not be copied without prior written permission"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    table = [(r, re.compile(r["pattern"])) for r in licenses.rules()]
    assert {r["priority"] for r, _ in table} == set(licenses.LEVELS)
    for i, text in enumerate(texts):
        norm = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()))
        every = {(m.start(), m.end(), r["priority"], r["label"]) for r, p in table for m in p.finditer(norm)}
        alive = {(a, b, p, x) for a, b, p, x in every if not any(c <= a and b <= d and q >= p and ((c, d) != (a, b) or q > p or (q == p and y < x)) for c, d, q, y in every)}
        assert {(d.start, d.stop, d.priority, d.label) for d in got[i].found or []} == alive, text
        base = {label for phrase, label in licenses.BASE.items() if re.search(f"(?<![^ ]){phrase}(?![^ ])", norm)}
        assert got[i].labels == ",".join(sorted(base | {x for *_, x in alive})) and got[i].base_labels == ",".join(sorted(base))
