import re

import pandas as pd

from hushframe.llm import licenses
from hushframe.llm.queries import QUERIES

from frames import EDGE, prose, write
from plain import ascii_lower

NOT_A_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RULES = licenses.signature_rules()


def plain(text):
    """Every rule over the whole text, no gates; suppression by comparing all intervals."""
    w = NOT_A_WORD.findall(ascii_lower(text or ""))
    joined = " " + " ".join(w) + " "
    found = []
    for i, r in enumerate(RULES):
        for m in re.finditer(f"(?<= ){r.regex}(?= )", joined):
            start = joined[:m.start()].count(" ") - 1
            found.append((start, start + len(m[0].split(" ")), r.priority, i, r))
    base = [f for f in found if f[4].base]
    stands = [
        a for a in found
        if a[4].base or not any(
            b[0] <= a[0] and b[1] >= a[1] and b[2] >= a[2] and b[3] != a[3] and ((b[0], -b[1], -b[2], b[3]) < (a[0], -a[1], -a[2], a[3])) for b in found
        )
    ]
    labels = lambda fs: ",".join(sorted({f[4].label for f in fs}))
    return (
        len(w), len(base), min((f[0] for f in base), default=None), max((f[0] for f in base), default=None), labels(base), labels(stands),
        max((f[4].confidence for f in stands), default=0.0),
    )


def check(got, rows):
    none = lambda x: None if pd.isna(x) else int(x)
    have = sorted(
        ((none(r.doc_id), r.n_words, r.n_base, none(r.first_word), none(r.last_word), r.base_labels, r.labels, r.score) for r in got.itertuples()),
        key=repr,
    )
    assert have == sorted(((i, *plain(t)) for i, t in rows), key=repr)


CASES = [
    "Released under the MIT License.", "under the mit license under the mit license", "Licensed under the Apache License, Version 2.0.",
    "Licensed under CC BY-NC 4.0.", "cc by-nc cc by nc-sa", "GNU Lesser General Public License v2.1 or later", "SPDX-License-Identifier: MIT",
    "This work is licensed under the GNU General Public License, version 3.", "BSD 3-Clause License. All rights reserved.", "cc by nc", "mit license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy", "a license to drive", "under the MIT", "commit licensed", "é mit é license",
    "Neither the name of the Example Foundation nor the names of its contributors may be used to endorse", "Mozilla Public License 2.0, see the apache license",
]


def test_edges(spark, tmp_path):
    rows = EDGE + list(enumerate(CASES, 100)) + [(300, prose(4_000) + " under the MIT license " + " ".join(CASES * 10))]
    check(licenses.document_licenses(write(spark, tmp_path, rows)).toPandas(), rows)


# Notices with the labels a reader gives them; the contract's base phrase "cc by nc" always counts beside them.
NOTICES = {
    "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: ISC": "isc", "// SPDX-License-Identifier: EPL-2.0": "epl-2", "SPDX-License-Identifier: Zlib": "zlib",
    "# SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2", "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause", "SPDX-License-Identifier: 0BSD": "0bsd",
    "License: MIT": "mit", "license = \"ISC\"": "isc", "Licence: Apache-2.0": "apache-2", "licensed under GPLv3": "gpl-3", "licensed under AGPLv3": "agpl-3",
    "released under the GPLv2 or later": "gpl-2", "LGPLv2.1": "lgpl-2.1", "LGPL v3": "lgpl-3", "MIT Licence": "mit", "The MIT License (MIT)": "mit",
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0": "cc-by-nc-sa", "Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc",
    "Creative Commons Attribution-ShareAlike 3.0": "cc-by-sa", "Creative Commons Attribution 4.0 International Public License": "cc-by",
    "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International": "cc-by-nc-nd", "CC BY-NC-ND 4.0": "cc-by-nc,cc-by-nc-nd",
    "the GNU Lesser General Public License": "lgpl", "GNU Lesser General Public License v2.1": "lgpl-2.1", "GNU General Public License version 3": "gpl-3",
    "Mozilla Public License": "mpl", "under the Mozilla Public License 2.0": "mpl-2", "Eclipse Public License v2.0": "epl-2", "Apache License, Version 2.0": "apache-2",
    "two-clause code, 2-Clause BSD License": "bsd-2-clause", "a license to drive a car": "", "the MIT campus": "", "ISC stands for much": "", "he was licensed in 1999": "",
    "If a copy of the MPL was not distributed with this file, You can obtain one": "mpl-2", "This is free and unencumbered software released into the public domain.": "unlicense",
}


def test_notices_by_hand(spark, tmp_path):
    rows = list(enumerate(NOTICES))
    got = {r.doc_id: r for r in licenses.document_licenses(write(spark, tmp_path, rows)).collect()}
    wrong = {t: got[i].labels for i, t in rows if got[i].labels != NOTICES[t]}
    assert not wrong


def test_gates_hold_for_identifiers():
    for context in licenses.IDENTIFIER_CONTEXTS:
        around = licenses.longest_literal(context.replace("{name}", "(x)"))
        for name in licenses.IDENTIFIERS.values():
            literal = licenses.longest_literal(name)
            assert len(literal) > 2
            for text in spellings(context.replace("{name}", f"({name})"))[0]:
                assert literal in text and around in f" {text} " and any(k in f" {text} " for k in licenses.KEYWORDS)


def spellings(regex, at=0):
    """All strings of the small regex language that the rules use, and where parsing ended."""
    options = [[""]]
    while at < len(regex) and regex[at] != ")":
        c = regex[at]
        if c == "|":
            options.append([""])
            at += 1
            continue
        if c == "(":
            item, at = spellings(regex, at + 1)
            at += 1
        elif c == "[":
            end = regex.index("]", at)
            item, at = list(regex[at + 1:end]), end + 1
        elif c == "\\":
            item, at = ["1" if regex[at + 1] == "d" else "x"], at + 2
        else:
            item, at = [c], at + 1
        if at < len(regex) and regex[at] == "?":
            item, at = [*item, ""], at + 1
        elif at < len(regex) and regex[at] == "+":
            at += 1
        elif at < len(regex) and regex[at] == "{":
            at = regex.index("}", at) + 1
        options[-1] = list(dict.fromkeys(x + y for x in options[-1] for y in item))
    return list(dict.fromkeys(x for o in options for x in o)), at


def test_gates_hold_for_every_rule():
    """No spelling of a name or text lacks the string that gates it, nor one of the keywords."""
    names = [name.replace("license", "licen[cs]e") for names in licenses.NAMES.values() for name in names] + [r for _, r in licenses.TEXTS] + list(licenses.BASE_PHRASES)
    for regex in names:
        literal = licenses.longest_literal(regex)
        assert len(literal) > 2
        for text in spellings(regex)[0]:
            assert literal in f" {text} " and any(k in f" {text} " for k in licenses.KEYWORDS), (literal, text)
    for context in licenses.CONTEXTS:
        around = licenses.longest_literal(context.replace("{name}", "(x)"))
        for text in spellings(context.replace("{name}", "mit license"))[0]:
            assert around in f" {text} ", (around, text)


def test_rules_are_many_and_ordered():
    assert len(RULES) > 300
    assert [r.base for r in RULES[:3]] == [True] * 3 and not any(r.base for r in RULES[3:])


def test_empty(spark, tmp_path):
    assert licenses.document_licenses(write(spark, tmp_path, [])).count() == 0


def test_query(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    check(QUERIES["op10_license_rules"](spark, sf).toPandas(), list(zip(docs.doc_id, docs.text)))
