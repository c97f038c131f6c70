"""License scans by ordered signature rules over normalised words.

Texts become lower-case words joined by single spaces.  A text without any keyword of
the rules is done after a few substring searches; in the others a rule is tried only
where the longest literal of its name and of its context occur.  Every match is an interval of words with the
rule's priority.  A match inside the interval of one of equal or higher priority is
suppressed (of equal intervals the earlier rule wins), the rest give labels and score.

Defined cases: a null text has no words and no label; repeated rows are scanned each on
its own; the contract's base phrases always count and always give their label; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.common import ascii_lower, text_of, with_row_id
from hushframe.session import stage

# Fixed by the contract.
NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# label -> regexes of the license's name over words; from specific to general
NAMES: dict[str, tuple[str, ...]] = {
    "agpl-3": ("gnu affero general public license( version)?( v)? ?3( 0)?( or later)?", "agpl( version)?( v)? ?3( 0)?( only| or later)?", "agplv3( 0)?( only| or later)?"),
    "agpl": ("gnu affero general public license", "gnu agpl", "agpl license"),
    "lgpl-2.1": ("gnu lesser general public license( version)?( v)? ?2 1( or later)?", "lgpl( version)?( v)? ?2 1( only| or later)?", "lgplv2 1( only| or later)?"),
    "lgpl-3": ("gnu lesser general public license( version)?( v)? ?3( 0)?( or later)?", "lgpl( version)?( v)? ?3( 0)?( only| or later)?", "lgplv3( 0)?( only| or later)?"),
    "lgpl": ("gnu lesser general public license", "gnu lgpl", "lgpl license"),
    "lgpl-2": ("gnu library general public license( version 2)?",),
    "gpl-2": ("gnu general public license( version)?( v)? ?2( 0)?( or later)?", "gnu gpl( version)?( v)? ?2( 0)?"),
    "gpl-3": ("gnu general public license( version)?( v)? ?3( 0)?( or later)?", "gnu gpl( version)?( v)? ?3( 0)?"),
    "gpl-2-short": ("gpl( version)?( v)? ?2( 0)?( only| or later)?", "gplv2( 0)?( only| or later)?"),
    "gpl-3-short": ("gpl( version)?( v)? ?3( 0)?( only| or later)?", "gplv3( 0)?( only| or later)?"),
    "gpl": ("gnu general public license", "gnu gpl", "gnu public license", "gpl license"),
    "gfdl": ("gnu free documentation license( version 1 (1|2|3))?",),
    "apache-2": ("apache license( version)?( v)? ?2( 0)?", "apache software license( version)? 2( 0)?", "apache( license)? 2( 0)?( license)?", "apache license v2( 0)?"),
    "apache-1.1": ("apache license( version)? 1 1", "apache software license( version)? 1 1"),
    "apache": ("apache license", "apache software license"),
    "mit-0": ("mit no attribution( license)?", "mit 0 license"),
    "mit": ("mit license", "mit x11 license", "mit open source license", "mit expat license"),
    "bsd-4-clause": ("bsd 4 clause( original or old)?( license)?", "4 clause bsd license", "original bsd license"),
    "bsd-3-clause": ("bsd 3 clause( new or revised)?( license)?", "3 clause bsd license", "new bsd license", "modified bsd license", "revised bsd license"),
    "bsd-2-clause": ("bsd 2 clause( simplified)?( license)?", "2 clause bsd license", "simplified bsd license", "freebsd license"),
    "bsd-0-clause": ("zero clause bsd( license)?", "0bsd( license)?"),
    "bsd": ("bsd license", "bsd style license"),
    "mpl-1.1": ("mozilla public license( version)?( v)? ?1 1",),
    "mpl-2": ("mozilla public license( version)?( v)? ?2( 0)?", "mpl( version)?( v)? ?2( 0)?", "mplv2( 0)?"),
    "mpl-1.1-short": ("mpl( version)?( v)? ?1 1",),
    "mpl": ("mozilla public license",),
    "epl-1": ("eclipse public license( version)?( v)? ?1( 0)?",),
    "epl-2": ("eclipse public license( version)?( v)? ?2( 0)?",),
    "epl": ("eclipse public license",),
    "edl-1": ("eclipse distribution license( version)?( v)? ?1( 0)?",),
    "cddl-1": ("common development and distribution license( version)?( 1 0| 1 1)?",),
    "cpl-1": ("common public license( version)?( 1 0)?",),
    "eupl": ("european union public licen[cs]e( version)?( v)? ?(1 1|1 2)?",),
    "isc": ("isc license", "isc style license"),
    "zlib": ("zlib license", "zlib libpng license"),
    "bsl-1": ("boost software license( version)?( 1 0)?",),
    "artistic-2": ("artistic license( version)? 2( 0)?",),
    "artistic-1": ("artistic license( version)? 1( 0)?",),
    "artistic": ("artistic license",),
    "psf-2": ("python software foundation license( version 2)?",),
    "psf-2-short": ("psf license( agreement)?",),
    "ofl-1.1": ("sil open font license( version)?( 1 1)?", "open font license"),
    "unlicense": ("the unlicense", "unlicense license"),
    "wtfpl": ("wtfpl( version 2)?",),
    "cc0-1": ("cc0( 1 0)?( universal)?( public domain dedication)?",),
    "cc-by-nc-nd": ("cc by nc nd( \\d 0)?",),
    "cc-by-nc-nd-long": ("creative commons attribution non ?commercial no ?deriv(ative)?s?( works)?( \\d 0)?( international)?( public)?( license)?",),
    "cc-by-nc-sa-long": ("creative commons attribution non ?commercial share ?alike( \\d 0)?( international)?( public)?( license)?",),
    "cc-by-nc-sa": ("cc by nc sa( \\d 0)?",),
    "cc-by-nc": ("cc by nc( \\d 0)?",),
    "cc-by-nc-long": ("creative commons attribution non ?commercial( \\d 0)?( international)?( public)?( license)?",),
    "cc-by-nd": ("cc by nd( \\d 0)?",),
    "cc-by-nd-long": ("creative commons attribution no ?deriv(ative)?s?( works)?( \\d 0)?( international)?( public)?( license)?",),
    "cc-by-sa": ("cc by sa( \\d 0)?",),
    "cc-by-sa-long": ("creative commons attribution share ?alike( \\d 0)?( international)?( public)?( license)?",),
    "cc-by": ("cc by \\d 0",),
    "cc-by-long": ("creative commons attribution( \\d 0)?( international)?( public)? license",),
    "cc": ("creative commons license",),
    "odbl-1": ("open database license( version)?( v)? ?(1 0)?",),
    "odbl-1-short": ("odbl 1 0",),
    "odc-by": ("open data commons attribution license",),
    "pddl": ("public domain dedication and license",),
    "bigscience-rail": ("(bigscience )?open ?rail( m)? license", "creativeml open ?rail m"),
    "llama": ("llama( 2| 3)? community license( agreement)?",),
    "sspl-1": ("server side public license( version)?( v)? ?1?",),
    "elastic-2": ("elastic license( version)?( v)? ?2( 0)?",),
    "busl-1.1": ("business source license( version)?( 1 1)?",),
    "openssl": ("openssl license",),
    "ms-pl": ("microsoft public license", "microsoft reciprocal license"),
    "proprietary": ("proprietary( software)? license", "proprietary and confidential"),
}
# Identifiers of public licenses as words, without which a notice is often just this line.
IDENTIFIERS = {
    "mit": "mit", "mit-0": "mit 0", "isc": "isc", "0bsd": "0bsd", "bsd-2-clause": "bsd 2 clause", "bsd-3-clause": "bsd 3 clause( clear)?", "bsd-4-clause": "bsd 4 clause",
    "apache-2": "apache 2 0", "apache-1.1": "apache 1 1", "gpl-1": "gpl 1 0( only| or later)?", "gpl-2": "gpl 2 0( only| or later)?", "gpl-3": "gpl 3 0( only| or later)?",
    "lgpl-2": "lgpl 2 0( only| or later)?", "lgpl-2.1": "lgpl 2 1( only| or later)?", "lgpl-3": "lgpl 3 0( only| or later)?", "agpl-3": "agpl 3 0( only| or later)?",
    "gfdl": "gfdl 1 [123]( only| or later)?", "mpl-1.1": "mpl 1 1", "mpl-2": "mpl 2 0", "epl-1": "epl 1 0", "epl-2": "epl 2 0", "cddl-1": "cddl 1 [01]", "cpl-1": "cpl 1 0",
    "eupl": "eupl 1 [012]", "zlib": "zlib", "libpng-2": "libpng 2 0", "bsl-1": "bsl 1 0", "artistic-1": "artistic 1 0", "artistic-2": "artistic 2 0", "psf-2": "(psf|python) 2 0",
    "ofl-1.1": "ofl 1 1", "unlicense": "unlicense", "wtfpl": "wtfpl", "cc0-1": "cc0 1 0", "cc-by": "cc by [1234] [05]", "cc-by-sa": "cc by sa [1234] [05]",
    "cc-by-nc": "cc by nc [1234] [05]", "cc-by-nd": "cc by nd [1234] [05]", "cc-by-nc-sa": "cc by nc sa [1234] [05]", "cc-by-nc-nd": "cc by nc nd [1234] [05]",
    "odbl-1": "odbl 1 0", "odc-by": "odc by 1 0", "pddl": "pddl 1 0", "sspl-1": "sspl 1 0", "elastic-2": "elastic 2 0", "busl-1.1": "busl 1 1", "openssl": "openssl",
    "ms-pl": "ms pl", "ms-rl": "ms rl", "postgresql": "postgresql", "ncsa": "ncsa", "x11": "x11", "hpnd": "hpnd", "upl-1": "upl 1 0", "blueoak-1": "blueoak 1 0 0",
    "ecl-2": "ecl 2 0", "afl-3": "afl 3 0", "osl-3": "osl 3 0", "cecill-2.1": "cecill 2 1", "mulanpsl-2": "mulanpsl 2 0", "lppl-1.3": "lppl 1 3[ac]", "ruby": "ruby", "vim": "vim",
    "curl": "curl", "icu": "icu", "w3c": "w3c", "naist-2003": "naist 2003", "unicode": "unicode (dfs 2016|3 0)", "qpl-1": "qpl 1 0", "sleepycat": "sleepycat", "intel": "intel",
}
# context around an identifier -> (priority, confidence)
IDENTIFIER_CONTEXTS = {
    "spdx license identifier {name}": (4, 1.0),
    "licensed under( the)?( terms of)?( the)? {name}": (3, 0.95),
    "licen[cs]e(s|d)?( is| as| type| expression| id)? {name}": (2, 0.85),
}
# context around a name -> (priority, confidence)
CONTEXTS = {
    "spdx license identifier {name}": (4, 1.0),
    "(licensed|released|distributed|available|provided|published|issued|shared) under( the)?( terms)?( and conditions)?( of)?( the)?( a| an)? {name}": (3, 0.95),
    "(subject to|governed by|covered by|terms of|version of)( the)?( terms of the)? {name}": (3, 0.9),
    "licen[cs]e(s|d)?( is| as| type)? {name}": (2, 0.85),
    "see the {name}( for)?": (2, 0.7),
    "{name}": (1, 0.6),
}
# Sentences of license texts: (label, regex)
TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither the name of( the)? (\\S+ ){1,8}nor the names of its contributors may be used to endorse"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license"),
    ("bsd-3-clause", "neither the name of( the)? (\\S+ ){1,8}may be used to endorse or promote products derived from this software"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice"),
    ("apache-2", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl", "you should have received a copy of the gnu general public license along with this"),
    ("lgpl", "you should have received a copy of the gnu (lesser|library) general public license along with this"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-1", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cddl-1", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("ofl-1.1", "this font software is licensed under the sil open font license"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0-1", "to the extent possible under law (\\S+ ){1,12}waived all copyright and related or neighboring rights"),
    ("cc", "this work is licensed under a creative commons"),
    ("openssl", "this product includes software developed by the openssl project"),
    ("bsd-4-clause", "this product includes software developed by the university of california berkeley and its contributors"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("ncsa", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license"),
    ("zlib", "an acknowledgment in the product documentation would be appreciated but is not required"),
    ("bsl-1", "distributed under the boost software license version 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0-1", "waive all copyright and related or neighboring rights"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("public-domain", "(this (work|file|code) is|released|placed) (in|into) the public domain"),
    ("all-rights-reserved", "all rights reserved"),
    ("psf-2", "psf is making python available to licensee"),
    ("proprietary", "this (document|software) is (the )?confidential and proprietary"),
)


@dataclass(frozen=True)
class Rule:
    label: str
    regex: str
    priority: int
    confidence: float
    # strings that every match holds
    needs: tuple[str, str]
    base: bool = False


def longest_literal(regex: str) -> str:
    """The longest string outside groups and classes that every match of ``regex`` holds."""
    outside = re.sub(r"\[[^]]*\][?+]?", "|", regex)
    while "(" in outside:
        outside = re.sub(r"\([^()]*\)([?+]|\{[^}]*\})?", "|", outside)
    outside = re.sub(r"\\.[?+]?|.\?", "|", outside)
    return max(outside.split("|"), key=len)


def signature_rules() -> list[Rule]:
    """All rules in order: base phrases, license texts, identifiers, then every name in every context."""
    rules = [Rule(label, phrase, 5, 1.0, (phrase, ""), True) for phrase, label in BASE_PHRASES.items()]
    rules += [Rule(label, regex, 4, 1.0, (longest_literal(regex), "")) for label, regex in TEXTS]
    for context, (priority, confidence) in IDENTIFIER_CONTEXTS.items():
        around = longest_literal(context.replace("{name}", "(x)"))
        rules += [
            Rule(label, context.replace("{name}", f"({name})"), priority, confidence, (longest_literal(name), around)) for label, name in IDENTIFIERS.items()
        ]
    for context, (priority, confidence) in CONTEXTS.items():
        around = longest_literal(context.replace("{name}", "(x)"))
        for label, names in NAMES.items():
            label = label.removesuffix("-short").removesuffix("-long")
            # either spelling of the noun
            written = [name.replace("license", "licen[cs]e") for name in names]
            rules += [
                Rule(label, context.replace("{name}", f"({name})"), priority, confidence, (longest_literal(name), around)) for name in written
            ]
    return rules


# Every rule's match holds one of these; a text without them is not looked at further.
KEYWORDS = (
    "licen", "copyright", "permission is hereby", "permission to use copy", "redistribut", "gpl", "gnu ", "apache 2", "mit no attribution", "bsd", " mpl", " cc by ",
    " cc0", " wtfpl", "creative commons", "public domain", "all rights reserved", "neither the name of", "all advertising materials",
    "acknowledgment in the product", " odbl ", "rail m ", "confidential", "required by applicable law", "if a copy of the mpl", "origin of this software",
    "anyone is free to copy", "this product includes software", "without fee", "related or neighboring rights", "subject to the terms", "accompanying materials",
)


def normalised(text: Column) -> Column:
    """Words joined by single spaces, with a space at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(text), NOT_A_WORD, " ")), F.lit(" "))


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _rule_array(rules: list[Rule]) -> str:
    quote = lambda s: "'" + s.replace("\\", "\\\\") + "'"
    return "array(" + ", ".join(
        f"named_struct('rule', {i}, 'name', {quote(r.needs[0])}, 'around', {quote(r.needs[1])}, 'regex', {quote(f'(?<= ){r.regex}(?= )')})"
        for i, r in enumerate(rules)
    ) + ")"


def matches(scan: DataFrame, rules: list[Rule]) -> DataFrame:
    """Staged (row, doc_id, n_words, found): the matches of every rule, as counts of words between and in them."""
    docs = with_row_id(scan.select("doc_id", text_of().alias("text")), "row").select("row", "doc_id", normalised(F.col("text")).alias("words"))
    words = F.col("words")
    count = F.when(F.length(words) > 2, _spaces(words) - 1).otherwise(F.lit(0)).cast("long")
    gate = reduce(lambda a, b: a | b, [words.contains(k) for k in KEYWORDS])
    tried = F.filter(F.expr(_rule_array(rules)), lambda r: words.contains(r["name"]) & words.contains(r["around"]))

    def hits(r: Column) -> Column:
        inside = F.transform(F.regexp_extract_all(words, r["regex"], F.lit(0)), lambda h: _spaces(h) + 1)
        before = F.transform(F.split(words, r["regex"], -1), _spaces)
        both = F.transform(
            F.arrays_zip(inside.alias("a"), before.alias("b")),
            lambda z, i: F.struct(r["rule"].alias("rule"), i.alias("i"), z["a"].alias("words"), z["b"].alias("before")),
        )
        return F.filter(both, lambda z: z["words"].isNotNull())

    none = F.array().cast("array<struct<rule:int,i:int,words:int,before:int>>")
    found = F.when(gate, F.flatten(F.transform(tried, hits))).otherwise(none)
    return stage(docs.select("row", "doc_id", count.alias("n_words"), found.alias("found")))


def intervals(found: DataFrame, rules: list[Rule]) -> DataFrame:
    """row, rule columns, start, end and whether the match is suppressed."""
    spark = found.sparkSession
    # the rule table is as long as the list above
    table = F.broadcast(spark.createDataFrame(
        [(i, r.label, r.priority, r.confidence, r.base) for i, r in enumerate(rules)],
        "rule int, label string, priority int, confidence double, base boolean",
    ))
    rows = found.select("row", F.explode("found").alias("f")).select("row", "f.*")
    upto = Window.partitionBy("row", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    # a gap holds the space on both of its sides, a match the spaces between its words
    start = F.sum("before").over(upto) + F.sum(F.col("words") - 1).over(upto) - (F.col("words") - 1) - 1
    rows = rows.withColumn("start", start.cast("long")).withColumn("end", F.col("start") + F.col("words")).join(table, "rule")
    earlier = Window.partitionBy("row").orderBy("start", F.col("end").desc(), F.col("priority").desc(), "rule").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({r.priority for r in rules})
    reach = F.lit(None).cast("long")
    for p in levels:
        reach = F.when(F.col("priority") == p, F.max(F.when(F.col("priority") >= p, F.col("end"))).over(earlier)).otherwise(reach)
    return rows.withColumn("suppressed", F.coalesce(reach >= F.col("end"), F.lit(False)))


def document_licenses(documents: DataFrame) -> DataFrame:
    """One row per document: base places, labels and the best confidence."""
    rules = signature_rules()
    docs = matches(documents, rules)
    base = F.col("base")
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    stands = base | ~F.col("suppressed")
    found = intervals(docs, rules).groupBy("row").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"), labels(base).alias("base_labels"), labels(stands).alias("labels"),
        F.max(F.when(stands, F.col("confidence"))).alias("score"),
    )
    return docs.select("row", "doc_id", "n_words").join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
