"""Licence scans by sentences: known licence sentences become identifiers, and rules match their order.

A text is cut after ``. ! ? ; :`` before white space and at blank lines, lines with nothing but comment signs included; words are normalised to
lower-case ASCII.  A sentence begins and ends at a line or a cut and may run over any number of lines, so wrapped licence texts and comment
headers are recognised as well as notices of one line.  ``SENTENCES`` (notices) and ``FULL_SENTENCES`` (the sentences of licence texts)
give the identifier of each known one.  A line whose first three words begin a known sentence (looked up in a hash set) opens runs of one, two, ... lines; each run
is looked up among the known sentences, so a longer table costs no more a line.  Of known ones that begin together the longest counts.  The recognised identifiers of a document, in
order, are matched against ``RULES`` and ``FULL_RULES`` from the first to the last; a rule takes what it matches, so that a longer rule hides
the shorter ones in it.

Defined cases: null and empty texts have no sentence; each row is scanned by itself, so rows with the same id keep their own results; documents
with no known sentence have an empty list.  The colon of an SPDX tag is no cut.  The SQL form covers ``SENTENCES`` on one line each, as the given tables have them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmark.llm.common import let

# Well-known sentences of public licences, normalised, and their identifiers.
SENTENCES = {
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this project is licensed under the mit license": "mit-notice",
    "spdx license identifier mit": "mit-tag",
    "the mit license mit": "mit-title",
    "mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-keep",
    "licensed under the apache license version 2 0": "apache-notice",
    "licensed under the apache license version 2 0 the license": "apache-notice",
    "spdx license identifier apache 2 0": "apache-tag",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache-as-is",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "licensed under the gnu general public license version 3": "gpl3-notice",
    "spdx license identifier gpl 3 0 only": "gpl3-tag",
    "spdx license identifier gpl 3 0 or later": "gpl3-tag",
    "this program is free software": "gnu-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gnu-terms",
    "either version 3 of the license or at your option any later version": "gnu-v3-later",
    "either version 2 of the license or at your option any later version": "gnu-v2-later",
    "licensed under cc by nc 4 0": "cc-by-nc-notice",
    "licensed under cc by 4 0": "cc-by-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-notice",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd-names",
    "spdx license identifier bsd 3 clause": "bsd3-tag",
    "all rights reserved": "reserved",
    "spdx license identifier gpl 2 0 only": "gpl2-tag",
    "spdx license identifier gpl 2 0 or later": "gpl2-later-tag",
    "licensed under the gnu general public license version 2": "gpl2-notice",
    "spdx license identifier lgpl 2 1 only": "lgpl21-tag",
    "spdx license identifier lgpl 2 1 or later": "lgpl21-later-tag",
    "spdx license identifier lgpl 3 0 only": "lgpl3-tag",
    "spdx license identifier lgpl 3 0 or later": "lgpl3-later-tag",
    "licensed under the gnu lesser general public license version 2 1": "lgpl21-notice",
    "licensed under the gnu lesser general public license version 3": "lgpl3-notice",
    "spdx license identifier agpl 3 0 only": "agpl3-tag",
    "spdx license identifier agpl 3 0 or later": "agpl3-later-tag",
    "licensed under the gnu affero general public license version 3": "agpl3-notice",
    "spdx license identifier mpl 2 0": "mpl2-tag",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-notice",
    "spdx license identifier epl 2 0": "epl2-tag",
    "spdx license identifier isc": "isc-tag",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "spdx license identifier bsd 2 clause": "bsd2-tag",
    "spdx license identifier unlicense": "unlicense-tag",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "spdx license identifier cc0 1 0": "cc0-tag",
    "spdx license identifier cc by 4 0": "cc-by-tag",
    "spdx license identifier cc by sa 4 0": "cc-by-sa-tag",
    "spdx license identifier cc by nc 4 0": "cc-by-nc-tag",
    "spdx license identifier zlib": "zlib-tag",
    "spdx license identifier bsl 1 0": "boost-tag",
    "distributed under the boost software license version 1 0": "boost-notice",
}
# Whole sentences of licence texts, of which some entries above are only the beginning.  ``*`` stands for the name of a holder, up to 12 words.
FULL_SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-keep",
    "the asf licenses this file to you under the apache license version 2 0 the license": "apache-notice",
    "apache license version 2 0 january 2004": "apache-title",
    "apache license version 2 0 january 2004 http www apache org licenses": "apache-title",
    "apache license version 2 0 january 2004 https www apache org licenses": "apache-title",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-copy",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-as-is",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gnu-terms-v3-later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gnu-terms-v2-later",
    "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "neither the name of * nor the names of other contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
}
# The rules in order, as (licence, kind, identifiers that follow one another).
RULES = [
    ("GPL-3.0-or-later", "copyleft", ("gnu-free", "gnu-terms", "gnu-v3-later")),
    ("GPL-2.0-or-later", "copyleft", ("gnu-free", "gnu-terms", "gnu-v2-later")),
    ("Apache-2.0", "permissive", ("apache-notice", "apache-comply", "apache-copy", "apache-as-is")),
    ("MIT", "permissive", ("mit-title", "mit-grant", "mit-keep")),
    ("MIT", "permissive", ("mit-grant", "mit-keep")),
    ("BSD-3-Clause", "permissive", ("bsd-grant", "bsd-names")),
    ("Apache-2.0", "permissive", ("apache-notice",)),
    ("Apache-2.0", "permissive", ("apache-tag",)),
    ("MIT", "permissive", ("mit-notice",)),
    ("MIT", "permissive", ("mit-tag",)),
    ("GPL-3.0-only", "copyleft", ("gpl3-notice",)),
    ("GPL-3.0-only", "copyleft", ("gpl3-tag",)),
    ("CC-BY-NC-4.0", "noncommercial", ("cc-by-nc-notice",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc-by-sa-notice",)),
    ("CC-BY-4.0", "permissive", ("cc-by-notice",)),
    ("BSD-2-Clause", "permissive", ("bsd-grant",)),
    ("BSD-3-Clause", "permissive", ("bsd3-tag",)),
    ("GPL-2.0-only", "copyleft", ("gpl2-tag",)),
    ("GPL-2.0-only", "copyleft", ("gpl2-notice",)),
    ("GPL-2.0-or-later", "copyleft", ("gpl2-later-tag",)),
    ("LGPL-2.1-only", "copyleft", ("lgpl21-tag",)),
    ("LGPL-2.1-only", "copyleft", ("lgpl21-notice",)),
    ("LGPL-2.1-or-later", "copyleft", ("lgpl21-later-tag",)),
    ("LGPL-3.0-only", "copyleft", ("lgpl3-tag",)),
    ("LGPL-3.0-only", "copyleft", ("lgpl3-notice",)),
    ("LGPL-3.0-or-later", "copyleft", ("lgpl3-later-tag",)),
    ("AGPL-3.0-only", "copyleft", ("agpl3-tag",)),
    ("AGPL-3.0-only", "copyleft", ("agpl3-notice",)),
    ("AGPL-3.0-or-later", "copyleft", ("agpl3-later-tag",)),
    ("MPL-2.0", "copyleft", ("mpl2-tag",)),
    ("MPL-2.0", "copyleft", ("mpl2-notice",)),
    ("EPL-2.0", "copyleft", ("epl2-tag",)),
    ("ISC", "permissive", ("isc-tag",)),
    ("ISC", "permissive", ("isc-grant",)),
    ("BSD-2-Clause", "permissive", ("bsd2-tag",)),
    ("Unlicense", "permissive", ("unlicense-tag",)),
    ("Unlicense", "permissive", ("unlicense-grant",)),
    ("CC0-1.0", "permissive", ("cc0-tag",)),
    ("CC-BY-4.0", "permissive", ("cc-by-tag",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc-by-sa-tag",)),
    ("CC-BY-NC-4.0", "noncommercial", ("cc-by-nc-tag",)),
    ("Zlib", "permissive", ("zlib-tag",)),
    ("BSL-1.0", "permissive", ("boost-tag",)),
    ("BSL-1.0", "permissive", ("boost-notice",)),
]
# Further rules, for identifiers of whole texts; they follow those above.
FULL_RULES = [
    ("GPL-3.0-or-later", "copyleft", ("gnu-free", "gnu-terms-v3-later")),
    ("GPL-2.0-or-later", "copyleft", ("gnu-free", "gnu-terms-v2-later")),
    ("GPL-3.0-or-later", "copyleft", ("gnu-terms-v3-later",)),
    ("GPL-2.0-or-later", "copyleft", ("gnu-terms-v2-later",)),
    ("GPL-3.0-or-later", "copyleft", ("gnu-terms", "gnu-v3-later")),
    ("GPL-2.0-or-later", "copyleft", ("gnu-terms", "gnu-v2-later")),
    ("Apache-2.0", "permissive", ("apache-title",)),
]
KINDS = ("noncommercial", "copyleft", "permissive")


KNOWN = {**SENTENCES, **FULL_SENTENCES}
#: How many words tell whether a line may begin a known sentence.
START_WORDS = 3
STARTS = sorted({" ".join(s.split()[:k]) for s in KNOWN for k in range(1, START_WORDS + 1)})
HOLDER_WORDS = 12
#: No known sentence runs over more lines: each has a word at least, and each word of a holder's name may be followed by a cut.
MOST_LINES = max(len(s.split()) for s in KNOWN) + 2 * HOLDER_WORDS


def normalised(text: Column) -> Column:
    """The lines of a text as lower-case ASCII words, with an empty line for each cut."""
    cut = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<!(?i:spdx-license-identifier))([.!?;:])[ \t\r\n]+", "$1\n\n")
    return F.regexp_replace(F.regexp_replace(F.lower(cut), r"[^a-z0-9\n]+", " "), r" ?\n ?", "\n")


def _runs(lines: Column, i: Column) -> Column:
    """The runs of lines from line ``i``, each as (end, sentence); one over an empty line has two spaces and equals no known sentence, but for the name of a holder (``Inc.`` is a cut)."""
    holder = rf"^(neither the name of)(?: +[a-z0-9]+){{1,{HOLDER_WORDS}}} +(nor the names of)"

    def run(n: Column) -> Column:
        return F.struct((i + n).alias("end"), F.regexp_replace(F.array_join(F.slice(lines, i + 1, n), " "), holder, "$1 * $2").alias("sentence"))

    return F.transform(F.sequence(F.lit(1), F.least(F.lit(MOST_LINES), F.size(lines) - i)), run)


def recognised(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])

    def longest(lines: Column, i: Column) -> Column:
        run = F.try_element_at(F.filter(_runs(lines, i), lambda r: r["sentence"].isin(list(KNOWN))), F.lit(-1))
        return F.when(run.isNotNull(), F.struct(i.alias("start"), run["end"].alias("end"), run["sentence"].alias("sentence")))

    def found(lines: Column) -> Column:
        starts = F.array_compact(F.transform(lines, lambda line, i: F.when(F.substring_index(line, " ", START_WORDS).isin(STARTS), i)))
        return F.array_compact(F.transform(starts, lambda i: longest(lines, i)))

    def taken(state: Column, run: Column) -> Column:
        """Runs that begin inside one already taken go."""
        longer = F.struct(run["end"].alias("free"), F.concat(state["sids"], F.array(F.element_at(known, run["sentence"]))).alias("sids"))
        return F.when(run["start"] >= state["free"], longer).otherwise(state)

    lines = F.split(F.btrim(normalised(text), F.lit(" ")), "\n")
    none = F.struct(F.lit(0).alias("free"), F.array().cast("array<string>").alias("sids"))
    return F.aggregate(let(lines, found), none, taken, lambda state: state["sids"])


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, n_known, licences, kind, sentences) for each row of ``docs``.

    ``licences``: the names found, sorted, each once.  ``kind``: the strictest of them, ``none`` without any.
    ``sentences``: the identifiers recognised, in order.
    """
    rules = RULES + FULL_RULES
    left, took = F.concat(F.lit(" "), F.array_join("sids", "  "), F.lit(" ")), []
    found = docs.select("doc_id", recognised(F.col("text")).alias("sids")).withColumn("left", left)
    for name, kind, sids in rules:
        part = F.lit(" " + "  ".join(sids) + " ")
        took.append(F.when(F.contains("left", part), F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"))))
        found = found.withColumns({"left": F.replace("left", part, F.lit(" | ")), f"took{len(took)}": took[-1]})
    rows = found.withColumn("took", F.array_compact(F.array(*[F.col(f"took{i + 1}") for i in range(len(rules))])))
    kinds = F.transform("took", lambda t: t["kind"])
    kind = F.lit("none")
    for k in reversed(KINDS):
        kind = F.when(F.array_contains(kinds, k), F.lit(k)).otherwise(kind)
    return rows.select("doc_id", F.size("sids").cast("long").alias("n_known"), F.array_join(F.array_sort(F.array_distinct(F.transform("took", lambda t: t["name"]))), ",").alias("licences"), kind.alias("kind"), F.array_join("sids", ",").alias("sentences"))


def oracle_sql() -> str:
    """The same scan as DuckDB SQL over ``documents``."""
    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    steps, last = [], "seen"
    for n, (_, _, sids) in enumerate(RULES, 1):
        part = " " + "  ".join(sids) + " "
        steps.append(f"r{n} AS (SELECT * EXCLUDE (rest), replace(rest, '{part}', ' | ') AS rest, contains(rest, '{part}') AS took{n} FROM {last})")
        last = f"r{n}"
    names = ", ".join(f"CASE WHEN took{n} THEN '{name}' END" for n, (name, _, _) in enumerate(RULES, 1))
    kind = "CASE " + " ".join("WHEN " + " OR ".join(f"took{n}" for n, r in enumerate(RULES, 1) if r[1] == k) + f" THEN '{k}'" for k in KINDS) + " ELSE 'none' END"
    return f"""
WITH known(sentence, sid) AS (VALUES {known}),
cut AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?;:])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM documents),
rows AS (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS pos FROM cut),
hit AS (SELECT doc_id, pos, sid FROM (SELECT doc_id, pos, trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')) AS sentence FROM rows) JOIN known USING (sentence)),
seen AS (SELECT doc_id, count(*) AS n_known, string_agg(sid, ',' ORDER BY pos) AS sentences, ' ' || string_agg(sid, '  ' ORDER BY pos) || ' ' AS rest FROM hit GROUP BY doc_id),
{", ".join(steps)},
got AS (SELECT doc_id, n_known, sentences, {kind} AS kind, array_to_string(list_sort(list_distinct(list_filter([{names}], lambda x: x IS NOT NULL))), ',') AS licences FROM {last})
SELECT d.doc_id, coalesce(n_known, 0)::BIGINT AS n_known, coalesce(licences, '') AS licences, coalesce(kind, 'none') AS kind, coalesce(sentences, '') AS sentences
FROM documents d LEFT JOIN got g ON d.doc_id = g.doc_id"""
