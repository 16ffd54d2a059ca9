"""Licence scan by sentence rules: known sentences become identifiers, rules match ordered runs of identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ohmwatch.llm.common import table

# Sentences of common licences and notices, with their identifiers.
SENTENCES = {
    1: "Released under the MIT License",
    2: "Licensed under the MIT License",
    3: "The MIT License MIT",
    4: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    5: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    10: "Licensed under the Apache License, Version 2.0",
    11: "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    12: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    20: "This work is licensed under the GNU General Public License, version 3",
    21: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    22: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    23: "You should have received a copy of the GNU General Public License along with this program",
    30: "Licensed under CC BY-NC 4.0",
    31: "Licensed under CC BY 4.0",
    32: "Licensed under CC BY-SA 4.0",
    33: "This work is licensed under a Creative Commons Attribution 4.0 International License",
    34: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    40: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    41: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    42: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    43: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    50: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    60: "This is free and unencumbered software released into the public domain",
    61: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    62: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    63: "Distributed under the Boost Software License, Version 1.0",
    64: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    65: "The origin of this software must not be misrepresented; you must not claim that you wrote the original software",
    66: "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    67: "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    68: "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    69: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    70: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    71: "You should have received a copy of the GNU Lesser General Public License along with this library",
    72: "You should have received a copy of the GNU Affero General Public License along with this program",
    73: "This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself",
    74: "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed",
    75: "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
    76: "The contents of this file are subject to the terms of the Common Development and Distribution License",
    77: "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License",
    78: "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    79: "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    80: "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    81: "Licensed under CC BY-NC-SA 4.0",
    82: "Licensed under CC BY-ND 4.0",
    83: "Licensed under CC BY-NC-ND 4.0",
    84: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    85: "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    86: "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    87: "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    88: "Licensed under the EUPL, Version 1.2",
    89: "This license governs use of the accompanying software",
    90: "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
}
# Rules in the order in which they are tried: longer runs come before the runs that they contain.
RULES = (
    ("MIT", (3, 4, 5)), ("MIT", (4, 5)), ("BSD-4-Clause", (40, 41, 42, 80, 43)), ("BSD-3-Clause", (40, 41, 42, 43)), ("BSD-2-Clause", (40, 41, 42)),
    ("Apache-2.0", (11, 12, 90)), ("Apache-2.0", (11, 12)), ("GPL-3.0-or-later", (21, 23)), ("GPL-2.0-or-later", (22, 23)),
    ("LGPL-2.1-or-later", (68, 71)), ("LGPL-3.0-or-later", (69, 71)), ("AGPL-3.0-or-later", (70, 72)), ("Zlib", (64, 65)),
    ("MIT", (1,)), ("MIT", (2,)), ("MIT", (3,)), ("Apache-2.0", (10,)), ("Apache-2.0", (11,)),
    ("GPL-3.0-only", (20,)), ("GPL-3.0-or-later", (21,)), ("GPL-2.0-or-later", (22,)),
    ("CC-BY-NC-4.0", (30,)), ("CC-BY-4.0", (31,)), ("CC-BY-SA-4.0", (32,)), ("CC-BY-4.0", (33,)), ("CC-BY-SA-4.0", (34,)),
    ("MPL-2.0", (50,)), ("Unlicense", (60,)),
    ("ISC", (61,)), ("0BSD", (62,)), ("BSL-1.0", (63,)), ("Zlib", (64,)), ("EPL-2.0", (66,)), ("EPL-1.0", (67,)),
    ("LGPL-2.1-or-later", (68,)), ("LGPL-3.0-or-later", (69,)), ("AGPL-3.0-or-later", (70,)), ("Artistic-1.0-Perl", (73,)), ("WTFPL", (74,)),
    ("CC0-1.0", (75,)), ("CDDL-1.0", (76,)), ("MPL-1.1", (77,)), ("OFL-1.1", (78,)), ("PostgreSQL", (79,)),
    ("CC-BY-NC-SA-4.0", (81,)), ("CC-BY-ND-4.0", (82,)), ("CC-BY-NC-ND-4.0", (83,)), ("CC-BY-NC-4.0", (84,)),
    ("CC-BY-NC-SA-4.0", (85,)), ("CC-BY-ND-4.0", (86,)), ("CC-BY-NC-ND-4.0", (87,)), ("EUPL-1.2", (88,)), ("MS-PL", (89,)),
)
# Every licence that a rule names also has its one-line tag, numbered from 100 in order of the names.
TAGS = {100 + i: name for i, name in enumerate(sorted({name for name, _ in RULES}))}
SENTENCES = SENTENCES | {i: f"SPDX-License-Identifier: {name}" for i, name in TAGS.items()}
RULES = RULES + tuple((name, (i,)) for i, name in TAGS.items())

#: A text is cut at line breaks, and at a full stop, exclamation or question mark before white space.  The pieces of
#: a sentence that was wrapped or has a full stop inside stand side by side and are matched together.
_STOP, _NOT_PLAIN = r"[.!?][\x20\x09-\x0D]", r"[^A-Za-z0-9\n]+"
#: Lines may begin with comment prefixes made of letters; other prefixes are not words.  The runs are possessive, so
#: matching them takes no stack, and start only where the line before is no bare prefix, so each is read once.
_MARKED = r"(?:\n(?:dnl|rem)(?=[ \n]))"
_GAP = rf"(?:{_MARKED}*+[ \n])"


def _plain(sentence: str) -> str:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in sentence).lower()


def plain(sentence: str) -> str:
    return " ".join(_plain(sentence).split())


def _pattern(known: list[str]) -> str:
    """The known sentences in whole pieces; each word may begin a new piece.

    Sentences with the same first words share one branch, so a line is left at the first words that no sentence has.
    Where one sentence begins another, the longer one is tried first.
    """

    def branch(rest: list[list[str]]) -> str:
        """The ways to go on after shared words; an empty rest, the end of a sentence, is tried last."""
        by_first: dict[str, list[list[str]]] = {}
        for words in sorted(w for w in rest if w):
            by_first.setdefault(words[0], []).append(words[1:])
        ways = []
        for first, more in by_first.items():
            while len(more) == 1 and more[0] or len({m[0] if m else None for m in more}) == 1 and more[0]:
                first, more = first + _GAP + more[0][0], [m[1:] for m in more]
            ways.append(first + (f"{branch([m and [_GAP + m[0], *m[1:]] for m in more])}" if any(more) else "(?=\\n)"))
        if any(not w for w in rest):
            ways.append("(?=\\n)")
        return "(?:" + "|".join(ways) + ")"

    return rf"(?:(?<!\n(?:dnl|rem)){_MARKED}++[ \n]|\n)" + branch([k.split() for k in known])


def _run(ids: tuple[int, ...]) -> str:
    return "".join(f"<{i}>" for i in ids)


def licences(docs: DataFrame, sentences: dict[int, str] = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """doc_id, sentence_ids, licences, n_known, n_other: documents with a known sentence or another mention of a licence.

    Pieces are normalised to lower-case ASCII words, so comment prefixes go.  A known sentence, from a fixed small
    list, is found where whole pieces in a row make it up, so it may be wrapped anywhere; the longest one counts.  A
    document's known sentences in order form a run like <1><5>.  Rules are tried in order; each takes its
    identifiers out wherever they stand side by side, and names a licence.  sentence_ids is the whole run, licences
    the names in rule order, joined by commas, empty if no rule fits.  n_other counts the remaining pieces with
    the word license or licence.  Rows that repeat an id and a text count once; null and empty texts and empty tables
    give no row.  Long runs of blanks, dots or comment prefixes take time in proportion and no stack.
    """
    ids = {plain(s): i for i, s in sentences.items()}
    pattern = F.lit(_pattern(list(ids)))
    # One piece to a line, its words parted by single blanks, with a line break before and after each.
    # Punctuation goes anyway, so a full stop and one blank are enough to cut, which is linear in the text.
    lines = F.regexp_replace(F.regexp_replace("text", _STOP, "\n"), _NOT_PLAIN, " ")
    lines = F.regexp_replace(F.concat(F.lit("\n"), F.lower(lines), F.lit("\n")), r" ?\n[ \n]*", "\n")
    identifier = F.create_map(*[x for known, i in ids.items() for x in (F.lit(known), F.lit(i))])
    sentence = lambda m: F.trim(F.regexp_replace(m, _GAP, " "))

    def scan(lines: Column) -> Column:
        seen = F.transform(F.regexp_extract_all(lines, pattern, F.lit(0)), lambda m: identifier[sentence(m)])
        other = F.regexp_count(F.regexp_replace(lines, pattern, F.lit("\n")), F.lit(r"\n(?:[^\n]* )?licen[sc]es?(?= |\n)[^\n]*"))
        return F.struct(seen.alias("seen"), other.cast("long").alias("n_other"))

    # As elements of arrays, so that a text is normalised and scanned once for all columns and the filter.
    found = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.inline(F.transform(F.array(lines), scan)))
    found = found.filter((F.size("seen") > 0) | (F.col("n_other") > 0)).dropDuplicates(["doc_id", "mark"])
    found = found.select(
        "doc_id", F.size("seen").cast("long").alias("n_known"), "n_other",
        F.array_join(F.transform("seen", lambda i: F.concat(F.lit("<"), i.cast("string"), F.lit(">"))), "").alias("sentence_ids"),
    )
    steps = F.array(*[F.struct(F.lit(_run(ids)).alias("run"), F.lit(name).alias("name")) for name, ids in rules])
    start = F.struct(F.col("sentence_ids").alias("left"), F.array().cast("array<string>").alias("names"))

    def step(state, rule):
        fits = F.contains(state["left"], rule["run"])
        return F.struct(
            F.replace(state["left"], rule["run"], F.lit("|")).alias("left"),
            F.when(fits & ~F.array_contains(state["names"], rule["name"]), F.concat(state["names"], F.array(rule["name"]))).otherwise(state["names"]).alias("names"),
        )

    return found.select("doc_id", "sentence_ids", F.array_join(F.aggregate(steps, start, step)["names"], ",").alias("licences"), "n_known", "n_other")


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))


def sql() -> str:
    """The same in DuckDB: runs of pieces grow while they begin a known sentence; one step per rule."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({i}, {quote(plain(s))})" for i, s in SENTENCES.items())
    steps, last = [], "s0"
    for n, (name, ids) in enumerate(RULES, 1):
        run = quote(_run(ids))
        steps.append(
            f"s{n} AS (SELECT k, replace(rest, {run}, '|') AS rest, CASE WHEN contains(rest, {run}) AND NOT list_contains(names, {quote(name)}) "
            f"THEN list_append(names, {quote(name)}) ELSE names END AS names FROM {last})"
        )
        last = f"s{n}"
    return rf"""
WITH RECURSIVE d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
n AS (SELECT row_number() OVER () AS k, doc_id,
  string_split(lower(regexp_replace(regexp_replace(text, '{_STOP}', chr(10), 'g'), '{_NOT_PLAIN}', ' ', 'g')), chr(10)) AS parts FROM d),
e AS (SELECT k, doc_id, unnest(range(len(parts))) AS spot, unnest(parts) AS piece FROM n),
t AS (SELECT k, doc_id, spot, regexp_replace(trim(piece), '^(dnl|rem)( |$)', '') AS piece FROM e),
p AS (SELECT k, doc_id, row_number() OVER (PARTITION BY k ORDER BY spot) AS place, piece FROM t WHERE piece <> ''),
known(id, known) AS (VALUES {known}),
w AS (SELECT string_split(known, ' ') AS words FROM known),
u AS (SELECT words, unnest(range(1, len(words) + 1)) AS n FROM w),
begins AS (SELECT DISTINCT array_to_string(words[:n], ' ') AS beginning FROM u),
reach AS (SELECT k, place AS first, place AS last, piece AS run FROM p JOIN begins ON piece = beginning
  UNION ALL SELECT r.k, r.first, p.place, r.run || ' ' || p.piece FROM reach r JOIN p ON p.k = r.k AND p.place = r.last + 1 JOIN begins ON r.run || ' ' || p.piece = beginning),
longest AS (SELECT k, first, max(last) AS last, arg_max(id, last) AS id FROM reach JOIN known ON run = known GROUP BY k, first),
follow AS (SELECT a.k, a.first, a.last, a.id, min(b.first) AS next FROM longest a LEFT JOIN longest b ON a.k = b.k AND b.first > a.last GROUP BY ALL),
taken AS (SELECT f.* FROM follow f JOIN (SELECT k, min(first) AS first FROM follow GROUP BY k) USING (k, first)
  UNION ALL SELECT f.* FROM taken t JOIN follow f ON f.k = t.k AND f.first = t.next),
inside AS (SELECT k, unnest(range(first, last + 1)) AS place FROM taken),
other AS (SELECT k, count(*) AS n_other FROM p ANTI JOIN inside USING (k, place) WHERE regexp_matches(' ' || piece || ' ', ' licen[sc]es? ') GROUP BY k),
runs AS (SELECT k, string_agg('<' || id || '>', '' ORDER BY first) AS ids, count(*) AS n_known FROM taken GROUP BY k),
g AS (SELECT k, doc_id, coalesce(ids, '') AS ids, coalesce(n_known, 0) AS n_known, coalesce(n_other, 0) AS n_other
  FROM (SELECT k, doc_id FROM n) LEFT JOIN runs USING (k) LEFT JOIN other USING (k) WHERE n_known > 0 OR n_other > 0),
s0 AS (SELECT k, ids AS rest, []::VARCHAR[] AS names FROM g),
{", ".join(steps)}
SELECT doc_id, ids AS sentence_ids, coalesce(array_to_string(names, ','), '') AS licences, n_known, n_other FROM g JOIN {last} USING (k)
"""


OP6_SQL = sql()
