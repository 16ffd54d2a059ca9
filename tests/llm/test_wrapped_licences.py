"""Licence texts wrapped at narrow columns, as they stand in licence files and source headers."""

from __future__ import annotations

import textwrap
import time

import duckdb
import numpy as np
import pandas as pd
import pytest

from ohmwatch.llm import licences

S = licences.SENTENCES
MIT = f"MIT License\n\nCopyright (c) 2020 A. Person\n\n{{0}}{S[4]}\n\n{{0}}{S[5]}.\n\nTHE SOFTWARE IS PROVIDED AS IS."
BSD = f"Copyright 2020\n\n{S[40]}\n\n1. {S[41]}.\n\n2. {S[42]}.\n\n3. {S[43]}.\n\nTHIS SOFTWARE IS PROVIDED AS IS."
APACHE = "Licensed under the Apache License, Version 2.0\n(the \"License\"); you may not use this file except\nin compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by law"
GPL = f"{S[21]}.\n\n{S[23]}.  If not, see <https://www.gnu.org/licenses/>."
MPL = f"{S[50]}. If a copy of the MPL was not distributed with this file, You can obtain one."


def wrapped(text, width, prefix):
    lines = [line for part in text.split("\n") for line in textwrap.wrap(part, width, break_long_words=False) or [""]]
    return "\n".join(prefix + line for line in lines)


@pytest.mark.parametrize("width, prefix", [(75, ""), (70, " * "), (60, "# "), (60, "// "), (40, "dnl "), (10_000, "")])
def test_wrapped_licence_texts(spark, width, prefix):
    texts = [MIT.replace("{0}", ""), BSD, APACHE, GPL, MPL]
    docs = spark.createDataFrame([(i, wrapped(t, width, prefix)) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: (r.sentence_ids, r.licences) for r in licences.licences(docs).collect()}
    assert rows == {
        0: ("<4><5>", "MIT"), 1: ("<40><41><42><43>", "BSD-3-Clause"), 2: ("<11><12>", "Apache-2.0"), 3: ("<21><23>", "GPL-3.0-or-later"), 4: ("<50>", "MPL-2.0"),
    }


def test_what_stands_beside_a_known_sentence_still_counts(spark):
    texts = ["Foo\nReleased under the MIT License\nmore words", "x Released under the MIT License\nlicence\nlicense and license. no", "Released under the MIT License\nReleased under the\nMIT License", "Released under the MIT License too"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    rows = sorted((r.doc_id, r.sentence_ids, r.n_known, r.n_other) for r in licences.licences(docs).collect())
    assert rows == [(0, "<1>", 1, 0), (1, "", 0, 3), (2, "<1><1>", 2, 0), (3, "", 0, 1)]


@pytest.mark.parametrize("filler", ["\nrem" * 30_000, "\ndnl rem\nrem dnl" * 10_000, " " * 1_000_000, "." * 1_000_000, " .\t" * 300_000, "\n" * 1_000_000, "\n \n." * 250_000])
def test_long_runs_take_no_stack_and_little_time(spark, filler):
    text = f"before{filler}\n{S[1]}{filler}\n{S[10]}.{filler}\nafter"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.perf_counter()
    rows = [(r.sentence_ids, r.licences) for r in licences.licences(docs).collect()]
    assert rows == [("<1><10>", "MIT,Apache-2.0")] and time.perf_counter() - start < 20


def test_query_and_sql_agree_on_wrapped_texts(spark):
    """Whole, wrapped, overlapping and broken sentences: the scan and its SQL find the same runs and licences."""
    draw = np.random.default_rng(9)
    sentences, texts = list(S.values()), [MIT.replace("{0}", ""), BSD, APACHE, GPL, MPL]
    rows = [(wrapped(t, w, p),) for t in texts for w, p in ((75, ""), (40, " * "), (60, "dnl "), (30, "rem "))]
    for _ in range(300):
        parts = []
        for _ in range(int(draw.integers(1, 6))):
            words = sentences[int(draw.integers(len(sentences)))].split(" ")
            if draw.random() < 0.3:  # a beginning or an end only
                words = words[: int(draw.integers(1, len(words) + 1))] if draw.random() < 0.5 else words[int(draw.integers(len(words))) :]
            gaps = draw.choice([" ", "  ", "\n", "\nrem ", "\n * ", "\n\nrem\ndnl "], len(words), p=[0.82, 0.02, 0.07, 0.03, 0.04, 0.02])
            parts.append("".join(w + g for w, g in zip(words, gaps)) + str(draw.choice([".", "", "!", " licence", ". "])))
        rows.append((str(draw.choice(["\n", " ", "\n# "])).join(parts),))
    rows += [(None,), ("",), ("rem license",), ("a\nrem\n" + S[1] + "\nrem",), (rows[0][0],)]
    frame = pd.DataFrame({"doc_id": range(len(rows)), "text": [r[0] for r in rows]})
    columns = ["doc_id", "sentence_ids", "licences", "n_known", "n_other"]
    found = [tuple(r) for r in licences.licences(spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "doc_id long, text string")).select(columns).collect()]
    with duckdb.connect() as db:
        db.register("documents", frame)
        expected = db.sql(licences.OP6_SQL).select(*columns).fetchall()
    assert sorted(found) == sorted(expected) and len(found) > 280 and sum(r[3] > 1 for r in found) > 100


def test_every_known_sentence_and_rule_is_found(spark):
    docs = spark.createDataFrame([(i, f"Some words.\n{wrapped(s, 50, '# ')}.\nMore") for i, s in S.items()], "doc_id long, text string")
    rows = {r.doc_id: r for r in licences.licences(docs).collect()}
    assert all(rows[i].sentence_ids == f"<{i}>" for i in S)
    runs = spark.createDataFrame([(n, "\n\n".join(S[i] for i in ids)) for n, (_, ids) in enumerate(licences.RULES)], "doc_id long, text string")
    names = {r.doc_id: r.licences.split(",") for r in licences.licences(runs).collect()}
    assert all(name in names[n] for n, (name, _) in enumerate(licences.RULES)) and len({name for name, _ in licences.RULES}) >= 30
