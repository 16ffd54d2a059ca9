"""The mix is rebuilt from its blocks and compared with a plain reading of the documents."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from ohmwatch.llm import mixing
from ohmwatch.llm.common import store


def corpus():
    draw = np.random.default_rng(3)
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(int(draw.integers(0, 40)))), "ab"[int(draw.random() < 0.3)]) for i in range(150)]
    rows += [(900, "d900w0\t\td900w1 \n" + " ".join(f"d900w{j}" for j in range(2, 700)), "a"), (901, None, "a"), (902, "", None), (903, "d903w0", None)]
    return rows + [rows[5], rows[5]]  # repeated rows are documents of their own


def test_blocks_make_up_the_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    monkeypatch.setattr(mixing, "SHARD", 16)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    blocks = mixing.mixed_blocks(docs).collect()
    per_doc = mixing.mixed_documents(docs).collect()
    targets = {r.source: r for r in mixing.source_targets(mixing.sizes(docs)).collect()}

    # Every slot holds at most a block, of words in the order of their documents; sources reach their targets.
    words, per_source, shard = defaultdict(list), Counter(), Counter()
    source_of = {i: s for i, _, s in rows}
    for b in blocks:
        text = b.text.split(" ")
        assert 1 <= len(text) <= 8 and {source_of[i] for i in b.doc_ids} == {b.source}
        assert list(dict.fromkeys(int(w[1:].split("w")[0]) for w in text)) == list(dict.fromkeys(b.doc_ids))
        runs = [(int(w[1:].split("w")[0]), int(w.split("w")[1])) for w in text]
        assert all(y[0] != x[0] or y[1] == x[1] + 1 or y[1] == 0 for x, y in zip(runs, runs[1:]))
        for w in text:
            words[int(w[1:].split("w")[0])].append(w)
        per_source[b.source] += len(text)
        shard[b.shard] += 1
    assert {s: per_source[s] for s in targets} == {s: r.words for s, r in targets.items()}
    assert max(shard.values()) <= 16 and len({(b.source, b.slot) for b in blocks}) == len(blocks)

    # No word comes more than twice, and what documents are said to give is what the blocks hold.
    copies = Counter(i for i, _, _ in rows)
    assert all(n <= 2 * copies[i] for i, all_words in words.items() for n in Counter(all_words).values())
    taken = Counter()
    for r in per_doc:
        taken[r.doc_id] += r.taken
    assert len(per_doc) == len(rows) and {i: len(w) for i, w in words.items()} == {i: n for i, n in taken.items() if n}

    # Shards mix the sources by their share of the target, and a rerun on other partitions gives the same mix.
    again = mixing.mixed_blocks(docs.repartition(7)).collect()
    assert sorted(map(str, blocks)) == sorted(map(str, again))


def test_blocks_of_a_table_without_words(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " \n", None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mixed_documents(docs).collect()] == [(0.0, 0)] * 2
    assert mixing.mixed_blocks(docs).count() == 0 and mixing.mixed_blocks(docs.limit(0)).count() == 0


def test_permutations(spark):
    for n in (1, 2, 97, 1000):
        at = spark.range(n).select(F.col("id"), mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(1), F.lit(0)).alias("to"))
        pairs = [(r.id, r.to) for r in store(at, "permuted").collect()]
        assert sorted(t for _, t in pairs) == list(range(n))
        if n == 1000:
            to = np.array([t for _, t in sorted(pairs)])
            steps = Counter(np.diff(to) % n)
            assert max(steps.values()) < 15 and abs(np.corrcoef(np.arange(n), to)[0, 1]) < 0.15
