"""Decontamination looks at every passage that reaches the threshold, and at short items and items without an id."""

from __future__ import annotations

import numpy as np

from ohmwatch.llm import decontaminate


def prose(seed, n):
    return " ".join(f"w{k}" for k in np.random.default_rng(seed).integers(0, 5000, n))


def test_a_lower_scoring_passage_with_the_answer_counts(spark):
    item = f"{prose(1, 40)}. {prose(2, 10)}."
    words = [w.strip(".") for w in item.split()]
    shuffled = [words[i] for i in np.random.default_rng(5).permutation(len(words))]  # all words, in no order
    copy = words[:]
    copy[3], copy[30] = "other", "changed"  # question and answer, two words changed
    text = " ".join([*shuffled, *prose(7, 600).split(), *copy, *prose(8, 300).split()])
    docs = spark.createDataFrame([(1, text), (2, " ".join(shuffled))], "doc_id long, text string")
    items = spark.createDataFrame([(9, item), (10, prose(3, 60)), (11, prose(4, 60))], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()] == [(1, 9)]
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()] == [2]


def test_short_items_and_null_ids(spark):
    docs = [(1, "Ask: what is two and two? Four! Then more"), (2, "what is two and then two four"), (3, prose(20, 80) + " " + prose(21, 40)), (4, None)]
    items = [(5, "What is two and two? Four."), (None, prose(21, 40)), (None, "Then more"), (7, "")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    for some in (items, items[:1] + items[2:]):  # with and without a longer item
        table = spark.createDataFrame(some, "item_id long, text string")
        wanted = {(1, 5), (1, None)} | ({(3, None)} if len(some) == 4 else set())
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, table).collect()} == wanted
        assert {r.doc_id for r in decontaminate.drop_contaminated(docs, table).collect()} == {1, 2, 3, 4} - {d for d, _ in wanted}
