"""The context tree in small blocks and on a long text: counts go out in parts and meet again, and nothing changes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from ohmwatch.llm import context_tree as ct


def test_packed_numbers_come_back():
    grams = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 5_000))
    assert (ct.unpack_grams(ct.pack_grams(grams), len(grams)) == grams).all()
    logs = np.linspace(-9, 0, 77, dtype=np.float32)
    assert (ct.unpack(ct.pack(logs), 77, np.float32) == logs).all()


def test_chunks_keep_contexts_whole(monkeypatch):
    monkeypatch.setattr(ct, "CHUNK", 10)
    grams = np.unique(np.random.default_rng(2).integers(0, 40, 300) << 16 | np.random.default_rng(3).integers(0, 1 << 16, 300))
    parts = [grams[p] for p in ct.chunks(grams)]
    assert (np.concatenate(parts) == grams).all() and len(parts) > 5
    contexts = [set((p >> 16).tolist()) for p in parts]
    assert sum(map(len, contexts)) == len(set.union(*contexts))


def test_a_bin_holds_a_context_whole():
    grams = np.arange(1 << 16) | 7 << 16
    assert len(np.unique(ct.bin_of(grams, 97))) == 1 and len(np.unique(ct.bin_of(np.arange(1000) << 16, 97))) == 97


def test_partial_counts_add_up(monkeypatch):
    monkeypatch.setattr(ct, "FULL", 300)
    monkeypatch.setattr(ct, "SLICE", 512)
    draw = np.random.default_rng(4)
    texts = ["".join(draw.choice(list("abcdef é"), 3_000)), "", "a b a", "b " * 400]
    held = [False, False, True, False]
    batch = pa.RecordBatch.from_pydict({"text": texts, "held_out": held})
    out = list(ct.block_counter(5)((pa.scalar(3),), iter([batch])))
    assert len(out) > 4
    total, words = ct.Counts(), {}
    for rows in out:
        for i in range(len(rows)):
            if rows["grams"][i].is_valid:
                total.add(*ct._read(rows, i, "ns"))
            else:
                words[rows["word"][i].as_py()] = words.get(rows["word"][i].as_py(), 0) + rows["n"][i].as_py()
    total.merge()
    expected = ct.Counts()
    for text, out_of in zip(texts, held):
        for code in ct.codes(text):
            expected.add(code, np.full(len(code), 0 if out_of else 1))
    expected.merge()
    assert (total.grams == expected.grams).all() and (total.ns == expected.ns).all()
    assert words[b"b"] == 400 + texts[0].encode().split().count(b"b") and words[b"a"] == texts[0].encode().split().count(b"a")


def test_blocks_do_not_change_scores(spark, monkeypatch):
    monkeypatch.setattr(ct, "FAN", 4)
    monkeypatch.setattr(ct, "LOOK", 3)
    draw = np.random.default_rng(5)
    texts = [" ".join(draw.choice(["ta", "romi", "sel", "une", "é"], 60)) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (60, None), (None, "")], "doc_id long, text string")
    docs = docs.selectExpr("*", "'x' AS block", "1 AS gram", "2 AS word", "true AS held_out")
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    one = sorted(ct.scores(docs).collect(), key=key)
    many = sorted(ct.scores(docs, block_bytes=500).collect(), key=key)
    assert len(one) == len(many) == 63
    for a, b in zip(one, many):
        assert (a.doc_id, a.held_out, a.n_tokens, a.n_known, a.train_tokens) == (b.doc_id, b.held_out, b.n_tokens, b.n_known, b.train_tokens)
        assert a.score == pytest.approx(b.score) and a.base_score == pytest.approx(b.base_score)


def test_one_text_of_20_mb(spark):
    words = [f"w{i % 4999}" for i in range(3_500_000)]
    long = " ".join(words)
    docs = spark.createDataFrame([(0, long), (4, "w1 w2"), (2, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in ct.scores(docs).collect()}
    assert len(long) > 20_000_000 and rows[0].n_tokens == len(words) + 1 and rows[0].score < 0 and rows[2].n_tokens == 1
    assert not rows[0].held_out and rows[0].bits_per_byte < 2.5
