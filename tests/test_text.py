from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ohmwatch.functions import text as x
from ohmwatch.operators import retrieval as r
from ohmwatch.session import scratch_path, store
from ohmwatch.sources.documents import read_text_folder

TEXTS = {
    1: "",
    2: " \n\t ",
    3: "Denial of service floods the relay. " * 20,
    4: "é" * 700,
    5: "ab " * 267,
    6: "The relay trips; the breaker OPENS. Über_2 relay a b cc",
    7: "replay of the relay messages 42 times",
    8: "".join(f"wörd{i % 50} 😀\n" for i in range(9000)),
}


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, f"f{i}.txt", t) for i, t in TEXTS.items()]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def windows(text: str, size: int, overlap: int) -> list[str]:
    step = size - overlap
    starts = range(0, len(text), step) if step > 0 else ([0] if text else [])
    return [w for w in (text[s : s + size].strip() for s in starts) if w]


@pytest.mark.parametrize("size,overlap", [(800, 100), (50, 0), (30, 29), (20, 20), (10, 40)])
def test_chunks_equal_python_slices(documents, size, overlap):
    got = {}
    for row in x.chunk(documents, size=size, overlap=overlap).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(row["doc_id"], []).append(row["text"])
    assert got == {i: w for i, t in TEXTS.items() if (w := windows(t, size, overlap))}


def words(text: str) -> list[str]:
    return re.findall(r"\w{2,}", text.lower())


def test_term_counts_equal_python(documents):
    for row in documents.select("doc_id", x.term_counts(F.col("text")).alias("t")).collect():
        assert {t["term"]: t["tf"] for t in row["t"]} == Counter(words(TEXTS[row["doc_id"]]))


def brute_search(texts: dict, query: str, k: int) -> list[tuple]:
    n = len(texts)
    df = Counter(w for t in texts.values() for w in set(words(t)))
    idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in df.items()}

    def unit(t):
        v = {w: c * idf[w] for w, c in Counter(words(t)).items() if w in idf}
        norm = math.sqrt(sum(a * a for a in v.values())) or 1.0
        return {w: a / norm for w, a in v.items()}

    q = unit(query)
    scores = [(round(sum(a * unit(t).get(w, 0.0) for w, a in q.items()), 9), key) for key, t in texts.items()]
    return [(key, s) for s, key in sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1]))][:k]


def test_search_equals_brute_force(spark, documents):
    index = r.index_documents(documents)
    chunked = {(c["doc_id"], c["chunk_no"]): c["text"] for c in index.chunks.collect()}
    asked = {1: "relay replay", 2: "the the breaker", 3: "nothing known", 4: "denial of service relay"}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    for pad in (False, True):
        rows = r.search(index, queries, 3, pad).orderBy("query_id", "rank").collect()
        for i, text in asked.items():
            got = [((h["doc_id"], h["chunk_no"]), h["score"]) for h in rows if h["query_id"] == i]
            expected = brute_search(chunked, text, 3)
            if pad:
                expected += [(key, 0.0) for key in sorted(chunked) if key not in dict(expected)][: 3 - len(expected)]
            assert [key for key, _ in got] == [key for key, _ in expected]
            assert [s for _, s in got] == pytest.approx([s for _, s in expected], abs=2e-9)
    lines = r.retrieve(index, queries, 1).collect()
    assert all(h["reference"].startswith(f"[{h['source']}] ") and len(h["reference"]) <= 309 for h in lines)
    with pytest.raises(RuntimeError):
        r.search(None, queries)


def test_blocks_and_shards_find_the_same(spark, documents):
    index = r.index_documents(documents)
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(["relay", "breaker", "times", "service"])], "query_id long, text string")
    whole = r.search(index, queries).collect()
    for direct in (0, 100):
        assert sorted(r.search(index, queries, query_block=1, shard_rows=2, direct=direct).collect()) == sorted(whole)
    assert r.search(index, queries.limit(0), query_block=1, shard_rows=2, direct=0).count() == 0
    assert r.search(index, queries.limit(0)).count() == 0


def test_bounds_spare_meetings_and_lose_nothing(spark):
    """Texts about one subject each: the fewer chunks are asked for, the fewer shards meet a block."""
    draw = np.random.default_rng(5)
    subject = [[f"s{s}w{i}" for i in range(2)] for s in range(40)]
    texts = [" ".join([*draw.choice(subject[i % 40], 9), *draw.choice(["common", "usual", "plain"], 3)]) for i in range(1600)]
    docs = spark.createDataFrame([(i, "x", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    index = r.index_documents(docs)
    queries = spark.createDataFrame([(i, " ".join([*draw.choice(subject[i % 40], 4), "common"])) for i in range(80)], "query_id long, text string")
    met = {}
    for k in (1, 4, 200):
        plain = r.search(index, queries, k, query_block=8, shard_rows=64, direct=10_000).collect()
        assert sorted(r.search(index, queries, k, query_block=8, shard_rows=64, direct=0).collect()) == sorted(plain)
        sharded = store(r.grouped(index.vectors, 64, "shard"), "sharded")
        asked = store(r.grouped(r.query_vectors(index, queries), 8, "block"), "asked")
        second, _ = r.visits(sharded, asked, k)
        met[k] = second.count()
    assert met[1] <= met[4] < met[200]
    assert met[4] < 0.5 * sharded.select("shard").distinct().count() * asked.select("block").distinct().count()


def test_vocabulary_cap_keeps_frequent_terms(documents):
    rows = r.vocabulary(r.counted(x.chunk(documents)), max_terms=3).orderBy("term_id").collect()
    totals = Counter(w for t in TEXTS.values() for c in windows(t, 800, 100) for w in words(c))
    expected = sorted(totals.items(), key=lambda item: (-item[1], item[0]))[:3]
    assert [(row["term"], row["tf"]) for row in rows] == expected


def test_index_is_loaded_or_built(spark, documents, tmp_path):
    path = scratch_path(spark, "index")
    built = r.load_or_build(spark, path, documents)
    r.save_index(built, path)
    loaded = r.load_or_build(spark, path, documents.limit(0))
    assert loaded.chunks.count() == built.chunks.count()
    with pytest.raises(ValueError):
        r.index_documents(documents.limit(0))


def test_text_folder(spark, tmp_path):
    (tmp_path / "b.txt").write_text("two\nlines")
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "c.md").write_text("no")
    rows = {d["source"]: d["text"] for d in read_text_folder(spark, str(tmp_path)).collect()}
    assert rows == {"a.txt": "one", "b.txt": "two\nlines"}


def test_texts_are_weighed_where_they_lie(spark):
    """No shuffle when keys are unique; texts with the same keys, null ones too, stay one vector."""
    rows = [(i, 0, "t", f"alpha beta{i % 7} alpha gamma{i % 3}") for i in range(60)] + [(100, 0, "t", "!"), (101, 0, "t", None)]
    schema = "doc_id long, chunk_no int, source string, text string"
    texts = store(r.counted(spark.createDataFrame(rows, schema)), "texts")
    terms = store(r.vocabulary(texts, 8), "terms")
    found = r.weigh(texts, terms, r.CHUNK_KEY)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()

    def whole(frame):
        joined = frame.select(*r.CHUNK_KEY, F.inline("counts")).join(terms.select("term", "term_id", "idf"), "term")
        gathered = r.unit_terms(joined.select(*r.CHUNK_KEY, "term_id", (F.col("tf") * F.col("idf")).alias("w")), r.CHUNK_KEY)
        return {(row.doc_id, row.chunk_no): [(t.term_id, round(t.weight, 9)) for t in row.terms] for row in gathered.collect()}

    def got(frame):
        return {(row.doc_id, row.chunk_no): [(t.term_id, round(t.weight, 9)) for t in row.terms] for row in frame.collect()}

    assert got(found) == whole(texts) and len(whole(texts)) == 60
    again = store(r.counted(spark.createDataFrame([*rows, (3, 0, "t", "alpha beta1 beta1"), (None, 0, "t", "alpha"), (None, 0, "t", "beta2")], schema)), "again")
    assert got(r.weigh(again, terms, r.CHUNK_KEY)) == whole(again) and len(whole(again)) == 61
