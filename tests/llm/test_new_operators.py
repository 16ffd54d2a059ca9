"""Conversation repair, ranked search and the Jaccard join against plain versions, on awkward tables."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from check import rows as plain_rows
from ohmwatch.llm import jaccard, ranked, repair

LONG = " ".join(f"w{i % 977}" for i in range(200_000))
CONV = "conv_id long, turn long, role string, text string, n long, fault string, chunk long, copies int, `at` string"


# Conversation repair


def plain_repair(rows):
    """Cheapest edits with the least audit of (role, text, fault) rows, by a search over all edits."""
    allowed = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    turned = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, out = heapq.heappop(heap)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        if at == len(rows) and state in ("", "a"):
            return cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()
        heapq.heappush(heap, (cost + 2, audit + "I", at, turned[state], (*out, names[turned[state]] + ":")))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, out))
            if fault not in ("blank", "duplicate"):
                more = cost + (fault == "truncated")
                heapq.heappush(heap, (more + 2, audit + "R", at + 1, turned[state], (*out, f"{names[turned[state]]}:{text}")))
                if (state, role[:1]) in allowed:
                    heapq.heappush(heap, (more, audit + "K", at + 1, allowed[state, role[:1]], (*out, f"{role}:{text}")))


def plain_faults(rows):
    found, seen = [], set()
    for role, text in rows:
        said = text.strip(" \t\n\x0b\f\r")
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
        seen.add((role, text))
        found.append((role, text, fault))
    return found


@pytest.mark.parametrize("chunk_rows", [1, 3, 1 << 16])
def test_repair_equals_a_search_over_all_edits(spark, chunk_rows):
    draw = np.random.default_rng(chunk_rows)
    rows = []
    for conv in [*range(40), None]:
        for turn in range(int(draw.integers(1, 30 if conv else 120))):
            role = draw.choice(["user", "assistant", "system", "tool", "", "user", "assistant"])
            rows.append((conv, turn + int(draw.integers(0, 2)) * 1000, str(role), str(draw.choice(["Yes.", "No", "  ", "", f"Say {turn}!", f"cut {turn}"])), int(draw.choice([1, 1, 1, 2]))))
    # Equal places would leave the order open.
    rows = list({(r[0], r[1]): r for r in rows}.values())
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int")
    got = {r["conv_id"]: r for r in repair.repair(df.repartition(7), df, chunk_rows).collect()}
    by = defaultdict(list)
    for conv, turn, role, text, copies in rows:
        by[conv] += [(turn, role, text)] * copies
    assert set(got) == set(by)
    for conv, said in by.items():
        said.sort(key=lambda r: r[0])
        marked = plain_faults([(role, text) for _, role, text in said])
        cost, audit, digest = plain_repair(marked)
        turns = {t for t, _, _ in said}
        count = Counter(fault for _, _, fault in marked)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        row = got[conv]
        assert (row["cost"], row["audit"], row["repaired_sha256"]) == (cost, audit, digest)
        assert (row["gaps"], row["blank"], row["duplicate"], row["truncated"], row["illegal"]) == (max(turns) - min(turns) + 1 - len(turns), count["blank"], count["duplicate"], count["truncated"], illegal)


def test_fix_up_stops_where_vectors_differ_by_a_constant():
    steps = repair.Steps()
    draw = np.random.default_rng(0)
    for _ in range(200):
        kinds = [str(draw.choice(list("sua "))) + str(draw.choice(list(".!~"))) for _ in range(60)]
        before = repair.run_back(kinds, repair.SPECULATIVE, steps)
        found = repair.fix_up(kinds, repair.END, repair.SPECULATIVE, before, steps)
        assert found[:2] == repair.run_back(kinds, repair.END, steps) and found[2] <= 60
        v, total = repair.level(repair.END)
        plain = repair.END
        for kind in reversed(kinds):
            plain = repair.step(kind, plain)
        assert tuple(x + found[1] for x in found[0]) == plain


@pytest.fixture(scope="module")
def awkward_dir(spark, tmp_path_factory):
    """Tables with nulls, empty, long and repeated texts, ties and columns whose names the operators use themselves."""
    folder = str(tmp_path_factory.mktemp("awkward"))
    talk = [(1, 0, "system", "Hello."), (1, 1, "user", None), (1, 2, "user", "Why?"), (1, None, None, "Lost."), (2, 5, "assistant", "a" * 300_000), (2, 9, "user", "a" * 300_000 + "."),
            (None, 1, "user", "Nobody?"), (None, 2, "assistant", "Nobody."), (3, None, "user", None), (4, -3, "user", "é "), (4, 4, "assistant", "   "), (5, 7, "user", "Same."), (5, 8, "user", "Same.")]
    talk += [(conv, turn, ["user", "assistant"][turn % 2], f"Turn {turn} of {conv}" + "." * (turn % 3)) for conv in range(100, 140) for turn in range(9)]
    talk += [(77, turn, ["user", "assistant"][turn % 2], f"{turn}.") for turn in range(700)]
    spark.createDataFrame([(*t, 1, "x", 2, 3, "y") for t in talk], CONV).write.parquet(f"{folder}/conversations.parquet")
    docs = [(1, "Red fox, red FOX; naïve café 7"), (2, "red fox"), (2, "red fox"), (3, None), (4, ""), (5, " \t\n ,;"), (None, "red fox"), (6, LONG), (7, LONG + " tail"), (8, "ÀÉ straße été"), (9, "fox " * 40),
            (10, LONG), (11, "one two three four five"), (12, "ONE  two\nthree four five"), (13, "one two three four"), (14, "one two three four"), (None, "one two three four"), (15, "one")]
    spark.createDataFrame([(*d, 0, 0, 0, b"k") for d in docs], "doc_id long, text string, n long, score long, rank int, key binary").write.parquet(f"{folder}/documents.parquet")
    items = [(0, "the red fox"), (0, "naïve"), (1, None), (2, "w5 w6 tail"), (None, "FOX"), (3, "absent words"), (4, "7 café été"), (5, "red fox w1"), (6, "red fox w2"), (6, "red fox w2")]
    spark.createDataFrame([(*i, "z", 4) for i in items], "item_id long, text string, term string, doc_id long").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def connected(folder):
    db = duckdb.connect()
    for name in ("documents", "conversations", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return db


def test_repair_query_on_awkward_rows(spark, awkward_dir):
    got = repair.op11_repair(spark, awkward_dir).toPandas()
    assert len(got) == 47 and plain_rows(got) == plain_rows(connected(awkward_dir).sql(repair.OP11_SQL).df())
    empty = spark.createDataFrame([], CONV)
    assert repair.repair(repair.damaged(empty), empty).count() == 0
    dropped = spark.createDataFrame([(1,)], "conv_id long")
    row = repair.repair(repair.damaged(empty), dropped).first()
    assert row["audit"] == "" and row["cost"] == 0 and row["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


# Ranked search


def test_ranked_query_on_awkward_rows(spark, awkward_dir):
    expected = plain_rows(connected(awkward_dir).sql(ranked.OP12_SQL).df())
    assert plain_rows(ranked.op12_ranked_search(spark, awkward_dir).toPandas()) == expected and len(expected) > 20
    docs, items = (spark.read.parquet(f"{awkward_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    assert plain_rows(ranked.ranked(docs, items, pass_pairs=4).toPandas()) == expected  # several passes
    for nothing in (ranked.ranked(docs.limit(0), items), ranked.ranked(docs, items.limit(0))):
        assert nothing.count() == 0 and nothing.columns == ["item_id", "rank", "doc_id", "score"]


def test_ranked_search_equals_plain_scores(spark):
    draw = np.random.default_rng(2)
    words = [f"t{i}" for i in range(30)]
    docs = [(i, " ".join(draw.choice(words, int(draw.integers(1, 40)), p=np.arange(1, 31) / 465))) for i in range(300)]
    items = [(i, " ".join(draw.choice(words, 8))) for i in range(40)]
    got = ranked.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=7).collect()
    terms = {d: re.findall(r"[a-z0-9]+", t) for d, t in docs}
    total, held = len(docs), sum(map(len, terms.values()))
    df = Counter(t for f in terms.values() for t in set(f))
    expected = []
    for item, text in items:
        scores = []
        for d, found in terms.items():
            tf, m = Counter(found), 100 - 90 + (90 * len(found) * total) // held
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in set(text.split()) if t in tf)
            scores.append((-score, d))
        expected += [(item, rank, d, -s) for rank, (s, d) in enumerate(sorted(scores)[:7], 1) if s < 0]
    assert sorted(tuple(r) for r in got) == sorted(expected)


def test_shared_terms_are_added_once():
    """Each node serves several queries, and every query is the sum of its parts."""
    queries = [[0, 1, 2, 3], [0, 1, 2, 4], [0, 1, 5], [6, 7], [2], [0, 1, 2, 3]]
    nodes, parts = ranked.mined([list(q) for q in queries], 8)
    made = {8 + i: pair for i, pair in enumerate(nodes)}

    def leaves(part):
        return [part] if part < 8 else [x for p in made[part] for x in leaves(p)]

    assert [sorted(x for p in q for x in leaves(p)) for q in parts] == [sorted(q) for q in queries]
    reached = [set(q) for q in parts]
    for q in reached:
        waiting = list(q)
        while waiting:
            below = made.get(waiting.pop(), ())
            waiting += below
            q |= set(below)
    assert nodes and all(sum(n in q for q in reached) > 1 for n in made)
    adds = len(nodes) + sum(len(q) - 1 for q in parts)
    assert adds < sum(len(q) - 1 for q in queries)


# Jaccard join


def shingle_texts(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def plain_classes(docs):
    """Component of each row by comparing all pairs of sets."""
    sets = sorted({shingle_texts(t) for _, t in docs} - {frozenset()}, key=sorted)
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if 100 * common >= 80 * (len(a) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    where = {s: i for i, s in enumerate(sets)}
    least = {}
    for d, t in docs:
        if shingle_texts(t) and d is not None:
            r = root(where[shingle_texts(t)])
            least[r] = min(least.get(r, d), d)
    return [(d, len(s), least.get(root(where[s])) if s else d) for d, t in docs for s in [shingle_texts(t)]]


def key(row):
    return tuple((x is None, x or 0) for x in row)


def test_jaccard_query_on_awkward_rows(spark, awkward_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{awkward_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.op13_ngram_jaccard(spark, awkward_dir).collect()]
    assert sorted(got, key=key) == sorted(plain_classes(docs), key=key)
    assert jaccard.similar_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("hot, pairs", [(50_000, 256), (-1, 0)])
def test_jaccard_links_equal_all_pairs(spark, monkeypatch, hot, pairs):
    """Chains and groups around the threshold, a passage that many share, short texts; lists dealt by key and further pivots too."""
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "PAIRS", pairs)
    draw = np.random.default_rng(11)
    words = [f"v{i}" for i in range(4000)]
    docs, passage = [], list(draw.choice(words, 60))
    for _ in range(12):  # each text is the one before with a few words changed
        text = list(draw.choice(words, int(draw.integers(40, 160))))
        for _ in range(10):
            docs.append(" ".join(text))
            text = list(text)
            for at in draw.integers(0, len(text), int(draw.integers(0, 5))):
                text[at] = str(draw.choice(words))
    base = list(draw.choice(words, 100))
    for _ in range(60):  # copies of one text, near the threshold to each other
        text = list(base)
        for at in draw.integers(0, 100, 2):
            text[at] = str(draw.choice(words))
        docs.append(" ".join(text))
    docs += [" ".join([*passage, *draw.choice(words, int(draw.integers(0, 25)))]) for _ in range(60)]
    docs += [" ".join(draw.choice(words[:6], int(draw.integers(0, 8)))) for _ in range(60)]
    for n in (1500, 2040, 2060, 4090, 4110):  # long texts on both sides of a change in the number of parity bits
        text = list(draw.choice(words, n))
        docs += [" ".join(text), " ".join([*text[: n // 2], "x", *text[n // 2 :], *draw.choice(words, int(draw.integers(0, n // 3)))])]
        docs += [" ".join([str(draw.choice(words)) if draw.random() < share else w for w in text]) for share in (0.02, 0.021, 0.04)]
    rows = list(enumerate(docs))
    got = jaccard.similar_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(plain_classes(rows))


def test_prefixes_of_similar_sets_share_what_they_demand():
    """Any two sets at or above the threshold share at least the smaller demand in their prefixes, whatever the order."""
    draw = np.random.default_rng(4)
    for _ in range(300):
        n = int(draw.integers(1, 80))
        a = list(range(n))
        b = [x if draw.random() > 0.05 else 1000 + x for x in a]
        common = len(set(a) & set(b))
        if 100 * common < 80 * (2 * n - common):
            continue
        rank = {x: draw.random() for x in {*a, *b}}
        demands = [int(draw.integers(1, max(2, min(16, int(jaccard.least_overlap(n)) + 1)))) for _ in range(2)]
        prefixes = [set(sorted(s, key=rank.get)[: n - int(jaccard.least_overlap(n)) + d]) for s, d in zip((a, b), demands)]
        assert len(prefixes[0] & prefixes[1]) >= min(demands)
    assert jaccard.matches(100, np.zeros(36)) == 1 and jaccard.matches(100, np.full(36, 1e6)) > 1
