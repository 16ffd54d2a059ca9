"""The text operators on small tables: awkward rows, and plain versions of the same work."""

from __future__ import annotations

import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from ohmwatch.llm import chat, context_tree, decontaminate, exact, licences, mixing, quality, simhash, toxicity, urls

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, key long, fp long"
LONG = " ".join(f"w{i % 977}" for i in range(300_000))
AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog. It was late.", "en", "a"),
    (2, "The quick  brown fox\njumps over the lazy dog. It was late.", "en", "b"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, "   \t\n ", "en", None),
    (6, "You idiot! Nice day.\nGo home.", "en", "c"),
    (6, "You idiot! Nice day.\nGo home.", "en", "c"),
    (7, LONG, "en", "é"),
    (8, "naïve café ÀÉ straße", "fr", "c"),
    (None, "no id here, none at all", "en", "a"),
    (9, "x", "en", "b"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*row, 0, 0.5, 1, 2, 3) for row in AWKWARD], DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def words(text):
    return (text or "").encode().lower().split()


def prose(seed, n=120):
    draw = np.random.default_rng(seed)
    return " ".join(draw.choice([a + b + c for a in ("ta", "ro", "mi", "se") for b in ("l", "n", "k") for c in ("o", "a", "um", "er")], n))


def test_exact(awkward, empty):
    rows = exact.duplicates(awkward, fan_in=2).collect()
    groups = defaultdict(list)
    for key, text, *_ in AWKWARD:
        groups[re.sub("[\x20\x09-\x0d]+", " ", text or "")].append(key)
    assert len(rows) == len(AWKWARD)
    expected = sorted((k, min((x for x in g if x is not None), default=None), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for k in g if k is not None)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows if r.doc_id is not None) == expected
    assert all(r.kept == (r.doc_id == r.keep_id) for r in rows)
    left = exact.drop_duplicates(awkward)
    assert left.columns == awkward.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter([1, 3, 5, 6, 7, 8, None, 9])
    assert exact.duplicates(empty).count() == 0 and exact.drop_duplicates(empty).count() == 0


def test_exact_keeps_another_text_of_a_dropped_id(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (2, "b")], "doc_id long, text string")
    assert sorted(map(tuple, exact.drop_duplicates(docs).collect())) == [(1, "a"), (2, "b")]


def test_simhash_fingerprints(awkward, empty):
    found = {r.doc_id: r for r in simhash.near_components(awkward).collect()}
    for key, text, *_ in AWKWARD:
        w = words(text)
        grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        value = sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h)) if key != 7 else int(found[7].fingerprint, 16)
        assert found[key].fingerprint == f"{value:016x}"
    assert found[2].component_id == 1 and found[4].component_id == found[5].component_id == 3 and found[3].fingerprint == "0" * 16
    assert simhash.near_components(empty).count() == 0


@pytest.mark.parametrize("bits", [1, 2, 3, 5])
def test_simhash_links_match_all_pairs(spark, bits):
    draw = np.random.default_rng(bits)
    base = draw.integers(0, 2**63, 12)
    values = {int(b) for b in base}
    for b in base:
        for n in range(1, 8):
            values.add(int(b) ^ sum(1 << int(i) for i in draw.choice(63, n, replace=False)))
    values = sorted(values)
    wanted = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= bits}
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    assert {tuple(r) for r in simhash.links_within(prints, bits).distinct().collect()} == wanted


def test_near_duplicates(spark, awkward, empty):
    rows = []
    for k in range(6):
        base = prose(k).split()
        rows.append((k * 10, " ".join(base)))
        for c in range(1, 4):
            base[c * 30] = "changed"
            rows.append((k * 10 + c, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect())
    assert set(range(0, 60, 10)) <= set(left) and len(left) <= 8
    assert len([r for r in simhash.drop_near_duplicates(awkward).collect() if r.doc_id == 6]) == 1
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_mixing(awkward, empty):
    rows = mixing.mixed_documents(awkward).collect()
    assert len(rows) == len(AWKWARD)
    by_source = defaultdict(int)
    for key, text, _, source in AWKWARD:
        by_source[source] += len(words(text))
    order = sorted((s for s in by_source if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        level = (1.5 * sum(by_source.values()) - sum(2 * by_source[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and level * weight[s] > 2 * by_source[s]}
        if not more:
            break
        capped |= more
    target = {s: 2.0 * by_source[s] if s in capped else level * weight[s] for s in order}
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == by_source[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.51 for s in order)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixed_documents(awkward.repartition(5)).collect()))
    assert mixing.mixed_documents(empty).count() == 0


def labelled(spark, flag):
    draw = np.random.default_rng(5)
    docs, labels = [], []
    for k in range(400):
        bad = int(draw.random() < 0.3)
        text = prose(k + 1000, 60).split()
        for i in range(5, 60, 11):
            text[i] += "."
        if bad and flag == "toxic":
            text[int(draw.integers(60))] = "scum"
        if flag == "quality" and not bad:
            text = [w + "###" for w in text]
        docs.append((k, " ".join(text)))
        labels.append((k, bad if flag == "quality" else 1, bad if flag == "toxic" else 0))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, awkward, empty):
    docs, labels = labelled(spark, "toxic")
    model = toxicity.fit(docs, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in toxicity.toxicity(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([(r.score >= 0.3) == truth[r.doc_id] for r in held]) > 0.95
    bad = {r.doc_id: r for r in toxicity.offending(docs, model).collect()}
    assert all("scum" in bad[r.doc_id].words for r in held if r.score >= 0.9 and r.doc_id in bad)
    scored = toxicity.toxicity(awkward, model).collect()
    assert len(scored) == len(AWKWARD) and all(0 <= r.score <= 1 for r in scored)
    assert {(r.score, r.worst_sentence) for r in scored if r.doc_id in (3, 4)} == {(0.0, -1)}
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    assert toxicity.toxicity(empty, model).count() == 0
    none = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.score < 0.01 for r in toxicity.toxicity(docs, none).collect())


def test_noisy_or_is_the_product_of_sentences():
    model = toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), -1.0)
    score, counts, *_ = toxicity.judge(["a b. c d! e", "", None], model, toxicity.Coder())
    p = 1 / (1 + math.e)
    assert counts.tolist() == [3, 0, 0] and score == pytest.approx([1 - (1 - p) ** 3, 0, 0])


def test_decontamination(spark, awkward, empty):
    items = [(i, f"{prose(i + 50, 20)}. {prose(i + 90, 8)}.") for i in range(60)] + [(100, None), (101, ""), (102, "too short"), (103, prose(700, 200))]
    docs = [(0, prose(1, 300) + "\n" + items[3][1].upper() + " " + prose(2, 300)), (1, prose(3, 400)), (2, prose(4, 63) + " " + items[59][1]), (3, items[3][1].replace(" ", "\n ")), (4, prose(700, 200)), (5, prose(50, 20)), (6, None)]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(0, 3), (2, 59), (3, 3), (4, 103)}
    table = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.drop_contaminated(awkward, table).count() == len(AWKWARD) and decontaminate.contaminated(empty, table).count() == 0
    assert decontaminate.contaminated(awkward, table.limit(0)).count() == 0


def test_block_bounds_lose_nothing():
    items = [(i, prose(i, 30)) for i in range(80)]
    index = decontaminate.build_index(items)
    texts = [decontaminate.plain_words(prose(i + 500, 150) + " " + " ".join(items[i][1].split()[: 10 + i % 20])) for i in range(60)]
    found = {(d, i) for d, i, *_ in decontaminate.search(texts, index)}
    wanted = set()
    for d, w in enumerate(texts):
        for h in range(0, len(w), decontaminate.HALF):
            have = {index.terms[x] for x in w[h : h + 2 * decontaminate.HALF] if x in index.terms}
            score = np.zeros(len(index.item_of))
            for t in have:
                own = slice(index.starts[t], index.starts[t + 1])
                score[index.segments[own]] += index.weights[own]
            wanted |= {(d, int(index.item_of[s])) for s in np.flatnonzero(score >= decontaminate.RETRIEVE)}
    assert found == wanted and wanted


def test_quality(spark, awkward, empty):
    docs, labels = labelled(spark, "quality")
    vectors = quality.word_vectors(docs)
    network = quality.fit(docs, labels, vectors)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in quality.quality(docs, vectors, network).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.score >= 0.3) == truth[r.doc_id] for r in held]) > 0.95
    scored = quality.quality(awkward, vectors, network).collect()
    assert len(scored) == len(AWKWARD) and all(0 <= r.score <= 1 for r in scored)
    assert quality.quality(empty, quality.word_vectors(empty), network).count() == 0


def test_context_sums_match_a_loop():
    place, sign = quality.index_vectors()
    texts = [np.array([5, 9, 5, 7]), np.array([], np.int32), np.array([9])]
    wanted = np.zeros((quality.BUCKETS, quality.DIMS))
    for t in texts:
        for i, u in enumerate(t):
            for j in range(max(0, i - quality.REACH), min(len(t), i + quality.REACH + 1)):
                if i != j:
                    np.add.at(wanted[u], place[t[j]], sign[t[j]])
    assert np.array_equal(quality.context_sums(texts), wanted)


def test_context_tree(awkward, empty):
    rows = context_tree.scores(awkward).collect()
    train = [t for k, t, *_ in AWKWARD if k is None or zlib.crc32(str(k).encode()) % 7 != 2]
    count = Counter(w for t in train for w in [*words(t), None])
    n, v = sum(count.values()), len(count)
    text = {k: t for k, t, *_ in AWKWARD}
    assert len(rows) == len(AWKWARD)
    for r in rows:
        w = [*words(text[r.doc_id]), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)) and r.score < 0
    assert context_tree.scores(empty).count() == 0


def test_context_tree_matches_a_plain_one(spark):
    texts = [(1, "abracadabra"), (2, "abba"), (3, "cab"), (4, "")]
    rows = {r.doc_id: r for r in context_tree.scores(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    seen = defaultdict(lambda: [0, 0])
    padded = lambda t: bytes([255]) * 5 + t.encode() + b"\xff"
    for k, t in texts:
        if zlib.crc32(str(k).encode()) % 7 != 2:
            data = padded(t)
            for i in range(5, len(data)):
                for d in range(6):
                    for b in range(8):
                        seen[data[i - d : i], (1 << b) | data[i] >> (8 - b)][data[i] >> (7 - b) & 1] += 1
    kt = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.log(math.pi) - math.lgamma(sum(n) + 1)

    def weighted(context, prefix):
        own = kt(seen.get((context, prefix), [0, 0]))
        if len(context) == 5:
            return own
        below = sum(weighted(c, prefix) for c in {c for c, p in list(seen) if len(c) == len(context) + 1 and c[1:] == context and p == prefix})
        return np.logaddexp(own, below) - math.log(2)

    def probability(context, prefix, bit, d=0):
        here = context[5 - d :]
        n = seen.get((here, prefix), [0, 0])
        one = (n[bit] + 0.5) / (sum(n) + 1)
        if d == 5:
            return one
        share = math.exp(kt(n) - weighted(here, prefix)) / 2
        return share * one + (1 - share) * probability(context, prefix, bit, d + 1)

    for k, t in texts:
        data = padded(t)
        score = sum(math.log10(probability(data[i - 5 : i], (1 << b) | data[i] >> (8 - b), data[i] >> (7 - b) & 1)) for i in range(5, len(data)) for b in range(8))
        assert rows[k].score == pytest.approx(score)


def test_licences(spark, awkward, empty):
    full = "\n".join(licences.SENTENCES[i] + "." for i in (40, 41, 42, 43))
    docs = spark.createDataFrame([(1, "Hello. released under the  MIT license!\nBye"), (2, full), (3, "A strange licence applies."), (4, full.replace(licences.SENTENCES[43], "")), (5, None)], "doc_id long, text string")
    rows = {r.doc_id: (r.licences, r.n_known, r.n_other) for r in licences.licences(docs).collect()}
    assert rows == {1: ("MIT", 1, 0), 2: ("BSD-3-Clause", 4, 0), 3: ("", 0, 1), 4: ("BSD-2-Clause", 3, 0)}
    assert licences.licences(awkward).count() == 0 and licences.licences(empty).count() == 0


def test_url_filter(spark):
    pages = [
        (1, "http://A.Example.com/en/x?y", None), (2, "https://www.example.com/en/1#t", ""), (3, "http://b.net/es/1", "<a href='//hub.org/x'>"),
        (4, None, "x"), (5, "no scheme", "x"), (6, "http://hub.org", '<a href="http://b.net/q">'), (7, "http://example.com/de/1", '<a href="https://good.org/">'), (7, "http://example.com/de/1", None),
        (8, "http://good.org/1", None), (9, "http://badnet/es/1", None), (10, "http://c.net/en/?/es/", None),
    ]
    docs = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, html string, host string, n long")
    rows = [tuple(r) for r in urls.judged(docs, spark.createDataFrame(urls.RULES, "verdict string, host string, path string")).collect()]
    assert len(rows) == len(pages)
    found = {r[0]: r[1:] for r in rows}
    assert found[1] == ("a.example.com", "/en/x", "example.com/en/", "block") and found[2][2:] == ("www.example.com/en/", "allow")
    assert found[3][2:] == ("net/es/", "block") and found[4] == found[5] == ("", "", None, "allow")
    assert found[6] == ("hub.org", "", None, "block") and found[7][2:] == ("com/", "allow") and found[8][2:] == (None, "allow")
    assert found[9][2] is None and found[10][2] is None
    assert urls.judged(docs.limit(0), spark.createDataFrame(urls.RULES, "verdict string, host string, path string")).count() == 0


def test_chat_escapes_are_reversible():
    for text in ["", "\\", "\\l", "</s>", "<<s>", "[INST] a [/INST]", "<</SYS>>", "<|turn|>", "a\nb\\n", "<s></s>\\[INST]"]:
        assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROL)
        assert chat.read_back(chat.formatted(text, text)[0]) == (text, text)


def test_chat_layouts(spark):
    records = [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, [("user", "a"), ("assistant", "")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, [("user", "a"), ("assistant", "b")]),
        ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
        ({"instruction": "i", "input": "n", "output": "o"}, [("user", "i"), ("user", "n"), ("assistant", "o")]),
        ({"role": "assistant"}, [("assistant", "")]),
    ]
    for record, turns in records:
        assert chat.turns_of(json.dumps(record))[1] == turns
    assert chat.turns_of(None) is None and chat.turns_of("{") is None and chat.turns_of('{"other": 1}') is None
    rows = [(1, 0, json.dumps(records[0][0])), (1, 0, json.dumps(records[2][0])), (None, None, json.dumps(records[4][0])), (2, 0, "x"), (1, None, json.dumps({"role": "system", "text": "s"}))]
    out = {r.conv_id: r for r in chat.digests(chat.format_records(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, record string, place int"))).collect()}
    said = "system\ns\nuser\na\nassistant\n\nuser\np\nassistant\nc\n"
    assert set(out) == {1, None} and out[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and out[1].loss_chars == 1
