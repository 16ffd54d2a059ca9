"""Links of the near-duplicate stage against a comparison of all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from ohmwatch.llm import simhash
from ohmwatch.llm.components import roots


def groups(pairs, keys):
    parent = {k: k for k in keys}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {k: top(k) for k in keys}


@pytest.mark.parametrize("most", [1024, 7])
def test_links_connect_what_all_pairs_of_a_cell_connect(spark, most):
    """Crowded cells with pairs, chains and strangers: every comparison within a cell counts, also in split cells."""
    draw = np.random.default_rng(3)
    full = draw.integers(0, 2, (120, 256)).astype(np.uint8)
    for i in range(120):
        if i % 3:  # a third near the one before, a third a chain
            full[i] = full[i - 1]
            full[i, draw.choice(256, 30, replace=False)] ^= 1
    full[60:100] = full[60]  # a crowd of near copies
    for i in range(61, 100):
        full[i, draw.choice(256, 9, replace=False)] ^= 1
    near = draw.integers(0, 2, (120, 256)).astype(np.uint8)
    near[:, :32] = near[0, :32]  # all share two cells
    near[::2, 32:64] = near[0, 32:64]
    cells = simhash.cells_of(near)
    words = np.packbits(full, axis=1, bitorder="little").view("<i8")
    keys = [int(k) for k in draw.permutation(10_000)[:120]]
    rows = [(k, i, [int(x) for x in words[i]], [int(x) for x in cells[i]]) for i, k in enumerate(keys)]
    prints = spark.createDataFrame(rows, "key long, doc_id long, full array<long>, cells array<int>").repartition(5)
    limit = simhash.bits_for(0.8)
    wanted = [(keys[i], keys[j]) for i in range(120) for j in range(i) if (cells[i] == cells[j]).any() and (full[i] != full[j]).sum() <= limit]
    links = simhash.similar_links(prints, 0.8, most)
    distance = {(a, b) for a, b in wanted} | {(b, a) for a, b in wanted}
    got = [(r.a, r.b) for r in links.collect()]
    assert all(p in distance for p in got)
    assert groups(got, keys) == groups(wanted, keys)
    assert {r.node: r.root for r in roots(links).collect()} == {k: g for k, g in groups(wanted, keys).items() if any(k in p for p in wanted)}


def test_recall_does_not_depend_on_the_number_of_documents():
    """Cells come from the bits alone, so a pair that meets in a small table meets in a large one; the share is as stated."""
    draw = np.random.default_rng(8)
    near = draw.integers(0, 2, (2000, 256)).astype(np.uint8)
    assert np.array_equal(simhash.cells_of(near)[:10], simhash.cells_of(near[:10]))
    for bits in (15, 24, 39):
        other = near.copy()
        for row in other:
            row[draw.choice(256, bits, replace=False)] ^= 1
        shared = (simhash.cells_of(near) == simhash.cells_of(other)).any(axis=1).mean()
        assert abs(shared - simhash.recall(bits)) < 0.01
    assert simhash.recall(15) == 1 and simhash.recall(24) > 0.9999 and simhash.recall(39) > 0.98


def test_the_stage_drops_what_the_operator_links(spark):
    """One three-word shingle multiset in several orders: equal fingerprints, but five-word shingles that say the texts differ."""
    draw = np.random.default_rng(5)
    rows = []
    for group in range(6):
        between = [f"g{group}w{i}" for i in range(24)]
        for copy in range(3):
            order = draw.permutation(between)
            rows.append((100 * group + copy, " ".join(["x y", *[f"{w} x y" for w in order]]), "s"))
    rows += [(9001, None, "s"), (9002, " \n", "s"), (None, rows[0][1] + " end", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r.component_id for r in simhash.near_components(docs).collect()}
    assert all(found[100 * group + copy] == 100 * group for group in range(6) for copy in range(3))
    kept = [r.doc_id for r in simhash.drop_near_duplicates(docs).collect()]
    assert {d for d in kept if d is not None} == {100 * group for group in range(6)} | {9001}


def test_print_links_are_all_pairs_within_two_bits(spark):
    draw = np.random.default_rng(9)
    prints = [int(x) for x in draw.integers(-(2**63), 2**63, 30)]
    for i in range(60):
        flips = draw.choice(64, draw.integers(0, 5), replace=False)
        value = (prints[i] % 2**64) ^ sum(1 << int(f) for f in flips)
        prints.append(value - 2**64 if value >= 2**63 else value)
    keys = [int(k) for k in draw.permutation(5_000)[: len(prints)]]
    rows = spark.createDataFrame([*zip(keys, prints)], "key long, fp long")
    near = [(keys[i], keys[j]) for i in range(len(keys)) for j in range(i) if ((prints[i] ^ prints[j]) % 2**64).bit_count() <= 2]
    got = [(r.a, r.b) for r in simhash.print_links(rows).collect()]
    assert groups(got, keys) == groups(near, keys)


def test_asks_of_fingerprints_are_not_broadcast(spark):
    """Each fingerprint asks for dozens of values, which Spark's estimate of an exploded table leaves out."""
    prints = spark.range(2000).selectExpr("xxhash64(id) AS fp")
    links = simhash.links_within(prints, 2)
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()
    links.collect()
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()


def test_links_of_the_near_duplicate_stage_are_merged(spark):
    """The stage of the pipeline takes the same way: the exploded tables meet in a merge join."""
    prints = spark.range(2000).selectExpr("id AS key", "xxhash64(id % 1500) AS fp")
    assert "SortMergeJoin [segment" in simhash.print_links(prints)._jdf.queryExecution().executedPlan().toString()
