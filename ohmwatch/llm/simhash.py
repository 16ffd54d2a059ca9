"""Near duplicates by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ohmwatch.llm.common import arrow_parts, store, table, word_runs
from ohmwatch.llm.components import roots
from ohmwatch.llm.exact import drop_duplicates

SEED = 42
#: Shingles that are hashed and summed together.
CHUNK = 200_000


def shingles(runs: Iterable[list[bytes]], size: int) -> Iterator[list[bytes]]:
    """Space-joined shingles in lists, repeats included; a text with fewer words gives its whole sequence, none gives nothing."""
    tail: list[bytes] = []
    made = False
    for words in runs:
        words = tail + words
        if len(words) >= size:
            made = True
            yield list(map(b" ".join, zip(*[words[i:] for i in range(size)])))
        tail = words[len(words) - size + 1 :] if len(words) >= size else words
        if size == 1:
            tail = []
    if not made and tail:
        yield [b" ".join(tail)]


def hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(SEED)), np.uint64, len(found))


def _bits(values: np.ndarray) -> np.ndarray:
    """A row of 64 zeros and ones for each value; column j is bit j."""
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _more(values: np.ndarray, number: int) -> np.ndarray:
    """Further hashes of what ``values`` are hashes of; number 0 gives ``values``."""
    if number:
        values = (values ^ np.uint64(0x9E3779B97F4A7C15 * number % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        values ^= values >> np.uint64(32)
    return values


def texts_bits(texts: list[str | None], size: int, wide: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For each text, how many of its shingle hashes (``wide`` times 64 bits) have each bit set, and how many shingles it has."""
    ones, total = np.zeros((len(texts), 64 * wide), np.int64), np.zeros(len(texts), np.int64)
    found: list[bytes] = []
    owners: list[int] = []
    counts: list[int] = []

    def add() -> None:
        if found:
            first, starts = hashes(found), np.cumsum([0, *counts[:-1]])
            for k in range(wide):
                np.add.at(ones[:, 64 * k : 64 * k + 64], owners, np.add.reduceat(_bits(_more(first, k)), starts, axis=0, dtype=np.int32))
            np.add.at(total, owners, counts)
            found.clear(), owners.clear(), counts.clear()

    for i, text in enumerate(texts):
        for some in shingles(word_runs(text), size):
            found += some
            owners.append(i)
            counts.append(len(some))
            if len(found) >= CHUNK:
                add()
    add()
    return ones, total


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp: the fingerprint as a long (its 64 bits read as a signed number).  No words: zero."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_parts(batches):
            ones, total = texts_bits(part.column("text").to_pylist(), shingle)
            fp = np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<i8").ravel()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, fp long")


def _segment(fp: Column, number: int, segments: int) -> tuple[Column, int]:
    """Value and width of one segment; widths differ by one bit at most."""
    start, end = 64 * number // segments, 64 * (number + 1) // segments
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << (end - start)) - 1)), end - start


def links_within(prints: DataFrame, max_bits: int) -> DataFrame:
    """a, b: pairs of distinct fingerprints (column fp, no repeats) that differ in at most ``max_bits`` bits.

    With ``max_bits // 2 + 1`` segments, two at least, a linked pair differs in one bit at most in some segment.  Each fingerprint
    stands in the table of every segment under its exact value and asks for the ball of radius one.  Of two values
    that differ in one bit, just one has a zero there, so only zeros are flipped; equal values ask once as well.
    A pair may come from several segments.
    """
    segments = max(2, max_bits // 2 + 1)
    rows, asks = [], []
    for s in range(segments):
        value, width = _segment(F.col("fp"), s, segments)
        rows.append(F.struct(F.lit(s).alias("segment"), value.alias("value")))
        ball = [value.alias("value"), *[F.when(F.shiftright(value, i).bitwiseAND(F.lit(1)) == 0, value.bitwiseOR(F.lit(1 << i))) for i in range(width)]]
        asks += [F.struct(F.lit(s).alias("segment"), b.alias("value")) for b in ball]
    kept = prints.select("fp", F.explode(F.array(*rows)).alias("at")).select("fp", "at.segment", "at.value")
    asked = prints.select(F.col("fp").alias("other"), F.explode(F.array(*asks)).alias("at")).select("other", "at.segment", "at.value").filter("value IS NOT NULL")
    differ = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    # Spark does not count what explode adds: by its size, a table of ten million asks might be broadcast.
    found = kept.join(asked.hint("merge"), ["segment", "value"]).filter((F.col("fp") != F.col("other")) & (differ <= max_bits))
    return found.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))


def near_components(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fingerprint, component_id, n_links: one row per row of ``docs``, which needs doc_id and text.

    Documents are linked when their fingerprints differ in at most ``max_bits`` bits; component_id is the smallest
    doc_id reachable over links, and n_links counts the other fingerprints linked directly.  Null and blank texts
    have fingerprint zero and are linked like any other.  Null ids stay and count only where no other id is
    reachable.  Copies share a fingerprint, which is linked once.  Other columns are not read.
    """
    rows = store(fingerprints(docs, shingle), "fingerprints")
    prints = store(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "prints")
    links = store(links_within(prints.select("fp"), max_bits).distinct(), "links")
    found = roots(links)
    rooted = prints.join(found.withColumnRenamed("node", "fp"), "fp")
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    degree = links.select(F.explode(F.array("a", "b")).alias("_fp")).groupBy("_fp").agg(F.count("*").alias("_links"))
    linked = rooted.join(least, "root").join(degree, F.col("fp") == F.col("_fp")).select(F.col("fp").alias("_fp"), "component", "_links")
    alone = prints.filter("n > 1").join(linked, F.col("fp") == F.col("_fp"), "left_anti").select(F.col("fp").alias("_fp"), F.col("first").alias("component"), F.lit(0).cast("long").alias("_links"))
    joined = rows.join(linked.unionByName(alone), F.col("fp") == F.col("_fp"), "left")
    return joined.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("_fp").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
    )


#: Near duplicates by similarity: words of 64 bits in a fingerprint, shingle sizes for candidates and for the distance.
WIDE, CANDIDATE_SHINGLE, SHINGLE = 4, 2, 5
#: Bits of a segment, whatever the number of documents.  Each permutation of the bits is cut into segments, each a table.
WIDTH, PERMUTATIONS = 16, 4
SEGMENTS = 64 * WIDE // WIDTH
#: Members of a table cell, or of a block of a fuller cell, that are compared in one go.
CELL = 1024


def _orders() -> np.ndarray:
    """The permutations of the bits, one after the other; the first leaves them in order."""
    bits = range(64 * WIDE)
    return np.array([sorted(bits, key=lambda i: (xxhash.xxh64_intdigest(f"{p} {i}", SEED), i) if p else i) for p in range(PERMUTATIONS)]).ravel()


ORDERS = _orders()


def recall(bits: int) -> float:
    """Chance that fingerprints which differ in ``bits`` random bits share a cell: up to SEGMENTS - 1 bits it is sure.

    For one permutation, the chance that no segment is free of differing bits is counted by inclusion and exclusion.
    """
    total = 64 * WIDE
    apart = sum((-1) ** i * comb(SEGMENTS, i) * comb(total - i * WIDTH, bits) for i in range(SEGMENTS + 1)) / comb(total, bits)
    return 1 - apart**PERMUTATIONS


def bits_for(similarity: float, total: int = 64 * WIDE) -> int:
    """Differing bits of ``total`` that texts of this resemblance are within five times out of six.

    Resemblance j of two shingle sets is a cosine of 2j / (1 + j), and a bit differs in proportion to the angle.
    """
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(round(share * total + np.sqrt(total * share * (1 - share))))


def cells_of(bits: np.ndarray) -> np.ndarray:
    """For each row of zeros and ones its cell in every table; cells of different tables have different numbers."""
    values = np.packbits(bits[:, ORDERS].reshape(len(bits), -1, WIDTH), axis=2, bitorder="little").view("<u2")[..., 0]
    return values.astype(np.int32) + (np.arange(values.shape[1], dtype=np.int32) << WIDTH)


def wide_fingerprints(docs: DataFrame) -> DataFrame:
    """key, doc_id, fp, full, cells: the fingerprint, 256 bits over five-word shingles, and the table cells of 256 bits over two-word shingles.

    key is a hash of id and text; fp is what ``fingerprints`` gives.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_parts(batches):
            texts, columns = part.column("text").to_pylist(), [part.column("key"), part.column("doc_id")]
            near, full = [2 * ones > total[:, None] for ones, total in (texts_bits(texts, size, WIDE) for size in (CANDIDATE_SHINGLE, SHINGLE))]
            ones, total = texts_bits(texts, 3)
            columns.append(pa.array(np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<i8").ravel()))
            for rows in (np.packbits(full, axis=1, bitorder="little").view("<i8"), cells_of(near)):
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel())))
            yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "fp", "full", "cells"])

    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(scan, "key long, doc_id long, fp long, full array<long>, cells array<int>")


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the rows ``a`` and ``b`` were linked; a label is the first row of its group."""
    a, b = label[a], label[b]
    while len(a):
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(above := parent[parent], parent):
            parent = above
        label, a, b = parent[label], parent[a], parent[b]
        a, b = a[a != b], b[a != b]
    return label


def links_in_cells(cell: np.ndarray, full: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows linked, each with a later row of its cell: rows of a cell stand together, ``full`` has a column per 64 bits.

    Every two rows of a cell are compared over all bits, but for those that links already found there connect: a
    link between them would change no group.
    """
    bounds = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
    end = np.repeat(bounds[1:], np.diff(bounds))
    label = at = np.arange(len(cell))
    columns = [np.ascontiguousarray(c) for c in full.T]
    found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = 1
    while len(at := at[at + step < end[at]]):
        one = at[label[at] != label[at + step]]
        two = one + step
        differ = np.zeros(len(one), np.int16)
        for c in columns:
            differ += np.bitwise_count(c[one] ^ c[two])
        one, two = one[differ <= max_bits], two[differ <= max_bits]
        if len(one):
            label = _merge(label, one, two)
            found[0].append(one), found[1].append(two)
        step += 1
    return np.concatenate(found[0]), np.concatenate(found[1])


def _whole_cells(batches: Iterable[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Sorted batches joined to tables of about so many rows that cut no part."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            joined = pa.Table.from_batches(held)
            part = joined.column("part").to_numpy()
            cut = int(np.flatnonzero(part != part[-1])[-1]) + 1 if part[0] != part[-1] else 0
            if cut:
                yield joined.slice(0, cut)
            held = joined.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def similar_links(prints: DataFrame, similarity: float, most: int = CELL) -> DataFrame:
    """a, b: links that connect all keys which share a table cell and whose five-word fingerprints are near enough.

    Each segment of the two-word fingerprint is a table in which every document stands under its value.  All pairs
    of a cell are compared by the whole five-word fingerprint, unless links of that cell connect them already.
    Cells with more than ``most`` members are split without losing a pair.  Members near their smallest key are linked
    with it and so need no comparison among themselves: they are the star.  The rest and the star are dealt into
    blocks by a hash of the key; each block of the rest meets each other block, of the rest and of the star.
    """
    max_bits = bits_for(similarity)
    words = [f"w{i}" for i in range(WIDE)]
    placed = prints.select("key", *[F.col("full")[i].alias(w) for i, w in enumerate(words)], F.explode("cells").alias("cell"))
    full = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("key").alias("pivot")).filter(F.col("n") > most).drop("n")
    of_pivot = prints.select(F.col("key").alias("pivot"), *[F.col("full")[i].alias(f"p{i}") for i in range(WIDE)])
    full = store(full.join(of_pivot, "pivot"), "full_cells")
    pairs = None
    if full.isEmpty():
        parts = placed.select(F.col("cell").cast("long").alias("part"), "key", *words)
    else:
        differ = sum((F.bit_count(F.col(f"w{i}").bitwiseXOR(F.col(f"p{i}"))) for i in range(1, WIDE)), F.bit_count(F.col("w0").bitwiseXOR(F.col("p0"))))
        crowd = placed.join(full, "cell").withColumn("star", differ <= max_bits)
        pairs = crowd.filter(F.col("star") & (F.col("key") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("key").alias("b"))
        blocks = lambda of: F.ceil(F.count_if(of) / most)
        sizes = store(crowd.groupBy("cell").agg(blocks(~F.col("star")).alias("rests"), blocks(F.col("star")).alias("stars")), "blocks")
        dealt = placed.join(full.join(sizes, "cell"), "cell", "left").withColumn("star", differ <= max_bits)
        salt = F.xxhash64("key")
        own = F.when(F.col("star"), F.col("rests") + F.pmod(salt, F.col("stars"))).otherwise(F.pmod(salt, F.greatest("rests", F.lit(1))))
        none, total = F.array().cast("array<long>"), F.col("rests") + F.col("stars")
        meets = (
            F.when(F.col("pivot").isNull(), F.array(F.lit(-1).cast("long")))
            .when(F.col("star"), F.when(F.col("rests") > 0, F.sequence(F.lit(0).cast("long"), F.col("rests") - 1)).otherwise(none))
            .otherwise(F.filter(F.sequence(F.lit(0).cast("long"), total - 1), lambda x: x != F.col("own")))
        )
        dealt = dealt.withColumn("own", own).withColumn("meets", F.explode(meets))
        part = F.when(F.col("pivot").isNull(), F.col("cell").cast("long")).otherwise(F.xxhash64("cell", F.least("own", "meets"), F.greatest("own", "meets")))
        parts = dealt.select(part.alias("part"), "key", *words)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_cells(batches):
            key = rows.column("key").to_numpy()
            one, two = links_in_cells(rows.column("part").to_numpy(), np.stack([rows.column(w).to_numpy().view(np.uint64) for w in words], axis=1), max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(key[one]), pa.array(key[two])], ["a", "b"])

    met = parts.repartition("part").sortWithinPartitions("part", "key").mapInArrow(scan, "a long, b long")
    pairs = met if pairs is None else pairs.unionByName(met)
    return pairs.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def print_links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """a, b: links that connect all keys whose fingerprints ``fp`` are equal or differ in at most ``max_bits`` bits.

    The smallest key of a fingerprint stands for it: other keys hang on it, and it carries the links of ``links_within``.
    """
    firsts = store(prints.groupBy("fp").agg(F.min("key").alias("first"), F.count("*").alias("n")), "prints")
    copies = prints.join(firsts.filter("n > 1").withColumnRenamed("fp", "_fp"), F.col("fp") == F.col("_fp")).filter("key != first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    links = links_within(firsts.select("fp"), max_bits).distinct()
    for end in ("a", "b"):
        links = links.join(firsts.select(F.col("fp").alias(end), F.col("first").alias(f"_{end}")), end)
    return links.select(F.col("_a").alias("a"), F.col("_b").alias("b")).unionByName(copies)


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near duplicates, all columns as they were: the one with the smallest id.

    Texts are near duplicates when they are linked as in ``near_components``, which misses none, or when the fingerprints
    of their five-word shingles say that the resemblance is about ``similarity`` or more; groups are linked by both.
    Null and blank texts are one group.  Repeated rows fall to one first.  An empty table stays empty.
    """
    prints = store(wide_fingerprints(docs), "wide")
    if not prints.groupBy("key").count().filter("count > 1").isEmpty():
        docs = drop_duplicates(docs)
        prints = store(wide_fingerprints(docs), "wide")
    found = roots(print_links(prints).unionByName(similar_links(prints, similarity)))
    grouped = prints.select("key", "doc_id").join(found, F.col("key") == F.col("node"))
    kept = grouped.groupBy("root").agg(F.min_by("key", F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("_kept"))
    gone = grouped.join(kept, "root").filter(F.col("key") != F.col("_kept")).select(F.col("key").alias("_gone"))
    return docs.withColumn("_own_key", F.xxhash64(docs["doc_id"], docs["text"])).join(gone, F.col("_own_key") == F.col("_gone"), "left_anti").drop("_own_key")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))
