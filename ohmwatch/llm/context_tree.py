"""Language-model scoring by context-tree weighting over bytes, and a unigram base for comparison.

A node of the tree is a context (the last d bytes, d from 0 to 5) with a prefix of the next byte's bits.  It counts the
bits that followed in the training texts; its Krichevsky-Trofimov estimate is weighed half and half against the
product of the nodes one byte deeper.  With counts fixed after training, the probability of a bit is a mixture of the
estimates at all depths of its context.

Grams travel packed: a row holds a block's grams of one bin, sorted, as compressed differences.  A bin is a hash of
four context bytes, so the two deepest levels lie within it; the levels above are tables.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ohmwatch.llm.common import remainder, store, table, word_runs

DEPTH = 5
#: The depth that bins are made of: a context of four bytes has 65,536 grams at most, whatever the input.
CUT = 4
#: Not a byte of UTF-8: it stands before the text and ends it.
EDGE = 255
#: Bytes of text that are counted and scored together, and those that are turned into arrays at once.
BLOCK_BYTES, SLICE = 16 << 20, 1 << 21
#: Grams or words held before partial counts go out, and grams whose nodes are made at once.
FULL, CHUNK = 1 << 20, 1 << 16
#: Blocks whose counts are merged at once, and blocks that look their grams up together.
FAN, LOOK = 64, 1024
HALF = np.log(0.5)
_BIT = np.arange(8)
_PACKED = "bin int, size int, grams binary, ns binary"


def codes(text: str | None) -> Iterator[np.ndarray]:
    """For each byte of the lower-cased text and its end: the five bytes before, latest first, and the byte, as one number."""
    data = text.encode("utf-8", "surrogatepass").lower() if text else b""
    whole = np.frombuffer(bytes([EDGE]) * DEPTH + data + bytes([EDGE]), np.uint8)
    for start in range(DEPTH, len(whole), SLICE):
        end = min(start + SLICE, len(whole))
        code = whole[start:end].astype(np.int64)
        for back in range(1, DEPTH + 1):
            code |= whole[start - back : end - back].astype(np.int64) << (8 * (DEPTH + 1 - back))
        yield code


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, plane by plane, as most high bytes are equal."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, size: int, kind: type = np.int64) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = pa.decompress(data, decompressed_size=size * width, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(width, size).T.copy().view(kind).ravel()


def pack_grams(grams: np.ndarray) -> bytes:
    return pack(np.diff(grams, prepend=0))


def unpack_grams(data: bytes, size: int) -> np.ndarray:
    return np.cumsum(unpack(data, size))


def bin_of(grams: np.ndarray, bins: int) -> np.ndarray:
    """The bin of a gram's last four context bytes."""
    context = (grams >> (8 * (DEPTH - CUT) + 8)).astype(np.uint64)
    return ((context * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % bins


class Counts:
    """Distinct grams with their counts; what comes in waits until it is worth a merge, so memory follows the distinct grams."""

    def __init__(self) -> None:
        self.grams, self.ns = np.empty(0, np.int64), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, grams: np.ndarray, ns: np.ndarray) -> None:
        self.waiting.append((grams, ns))
        self.size += len(grams)
        if self.size >= max(SLICE, len(self.grams)):
            self.merge()

    def merge(self) -> None:
        if self.waiting:
            grams, ns = (np.concatenate(parts) for parts in zip((self.grams, self.ns), *self.waiting))
            self.waiting.clear()
            self.size = 0
            self.grams, place = np.unique(grams, return_inverse=True)
            self.ns = np.bincount(place, ns, len(self.grams)).astype(np.int64)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x of at least one half: Stirling's series, eight steps up."""
    up = x + 8
    series = (up - 0.5) * np.log(up) - up + 0.5 * np.log(2 * np.pi) + 1 / (12 * up) - 1 / (360 * up**3) + 1 / (1260 * up**5)
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3)) - np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov block probability."""
    return np.where(zeros + ones == 0, 0.0, log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1.0))


class Level:
    """Nodes of one depth: number of zeros and ones, estimate, weighted probability (both as logarithms)."""

    def __init__(self, nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.nodes, self.zeros, self.ones = nodes, zeros, ones
        self.kt = log_kt(zeros, ones)
        self.weighted = self.kt if below is None else np.logaddexp(HALF + self.kt, HALF + below)

    def own(self) -> np.ndarray:
        """Weight of a node's own estimate in the mixture."""
        return np.exp(np.minimum(HALF + self.kt - self.weighted, 0.0))

    def one(self) -> np.ndarray:
        return (self.ones + 0.5) / (self.zeros + self.ones + 1.0)

    def columns(self) -> dict[str, np.ndarray]:
        return {"node": self.nodes, "zeros": self.zeros, "ones": self.ones, "weighted": self.weighted, "own": self.own(), "one": self.one()}


_LEVEL = "node long, zeros double, ones double, weighted double, own double, one double"


def tree(grams: np.ndarray, counts: np.ndarray, least: int) -> tuple[dict[int, Level], dict[int, np.ndarray], np.ndarray]:
    """Levels from the deepest to ``least``, each gram's eight nodes in them, and the eight bits."""
    byte = grams & 255
    bits = (byte[:, None] >> (7 - _BIT)) & 1
    prefix = (1 << _BIT) | (byte[:, None] >> (8 - _BIT))
    levels, places, below = {}, {}, None
    n = np.repeat(counts.astype(float), 8)
    for depth in range(DEPTH, least - 1, -1):
        context = grams >> (8 * (DEPTH - depth) + 8)
        nodes, place = np.unique(((context << 8)[:, None] | prefix).ravel(), return_inverse=True)
        if below is not None:  # the product of the children
            parents = np.searchsorted(nodes, ((below.nodes >> 16) << 8) | (below.nodes & 255))
            product = np.bincount(parents, below.weighted, len(nodes))
        ones = np.bincount(place, n * bits.ravel(), len(nodes))
        levels[depth] = below = Level(nodes, np.bincount(place, n, len(nodes)) - ones, ones, None if below is None else product)
        places[depth] = place
    return levels, places, bits


def chunks(grams: np.ndarray) -> Iterator[slice]:
    """Parts of sorted grams of about CHUNK or the grams of one context of depth CUT, whichever is more."""
    start = 0
    while start < len(grams):
        end = start + CHUNK
        if end < len(grams):  # up to where the context of the last one ends
            shift = 8 * (DEPTH - CUT) + 8
            end = int(np.searchsorted(grams, ((grams[end - 1] >> shift) + 1) << shift))
        yield slice(start, end)
        start = end


def _read(rows: pa.RecordBatch, i: int, second: str, kind: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
    size = rows["size"][i].as_py()
    return unpack_grams(rows["grams"][i].as_py(), size), unpack(rows[second][i].as_py(), size, kind)


def merged(counts: DataFrame, blocks: int) -> DataFrame:
    """bin, size, grams, ns: one row per bin with all its grams, from rows of blocks, merged by FAN blocks at a time."""

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = Counts()
        for rows in batches:
            for i in range(len(rows)):
                whole.add(*_read(rows, i, "ns"))
        whole.merge()
        row = {"bin": [key[0].as_py()], "block": [key[1].as_py()], "size": [len(whole.grams)], "grams": [pack_grams(whole.grams)], "ns": [pack(whole.ns)]}
        yield pa.RecordBatch.from_arrays([pa.array(row["bin"], pa.int32()), pa.array(row["block"], pa.int32()), pa.array(row["size"], pa.int32()), pa.array(row["grams"], pa.binary()), pa.array(row["ns"], pa.binary())], names=list(row))

    while True:
        blocks = -(-blocks // FAN)
        part = F.floor(F.col("block") / FAN).cast("int").alias("block")
        counts = store(counts.select("bin", part, "size", "grams", "ns").groupBy("bin", "block").applyInArrow(merge, "bin int, block int, size int, grams binary, ns binary"), "merged")
        if blocks == 1:
            return counts.drop("block")


def gram_scores(model: DataFrame) -> DataFrame:
    """bin, size, grams, logp: log10 of the probability of a byte after its context, for the grams of each bin.

    ``model`` has one row per bin (bin, size, grams, ns); grams that training lacks come along with n = 0.  Nodes of
    depth 5 and 4 are made bin by bin, a bounded number of grams at a time; those above are sums of the nodes one
    byte deeper, pre-aggregated by Spark.  The mixture then goes down from the root by joins with the parents.
    """

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(len(rows)):
                grams, ns = _read(rows, i, "ns")
                for part in chunks(grams):
                    columns = tree(grams[part], ns[part], CUT)[0][CUT].columns()
                    yield pa.RecordBatch.from_pydict({"bin": pa.array(np.full(len(columns["node"]), rows["bin"][i].as_py()), pa.int32())} | columns)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield pa.RecordBatch.from_pydict(Level(*[rows[c].to_numpy(zero_copy_only=False) for c in ("node", "zeros", "ones", "weighted")]).columns())

    def parent(node):
        return F.shiftleft(F.shiftright(node, 16), 8).bitwiseOR(node.bitwiseAND(F.lit(255)))

    levels = {CUT: store(model.mapInArrow(lower, "bin int, " + _LEVEL), "nodes")}
    for depth in range(CUT - 1, -1, -1):
        up = levels[depth + 1].groupBy(parent(F.col("node")).alias("node")).agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")])
        levels[depth] = store(up.mapInArrow(weigh, _LEVEL), "nodes")
    state = levels[0].select("node", (F.col("own") * F.col("one")).alias("mixed"), (1 - F.col("own")).alias("left"))
    for depth in range(1, CUT + 1):
        above = state.select(F.col("node").alias("above"), F.col("mixed").alias("mixed_above"), F.col("left").alias("left_above"))
        joined = levels[depth].withColumn("above", parent(F.col("node"))).join(above, "above")
        kept = ["bin", "node"] if depth == CUT else ["node"]
        mixed = F.col("mixed_above") + F.col("left_above") * F.col("own") * F.col("one")
        state = joined.select(*kept, mixed.alias("mixed"), (F.col("left_above") * (1 - F.col("own"))).alias("left"))

    def score(rows: pa.Table, heads: pa.Table) -> pa.Table:
        order = np.argsort(heads["node"].to_numpy())
        node, mixed, left = (heads[c].to_numpy()[order] for c in ("node", "mixed", "left"))
        rows = rows.combine_chunks().to_batches()[0]
        grams, ns = _read(rows, 0, "ns")
        logp = np.empty(len(grams), np.float32)
        for part in chunks(grams):
            levels, places, bits = tree(grams[part], ns[part], DEPTH)
            deepest, at = levels[DEPTH], places[DEPTH]
            head = np.searchsorted(node, ((deepest.nodes >> 16) << 8) | (deepest.nodes & 255))
            p = (mixed[head] + left[head] * deepest.one())[at]
            p = np.clip(np.where(bits.ravel() == 1, p, 1 - p), 1e-300, 1.0)
            logp[part] = np.log10(p).reshape(-1, 8).sum(axis=1)
        return pa.table({"bin": rows["bin"], "size": rows["size"], "grams": rows["grams"], "logp": pa.array([pack(logp)], pa.binary())})

    return model.groupBy("bin").cogroup(state.groupBy("bin")).applyInArrow(score, "bin int, size int, grams binary, logp binary")


def block_counter(bins: int):
    """A function that counts a block's grams and words, 0 where only held-out texts have them, in partial counts of bounded size."""

    def count_block(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = key[0].as_py()
        words: Counter = Counter()
        grams = Counts()
        waiting: dict[bool, list[np.ndarray]] = {True: [], False: []}
        size = 0

        def settle() -> None:
            for held_out, parts in waiting.items():
                if parts:  # plain sorting is many times faster than a merge with places
                    found, ns = np.unique(np.concatenate(parts), return_counts=True)
                    grams.add(found, ns * (not held_out))
                    parts.clear()

        def out(rows: dict, size: int) -> pa.RecordBatch:
            kinds = {"block": pa.int32(), "bin": pa.int32(), "size": pa.int32(), "grams": pa.binary(), "ns": pa.binary(), "word": pa.binary(), "n": pa.int64()}
            rows = {"block": [block] * size} | rows
            return pa.RecordBatch.from_arrays([pa.array(rows[c], k) if c in rows else pa.nulls(size, k) for c, k in kinds.items()], names=list(kinds))

        def words_out() -> pa.RecordBatch:
            rows = out({"word": list(words), "n": list(words.values())}, len(words))
            words.clear()
            return rows

        def grams_out() -> pa.RecordBatch:
            where = bin_of(grams.grams, bins)
            order = np.argsort(where, kind="stable")  # grams stay sorted within a bin
            found, starts = np.unique(where[order], return_index=True)
            parts = np.split(order, starts[1:])
            rows = out({
                "bin": found, "size": [len(p) for p in parts],
                "grams": [pack_grams(grams.grams[p]) for p in parts], "ns": [pack(grams.ns[p]) for p in parts],
            }, len(parts))
            grams.__init__()
            return rows

        for rows in batches:
            for text, held_out in zip(rows["text"], rows["held_out"]):
                text, held_out = text.as_py(), held_out.as_py()
                for run in word_runs(text):
                    words.update(dict.fromkeys(run, 0) if held_out else run)
                    if len(words) >= FULL:
                        yield words_out()
                for code in codes(text):
                    waiting[held_out].append(code)
                    size += len(code)
                    if size >= SLICE:
                        settle()
                        size = 0
                        if len(grams.grams) >= FULL:
                            yield grams_out()
        settle()
        grams.merge()
        if len(grams.grams):
            yield grams_out()
        if words:
            yield words_out()

    return count_block


def looked_up(found: DataFrame, scored: DataFrame, blocks: int) -> DataFrame:
    """block, size, grams, logp: each row of ``found`` with the scores of its grams; a bin meets LOOK blocks in one task."""

    def look_up(rows: pa.Table, model: pa.Table) -> pa.Table:
        known, logp = _read(model.combine_chunks().to_batches()[0], 0, "logp", np.float32)
        values = []
        for batch in rows.to_batches():
            for i in range(len(batch)):
                grams = unpack_grams(batch["grams"][i].as_py(), batch["size"][i].as_py())
                values.append(pack(logp[np.searchsorted(known, grams)]))
        return pa.table({"block": rows["block"], "size": rows["size"], "grams": rows["grams"], "logp": pa.array(values, pa.binary())})

    there = scored.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // LOOK))))
    here = found.select("block", "bin", "size", "grams", F.floor(F.col("block") / LOOK).cast("int").alias("part"))
    return here.groupBy("bin", "part").cogroup(there.groupBy("bin", "part")).applyInArrow(look_up, "block int, size int, grams binary, logp binary")


def scores(docs: DataFrame, divisor: int = 7, left_out: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte: one row per row of ``docs``.

    ``docs`` needs doc_id and text; null counts as empty.  score is log10 of the probability of the lower-cased
    text's bytes and its end under the tree learnt from all texts that are not held out; base_score is that of its
    words and its end under their add-one frequencies.  An empty text has one token, its end, and still a score.  An
    empty table gives no rows; repeated rows are scored each.
    Texts are dealt into blocks of a bounded size, with each block's distinct grams and words: the model is looked up
    by joins and a block gets just what its texts need, so nothing is broadcast and the model may be of any size.  A
    very long text is read in slices and its counts go out in parts; a task holds it once, with its distinct grams.
    """
    named = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), (remainder(F.col("doc_id"), divisor) == left_out).alias("held_out"))
    size, n_train = named.agg(F.sum(F.octet_length("text") + 1), F.count_if(~F.col("held_out"))).first()
    blocks = max(1, -(-(size or 0) // block_bytes))
    bins = 2 * math.isqrt(blocks) + 1
    named = named.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    found = store(named.groupBy("block").applyInArrow(block_counter(bins), f"block int, {_PACKED}, word binary, n long"), "counts")
    words, grams = found.filter("word IS NOT NULL").select("block", "word", "n"), found.filter("grams IS NOT NULL").select("block", "bin", "size", "grams", "ns")
    words_all = store(words.groupBy("word").agg(F.sum("n").alias("n")), "words")
    total, distinct = words_all.agg(F.sum("n"), F.count_if(F.col("n") > 0)).first()
    n_tokens, vocabulary = (total or 0) + n_train, (distinct or 0) + (n_train > 0)
    scored = store(gram_scores(merged(grams, blocks)), "grams")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    need = looked_up(grams, scored, blocks).select("block", "size", "grams", "logp", none("binary", "word"), none("long", "n"))
    need = need.unionByName(words.select("block", "word").join(words_all, "word").select("block", none("int", "size"), none("binary", "grams"), none("binary", "logp"), "word", "n"))

    def score_block(texts: pa.Table, model: pa.Table) -> pa.Table:
        of_word = pc.is_valid(model["word"])
        known = dict(zip(model["word"].filter(of_word).to_pylist(), np.log10(model["n"].filter(of_word).to_numpy() + 1.0).tolist()))
        parts = [_read(batch, i, "logp", np.float32) for batch in model.filter(pc.is_valid(model["grams"])).to_batches() for i in range(len(batch))]
        gram, logp = (np.concatenate(p) for p in zip(*parts))
        del parts
        gram, first = np.unique(gram, return_index=True)  # a block with partial counts has some grams twice
        logp, index = logp[first], pd.Index(gram)
        whole, length = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        waiting: list[tuple[int, np.ndarray]] = []

        def settle() -> None:
            if waiting:
                sizes = [len(code) for _, code in waiting]
                values = logp[index.get_indexer(np.concatenate([code for _, code in waiting]))].astype(float)
                at = [i for i, _ in waiting]
                np.add.at(whole, at, np.add.reduceat(values, np.cumsum([0, *sizes[:-1]])))
                np.add.at(length, at, sizes)
                waiting.clear()

        out, size = [], 0
        for i, text in enumerate(texts["text"]):
            text = text.as_py()
            count, sure, base = 1, int(n_train > 0), np.log10(n_train + 1.0)
            for run in word_runs(text):
                value = np.fromiter(map(known.__getitem__, run), float, len(run))
                count, sure, base = count + len(run), sure + int(np.count_nonzero(value)), base + value.sum()
            for code in codes(text):
                waiting.append((i, code))
                size += len(code)
                if size >= SLICE:
                    settle()
                    size = 0
            out.append((count, sure, n_tokens, float(base - count * np.log10(n_tokens + vocabulary + 1))))
        settle()
        found = dict(zip(["n_tokens", "n_known", "train_tokens", "base_score"], map(pa.array, zip(*out))))
        return pa.table({"doc_id": texts["doc_id"], "held_out": texts["held_out"]} | found | {"score": whole, "bits_per_byte": -whole * np.log2(10) / length})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return named.groupBy("block").cogroup(need.groupBy("block")).applyInArrow(score_block, schema)


def op8_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
