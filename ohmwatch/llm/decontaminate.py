"""Benchmark decontamination: BM25 search of every passage in an index of test items, then an overlap check."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ohmwatch.llm.common import arrow_parts, table

K1, B = 1.2, 0.75
#: Items are searched in segments of this many words; a passage is two half passages of this many words.
HALF = 64
#: Segments that share one upper bound per term.
BLOCK = 4
#: Share of a segment's own BM25 score from which a passage is retrieved.
RETRIEVE = 0.6
#: Share of the question's and of the answer's word sequences that must stand in the passage.
OVERLAP = 0.5
GRAM = 5
#: Items with fewer words are found by their exact word sequence: a share of so few words would match by chance.
LEAST_WORDS = 8
#: Characters of test items in one index; more items make more indexes, each searched with all passages.
INDEX_CHARS = 1 << 20

# ASCII punctuation parts words, so that quotes or commas around a passage do not hide it.
_PUNCTUATION = bytes.maketrans(bytes(c for c in range(33, 127) if not chr(c).isalnum()), b" " * 32)
_ENDS = re.compile(r"(?<=[.!?])\s+|\n+")


def plain_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_PUNCTUATION).split() if text else []


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The last sentence is the answer and the rest the question; of a single sentence, the last third of its words."""
    parts = [w for w in map(plain_words, _ENDS.split(text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def grams(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    return set(zip(*[words[i:] for i in range(size)]))


def overlap(part: list[bytes], passage: list[bytes]) -> float:
    """Share of the part's sequences of five words (or fewer, if it is shorter) that stand in the passage; an empty part: 1."""
    size = min(GRAM, len(part))
    if not size:
        return 1.0
    wanted = grams(part, size)
    return len(wanted & grams(passage, size)) / len(wanted)


@dataclass
class Index:
    """An inverted index of item segments.  Weights are BM25 divided by the segment's own score, so 1 is the most."""

    items: list[tuple[int | None, list[bytes], list[bytes]]]  # id, question, answer
    item_of: np.ndarray  # of each segment
    terms: dict[bytes, int]
    starts: np.ndarray  # of each term's postings
    segments: np.ndarray
    weights: np.ndarray
    block_starts: np.ndarray  # of each term's block bounds
    blocks: np.ndarray
    bounds: np.ndarray
    frequent: np.ndarray  # terms too frequent to make a match alone
    rest: np.ndarray  # most that frequent terms add in each block
    short: dict[tuple[bytes, ...], list[int | None]] = field(default_factory=dict)  # ids of items with few words

    @property
    def n_blocks(self) -> int:
        return len(self.rest)


def build_index(items: list[tuple[int | None, str]]) -> Index | None:
    kept, item_of, texts = [], [], []
    short: dict[tuple[bytes, ...], list[int | None]] = {}
    for key, text in items:
        question, answer = question_answer(text or "")
        words = question + answer
        if len(words) < LEAST_WORDS:
            if words:
                short.setdefault(tuple(words), []).append(key)
            continue
        pieces = max(1, -(-len(words) // HALF))
        size = -(-len(words) // pieces)
        for i in range(0, len(words), size):
            item_of.append(len(kept))
            texts.append(words[i : i + size])
        kept.append((key, question, answer))
    if not kept:
        none = np.zeros(0, np.int64)
        return Index([], none, {}, none, none, none, none, none, none, none, none, short) if short else None
    terms: dict[bytes, int] = {}
    rows = []  # term, segment, frequency
    for s, words in enumerate(texts):
        ids, counts = np.unique([terms.setdefault(w, len(terms)) for w in words], return_counts=True)
        rows.append(np.stack([ids, np.full(len(ids), s), counts]))
    term, segment, count = np.concatenate(rows, axis=1)
    n, lengths = len(texts), np.array([len(w) for w in texts])
    df = np.bincount(term, minlength=len(terms))
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    weight = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * lengths[segment] / lengths.mean()))
    weight /= np.bincount(segment, weight, n)[segment]
    order = np.lexsort((segment, term))
    term, segment, weight = term[order], segment[order], weight[order]
    starts = np.searchsorted(term, np.arange(len(terms) + 1))
    n_blocks = -(-n // BLOCK)
    cells, at = np.unique(term * n_blocks + segment // BLOCK, return_inverse=True)
    bounds = np.zeros(len(cells))
    np.maximum.at(bounds, at, weight)
    # Frequent terms, most frequent first, as long as no segment can reach the threshold by them alone.
    frequent, reached, per_segment = np.zeros(len(terms), bool), 0.0, np.zeros(n)
    for t in np.argsort(-df, kind="stable"):
        own = slice(starts[t], starts[t + 1])
        per_segment[segment[own]] += weight[own]
        reached = max(reached, per_segment[segment[own]].max())
        if reached >= RETRIEVE / 2:
            break
        frequent[t] = True
    rest = np.zeros(n)
    of_frequent = frequent[term]
    np.add.at(rest, segment[of_frequent], weight[of_frequent])
    return Index(
        kept, np.array(item_of), terms, starts, segment, weight, np.searchsorted(cells // n_blocks, np.arange(len(terms) + 1)),
        cells % n_blocks, bounds, frequent, np.maximum.reduceat(rest, np.arange(0, n, BLOCK)), short,
    )


def _expand(starts: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all postings of ``terms``, and which of the terms each belongs to."""
    counts = starts[terms + 1] - starts[terms]
    of = np.repeat(np.arange(len(terms)), counts)
    first = np.cumsum(counts) - counts
    return np.arange(len(of)) - first[of] + starts[terms][of], of


def search(words: list[list[bytes]], index: Index) -> list[tuple[int, int, float, int]]:
    """(document, item, score, half passage) for all passages that reach the threshold with a segment of the item.

    A passage is two half passages in a row.  Bounds of blocks come first, from the rarer terms and what frequent
    terms can add at most; only blocks whose bound reaches the threshold are scored, with all their terms.
    """
    lengths = np.array([len(w) for w in words])
    halves = -(-lengths // HALF)
    first = np.cumsum(halves) - halves
    n_halves = int(halves.sum())
    if not n_halves or not index.items:
        return []
    get = index.terms.get
    ids = np.concatenate([np.fromiter(map(get, ws, repeat(-1)), np.int64, len(ws)) for ws in words])
    starts = np.cumsum(lengths) - lengths
    of_doc = np.repeat(np.arange(len(words)), lengths)
    half = first[of_doc] + (np.arange(len(ids)) - starts[of_doc]) // HALF
    known = ids >= 0
    cells = np.unique(half[known] * len(index.terms) + ids[known])  # each term once per half passage
    half, term = cells // len(index.terms), cells % len(index.terms)
    rare = ~index.frequent[term]
    at, of = _expand(index.block_starts, term[rare])
    bound = np.bincount(half[rare][of] * index.n_blocks + index.blocks[at], index.bounds[at], n_halves * index.n_blocks).reshape(n_halves, -1)
    last = np.zeros(n_halves, bool)
    last[(first + halves - 1)[halves > 0]] = True
    both = bound.astype(float)
    both[:-1][~last[:-1]] += bound[1:][~last[:-1]]
    both += index.rest
    found: dict[tuple[int, int, int], float] = {}
    doc_of = np.repeat(np.arange(len(words)), halves)
    ends = np.searchsorted(half, np.arange(n_halves + 1))
    for h, block in np.argwhere(both >= RETRIEVE):
        have = term[ends[h] : ends[h + 1]] if last[h] else np.unique(term[ends[h] : ends[h + 2]])
        places, _ = _expand(index.starts, have)
        inside = index.segments[places] // BLOCK == block
        score = np.bincount(index.segments[places][inside] - block * BLOCK, index.weights[places][inside], BLOCK)
        for s in np.flatnonzero(score >= RETRIEVE):
            key = (int(doc_of[h]), int(index.item_of[block * BLOCK + s]), int(h - first[doc_of[h]]))
            found[key] = max(found.get(key, 0.0), float(score[s]))
    return [(d, i, score, h) for (d, i, h), score in sorted(found.items())]


def verified(words: list[bytes], item: tuple[int, list[bytes], list[bytes]], half: int) -> tuple[float, float]:
    """Overlap of the question and of the answer with the text around the passage."""
    reach = len(item[1]) + len(item[2])
    near = words[max(0, half * HALF - reach) : (half + 2) * HALF + reach]
    return overlap(item[1], near), overlap(item[2], near)


def short_leaks(words: list[bytes], index: Index) -> Iterator[int | None]:
    """Ids of items with few words whose whole word sequence stands in the text."""
    for size in sorted({len(k) for k in index.short}):
        for sequence in sorted(index.short.keys() & grams(words, size)):
            yield from index.short[sequence]


def leaks(texts: list[str | None], index: Index) -> list[tuple[int, int | None, float, float, float]]:
    """(place of the text, item id, score, question overlap, answer overlap) of items with a verified passage, the best of them."""
    words = [plain_words(t) for t in texts]
    best: dict[tuple[int, int], tuple[float, int, float, float]] = {}
    for d, i, score, half in search(words, index):
        if (d, i) in best and best[d, i][:2] > (score, half):
            continue
        question, answer = verified(words[d], index.items[i], half)
        if question >= OVERLAP and answer >= OVERLAP:
            best[d, i] = (score, half, question, answer)
    out = [(d, index.items[i][0], score, question, answer) for (d, i), (score, _, question, answer) in best.items()]
    return out + [(d, key, 1.0, 1.0, 1.0) for d, ws in enumerate(words) for key in short_leaks(ws, index)]


def indexes(items: DataFrame) -> Iterator[Index]:
    """Indexes of the test items (item_id, text), each of a bounded amount of text; the items go by in blocks.

    Items without a word are left out.
    """
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // INDEX_CHARS)
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).select("item_id", "text").toArrow()
        index = build_index(sorted(((i, t) for i, t in zip(rows["item_id"].to_pylist(), rows["text"].to_pylist()) if t), key=lambda r: (r[0] is None, r[0] or 0, r[1])))
        if index:
            yield index


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: a row for each document and test item found in it.

    ``docs`` needs doc_id and text, ``items`` item_id and text.  Score is the BM25 of the best passage that passes the
    overlap check, as a share of the item segment's own; an item under eight words is found as its exact word sequence,
    with score and overlaps 1.  Items with a null id are reported under it.  Null and empty texts match nothing; repeated rows are reported each; items with the same
    text are all reported.  Other columns are not read.  Without items the result is empty.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    found = spark.createDataFrame([], schema)
    for index in indexes(items):
        shared = spark.sparkContext.broadcast(index)

        def scan(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in arrow_parts(batches, limit=2 << 20):
                rows = leaks(part.column("text").to_pylist(), shared.value)
                at, *rest = map(list, zip(*rows)) if rows else ([], [], [], [], [])
                columns = [part.column("doc_id").take(pa.array(at, pa.int64())), pa.array(rest[0], pa.int64()), *[pa.array(x, pa.float64()) for x in rest[1:]]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = found.unionByName(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, schema))
    return found


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no test item is found, all columns as they were."""
    schema = docs.schema
    for index in indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def scan(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in arrow_parts(batches, limit=2 << 20):
                keep = np.ones(part.num_rows, bool)
                keep[[row[0] for row in leaks(part.column("text").to_pylist(), shared.value)]] = False
                yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(scan, schema)
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
