"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network with calibrated output."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ohmwatch.llm.common import arrow_parts, remainder, table, word_runs
from ohmwatch.llm.toxicity import sample_of, sigmoid

#: Word units are hashed to so many buckets; a bucket has a vector of DIMS numbers.
BUCKETS, DIMS = 1 << 13, 32
#: Non-zero entries of an index vector, and how far on each side the context of a unit reaches.
NONZERO, REACH = 2, 2
#: Labelled documents that the network is fitted on at most.
SAMPLE = 10_000
FLAG = 0.3
_EDGES = re.compile(rb"^([^A-Za-z0-9\x80-\xff]*)(.*?)([^A-Za-z0-9\x80-\xff]*)$", re.S)


class Units(dict):
    """Raw word -> up to three units: its letters, the marks around them, and whether it is all capitals.

    It remembers a bounded number of words.
    """

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        before, core, after = _EDGES.match(word).groups()
        found = [b"w" + core.lower()] if core else []
        found += [b"m" + before + b" " + after] if before or after else []
        found += [b"capitals"] if len(core) > 1 and core.isupper() else []
        if len(self) > 300_000:
            self.clear()
        self[word] = units = tuple(zlib.crc32(f) % BUCKETS for f in found)
        return units


def units_of(text: str | None, units: Units) -> np.ndarray:
    return np.fromiter((u for run in word_runs(text, lower=False) for w in run for u in units[w]), np.int32)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's non-zero entries, fixed by a seed."""
    draw = np.random.default_rng(7)
    return draw.integers(0, DIMS, (BUCKETS, NONZERO)), draw.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def context_sums(units: list[np.ndarray]) -> np.ndarray:
    """For each bucket the sum of the index vectors of its neighbours; contexts end with the text."""
    place, sign = index_vectors()
    gap = np.full(REACH, -1, np.int32)
    line = np.concatenate([x for u in units for x in (u, gap)]) if units else gap
    sums = np.zeros(BUCKETS * DIMS)
    for step in range(1, REACH + 1):
        left, right = line[:-step], line[step:]
        pair = (left >= 0) & (right >= 0)
        left, right = left[pair], right[pair]
        for k in range(NONZERO):
            for one, other in ((left, right), (right, left)):
                sums += np.bincount(one * DIMS + place[other, k], sign[other, k], BUCKETS * DIMS)
    return sums.reshape(BUCKETS, DIMS)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all buckets, from the contexts in all texts.

    Each task sums its own contexts into one table of fixed size; Spark adds the tables up, so 8192 rows of whole
    numbers reach the driver, whatever the input.
    """
    columns = [f"d{i}" for i in range(DIMS)]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, total = Units(), np.zeros((BUCKETS, DIMS))
        for part in arrow_parts(batches):
            total += context_sums([units_of(t, units) for t in part.column("text").to_pylist()])
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *[pa.array(total[used, i].astype(np.int64)) for i in range(DIMS)]], ["bucket", *columns])

    sums = docs.select("text").mapInArrow(scan, ", ".join(["bucket long", *[f"{c} long" for c in columns]]))
    rows = sums.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    vectors = np.zeros((BUCKETS, DIMS))
    if rows.num_rows:
        vectors[rows["bucket"].to_numpy()] = np.stack([rows[c].to_numpy() for c in columns], axis=1)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
    return vectors.astype(np.float32)


def pooled(units: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A document's features: mean and mean square of its units' vectors, length of the mean, agreement of neighbours, log size."""
    n = len(units)
    total, square, agree = np.zeros(DIMS), np.zeros(DIMS), 0.0
    for start in range(0, n, 1 << 18):
        v = vectors[units[max(0, start - 1) : start + (1 << 18)]]
        agree += float(np.einsum("ij,ij->", v[:-1], v[1:]))
        v = v[1:] if start else v
        total += v.sum(axis=0)
        square += np.einsum("ij,ij->j", v, v)
    mean = total / max(n, 1)
    return np.concatenate([mean, square / max(n, 1), [np.linalg.norm(mean), agree / max(n - 1, 1), np.log1p(n)]])


@dataclass
class Network:
    centre: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.centre) / self.scale, -5, 5) @ self.hidden + self.hidden_bias) @ self.out + self.out_bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def _log_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def train(x: np.ndarray, y: np.ndarray, width: int = 32, rounds: int = 600, rate: float = 0.01, decay: float = 1e-3) -> Network:
    """A network fitted on four fifths of the rows; the rest choose the round to stop at and the temperature."""
    draw = np.random.default_rng(11)
    if len(y) < 10 or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        n = x.shape[1]
        return Network(np.zeros(n), np.ones(n), np.zeros((n, width)), np.zeros(width), np.zeros(width), float(np.log(share / (1 - share))))
    check = np.arange(len(y)) % 5 == 0
    centre, scale = x[~check].mean(axis=0), x[~check].std(axis=0) + 1e-6
    p = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], width)), np.zeros(width), draw.normal(0, 0.1, width), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    xs = np.clip((x - centre) / scale, -5, 5)
    xt, yt, xc, yc = xs[~check], y[~check], xs[check], y[check]
    best, kept = np.inf, [a.copy() for a in p]
    for step in range(1, rounds + 1):
        h = np.tanh(xt @ p[0] + p[1])
        d = (sigmoid(h @ p[2] + p[3]) - yt) / len(yt)
        dh = np.outer(d, p[2]) * (1 - h * h)
        for i, g in enumerate((xt.T @ dh + decay * p[0], dh.sum(axis=0), h.T @ d + decay * p[2], np.array([d.sum()]))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        if step % 10 == 0:
            loss = _log_loss(np.tanh(xc @ p[0] + p[1]) @ p[2] + p[3], yc)
            if loss < best:
                best, kept = loss, [a.copy() for a in p]
    net = Network(centre, scale, kept[0], kept[1], kept[2], float(kept[3][0]))
    z = net.logits(x[check])
    net.temperature = min(np.geomspace(0.25, 4, 65), key=lambda t: _log_loss(z / t, yc))
    return net


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, limit: int = SAMPLE, divisor: int = 5, left_out: int = 0) -> Network:
    """The network from at most ``limit`` labelled documents (doc_id, quality) whose id is not held out.

    Texts are pooled where they are; the driver gets one feature vector for each document of the sample.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units()
        for part in arrow_parts(batches):
            rows = [pooled(units_of(t, units), shared.value).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), part.column("label").cast(pa.int32())], ["x", "label"])

    rows = sample_of(docs, labels, "quality", divisor, left_out, limit).mapInArrow(scan, "x binary, label int").toArrow()
    order = sorted(zip(rows["x"].to_pylist(), rows["label"].to_pylist()))
    order = [order[i] for i in np.random.default_rng(3).permutation(len(order))]  # the same whatever order rows came in
    x = np.array([np.frombuffer(b) for b, _ in order]) if order else np.zeros((0, 2 * DIMS + 3))
    return train(x, np.array([float(y) for _, y in order]))


def quality(docs: DataFrame, vectors: np.ndarray, network: Network) -> DataFrame:
    """doc_id, score: the probability of good quality for each row of ``docs`` (doc_id, text).

    Null, empty and blank texts have zero features and score what the network makes of them.  Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units()
        vectors, network = shared.value
        for part in arrow_parts(batches):
            rows = [pooled(units_of(t, units), vectors) for t in part.column("text").to_pylist()]
            score = network.probability(np.array(rows).reshape(len(rows), -1)) if rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    vectors = word_vectors(docs)
    scored = quality(docs, vectors, fit(docs, labels, vectors))
    held_out = remainder(F.col("doc_id"), 5) == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= FLAG).cast("int").alias("predicted"))
