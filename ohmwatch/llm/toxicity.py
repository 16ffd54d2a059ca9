"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learnt from document labels."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ohmwatch.llm.common import arrow_parts, remainder, table, word_runs

BUCKETS = 1 << 18
#: Labelled documents that the model is fitted on at most.
SAMPLE = 6_000
#: A score from here on counts as toxic.
FLAG = 0.3
#: The filter drops documents from this score on.
REJECT = 0.5
_EDGE = re.compile(rb"^[^a-z0-9\x80-\xff]+|[^a-z0-9\x80-\xff]+$")
_STOPS = (b".", b"!", b"?")


class Coder(dict):
    """Raw word -> 2 * bucket + 1 if it ends a sentence.  Bucket 0 is for words without a letter or digit.

    It remembers what it has seen, up to a bounded number of words.
    """

    def __missing__(self, word: bytes) -> int:
        core = _EDGE.sub(b"", word)
        code = 2 * (1 + zlib.crc32(core) % (BUCKETS - 1) if core else 0) + word.rstrip(b"\"')]}").endswith(_STOPS)
        if len(self) > 300_000:
            self.clear()
        self[word] = code
        return code


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def codes_of(text: str | None, coder: Coder) -> np.ndarray:
    """A code for each word; a line break ends a sentence."""
    runs = word_runs(text.replace("\n", " . ")) if text else ()
    parts = [np.fromiter(map(coder.__getitem__, words), np.int32, len(words)) for words in runs]
    return np.concatenate(parts) if parts else np.empty(0, np.int32)


def sentence_starts(codes: np.ndarray) -> np.ndarray:
    """Where sentences begin."""
    if not len(codes):
        return np.empty(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(codes[:-1] & 1) + 1])


def sentence_logits(codes: np.ndarray, starts: np.ndarray, model: Model) -> np.ndarray:
    return np.add.reduceat(model.weights[codes >> 1], starts) + model.bias


def sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -z))


def train(docs: list[np.ndarray], labels: np.ndarray, rounds: int = 200, rate: float = 1.0, l1: float = 0.00005, least: int = 5) -> Model:
    """Weights that minimise the log loss of the noisy-or, by gradient steps with a step size for each weight.

    They start from how much more often toxic documents have the word, as far as that is beyond chance (two standard
    errors); a penalty on absolute weights keeps words that tell little at zero.  Words in fewer than ``least`` documents take no part.
    """
    weights, prior = np.zeros(BUCKETS), float(np.clip(labels.mean() if len(labels) else 0.0, 1e-4, 0.9))
    keep = [i for i, d in enumerate(docs) if len(d)]
    if not keep:
        return Model(weights.astype(np.float32), -20.0)
    y = labels[keep].astype(float)
    seen = np.bincount(np.concatenate([np.unique(docs[i] >> 1) for i in keep]), minlength=BUCKETS)
    seen[0] = 0
    starts = [sentence_starts(docs[i]) for i in keep]
    of_doc = np.repeat(np.arange(len(keep)), [len(s) for s in starts])
    n_sentences = len(of_doc)
    base = np.cumsum([0, *[len(docs[i]) for i in keep]])
    ends = np.concatenate([s + b for s, b in zip(starts, base)])
    words = np.concatenate([docs[i] for i in keep]) >> 1
    of_sentence = np.repeat(np.arange(n_sentences), np.diff(np.append(ends, len(words))))
    used = seen[words] >= least
    words, of_sentence = words[used], of_sentence[used]
    ids, words = np.unique(words, return_inverse=True)
    toxic = np.bincount(np.concatenate([[0], *[np.unique(docs[i] >> 1) for i in keep if labels[i] == 1]]), minlength=BUCKETS)[ids] + 0.5
    clean = seen[ids] + 1 - toxic
    odds = np.log(toxic / clean) - np.log((y.sum() + 1) / ((1 - y).sum() + 1))
    w = np.sign(odds) * np.maximum(np.abs(odds) - 2 * np.sqrt(1 / toxic + 1 / clean), 0)
    b = float(np.log(prior * len(keep) / n_sentences))
    gw2, gb2 = np.full(len(ids), 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(of_sentence, w[words], n_sentences) + b
        s = np.maximum(np.bincount(of_doc, np.logaddexp(0, z), len(keep)), 1e-9)
        slope = np.where(y == 1, -1 / np.expm1(np.minimum(s, 500)), 1.0)
        gz = slope[of_doc] * sigmoid(z)
        g = np.bincount(words, gz[of_sentence], len(ids)) / len(keep)
        gb = gz.sum() / len(keep)
        gw2 += g * g
        gb2 += gb * gb
        step = rate / np.sqrt(gw2)
        w -= step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b -= rate * gb / np.sqrt(gb2)
    weights[ids] = w
    return Model(weights.astype(np.float32), float(b))


def sample_of(docs: DataFrame, labels: DataFrame, label: str, divisor: int, left_out: int, limit: int) -> DataFrame:
    """Texts with labels (text, label) of at most ``limit`` documents outside the held-out fold, chosen by a hash of the id."""
    marked = labels.filter(F.col(label).isNotNull() & (remainder(F.col("doc_id"), divisor) != left_out))
    chosen = marked.groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, divisor: int = 4, left_out: int = 2) -> Model:
    """A model from at most ``limit`` labelled documents (doc_id, toxic) whose id is not held out.

    Words are coded where the texts are; the driver gets a number for each word of the sample.  Without labels
    every score is near 0.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for part in arrow_parts(batches):
            codes = [codes_of(t, coder).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.binary()), part.column("label").cast(pa.int32())], ["codes", "label"])

    rows = sample_of(docs, labels, "toxic", divisor, left_out, limit).mapInArrow(scan, "codes binary, label int").toArrow()
    order = sorted(zip(rows["codes"].to_pylist(), rows["label"].to_pylist()))  # the fit must not depend on row order
    return train([np.frombuffer(c, np.int32) for c, _ in order], np.array([y for _, y in order]))


def judge(texts: list[str | None], model: Model, coder: Coder) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Score, number of sentences, place of the worst sentence (-1: none) and its score, for each text."""
    n, worst, worst_p, score = len(texts), np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts))
    counts = np.zeros(n, np.int64)
    for i, text in enumerate(texts):
        codes = codes_of(text, coder)
        if len(codes):
            z = sentence_logits(codes, sentence_starts(codes), model)
            counts[i], worst[i] = len(z), z.argmax()
            worst_p[i] = sigmoid(z[worst[i]])
            # 1 minus the product of (1 - p) over the sentences
            score[i] = -np.expm1(-np.logaddexp(0, z).sum(dtype=np.float64))
    return score, counts, worst, worst_p


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_sentences, worst_sentence, worst_score: one row per row of ``docs`` (doc_id, text).

    Null, empty and blank texts have no sentence: score 0 and worst_sentence -1.  Repeated rows are scored each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for part in arrow_parts(batches):
            score, counts, worst, worst_p = judge(part.column("text").to_pylist(), shared.value, coder)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(score), pa.array(counts), pa.array(worst), pa.array(worst_p)],
                ["doc_id", "score", "n_sentences", "worst_sentence", "worst_score"],
            )

    schema = "doc_id long, score double, n_sentences long, worst_sentence long, worst_score double"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, schema)


def offending(docs: DataFrame, model: Model, least: float = FLAG) -> DataFrame:
    """doc_id, sentence_no, score, words: the sentences that score ``least`` or more, words space-joined in lower case."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, out = Coder(), ([], [], [], [])
        for part in arrow_parts(batches):
            for key, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                codes = codes_of(text, coder)
                starts = sentence_starts(codes)
                if not len(starts):
                    continue
                p = sigmoid(sentence_logits(codes, starts, shared.value))
                bad = np.flatnonzero(p >= least)
                if len(bad):
                    words = [w for run in word_runs(text.replace("\n", " . ")) for w in run]
                    ends = np.append(starts, len(words))
                    for s in bad:
                        found = b" ".join(words[ends[s] : ends[s + 1]]).decode("utf-8", "surrogatepass")
                        for column, value in zip(out, (key, int(s), float(p[s]), found)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.string())], ["doc_id", "sentence_no", "score", "words"])
            out = ([], [], [], [])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, sentence_no long, score double, words string")


def drop_toxic(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """The documents that score below ``reject``, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for part in arrow_parts(batches):
            score = judge(part.column("text").to_pylist(), shared.value, coder)[0]
            yield part.filter(pa.array(score < reject))

    return docs.mapInArrow(scan, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held_out = remainder(F.col("doc_id"), 4) == 2
    return toxicity(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= FLAG).cast("int").alias("predicted"), "n_sentences", "worst_sentence", "worst_score"
    )
