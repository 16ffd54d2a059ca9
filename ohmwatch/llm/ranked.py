"""Ranked lexical search for many queries at once, by common subexpressions.

A score is a sum over a query's terms, so queries that share terms share partial sums.  Terms that stand together in
several queries are mined into nodes of two, round by round; the nodes form a sharing DAG whose leaves are terms.  For
a block of documents each node's accumulator is made once, from its two parts, and a query adds up the few nodes that
are left of it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ohmwatch.llm.common import arrow_parts, store, table

#: Terms are runs of digits, letters and whatever is not ASCII; A-Z count as a-z.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
TOP = 10
#: Pairs of query and term that one pass over the documents answers, on average; more queries take more passes.
PASS_PAIRS = 1 << 17
#: Cells of accumulators that are held at once.
CELLS = 1 << 21
#: Bytes of text that are cut into terms at once.
RUN = 1 << 20


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, repeats included, in lists made from about ``RUN`` bytes each."""
    data = text.encode("utf-8", "surrogatepass").translate(_PLAIN) if text else b""
    start = 0
    while start < len(data):
        end = data.find(b" ", start + RUN)
        end = len(data) if end < 0 else end
        yield (data[start:end] if start or end < len(data) else data).split()
        start = end


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, term: the distinct terms of each item; rows with the same id are one item, null ids too."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_parts(batches):
            found = [sorted({t for run in terms_of(text.as_py()) for t in run}) for text in part.column("text")]
            owner = np.repeat(np.arange(len(found)), list(map(len, found)))
            yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(owner, pa.int64())), pa.array([t for f in found for t in f], pa.binary())], ["item_id", "term"])

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(scan, "item_id long, term binary").distinct()


def mined(queries: list[list[int]], leaves: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Nodes (left, right), numbered from ``leaves`` on, and for each query the nodes and leaves that add up to it.

    A query's parts stand in order of how many queries have them.  In each round neighbours that are together in two
    queries or more become a node, the most frequent first; a part goes into one node a round.
    """
    nodes: list[tuple[int, int]] = []
    while True:
        held = Counter(p for q in queries for p in q)
        queries = [sorted(q, key=lambda p: (-held[p], p)) for q in queries]
        together: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for i, q in enumerate(queries):
            for at, pair in enumerate(zip(q, q[1:])):
                together.setdefault(pair, []).append((i, at))
        taken: set[tuple[int, int]] = set()
        before = len(nodes)
        for pair, places in sorted(together.items(), key=lambda x: (-len(x[1]), x[0])):
            free = [(i, at) for i, at in places if (i, at) not in taken and (i, at + 1) not in taken]
            if len(free) > 1:
                for i, at in free:
                    taken |= {(i, at), (i, at + 1)}
                    queries[i][at], queries[i][at + 1] = leaves + len(nodes), -1
                nodes.append(pair)
        if len(nodes) == before:
            return nodes, queries
        queries = [[p for p in q if p >= 0] for q in queries]


class Plan:
    """The sharing DAG of one pass: levels of nodes, and each query's parts."""

    def __init__(self, item_ids: list[int | None], queries: list[list[int]], leaves: int):
        nodes, parts = mined(queries, leaves)
        self.item_ids, self.leaves, self.size = item_ids, leaves, leaves + len(nodes)
        depth = np.zeros(self.size, np.int64)
        for at, (left, right) in enumerate(nodes):
            depth[leaves + at] = 1 + max(depth[left], depth[right])
        pairs = np.array(nodes, np.int64).reshape(-1, 2)
        self.levels = []
        for d in range(1, int(depth.max(initial=0)) + 1):
            at = np.flatnonzero(depth == d)
            self.levels.append((at, pairs[at - leaves, 0], pairs[at - leaves, 1]))
        self.parts = np.array([p for q in parts for p in q], np.int64)
        self.starts = np.cumsum([0, *map(len, parts[:-1])])

    def scores(self, term: np.ndarray, doc: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
        """Scores of each query (row) for each document (column), from the weights of the documents' terms."""
        sums = np.zeros((self.size, docs), np.int64)
        sums[term, doc] = weight
        for at, left, right in self.levels:
            sums[at] = sums[left] + sums[right]
        return np.add.reduceat(sums[self.parts], self.starts, axis=0)

    def block(self) -> int:
        """Documents whose accumulators are made together."""
        return max(1, CELLS // (self.size + len(self.parts)))


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, tfs: length and counts of the vocabulary's terms of each document with any term."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most the terms of one pass

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = known.value.get
        for part in arrow_parts(batches):
            ids, sizes, terms, tfs, ends = [], [], [], [], [0]
            for doc_id, text in zip(part.column("doc_id"), part.column("text")):
                n, seen = 0, Counter()
                for run in terms_of(text.as_py()):
                    n += len(run)
                    seen.update(map(of, run))
                if n:
                    seen.pop(None, None)
                    ids.append(doc_id.as_py()), sizes.append(n)
                    terms += seen.keys()
                    tfs += seen.values()
                    ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(values, kind)) for values, kind in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, n long, terms array<int>, tfs array<long>")


def _best(rows: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of rows (query, null id, doc_id, score) the k best of each query, ties by id."""
    query, none, doc, score = rows
    order = np.lexsort((doc, none, -score, query))
    query = query[order]
    kept = order[np.arange(len(order)) - np.searchsorted(query, query) < k]
    return [c[kept] for c in rows]


def best_of_tasks(docs: DataFrame, plan: Plan, weights: np.ndarray, mean: tuple[int, int], k: int) -> DataFrame:
    """item_id, doc_id, score: what each task found best among the documents (as ``counted`` gives them) for each query."""
    shared = docs.sparkSession.sparkContext.broadcast((plan, weights))  # at most the terms of one pass
    total, terms_in_all = mean

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weights = shared.value
        nothing = np.zeros(0, np.int64)
        best = [nothing, np.zeros(0, bool), nothing, nothing]
        floor = np.ones(len(plan.item_ids), np.int64)
        step = plan.block()
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                lists = part.column("terms")
                doc = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                term, tf = lists.flatten().to_numpy(), part.column("tfs").flatten().to_numpy()
                m = 10 + 90 * part.column("n").to_numpy() * total // terms_in_all
                weight = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                scores = plan.scores(term, doc, weight, part.num_rows)
                query, at = np.nonzero(scores >= floor[:, None])
                ids = part.column("doc_id")
                none = np.array(ids.is_null())[at]
                found = [query, none, ids.fill_null(0).to_numpy()[at], scores[query, at]]
                best = _best([np.concatenate(pair) for pair in zip(best, found)], k)
                full = np.bincount(best[0], minlength=len(floor)) >= k
                least = np.full(len(floor), np.iinfo(np.int64).max)
                np.minimum.at(least, best[0], best[3])
                floor = np.where(full, np.maximum(least, 1), 1)
        ids = pa.array(plan.item_ids, pa.int64()).take(pa.array(best[0]))
        yield pa.RecordBatch.from_arrays([ids, pa.array(best[2], mask=best[1]), pa.array(best[3])], ["item_id", "doc_id", "score"])

    return docs.mapInArrow(scan, "item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, pass_pairs: int = PASS_PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest score above 0 for each item, ties by doc_id.

    ``docs`` needs doc_id and text, ``items`` item_id and text; other columns are not read.  Null and empty texts have
    no terms and neither count nor match.  Rows with the same item_id, null included, are one item with the terms of
    all.  Every row of ``docs`` is a document of its own, so repeated rows take ranks of their own; null ids come
    last among equals.  Very long texts are cut in runs.  No items or no documents give no rows.  Items are dealt
    into passes of a bounded number of terms; the documents are read once to count and once to score in each pass.
    """
    wanted = store(query_terms(items), "query_terms")
    passes = max(1, -(-wanted.count() // pass_pairs))
    wanted = wanted.withColumn("pass", F.pmod(F.xxhash64("item_id"), F.lit(passes)))
    found, totals = None, None
    for number in range(passes):
        mine = wanted.filter(F.col("pass") == number).select("item_id", "term").toArrow()  # one pass of items, by its bound
        vocabulary = {term: i for i, term in enumerate(sorted(set(mine["term"].to_pylist())))}
        if not vocabulary:
            continue
        queries: dict[int | None, list[int]] = {}
        for item, term in zip(mine["item_id"].to_pylist(), mine["term"].to_pylist()):
            queries.setdefault(item, []).append(vocabulary[term])
        order = sorted(queries, key=lambda i: (i is None, i))
        plan = Plan(order, [queries[i] for i in order], len(vocabulary))
        counts = store(counted(docs, vocabulary), "counts")
        totals = totals or counts.agg(F.count("*"), F.sum("n")).first()
        if not totals[0]:
            break
        df = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        weigh = F.floor(1000 * F.log((2 * F.lit(totals[0]) + 2) / (2 * F.col("df") + 1))).cast("long").alias("w")
        known = df.select("term", weigh).toArrow()  # at most the terms of one pass
        weights = np.zeros(len(vocabulary), np.int64)
        weights[known["term"].to_numpy()] = known["w"].to_numpy()
        some = store(best_of_tasks(counts, plan, weights, (totals[0], totals[1]), k), "best")
        found = some if found is None else found.unionByName(some)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    place = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = rf"""
WITH words AS (
  SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS row FROM documents)
), sizes AS (SELECT row, any_value(doc_id) AS doc_id, count(*)::BIGINT AS n FROM words GROUP BY row
), whole AS (SELECT count(*)::BIGINT AS total, sum(n)::BIGINT AS held FROM sizes
), asked AS (
  SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM benchmark)
), tfs AS (SELECT row, term, count(*)::BIGINT AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY row, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(total) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tfs CROSS JOIN whole GROUP BY term
), scored AS (
  SELECT a.item_id, s.doc_id, s.row, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * total) // held))))::BIGINT AS score
  FROM asked a JOIN tfs USING (term) JOIN weights USING (term) JOIN sizes s ON s.row = tfs.row CROSS JOIN whole GROUP BY a.item_id, s.doc_id, s.row
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
) WHERE rank <= 10
"""
