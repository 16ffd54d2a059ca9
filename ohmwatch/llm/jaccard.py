"""N-gram Jaccard join by adaptive multi-match prefixes.

The shingles of every document stand in one order, rare ones first.  Documents that are similar enough share at least
l of the first ``n - ceil(n * t) + l`` shingles of both, for any l up to ``ceil(n * t)``: a longer prefix demands more
matches.  Each document takes the l that promises the least work, and a pair is verified when it shares as many prefix
shingles as the smaller l of the two.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ohmwatch.llm.common import arrow_parts, store, table, word_runs
from ohmwatch.llm.components import roots
from ohmwatch.session import small_or_stored

SHINGLE = 5
#: Least similarity, as a fraction of whole numbers: the pair is compared in integers.
OVER, UNDER = 80, 100
SEED = 42
#: Cells in which shingles are counted; a cell's count stands for the frequency of its shingles.
CELLS = 1 << 18
#: Greatest number of matches that a prefix may demand, and the work of verifying one shingle against reading one posting.
MOST_MATCHES, VERIFY = 16, 0.05
#: Longs in the parity bits of a set.
WIDE = 16
#: Postings expected of a shingle from which its list is not gathered in one task.
HOT = 50_000
#: Pairs between components, for each posting, that are met without a further round of pivots: their parity bits are
#: compared inside the join, which costs less than a round.
PAIRS = 256
#: Places of the filter that thins the texts out before those to verify are joined.
SLOTS = 1 << 18
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def mixed(values: np.ndarray, number: int = 1) -> np.ndarray:
    values = (values ^ np.uint64(0x9E3779B97F4A7C15 * number % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(32))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; fewer words are one shingle, none give an empty set."""
    hashed = [np.fromiter(map(xxhash.xxh64_intdigest, run, repeat(SEED)), np.uint64, len(run)) for run in word_runs(text)]
    words = np.concatenate(hashed) if hashed else np.zeros(0, np.uint64)
    if not len(words):
        return words
    size = min(size, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        total += mixed(words[i : len(words) - size + 1 + i], i + 2) * np.uint64(_ODD[i % len(_ODD)])
    return np.unique(mixed(total))


def cells_of(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(40)).astype(np.int64) % CELLS


def set_key(found: np.ndarray) -> bytes:
    """128 bits that stand for the set."""
    return np.array([found.sum(dtype=np.uint64), mixed(found, 3).sum(dtype=np.uint64) + np.uint64(len(found))], np.uint64).tobytes()


def parity(found: np.ndarray, wide: int = WIDE) -> np.ndarray:
    """Bits of which each shingle turns one over: two sets differ in at least as many shingles as bits.

    The bits of ``2 * wide`` longs, their second half turned over on the first, are those of ``wide``.
    """
    odd = np.bincount((found % np.uint64(64 * wide)).astype(np.int64), minlength=64 * wide) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def long_parity(found: np.ndarray) -> np.ndarray:
    """Parity bits of a set for which ``WIDE`` longs say little: one to two bits for each shingle, else none."""
    wide = 1 << max(0, int(2 * len(found) // 64).bit_length() - 1)
    return parity(found, wide) if wide > WIDE else np.zeros(0, np.int64)


def least_overlap(n: np.ndarray | int) -> np.ndarray | int:
    """Shingles that a set of n shares with any set similar to it."""
    return -(-n * OVER // UNDER)


def matches(n: int, others: np.ndarray) -> int:
    """How many prefix shingles a set of n should demand; ``others`` is the expected number of other postings of each.

    The prefix for l has ``n - least_overlap(n) + l`` shingles; its postings are read, and at most their number over l
    documents share l of them and are verified.
    """
    least = int(least_overlap(n))
    wanted = np.arange(1, min(MOST_MATCHES, least) + 1)
    length = n - least + wanted
    read = np.cumsum(others)[length - 1]
    return int(wanted[np.argmin(length + read * (1 + VERIFY * n / wanted))])


def _scanned(docs: DataFrame) -> DataFrame:
    """Set size, key and parity bits of each row, and from each task the counts of the shingles of its rows by cell."""
    bits = ", ".join(f"b{i} long" for i in range(WIDE))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CELLS, np.int64)
        names = ["doc_id", "ref", "n", "key", *[f"b{i}" for i in range(WIDE)], "wide", "cells"]
        for part in arrow_parts(batches):
            size, keys, parities, wide = [], [], [], []
            for text in part.column("text"):
                found = shingle_set(text.as_py())
                np.add.at(seen, cells_of(found), 1)
                size.append(len(found)), keys.append(set_key(found)), parities.append(parity(found)), wide.append(long_parity(found))
            columns = np.array(parities, np.int64).reshape(len(size), WIDE).T
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("ref"), pa.array(size, pa.int64()), pa.array(keys, pa.binary()), *map(pa.array, columns), pa.array(wide, pa.list_(pa.int64())), pa.nulls(len(size), pa.binary())], names
            )
        nothing = [pa.nulls(1, pa.int64())] * 3 + [pa.nulls(1, pa.binary())] + [pa.nulls(1, pa.int64())] * WIDE + [pa.nulls(1, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*nothing, pa.array([seen.astype("<i8").tobytes()], pa.binary())], names)

    return _referred(docs).mapInArrow(scan, f"doc_id long, ref long, n long, key binary, {bits}, wide array<long>, cells binary")


def _referred(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["doc_id"].cast("long"), text).alias("ref"), text.alias("text"))


def _added(cells: DataFrame) -> np.ndarray:
    """Sum of the tasks' counts, level by level: few arrays meet in one task and in the driver."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for one in batch.column("cells"):
                total += np.frombuffer(one.as_py(), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["cells"])

    tasks = cells.count()
    while tasks > 8:
        tasks = -(-tasks // 32)
        cells = store(cells.repartition(tasks).mapInArrow(add, "cells binary"), "cells")
    return sum((np.frombuffer(row["cells"], "<i8") for row in cells.collect()), np.zeros(CELLS, np.int64))


def _postings(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """token, key, least (matches the document demands), hot: the prefix of each document; copies in a task once."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # CELLS numbers, whatever the input

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        usual = counts.mean()
        others = np.maximum(counts - usual - 4 * np.sqrt(usual) - 1, 0.0)
        met: set[bytes] = set()
        for part in arrow_parts(batches):
            rows = []
            for text in part.column("text"):
                found = shingle_set(text.as_py())
                key = set_key(found)
                if not len(found) or key in met:
                    continue
                met.add(key)
                cell = cells_of(found)
                order = np.lexsort((found, counts[cell]))
                longest = min(len(found), len(found) - int(least_overlap(len(found))) + MOST_MATCHES)
                order = order[:longest]
                wanted = matches(len(found), others[cell[order]])
                order = order[: len(found) - int(least_overlap(len(found))) + wanted]
                rows.append((found[order].view(np.int64), key, wanted, others[cell[order]] > HOT))
            if len(met) > 1 << 20:
                met.clear()
            if rows:
                token, key, wanted, hot = zip(*rows)
                owner = np.repeat(np.arange(len(rows)), [len(t) for t in token])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(token)), pa.array(key, pa.binary()).take(pa.array(owner)),
                        pa.array(np.array(wanted, np.int32)[owner]), pa.array(np.concatenate(hot)),
                    ],
                    ["token", "key", "least", "hot"],
                )

    return docs.select("text").mapInArrow(scan, "token long, key binary, least int, hot boolean")


def _met_again(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by token and short key, those whose token has another key; repeated ones once.

    ``held`` is the number of keys met with the token; a list that goes on in the next batch is counted in parts.
    """
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
        if rows.num_rows < 2:
            held = rows
            continue
        token = rows["token"].to_numpy()
        same_token = token[1:] == token[:-1]
        same_key = np.array(pc.equal(rows["short"].slice(1), rows["short"].slice(0, rows.num_rows - 1)))
        fresh = np.concatenate([[True], ~(same_token & same_key)])
        rows, token = rows.filter(pa.array(fresh)), token[fresh]
        again = np.concatenate([[False], token[1:] == token[:-1]])
        # The last row waits for the next batch; a row before it of the same token goes out now and is told by a mark.
        marked = np.array(rows["more"])
        marked |= again
        marked[:-1] |= again[1:]
        rows = rows.set_column(rows.schema.get_field_index("more"), rows.schema.field("more"), pa.array(marked))
        run = np.cumsum(~again) - 1
        rows = rows.set_column(rows.schema.get_field_index("held"), rows.schema.field("held"), pa.array(np.maximum(2, np.bincount(run)[run]).astype(np.int32)))
        held = rows.slice(rows.num_rows - 1)
        yield from rows.slice(0, rows.num_rows - 1).filter(pa.array(marked[:-1])).combine_chunks().to_batches()
    if held is not None and held.num_rows:
        yield from held.filter(held["more"]).combine_chunks().to_batches()


def shared_postings(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """token, short, least, hot, held: prefix postings, each once, of tokens that several documents have in their prefix.

    The list of a token expected in many documents (``hot``) is dealt out by key and kept as it is.  Most postings are
    of tokens that nobody shares, so they are shuffled with 64 bits of the key (``short``) and nothing known elsewhere.
    """
    rows = _postings(docs, counts).select("token", short("key").alias("short"), "least", "hot")
    salt = F.when(F.col("hot"), F.col("short")).otherwise(F.lit(0))
    dealt = rows.repartition("token", salt).sortWithinPartitions("token", "short")
    dealt = dealt.withColumn("held", F.lit(2)).withColumn("more", F.col("hot"))
    return dealt.mapInArrow(_met_again, "token long, short long, least int, hot boolean, held int, more boolean").drop("more")


def short(key: str) -> Column:
    """64 bits of a key, as many as name a shingle: classes that agree in them by chance pass for one in the lists."""
    return F.xxhash64(key)


def _members(reps: DataFrame, postings: DataFrame) -> DataFrame:
    """token, key, n, least, hot, central: the postings with the short numbers of classes for keys, shuffled once for it.

    Postings shared with many others make a good pivot, a central one: the text that the others of a group were made from.
    """
    length = F.floor((F.col("n") * (UNDER - OVER)) / UNDER) + F.col("least")
    central = F.sum(F.log("held") / length).over(Window.partitionBy("short", "num")).cast("float")
    known = reps.select(short("key").alias("short"), "num", F.col("n").cast("int").alias("n"))
    numbered = postings.join(known, "short").withColumn("central", central)
    return numbered.select("token", F.col("num").alias("key"), "n", "least", "hot", "central")


def _lengths(a: str, b: str):
    """Sizes that similar sets may have."""
    return F.least(a, b) * UNDER >= F.greatest(a, b) * OVER


def _few_bits(a: str, b: str, n_a: str, n_b: str):
    """Whether the parity bits leave room for the similarity: sets of sizes n and m differ in (n + m)(1 - t) / (1 + t) shingles at most."""
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in range(WIDE)])
    return differ * (UNDER + OVER) <= (F.col(n_a) + F.col(n_b)) * (UNDER - OVER)


def _few_long_bits(a: str, b: str, n_a: str, n_b: str):
    """The same with the longer bits of long sets, folded to the shorter length of the two; where one has none, they say nothing."""
    length = F.least(F.size(a), F.size(b))
    folded = lambda c: F.when(F.size(c) == length, F.col(c)).otherwise(
        F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.get(F.col(c), i).bitwiseXOR(F.get(F.col(c), i + length)))
    )
    differ = F.aggregate(F.zip_with(folded(a), folded(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(length > 0, differ * (UNDER + OVER) <= (F.col(n_a) + F.col(n_b)) * (UNDER - OVER)).otherwise(F.lit(True))


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in arrow_parts(batches):
        found = [shingle_set(text.as_py()) for text in part.column("text")]
        own = [set_key(one) == key.as_py() for one, key in zip(found, part.column("key"))]  # not another text with the same ref
        found = [one for one, right in zip(found, own) if right]
        ends = np.cumsum([0, *map(len, found)])
        values = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([part.column("num").filter(pa.array(own, pa.bool_())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], ["key", "tokens"])


def _sets_of(docs: DataFrame, reps: DataFrame, keys: DataFrame) -> DataFrame:
    """key, tokens: the whole shingle sets of some classes, named by number, made from the text of one row of each.

    Rows that cannot be wanted are taken out by a filter of at most ``SLOTS`` places before texts are shuffled.
    """
    wanted = reps.join(keys, F.col("num") == keys["key"], "left_semi").select("num", F.col("key").alias("key"), F.col("ref").alias("_ref"))
    wanted = store(wanted, "wanted")
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    slots = F.broadcast(wanted.select(slot("_ref").alias("_slot")).distinct())
    thinned = _referred(docs).select("ref", "text").withColumn("_slot", slot("ref")).join(slots, "_slot", "left_semi")
    return thinned.join(wanted, F.col("ref") == F.col("_ref")).select("text", "key", "num").mapInArrow(_sets, "key long, tokens array<long>")


def _linked(docs: DataFrame, reps: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """Those of the distinct pairs (a, b) that are similar: parity bits first, then whole sets."""
    side = lambda k: reps.select(F.col("num").alias(k), F.col("n").alias(f"n_{k}"), F.col("wide").alias(f"wide_{k}"), *[F.col(f"b{i}").alias(f"{k}_{i}") for i in range(WIDE)])
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(_lengths("n_a", "n_b") & _few_bits("a_", "b_", "n_a", "n_b"))
    near = store(near.filter(_few_long_bits("wide_a", "wide_b", "n_a", "n_b")).select("a", "b"), f"{name}_near")
    if near.isEmpty():
        return near
    sets = store(_sets_of(docs, reps, near.select(F.explode(F.array("a", "b")).alias("key")).distinct()), f"{name}_sets")
    both = near.join(sets.select(F.col("key").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("tokens").alias("y")), "b")
    shared = both.select("a", "b", (F.size("x") + F.size("y")).alias("sizes"), F.size(F.array_intersect("x", "y")).alias("common"))
    return store(shared.filter(F.col("common") * UNDER >= (F.col("sizes") - F.col("common")) * OVER).select("a", "b").distinct(), f"{name}_links")


def _pivots(now: DataFrame, crowded: bool) -> DataFrame:
    """``now`` with ``p``: the most central member of the list that is outside its largest component.

    A list is gathered in one task, but for hot ones, whose pivots are aggregated and joined.
    """
    who, rank = F.struct("key", "root", "n"), F.struct("central", "key")
    minor = F.col("major").isNull() | (F.col("root") != F.col("major"))
    placed = now.withColumn("place", F.when(F.col("hot"), F.xxhash64("key")).otherwise(F.lit(0)))
    placed = placed.withColumn("p", F.max_by(who, F.when(minor, rank)).over(Window.partitionBy("token", "place")))
    if not crowded:
        return placed
    most = small_or_stored(now.filter(F.col("hot") & minor).groupBy("token").agg(F.max_by(who, rank).alias("hot_p")), "pivots")
    return placed.join(most, "token", "left").withColumn("p", F.when(F.col("hot"), F.col("hot_p")).otherwise(F.col("p")))


def _open(now: DataFrame, crowded: bool) -> DataFrame:
    """The rows of lists with several components: ``major`` is the largest one, ``apart`` the number of members outside it."""
    now = store(now, "lists") if crowded else now
    one = Window.partitionBy("token", "place")
    placed = now.withColumn("place", F.when(F.col("hot"), F.xxhash64("key")).otherwise(F.lit(0))).repartition("token", "place")
    placed = placed.withColumn("alike", F.count("*").over(Window.partitionBy("token", "place", "root")))
    placed = placed.withColumn("total", F.count("*").over(one)).withColumn("best", F.max(F.struct("alike", "root")).over(one))
    if crowded:
        held = now.filter("hot").groupBy("token", "root").agg(F.count("*").alias("alike"))
        held = held.groupBy("token").agg(F.sum("alike").alias("hot_total"), F.max(F.struct("alike", "root")).alias("hot_best"))
        placed = placed.join(small_or_stored(held, "crowds"), "token", "left")
        placed = placed.withColumns({c: F.when(F.col("hot"), F.col(f"hot_{c}")).otherwise(F.col(c)) for c in ("total", "best")})
    rows = placed.filter(F.col("best.alike") < F.col("total")).withColumn("major", F.col("best.root"))
    return rows.select("token", "key", "n", "least", "hot", "central", "root", "major", (F.col("total") - F.col("best.alike")).alias("apart"))


def links(docs: DataFrame, reps: DataFrame, lists: DataFrame) -> DataFrame:
    """a, b: similar sets, by the numbers of their classes, that connect all sets which are connected by similarity.

    Pairs within a list grow with its square, and most of them connect what is connected already.  So each list first
    compares its members with one of them, the pivot: the one whose postings most others share.  In further rounds the members outside the list's largest
    component get a pivot of their own, until the pairs left between components are no more than a few for each
    posting, or a round finds nothing new.  All pairs between different components are met in the end, so no
    connection is lost; they alone need the number of matches, as a pivot sees only some lists of a pair.
    """
    budget = PAIRS * lists.count()
    crowded = not lists.filter("hot").isEmpty()
    now = lists.withColumn("root", F.col("key")).withColumn("major", F.lit(None).cast("long"))
    found = None
    while True:
        met = _pivots(now, crowded).filter((F.col("root") != F.col("p.root")) & _lengths("n", "p.n"))
        met = store(met.select(F.least("key", "p.key").alias("a"), F.greatest("key", "p.key").alias("b")).distinct(), "met")
        fresh = _linked(docs, reps, met, "pivot")
        new = not fresh.isEmpty()
        found = fresh if found is None else store(found.unionByName(fresh), "found")
        if new or found is fresh:
            label = store(roots(found), "label").withColumnRenamed("node", "key")
            now = now.drop("root", "major").join(label, "key", "left").withColumn("root", F.coalesce("root", "key"))
            now = store(_open(now, crowded), "open")
            pairs = now.agg(F.sum("apart")).first()[0] or 0
            now = now.drop("apart")
        if not pairs:
            return found
        if not new or pairs <= budget:
            break
    bits = [F.col(f"b{i}") for i in range(WIDE)]
    full = store(now.drop("hot", "central").join(reps.select(F.col("num").alias("key"), *bits), "key"), "members")
    one = full.filter("root != major").select("token", *[F.col(c).alias(f"o_{c}") for c in ("key", "n", "least", "root")], *[F.col(f"b{i}").alias(f"x{i}") for i in range(WIDE)])
    pairs = full.join(one, "token").filter(
        (F.col("root") != F.col("o_root")) & ((F.col("root") == F.col("major")) | (F.col("key") < F.col("o_key"))) & _lengths("n", "o_n") & _few_bits("b", "x", "n", "o_n")
    )
    pairs = pairs.select(F.least("key", "o_key").alias("a"), F.greatest("key", "o_key").alias("b"), F.least("least", "o_least").alias("demand"))
    enough = pairs.groupBy("a", "b").agg(F.count("*").alias("matches"), F.first("demand").alias("demand")).filter("matches >= demand")
    return found.unionByName(_linked(docs, reps, store(enough.select("a", "b"), "rest"), "rest"))


def similar_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, class_size: one row per row of ``docs``, which needs doc_id and text.

    Two documents are linked when their sets of distinct five-word shingles have a Jaccard similarity of 0.8 or more;
    component_id is the smallest doc_id reachable over links.  Documents with equal sets are a class, named by a
    digest of the set; classes, not copies, are compared.  Texts that are null, empty or blank have an empty set and
    are linked with nothing, not even their copies; repeated rows with words are linked.  Rows with a null id take
    part; component_id is null where no other id is reachable.  Very long texts are read in runs of words.  An empty
    table gives no rows; other columns are not read.  Shingles are compared by 64-bit hashes, classes by 128 bits; lists name a class by 64 bits of these.
    """
    scanned = store(_scanned(docs), "scanned")
    rows = scanned.filter("cells IS NULL")
    counts = _added(scanned.filter("cells IS NOT NULL").select("cells"))
    reps = rows.filter("n > 0").groupBy("key").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("members"), F.min("ref").alias("ref"), *[F.first(c).alias(c) for c in ("n", "wide", *[f"b{i}" for i in range(WIDE)])]
    )
    reps = store(reps.withColumn("num", F.monotonically_increasing_id()), "classes")
    lists = store(_members(reps, shared_postings(_referred(docs), counts)), "postings")
    found = roots(links(docs, reps, lists))
    rooted = reps.join(found.withColumnRenamed("node", "num"), "num")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component"))
    labels = rooted.join(least, "root").select(F.col("key").alias("_key"), "component", "members")
    copies = reps.filter("members > 1").join(found, F.col("num") == F.col("node"), "left_anti").select(F.col("key").alias("_key"), F.col("first_id").alias("component"), "members")
    joined = rows.join(labels.unionByName(copies), (F.col("key") == F.col("_key")) & (F.col("n") > 0), "left")
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("_key").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        F.lower(F.hex("key")).alias("class_id"), F.coalesce("members", F.lit(1)).cast("long").alias("class_size"),
    )


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents"))
