"""Mixing sources to target weights: words packed into blocks, multinomial draws per shard, permuted block numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ohmwatch.llm.common import WORD, running_offset, store, table

#: Words in a block; the last block of a source may be shorter.
BLOCK = 256
#: Blocks drawn for an output shard.
SHARD = 1024
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words, and how often a source may be taken at most.
SHARE, MOST = 1.5, 2
#: Rounds of the permutation of a source's blocks.
SWAPS = 32
_ROWS = 10_000


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a tie-breaking hash of every row, stored once: text is read here only."""
    count = F.regexp_count(F.coalesce(docs["text"], F.lit("")), F.lit(WORD)).cast("long")
    return store(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), count.alias("size"), F.xxhash64(docs["text"]).alias("mark")), "sizes")


def source_targets(rows: DataFrame) -> DataFrame:
    """source, source_size, weight, target, words, lo, hi: one row per source.

    Targets fill like water: each source gets weight times one level, cut at twice its size.  Sources that are cut
    are those with the least size per weight, so one ordered pass finds the level.  The pass is a window over the
    sources, one row each.  words is the target in whole words; lo and hi bound the source's part of the draw.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, WEIGHTS))), (F.col("rank") % len(WEIGHTS) + 1).cast("int")))
    cap = F.col("source_size") * MOST
    by = W.orderBy(cap / F.col("weight"), "rank")
    total = F.sum("source_size").over(W.partitionBy()) * SHARE
    level = (total - F.coalesce(F.sum(cap).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing))
    # The first source whose cap is above the level at its turn sets the level for all from there on.
    final = F.min(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.struct("order", "level"))).over(W.partitionBy())
    per = per.select("*", cap.cast("double").alias("cap"), level.alias("level"), F.row_number().over(by).alias("order"))
    per = per.withColumn("final", final["level"]).withColumn("target", F.coalesce(F.least("cap", F.col("final") * F.col("weight")), F.col("cap")))
    per = per.withColumn("words", F.round("target").cast("long"))
    share = F.greatest(F.sum("target").over(W.partitionBy()), F.lit(1.0))  # without words all targets are 0; else it is 1 at least
    up_to = F.sum("target").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return per.select(
        "source", "rank", "source_size", "weight", "target", "words",
        ((up_to - F.col("target")) / share).alias("lo"), F.when(F.col("rank") == F.max("rank").over(W.partitionBy()), F.lit(1.0)).otherwise(up_to / share).alias("hi"),
    )


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def permuted(place: Column, count: Column, *key: Column) -> Column:
    """``place`` under a pseudorandom permutation of 0 ... count - 1 chosen by ``key``.

    In each round two places that add up to the round's number change seats or do not, by a coin both of them see; so
    every round, and all of them together, is a permutation for any ``count``.
    """

    def swap(at: Column, number: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(number, *key), count) - at, count)
        coin = F.pmod(F.xxhash64(F.greatest(at, other), number, *key), F.lit(2)) == 1
        return F.when(coin, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(SWAPS)), place, swap)


def slots(targets: DataFrame, seed: int = 0) -> DataFrame:
    """shard, seat, source_rank, slot, block, length: the blocks of the mix, in output order by shard, seat, source, slot.

    A source is a line of words cut into blocks, so it needs a known number of slots.  Each shard draws
    its blocks' sources by target share, which gives multinomial counts per shard; the running total over shards
    numbers a source's slots.  Draws beyond the number needed are given up, and what is missing goes to closing shards
    of at most SHARD slots.  A seat is a random number that mixes the sources inside a shard.  Slot numbers run through
    a pseudorandom permutation of the source's full blocks, then its short block, and in another order for the second
    pass.  The very last slot takes as many words as the target still needs.
    """
    full = F.floor(F.col("source_size") / BLOCK)
    tail = F.col("source_size") % BLOCK
    per_pass = full + (tail > 0).cast("long")
    passes, rest = F.floor(F.col("words") / F.col("source_size")), F.col("words") % F.col("source_size")
    in_rest = F.least(F.ceil(rest / BLOCK), per_pass)
    plan = store(
        targets.filter("words > 0").select("rank", "words", "source_size", "lo", "hi", full.alias("full"), tail.alias("tail"), per_pass.alias("per_pass"), (passes * per_pass + in_rest).alias("needed")),
        "plan",
    )
    spark = targets.sparkSession
    draws = plan.agg(F.sum("needed")).first()[0] or 0
    shards = -(-draws // SHARD)
    cells = 4096
    cdf = plan.select("rank", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))).alias("cell"))
    drawn = spark.range(draws).select(F.floor(F.col("id") / SHARD).alias("shard"), _uniform(F.lit(seed), F.col("id")).alias("u"))
    drawn = drawn.withColumn("cell", F.floor(F.col("u") * cells))
    counts = drawn.join(cdf, (drawn["cell"] == cdf["cell"]) & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).groupBy("rank", "shard").agg(F.count("*").alias("n"))
    counts = store(running_offset(counts.withColumn("bucket", F.floor(F.col("shard") / _ROWS)), ["rank"], "bucket", [F.col("shard")], "n", "first"), "counts")
    drawn_of = counts.groupBy("rank").agg(F.sum("n").alias("got"))
    closing = plan.join(drawn_of, "rank", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < needed")
    # One row a source: the number of missing slots of the sources before it.
    before = F.coalesce(F.sum(F.col("needed") - F.col("got")).over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    closing = closing.withColumn("before", before).select("rank", "got", "before", F.explode(F.sequence(F.col("got"), F.col("needed") - 1)).alias("slot"))
    closing = closing.select((F.lit(shards) + F.floor((F.col("before") + F.col("slot") - F.col("got")) / SHARD)).cast("long").alias("shard"), "rank", "slot")
    # The counts are small but their slots are not: deal them out by number, about 64 shards a task.
    dealt = counts.repartition(max(1, -(-shards // 64)), "rank", "shard")
    taken = dealt.select("shard", "rank", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot")).unionByName(closing)
    numbered = taken.join(plan, "rank").filter("slot < needed")
    turn, place = F.floor(F.col("slot") / F.col("per_pass")), F.col("slot") % F.col("per_pass")
    block = F.when(place < F.col("full"), permuted(place, F.greatest("full", F.lit(1)), F.lit(seed), F.col("rank"), turn)).otherwise(F.col("full"))
    start = turn * F.col("source_size") + F.least(place, F.col("full")) * BLOCK
    whole = F.when(place < F.col("full"), F.lit(BLOCK)).otherwise(F.col("tail"))
    seat = F.xxhash64(F.lit(seed + 1), "rank", "slot")
    return numbered.select("shard", seat.alias("seat"), F.col("rank").alias("source_rank"), "slot", block.alias("block"), F.least(whole, F.col("words") - start).alias("length"))


def pieces(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, mark, source_rank, start, size, block, lo, hi: the parts of documents that lie in each block of their source.

    Documents of a source stand in order of a hash of their id; offsets come from bucket totals, so a source that
    holds most rows is spread over many tasks.  start, the document's first word in its source, tells all rows apart.
    """
    n = max(1, rows.count() // _ROWS)
    ranked = rows.join(targets.select("source", F.col("rank").alias("source_rank")), rows["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    ranked = ranked.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(n)))
    order = [F.xxhash64("doc_id", "mark"), F.col("doc_id"), F.col("mark"), F.col("size")]
    placed = running_offset(ranked.filter("size > 0"), ["source_rank"], "bucket", order, "size", "start")
    first, last = F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
    cut = placed.select("doc_id", "mark", "source_rank", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    lo = F.greatest(F.col("start") - F.col("block") * BLOCK, F.lit(0))
    return cut.select("doc_id", "mark", "source_rank", "start", "size", "block", lo.alias("lo"), F.least(F.col("start") + F.col("size") - F.col("block") * BLOCK, F.lit(BLOCK)).alias("hi"))


def mix(rows: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """shard, seat, source_rank, slot, block, place, doc_id, mark, start, size, first, words: the mix, span by span.

    Slots meet the parts of documents packed in their block, joined by source and block number; a slot takes at most
    its length, so the last one of a source may end inside a part.  A span is ``words`` words of a document from word
    ``first`` on, and stands at ``place`` of its block; in order of shard, seat, source_rank, slot and place the spans
    are the mix.
    """
    met = slots(targets, seed).join(pieces(rows, targets), ["source_rank", "block"]).filter("lo < length")
    return met.select(
        "shard", "seat", "source_rank", "slot", "block", F.col("lo").alias("place"), "doc_id", "mark", "start", "size",
        (F.col("block") * BLOCK + F.col("lo") - F.col("start")).alias("first"), (F.least("hi", "length") - F.col("lo")).alias("words"),
    )


def mixed_blocks(docs: DataFrame, seed: int = 0) -> DataFrame:
    """shard, seat, source, slot, doc_ids, text: the mix itself, one row per slot, for a writer that sorts by them.

    ``text`` has the slot's words, at most BLOCK, parted by blanks, and doc_ids the documents they come from, both in
    order.  Each text meets its own spans once; rows that repeat an id and a text share them.  A table without words has
    no slots.
    """
    rows = sizes(docs)
    targets = store(source_targets(rows), "targets")
    spans = store(mix(rows, targets, seed), "spans")
    wanted = spans.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("shard", "seat", "source_rank", "slot", "place", "first", "words")).alias("spans"))
    wanted = wanted.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "spans")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("mark"), docs["text"].alias("text"))
    texts = texts.groupBy("doc_id", "mark").agg(F.max("text").alias("text"))
    met = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
    met = met.select("doc_id", F.regexp_extract_all("text", F.lit(f"({WORD})")).alias("all"), "spans")
    cut = F.transform("spans", lambda s: F.struct(s.alias("span"), F.array_join(F.slice("all", (s["first"] + 1).cast("int"), s["words"].cast("int")), " ").alias("part")))
    cut = met.select("doc_id", F.explode(cut).alias("cut")).select("doc_id", "cut.span.*", "cut.part")
    parts = F.array_sort(F.collect_list(F.struct("place", "doc_id", "part")))
    blocks = cut.groupBy("shard", "seat", "source_rank", "slot").agg(parts.alias("parts"))
    named = targets.select(F.col("rank").alias("source_rank"), "source")
    return blocks.join(named, "source_rank").select(
        "shard", "seat", "source", "slot", F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"), F.array_join(F.transform("parts", lambda p: p["part"]), " ").alias("text")
    )


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row per row of ``docs`` (doc_id, text, source).

    size counts words (null and blank texts: 0), taken the words of the document's spans in the mix, repeats counted; it is at most twice the size.  The words taken from a source are its target, rounded.  A null source
    is a source, last in order.  Repeated rows are documents of their own.  Reruns give the same result, also on
    another number of partitions.  Without any word, every target and every taken is 0.
    """
    rows = sizes(docs)
    targets = store(source_targets(rows), "targets")
    taken = mix(rows, targets, seed).groupBy("source_rank", "start", "doc_id", "size").agg(F.sum("words").alias("taken"))
    per_doc = taken.join(targets.withColumnRenamed("rank", "source_rank"), "source_rank").select("doc_id", "source", "size", "source_size", "target", "taken")
    # A document none of whose words was drawn is missing here: give it its zero.
    counted = per_doc.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    zero = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("all"))
    missing = zero.join(
        counted.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), "n"),
        F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")), "left",
    ).select("doc_id", "source", "size", F.explode(F.array_repeat(F.lit(0).cast("long"), (F.col("all") - F.coalesce("n", F.lit(0))).cast("int"))).alias("taken"))
    zeros = missing.join(targets.select(F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s")))
    return per_doc.unionByName(zeros.select("doc_id", "source", "size", "source_size", "target", "taken"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
