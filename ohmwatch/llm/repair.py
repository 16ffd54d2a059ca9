"""Conversation structure repair: least edits by rank-convergence parallel Viterbi.

A conversation's rows are steps of a four-state machine (nothing yet, after system, after user, after assistant).  The
least cost of finishing from each state is a vector that one min-plus step makes from the next row's.  Long
conversations are cut into chunks: each starts from a speculative vector at its end, all at once.  Fix-up passes run
chunks again from the vector that their successor really has, until it differs from the one used by a constant only;
a run stops at the row where both vectors differ by a constant, as everything before it is right but for that constant.
Costs to finish, so stitched, drive the tracing of the least audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ohmwatch.llm.common import store, table

#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of the edits, of leaving a row truncated, and the cost that stands for impossible.
DELETE, REROLE, INSERT, CUT, NEVER = 3, 2, 2, 1, 1 << 40
#: The state after the only role that may be inserted or assigned in each state.
TURNED = (USER, USER, ASSISTANT, USER)
#: The state after keeping a row of an initial, where that is allowed.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Rows in a chunk at most.
CHUNK = 1 << 16
SAID = r"[^\x20\x09-\x0D]"
#: A whole text: its last character that is no white space is one of these.
ENDS = r"[.!?][\x20\x09-\x0D]*\z"
Vector = tuple[int, int, int, int]


def inserted(after: Vector) -> Vector:
    """Costs to finish when rows may be inserted before going on: at most three in a row ever help."""
    v = list(after)
    for _ in range(3):
        v = [min(v[q], INSERT + v[TURNED[q]]) for q in range(4)]
    return tuple(v)


#: Costs to finish with no row left: an empty conversation or one that ends with the assistant is whole.
END = inserted((0, NEVER, NEVER, 0))
SPECULATIVE: Vector = (0, 0, 0, 0)


def step(kind: str, after: Vector) -> Vector:
    """Costs to finish before a row, from those after it.  A kind is the role's initial, then '!' (must go), '~' (truncated) or '.'."""
    initial, state = kind[0], kind[1]
    extra = CUT if state == "~" else 0
    out = []
    for q in range(4):
        best = DELETE + after[q]
        if state != "!":
            best = min(best, REROLE + extra + after[TURNED[q]])
            to = KEPT.get(initial, {}).get(q)
            if to is not None:
                best = min(best, extra + after[to])
        out.append(min(best, NEVER))
    return inserted(tuple(out))


def level(v: Vector) -> tuple[Vector, int]:
    """The vector with its least cost taken away, and that cost."""
    least = min(v)
    return tuple(min(x - least, NEVER) for x in v), least


class Steps:
    """Min-plus steps on levelled vectors, each worked out once: there are few kinds of rows and few vectors."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, Vector], tuple[Vector, int]] = {}

    def __call__(self, kind: str, after: Vector) -> tuple[Vector, int]:
        found = self.known.get((kind, after))
        if found is None:
            found = self.known[kind, after] = level(step(kind, after))
        return found


def run_back(kinds: list[str], start: Vector, steps: Steps) -> tuple[Vector, int]:
    """Levelled costs before a chunk's first row, and the cost taken away on the way."""
    v, total = level(start)
    for kind in reversed(kinds):
        v, least = steps(kind, v)
        total += least
    return v, total


def fix_up(kinds: list[str], start: Vector, used: Vector, before: tuple[Vector, int], steps: Steps) -> tuple[Vector, int, int]:
    """``run_back`` from a better start, given the start that was used and what came of it.

    Both are run until they are equal but for a constant: from there on the former run stands.  Returns the vector,
    the cost and the number of rows run.
    """
    (v, total), (w, other) = level(start), level(used)
    for at, kind in enumerate(reversed(kinds)):
        if v == w:
            return before[0], total + before[1] - other, at
        (v, a), (w, b) = steps(kind, v), steps(kind, w)
        total, other = total + a, other + b
    return v, total, len(kinds)


def trace(kinds: list[str], start: Vector, state: int, steps: Steps, last: bool) -> tuple[str, int, list[str]]:
    """Least audit through a chunk from a state: edits in order, state at the end, and what becomes of each row.

    What becomes of a row is '' (deleted), 'K' or the new role's initial, after 'i' for each row inserted before it.
    Nothing is inserted before a deleted row, as deleting first reads less and costs the same.  The last chunk of a
    conversation has one entry more, for rows inserted at the end.
    """
    vectors = [level(start)[0]]
    costs = [0]
    for kind in reversed(kinds):
        v, least = steps(kind, vectors[-1])
        vectors.append(v), costs.append(least)
    audit: list[str] = []
    fates = []
    for at, kind in enumerate(kinds):
        before, after, taken = vectors[len(kinds) - at], vectors[len(kinds) - at - 1], costs[len(kinds) - at]
        fate = ""
        while True:
            want = before[state] + taken
            extra = CUT if kind[1] == "~" else 0
            if DELETE + after[state] == want:
                audit.append("D")
                break
            if before[TURNED[state]] + INSERT + taken == want:
                audit.append("I")
                state = TURNED[state]
                fate += "i"
                continue
            to = KEPT.get(kind[0], {}).get(state)
            if to is not None and extra + after[to] == want:
                audit.append("K")
                state, fate = to, fate + "K"
            else:
                audit.append("R")
                state = TURNED[state]
                fate += "ua"[state == ASSISTANT]
            break
        fates.append(fate)
    if last:
        fate = ""
        while state not in (START, ASSISTANT):
            audit.append("I")
            state = TURNED[state]
            fate += "i"
        fates.append(fate)
    return "".join(audit), state, fates


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with one row in five damaged by a checksum of its place; nulls in role and text are a space.

    A conversation all of whose rows are dropped has none here.
    """
    rows = rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    )
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    harm = F.crc32(F.encode(place, "UTF-8")) % 20
    rows = rows.withColumn("harm", harm).filter("harm != 0")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("harm") == 3, 2).otherwise(1).alias("copies"))


def _print(text: str) -> Column:
    """128 bits that stand for a text in comparisons."""
    return F.md5(F.encode(F.col(text), "UTF-8"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def faults(rows: DataFrame) -> DataFrame:
    """One row for each conv_id, turn, role and text of ``rows`` (with copies), without the text.

    n is how often it occurs, fault the first that its first copy has ('blank', 'duplicate', 'truncated' or null); its
    further copies are blank or duplicates.
    """
    light = rows.select(
        "conv_id", "turn", "role", _print("text").alias("print"), "copies", (~F.col("text").rlike(SAID)).alias("blank"), (~F.col("text").rlike(ENDS)).alias("open")
    )
    light = light.groupBy("conv_id", "turn", "role", "print").agg(F.sum("copies").alias("n"), F.first("blank").alias("blank"), F.first("open").alias("open"))
    light = store(light, "light")
    # The same words may be said in very many turns: the first turn is an aggregate, not a window.
    first = light.filter("NOT blank").groupBy("conv_id", "role", "print").agg(F.count("*").alias("said"), F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("first"))
    first = first.filter("said > 1").select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("print").alias("_p"), F.col("first.turn").alias("_t"))
    joined = light.join(first, _same("conv_id", "_c") & (F.col("role") == F.col("_r")) & (F.col("print") == F.col("_p")), "left")
    again = F.col("_p").isNotNull() & ~_same("turn", "_t")
    fault = F.when(F.col("blank"), "blank").when(again, "duplicate").when(F.col("open"), "truncated")
    return joined.select("conv_id", "turn", "role", "print", "n", fault.alias("fault"))


def chunked(found: DataFrame, rows: int = CHUNK) -> DataFrame:
    """The rows of ``faults`` in order: chunk numbers rise through the table, ``at`` within a chunk.  A copy is no row of its own."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "print"]
    ranged = found.repartitionByRange(*order).sortWithinPartitions(*order)

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            at = np.arange(seen, seen + batch.num_rows)
            seen += batch.num_rows
            part = batch.column("part").to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array((part << 32) + at // rows), pa.array(at % rows)], [*batch.schema.names[:-1], "chunk", "at"])

    ranged = ranged.withColumn("part", F.spark_partition_id().cast("long"))
    return store(ranged.mapInArrow(number, "conv_id long, turn long, role string, print string, n long, fault string, chunk long, at long"), "chunks")


def _kinds(role: list[str], fault: list[str | None]) -> list[str]:
    return [(r[:1] or " ") + ("!" if f in ("blank", "duplicate") else "~" if f else ".") for r, f in zip(role, fault)]


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[int | None, int], dict[str, list]]]:
    """Columns of each conversation's part of a chunk, from rows sorted by chunk and place."""
    held: dict[str, list] = {}
    now = None
    for batch in batches:
        columns = batch.to_pydict()
        keys = list(zip(columns["conv_id"], columns["chunk"]))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if now is not None and keys[start] != now:
                    yield now, held
                    held = {}
                now = keys[start]
                for name, values in columns.items():
                    held.setdefault(name, []).extend(values[start:i])
                start = i
    if now is not None:
        yield now, held


def _copied(kinds: list[str], times: list[int]) -> list[str]:
    """Kinds of all rows: further copies of a row must go."""
    return [k for kind, n in zip(kinds, times) for k in (kind, *[kind[0] + "!"] * (n - 1))]


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("chunk").sortWithinPartitions("chunk", "at")


def _vector(held: dict[str, list], letter: str) -> Vector:
    return tuple(held[f"{letter}{i}"][0] for i in range(4))


_ENDS = ["conv_id", "chunk", *[f"{p}{i}" for p in "uv" for i in range(4)], "cost", "ran"]


def _ends(rows: DataFrame, redo: DataFrame | None) -> DataFrame:
    """conv_id, chunk, u0..u3 (the vector used at the end), v0..v3, cost, ran: of all parts from speculative ends.

    ``redo`` gives parts to run again, with the vector s0..s3 that their successor has: only their rows are read.
    """
    speculate = redo is None
    if not speculate:
        again = redo.withColumnsRenamed({"conv_id": "_c", "chunk": "_k"}).drop("ran", "last")
        rows = rows.join(again, _same("conv_id", "_c") & (F.col("chunk") == F.col("_k"))).drop("_c", "_k")

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps()
        out = []
        for (conv, chunk), held in _pieces(batches):
            kinds = _copied(_kinds(held["role"], held["fault"]), held["n"])
            if speculate:
                start = SPECULATIVE
                v, cost = run_back(kinds, start, steps)
                ran = len(kinds)
            else:
                start = _vector(held, "s")
                v, cost, ran = fix_up(kinds, start, _vector(held, "u"), (_vector(held, "v"), held["cost"][0]), steps)
            out.append((conv, chunk, *level(start)[0], *v, cost, ran))
        columns = list(zip(*out)) or [()] * len(_ENDS)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _ENDS)

    rows = _in_order(rows.drop("turn", "print"))
    return rows.mapInArrow(scan, ", ".join(f"{c} long" for c in _ENDS))


def converged(rows: DataFrame) -> DataFrame:
    """conv_id, chunk, v0..v3, cost, s0..s3 (the vector its successor has, or that of the end) of each part, all right.

    Costs are those taken away within the part; a conversation costs their sum and its first vector's entry for the
    start, as every end vector has a least cost of zero.
    """
    now = store(_ends(rows, None), "ends")
    follows = W.partitionBy("conv_id").orderBy("chunk")
    true = [F.coalesce(F.lead(f"v{i}").over(follows), F.lit(END[i])).alias(f"s{i}") for i in range(4)]
    while True:
        stitched = now.withColumns({f"s{i}": c for i, c in enumerate(true)}).withColumn("last", F.lead("v0").over(follows).isNull())
        stitched = store(stitched, "stitched")
        least = F.least(*[F.col(f"s{i}") for i in range(4)])
        wrong = ~(F.array(*[F.col(f"s{i}") - least for i in range(4)]) == F.array(*[F.col(f"u{i}") for i in range(4)]))
        redo = stitched.filter(wrong)
        if redo.isEmpty():
            return stitched
        done = stitched.filter(~wrong).drop("s0", "s1", "s2", "s3", "last")
        now = store(done.unionByName(_ends(rows, redo)), "ends")


def _entries(exits: DataFrame) -> DataFrame:
    """conv_id, chunk, entry: the state in which the least audit enters each part, from the states that parts map states to.

    A conversation has one row for each part, so few; the maps are joined one after the other.
    """
    parts = F.sort_array(F.collect_list(F.struct("chunk", "exits")))
    state = lambda found, part: F.struct(
        F.concat(found["list"], F.array(F.struct(part["chunk"].alias("chunk"), found["state"].alias("entry")))).alias("list"), F.element_at(part["exits"], found["state"] + 1).alias("state")
    )
    nothing = F.struct(F.array().cast("array<struct<chunk:bigint,entry:int>>").alias("list"), F.lit(START).cast("int").alias("state"))
    walked = exits.groupBy("conv_id").agg(F.aggregate(parts, nothing, state)["list"].alias("list"))
    return walked.select("conv_id", F.inline("list"))


def _traced(rows: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, chunk, audit) of each part and (conv_id, turn, role, print, fate) of each row that is kept or after which rows are inserted."""
    names = [f"s{i}" for i in range(4)]
    at_end = ends.select(F.col("conv_id").alias("_c"), F.col("chunk").alias("_k"), *names, "last")
    base = rows.join(at_end, _same("conv_id", "_c") & (F.col("chunk") == F.col("_k"))).drop("_c", "_k")

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        steps = Steps()
        for key, held in _pieces(batches):
            yield key, held, _copied(_kinds(held["role"], held["fault"]), held["n"]), _vector(held, "s"), steps

    def exits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [(*key, [trace(kinds, end, q, steps, False)[1] for q in range(4)]) for key, _, kinds, end, steps in walk(batches)]
        columns = list(zip(*out)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int32()))], ["conv_id", "chunk", "exits"])

    # Only conversations of several parts need their entries; the others start at the start.
    many = base.filter("NOT last").select(F.col("conv_id").alias("_m")).distinct()
    several = base.join(many, _same("conv_id", "_m"), "left_semi")
    mapped = _in_order(several).mapInArrow(exits, "conv_id long, chunk long, exits array<int>")
    entry = store(_entries(mapped), "entries").select(F.col("conv_id").alias("_c"), F.col("chunk").alias("_k"), "entry")
    entered = base.join(entry, _same("conv_id", "_c") & (F.col("chunk") == F.col("_k")), "left").drop("_c", "_k").withColumn("entry", F.coalesce("entry", F.lit(START)))

    types = {"conv_id": pa.int64(), "chunk": pa.int64(), "turn": pa.int64(), "role": pa.string(), "print": pa.string(), "fate": pa.string(), "audit": pa.string()}

    def edits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * len(types), types.values())], list(types))
        for (conv, chunk), held, kinds, end, steps in walk(batches):
            last = held["last"][0]
            audit, _, fates = trace(kinds, end, held["entry"][0], steps, last)
            out.append((conv, chunk, None, None, None, None, audit))
            row = 0
            for turn, role, text, n in zip(held["turn"], held["role"], held["print"], held["n"]):
                if fates[row]:
                    out.append((conv, chunk, turn, role, text, fates[row], None))
                row += n
            if last and fates[-1]:
                out.append((conv, chunk, turn, role, text, "=" + fates[-1], None))
            if len(out) >= 10_000:
                yield batch()
                out.clear()
        yield batch()

    schema = "conv_id long, chunk long, turn long, role string, print string, fate string, audit string"
    traced = store(_in_order(entered).mapInArrow(edits, schema), "edits")
    return traced.filter("audit IS NOT NULL").select("conv_id", "chunk", "audit"), traced.filter("fate IS NOT NULL").select("conv_id", "turn", "role", "print", "fate")


def repaired(rows: DataFrame, fates: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the repaired rows, for conversations that have any.

    The rows of a conversation pass by in order, one at a time: the digest is a running one.
    """
    # After a row's text comes what becomes of it, and after the last row what is inserted at the end.
    marks = fates.withColumn("stage", F.when(F.col("fate").startswith("="), 2).otherwise(1)).withColumn("text", F.lit(None).cast("string"))
    texts = rows.select("conv_id", "turn", "role", _print("text").alias("print"), F.lit(None).cast("string").alias("fate"), F.lit(0).alias("stage"), "text")
    together = marks.unionByName(texts)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "print", "stage"]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, some, state, done, said = None, None, False, START, [], ""

        def close() -> None:
            if some:
                done.append((now, digest.hexdigest()))

        for batch in batches:
            for conv, role, fate, text in zip(*[batch.column(c) for c in ("conv_id", "role", "fate", "text")]):
                conv, fate = conv.as_py(), fate.as_py()
                if digest is None or conv != now:
                    close()
                    now, digest, some, state = conv, hashlib.sha256(), False, START
                if fate is None:
                    said = text
                    continue
                for edit in fate.lstrip("="):
                    state = KEPT[role.as_py()[:1]][state] if edit == "K" else TURNED[state]
                    name = role.as_py() if edit == "K" else ROLE[state]
                    line = f"{name}:{'' if edit == 'i' else said.as_py()}"
                    digest.update((("\n" if some else "") + line).encode("utf-8", "surrogatepass"))
                    some = True
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([d for _, d in done])], ["conv_id", "repaired_sha256"])
                done = []
        close()
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], ["conv_id", "repaired_sha256"])

    dealt = together.repartition("conv_id").sortWithinPartitions(*order)
    return dealt.select("conv_id", "role", "fate", "text").mapInArrow(scan, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame, ids: DataFrame, chunk_rows: int = CHUNK) -> DataFrame:
    """One row for each conv_id of ``ids``: counts of faults, least cost, least audit and digest of the repaired rows.

    ``rows`` has conv_id, turn, role, text and copies (as ``damaged`` gives).  Rows go by turn, nulls first; rows of
    one turn by role and a digest of their text, equal ones together.  Null ids are one conversation.  Roles count by
    their first character; an unknown or empty one can only be assigned anew or deleted.  Conversations without
    rows have zeros, an empty audit and the digest of nothing; so has an empty table no rows.  Long texts are compared
    by digests and read once more for the digest.  Other columns are not read.
    """
    found = chunked(faults(rows), chunk_rows)
    ends = converged(found)
    costs = ends.groupBy("conv_id").agg((F.sum("cost") + F.min_by("v0", "chunk")).alias("cost"))
    audits, fates = _traced(found, ends)
    audit = audits.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    counted = F.when(F.col("fault") == "duplicate", F.col("n")).when(F.col("fault") == "blank", F.lit(0)).otherwise(F.col("n") - 1)
    totals = found.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1).alias("_span"), F.sum(F.when(F.col("fault") == "blank", F.col("n"))).alias("blank"),
        F.sum(counted).alias("duplicate"), F.count_if(F.col("fault") == "truncated").alias("truncated"),
    )
    turns = found.filter("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1).alias("_one")).groupBy("conv_id").agg(F.count("*").alias("_turns"))
    illegal = _illegal(found)
    digest = repaired(rows, fates)
    out = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for part in (totals, turns, illegal, costs, audit, digest):
        out = out.join(part.withColumnRenamed("conv_id", "_id"), _same("conv_id", "_id"), "left").drop("_id")
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        "conv_id", F.coalesce(F.col("_span") - F.col("_turns"), F.lit(0)).cast("long").alias("gaps"), *map(whole, ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def _illegal(found: DataFrame) -> DataFrame:
    """conv_id, illegal: neighbouring rows whose initials are not su, ua or au; copies are neighbours of each other.

    The order is that of chunks: pairs within a part are found in one window over it, and the parts' ends in another.
    """
    initial = F.substring("role", 1, 1)
    part = W.partitionBy("conv_id", "chunk").orderBy("at")
    bad = lambda a, b: ~F.concat(a, b).isin("su", "ua", "au")
    rows = found.select("conv_id", "chunk", "at", "n", initial.alias("i")).withColumn("before", F.lag("i").over(part))
    own = F.when(bad(F.col("i"), F.col("i")), F.col("n") - 1).otherwise(0)
    parts = rows.groupBy("conv_id", "chunk").agg(
        F.sum(own + F.when(F.col("before").isNotNull() & bad(F.col("before"), F.col("i")), 1).otherwise(0)).alias("inside"),
        F.min_by("i", "at").alias("first"), F.max_by("i", "at").alias("final"),
    )
    ahead = F.lag("final").over(W.partitionBy("conv_id").orderBy("chunk"))
    parts = parts.withColumn("ahead", ahead)
    return parts.groupBy("conv_id").agg(F.sum(F.col("inside") + F.when(F.col("ahead").isNotNull() & bad(F.col("ahead"), F.col("first")), 1).otherwise(0)).alias("illegal"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair(damaged(rows), rows)



#: The same by two recursive walks over every conversation, row by row: costs to finish from its end, then edits from its start.
OP11_SQL = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations
), summed AS (
  SELECT *, xor(4294967295, list_reduce(list_transform(string_split(place, ''), lambda x: ascii(x)::BIGINT),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: xor(d >> 1, (d & 1) * 3988292384)), 4294967295::BIGINT)) % 20 AS harm FROM given
), harmed AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
    CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN harm = 3 THEN 2 ELSE 1 END)) AS copy FROM summed WHERE harm <> 0
), placed AS (
  SELECT conv_id, turn, role, text, row_number() OVER w AS pos, lag(left(role, 1)) OVER w AS ahead FROM harmed
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy)
), marked AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault FROM placed
), steps AS (
  SELECT *, left(role, 1) AS i, coalesce(fault IN ('blank', 'duplicate'), FALSE) AS goes, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM marked
), totals AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (ahead IS NOT NULL AND (ahead || i) NOT IN ('su', 'ua', 'au')) AS illegal FROM steps GROUP BY conv_id
), back AS (
  SELECT conv_id, n + 1 AS pos, [0, 4, 2, 0] AS v FROM totals
  UNION ALL
  SELECT conv_id, pos, [least(e[1], 2 + e[3], 4 + e[4]), least(e[2], 2 + e[3], 4 + e[4]), least(e[3], 2 + e[4]), least(e[4], 2 + e[3])] FROM (
    SELECT s.conv_id, s.pos, [
      least(3 + v[1], CASE WHEN goes THEN 1e9::BIGINT ELSE least(2 + cut + v[3], CASE WHEN i = 's' THEN cut + v[2] WHEN i = 'u' THEN cut + v[3] ELSE 1e9::BIGINT END) END),
      least(3 + v[2], CASE WHEN goes THEN 1e9::BIGINT ELSE least(2 + cut + v[3], CASE WHEN i = 'u' THEN cut + v[3] ELSE 1e9::BIGINT END) END),
      least(3 + v[3], CASE WHEN goes THEN 1e9::BIGINT ELSE least(2 + cut + v[4], CASE WHEN i = 'a' THEN cut + v[4] ELSE 1e9::BIGINT END) END),
      least(3 + v[4], CASE WHEN goes THEN 1e9::BIGINT ELSE least(2 + cut + v[3], CASE WHEN i = 'u' THEN cut + v[3] ELSE 1e9::BIGINT END) END)] AS e
    FROM back JOIN steps s ON s.conv_id IS NOT DISTINCT FROM back.conv_id AND s.pos = back.pos - 1)
), walk AS (
  SELECT conv_id, 1::BIGINT AS pos, 1 AS state, '' AS audit, NULL::VARCHAR AS repaired FROM totals
  UNION ALL
  SELECT conv_id, CASE edit WHEN 'I' THEN pos ELSE pos + 1 END,
    CASE edit WHEN 'D' THEN state WHEN 'K' THEN CASE i WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END ELSE turned END, audit || edit,
    CASE edit WHEN 'D' THEN repaired ELSE coalesce(repaired || chr(10), '') || CASE edit WHEN 'K' THEN role || ':' || text
      ELSE CASE turned WHEN 3 THEN 'user:' ELSE 'assistant:' END || CASE edit WHEN 'R' THEN text ELSE '' END END END
  FROM (
    SELECT w.*, s.role, s.text, s.i, [3, 3, 4, 3][w.state] AS turned,
      CASE WHEN s.pos IS NOT NULL AND 3 + y.v[w.state] = x.v[w.state] THEN 'D'
        WHEN 2 + x.v[[3, 3, 4, 3][w.state]] = x.v[w.state] THEN 'I'
        WHEN NOT s.goes AND ((s.i = 's' AND w.state = 1 AND s.cut + y.v[2] = x.v[w.state]) OR (s.i = 'u' AND w.state <> 3 AND s.cut + y.v[3] = x.v[w.state])
          OR (s.i = 'a' AND w.state = 3 AND s.cut + y.v[4] = x.v[w.state])) THEN 'K' ELSE 'R' END AS edit
    FROM walk w JOIN back x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.pos = w.pos
      LEFT JOIN back y ON y.conv_id IS NOT DISTINCT FROM w.conv_id AND y.pos = w.pos + 1
      LEFT JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.pos = w.pos
    WHERE s.pos IS NOT NULL OR w.state IN (2, 3))
), done AS (
  SELECT w.conv_id, audit, repaired FROM walk w JOIN totals t ON w.conv_id IS NOT DISTINCT FROM t.conv_id WHERE w.pos = t.n + 1 AND w.state IN (1, 4)
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v[1], 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN totals t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN back b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.pos = 1
LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id
"""
