"""Chat formatting: schema fingerprints select a mapping to canonical turns, which a reversible template marks."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ohmwatch.llm.common import table

# The template: fixed marks around each turn, and strings that models read as control.
OPEN, CLOSE = "<|turn|>", "</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn|>")
_CODES = {"\\": "\\\\", "<": "\\l", "[": "\\b", "\n": "\\n"}
_BACK = {code[1]: char for char, code in _CODES.items()}
_FIND = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_CODED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """The text without any control string: their first character, and a backslash, becomes a backslash and a letter."""
    return _FIND.sub(lambda m: _CODES[m[0]], text)


def unescape(text: str) -> str:
    return _CODED.sub(lambda m: _BACK[m[1]], text)


@dataclass(frozen=True)
class Layout:
    """How records of one shape become turns.

    ``turns`` lists (role, path of the text) for single fields; with ``each`` the record holds a list of turns there,
    and the two paths are those of role and text inside.  ``optional`` paths may be missing.
    """

    name: str
    turns: tuple[tuple[str, str], ...]
    each: str = ""
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[str]:
        if self.each:
            return [f"{self.each}[].{p}" for p in self.turns[0]]
        return [p for turn in self.turns for p in turn if p.startswith("$.")]

    def prints(self) -> list[str]:
        """The fingerprints of all shapes, with and without the optional paths."""
        full = self.paths()
        return [fingerprint_of(set(full) - set(gone)) for n in range(len(self.optional) + 1) for gone in combinations(self.optional, n)]


# Paths start with "$."; a role without it is the role itself.
LAYOUTS = (
    Layout("row", (("$.role", "$.text"),), optional=("$.role", "$.text")),
    Layout("messages", (("role", "content"),), each="$.messages", optional=("$.messages[].content",)),
    Layout("shared", (("from", "value"),), each="$.conversations", optional=("$.conversations[].value",), roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("completion", (("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.completion")), optional=("$.system",)),
    Layout("response", (("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response")), optional=("$.system",)),
    Layout("instruction", (("system", "$.system"), ("user", "$.instruction"), ("user", "$.input"), ("assistant", "$.output")), optional=("$.system", "$.input")),
)


def paths_of(value: object, at: str = "$") -> set[str]:
    """Paths of all fields that are not null; the elements of a list share one path."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths_of(v, f"{at}.{k}")}
    if isinstance(value, list):
        return {p for v in value for p in paths_of(v, f"{at}[]")}
    return set() if value is None else {at}


def fingerprint_of(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


MAPPINGS = {p: layout for layout in reversed(LAYOUTS) for p in layout.prints()}


def turns_of(record: str | None) -> tuple[str, list[tuple[str, str]]] | None:
    """Fingerprint and canonical turns of a JSON record; None if it is no JSON object or its shape is unknown."""
    try:
        value = json.loads(record) if record is not None else None
    except ValueError:
        return None
    if not isinstance(value, dict):
        return None
    print_ = fingerprint_of(paths_of(value))
    layout = MAPPINGS.get(print_)
    if layout is None:
        return None
    as_text = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if layout.each:
        role, text = layout.turns[0]
        names = dict(layout.roles)
        found = [(as_text(t.get(role)), as_text(t.get(text))) for t in value[layout.each[2:]] if isinstance(t, dict)]
        return print_, [(names.get(r, r), t) for r, t in found]
    get = lambda p: as_text(value.get(p[2:]))
    return print_, [(get(r) if r.startswith("$.") else r, get(t)) for r, t in layout.turns if layout.name == "row" or value.get(t[2:]) is not None]


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """The marked turn, and start and length of what the loss mask covers in it: an assistant's text, else nothing."""
    head = f"{OPEN}{escape(role).replace(chr(10), _CODES[chr(10)])}\n"
    body = escape(text)
    return head + body + CLOSE, len(head), len(body) if role == "assistant" else 0


def read_back(turn: str) -> tuple[str, str]:
    """Role and text of a marked turn; raises ValueError for anything else."""
    role, line, text = turn[len(OPEN) : -len(CLOSE)].partition("\n")
    if not (turn.startswith(OPEN) and turn.endswith(CLOSE) and line) or any(c in text or c in role for c in CONTROL):
        raise ValueError("not a marked turn")
    return unescape(role), unescape(text)


def format_records(records: DataFrame) -> DataFrame:
    """conv_id, turn, place, fingerprint, formatted, loss_start, loss_length: one row per canonical turn.

    ``records`` has conv_id, turn and record (JSON).  place numbers the turns of one record.  Records that are null,
    no JSON object or of unknown shape give one row whose fingerprint and formatted are null.  Null texts are empty.
    A conversation is its rows' formatted strings in order of turn and place; rows with the same turn are ordered by
    their record.
    """
    schema = "conv_id long, turn long, record string, place int, fingerprint string, formatted string, loss_start long, loss_length long"

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.strip().split(" ")[0] for f in schema.split(",")]
        for batch in batches:
            rows = []
            for conv, turn, record in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "record")]):
                found = turns_of(record)
                if found is None:
                    rows.append((conv, turn, record, 0, None, None, None, None))
                for place, (role, text) in enumerate(found[1] if found else ()):
                    rows.append((conv, turn, record, place, found[0], *formatted(role, text)))
            columns = list(zip(*rows)) if rows else [()] * len(names)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return records.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "record").mapInArrow(scan, schema)


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from formatted turns.

    Rows of a conversation are sorted into one partition and pass by one at a time: the digests are running ones, so
    a conversation of any length needs no more memory than a batch.  A null conv_id is a conversation.  Rows
    without a formatted turn are passed over; a conversation with no other rows is left out.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.strip().split(" ")[0] for f in schema.split(",")]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        now, state, done = object(), None, []

        def close() -> None:
            if state:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for conv, turn, start, length in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_length")]):
                if conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_back(turn)
                loss = unescape(turn[start : start + length])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[2] += len(loss)
                state[3].update(loss.encode("utf-8", "surrogatepass"))
                state[4] += len(turn)
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
                done = []
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*done)) or [()] * len(names), kinds)], names)

    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = turns.filter("formatted IS NOT NULL").repartition(n, "conv_id")
    ordered = ordered.sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), "record", "place")
    return ordered.select("conv_id", "formatted", "loss_start", "loss_length").mapInArrow(scan, schema)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    records = rows.unionByName(extra).select("conv_id", "turn", F.to_json(F.struct("role", "text")).alias("record"))
    return digests(format_records(records))
