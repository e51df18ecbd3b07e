"""Chat formatting by schema fingerprints.

A record may hold its turns in many layouts: one turn per row, prompt and completion, instruction,
input and output, or a list of messages under different names. The nested field paths of a record,
hashed, give its fingerprint, and the fingerprint picks a declarative mapping to canonical turns
(role, text). New layouts are added as mappings; no code looks at records one by one.

A formatted conversation puts control strings around each turn. A text cannot contain one: within
texts and roles a backslash goes between ``<`` (and any backslashes after it) and ``|``.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
ASSISTANT = "assistant"


# --- layouts ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns.

    ``paths`` are the nested field paths, list elements as ``[]``; ``optional`` ones may be absent.
    ``turns`` has (role, text) for each turn: a role is a path after ``$`` or a fixed word, a text
    joins the paths with a blank line. With ``each``, a list, the turns repeat for its elements and
    paths start there. ``roles`` renames roles. Fields named in ``ignored`` may be there too, with
    whatever is below them.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, tuple[str, ...]], ...]
    optional: tuple[str, ...] = ()
    each: str = ""
    roles: tuple[tuple[str, str], ...] = ()
    ignored: tuple[str, ...] = ("id", "name", "source", "metadata")


MAPPINGS: tuple[Mapping, ...] = (
    Mapping("turn", ("role", "text"), (("$role", ("text",)),)),
    Mapping("prompt", ("prompt", "completion"), (("user", ("prompt",)), (ASSISTANT, ("completion",)))),
    Mapping("question", ("prompt", "response"), (("user", ("prompt",)), (ASSISTANT, ("response",)))),
    Mapping(
        "instruction",
        ("instruction", "output"),
        (("system", ("system",)), ("user", ("instruction", "input")), (ASSISTANT, ("output",))),
        optional=("input", "system"),
    ),
    Mapping(
        "messages",
        ("messages[].role", "messages[].content"),
        (("$role", ("content",)),),
        each="messages",
    ),
    Mapping(
        "from_value",
        ("conversations[].from", "conversations[].value"),
        (("$from", ("value",)),),
        each="conversations",
        roles=(("human", "user"), ("gpt", ASSISTANT), ("bot", ASSISTANT), ("model", ASSISTANT)),
    ),
)


def field_paths(value: object, prefix: str = "") -> set[str]:
    """Nested field paths of a record; the elements of a list share theirs."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in field_paths(v, f"{prefix}.{k}" if prefix else k)}
    if isinstance(value, list):
        inner = {p for v in value for p in field_paths(v, f"{prefix}[]")}
        return inner or {f"{prefix}[]"}
    return {prefix}


def fingerprint(paths: set[str] | tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


Known = dict[tuple[str, ...], dict[str, Mapping]]


def fingerprints(mappings: tuple[Mapping, ...] = MAPPINGS) -> Known:
    """The mapping of each fingerprint, by the fields that are ignored for it; a mapping has one for
    each set of its optional paths."""
    every: Known = {}
    for mapping in mappings:
        found = every.setdefault(mapping.ignored, {})
        for bits in range(1 << len(mapping.optional)):
            some = {p for i, p in enumerate(mapping.optional) if bits >> i & 1}
            found[fingerprint({*mapping.paths, *some})] = mapping
        if mapping.each:  # an empty list has no element to show its fields
            found.setdefault(fingerprint({f"{mapping.each}[]"}), mapping)
    return every


def mapping_of(paths: set[str] | frozenset[str], known: Known) -> Mapping | None:
    """The mapping whose fingerprint the paths have, as they are or without ignored fields."""
    for ignored, found in known.items():
        for left_out in ((), ignored):
            kept = {p for p in paths if re.split(r"[.\[]", p, maxsplit=1)[0] not in left_out}
            if mapping := found.get(fingerprint(kept)):
                return mapping
    return None


def _parsed(raw: str | None) -> object:
    try:
        return json.loads(raw or "null")
    except ValueError:
        return None


def record_turns(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    out, renamed = [], dict(mapping.roles)
    for item in record.get(mapping.each) or [] if mapping.each else [record]:
        for role, parts in mapping.turns:
            if role == "system" and not item.get("system"):
                continue
            name = str(item.get(role[1:]) or "") if role[0] == "$" else role
            texts = [str(item[p]) for p in parts if item.get(p) is not None]
            out.append((renamed.get(name, name), "\n\n".join(t for t in texts if t)))
    return out


def canonical_turns(
    records: DataFrame,
    id_column: str,
    order_column: str,
    record_column: str,
    mappings: tuple[Mapping, ...] = MAPPINGS,
) -> DataFrame:
    """conv_id, position (of the record), step (of the turn in it), role, text, layout.

    ``record_column`` holds JSON objects. A record whose fingerprint no mapping has, or that is no
    JSON object, gives one row with null role and the layout ``unknown:<fingerprint>``, and a record
    without any turn one with the layout ``empty:<mapping>``, so nothing is lost unseen. Null texts
    are empty. Null ids and positions pass through, and so do records that repeat.
    """
    schema = "conv_id bigint, position bigint, step int, role string, text string, layout string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = fingerprints(mappings)
        layouts: dict[frozenset, Mapping | None] = {}
        for batch in batches:
            rows = []
            for conv, at, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                record = _parsed(raw)
                paths = frozenset(field_paths(record)) if isinstance(record, dict) else frozenset()
                if paths not in layouts:
                    layouts[paths] = mapping_of(paths, known)
                mapping = layouts[paths]
                if mapping is None:
                    rows.append((conv, at, 0, None, None, f"unknown:{fingerprint(set(paths))}"))
                    continue
                turns = record_turns(record, mapping)
                for step, (role, text) in enumerate(turns):
                    rows.append((conv, at, step, role, text, mapping.name))
                if not turns:
                    rows.append((conv, at, 0, None, None, f"empty:{mapping.name}"))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["conv_id", "position", "step", "role", "text", "layout"],
            )

    given = records.select(
        F.col(id_column).cast("long"), F.col(order_column).cast("long"), record_column
    )
    return given.mapInArrow(run, schema)


# --- template --------------------------------------------------------------------------------


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def formatted_turn(role: Column, text: Column) -> Column:
    return F.concat(
        F.lit(START), escaped(role), F.lit(SEPARATOR), escaped(text), F.lit(END), F.lit("\n")
    )


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, unescaped."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, rest = part.split(SEPARATOR, 1)
        turns.append((unescape(role), unescape(rest[: rest.index(END)])))
    return turns


def formatted_turns(turns: DataFrame) -> DataFrame:
    """``turns`` with ``formatted``, the text of the turn between control strings.

    Rows of unknown layouts and of empty records have none. A null role or text of another row counts
    as no turn either. A conversation is its turns put together by (position, step).
    """
    return turns.withColumn("formatted", formatted_turn(F.col("role"), F.col("text")))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from its formatted turns only.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. The loss mask covers
    the texts of the assistant. The turns of a conversation come sorted to one task and pass through
    it one by one, as a digest needs them in order; what is kept of a conversation has a fixed size,
    however many turns it has. Turns with the same position, step and text are counted as they come.
    """
    schema = (
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint,"
        " loss_sha256 string, formatted_chars bigint"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), None

        def row() -> tuple:
            conv, n, turns, chars, loss, total = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), total

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            names = [field.split()[0] for field in schema.split(",")]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names
            )

        for batch in batches:
            done = []
            for conv, formatted in zip(
                batch.column("conv_id").to_pylist(),
                batch.column("formatted").to_pylist(),
                strict=True,
            ):
                if state is None or conv != current:
                    if state is not None:
                        done.append(row())
                    current = conv
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(formatted):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                    if role == ASSISTANT:
                        state[3] += len(text)
                        state[4].update(text.encode())
                state[5] += len(formatted)
            yield batch_of(done)
        if state is not None:
            yield batch_of([row()])

    ordered = (
        formatted.where(F.col("formatted").isNotNull())
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "position", "step", "formatted")
        .select("conv_id", "formatted")
    )
    return ordered.mapInArrow(run, schema)
