"""Secrets by one combined deterministic automaton.

All rules are compiled together into one array of transitions (see ``automata``), which the driver
sends along with the task; each text is read once, byte by byte, for all rules. A found span counts
if its rule's stricter pattern, which knows the least lengths, matches it whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import automata
from llm.personal_data import span_text
from llm.words import utf8


@dataclass(frozen=True)
class Rule:
    """``search`` finds spans, leftmost and without overlaps; ``whole`` is what a span must be."""

    kind: str
    search: str
    whole: str | None = None
    fold_case: bool = False


_VALUE = "[A-Za-z0-9+/_.=-]"
_SIGN = "[\"']?\\x20*[:=]\\x20*[\"']?"
_NAMES = "password|passwd|secret|token|api_?key"
_MORE_NAMES = "(access|auth|private|secret|signing|encryption)[_-]?key|credentials?|pwd"
_BEARER = f"(({_MORE_NAMES}){_SIGN}|bearer\\x20+)"
_PREFIX = "(gh[pousr]_|glpat-|xox[abprs]-|[rs]k_live_|npm_|hf_|AIza|eyJ)"

# A search pattern need not know the least length, and a count in it would multiply the states of the
# automaton; it has one only where short spans are so frequent that they would slow the scan.
#: The base kinds, in their order of listing.
BASE = (
    Rule("assign", f"({_NAMES}){_SIGN}{_VALUE}+", f"({_NAMES}){_SIGN}{_VALUE}{{8,}}", True),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", "[0-9a-f]{8,}", "[0-9a-f]{32,}"),
)
#: Further names of values, public formats of tokens, and private keys.
ADDED = (
    Rule("named_key", f"{_BEARER}{_VALUE}+", f"{_BEARER}{_VALUE}{{12,}}", True),
    Rule("known_format", f"{_PREFIX}[A-Za-z0-9_.-]+", f"{_PREFIX}[A-Za-z0-9_.-]{{20,}}"),
    Rule("key_block", "-----BEGIN\\x20([A-Z0-9]+\\x20)*PRIVATE\\x20KEY-----"),
)
RULES = BASE + ADDED


@dataclass(frozen=True)
class Compiled:
    """The tables of some rules: small arrays that tasks get with their function."""

    kinds: tuple[str, ...]
    together: automata.Table
    backward: tuple[automata.Table, ...]
    whole: tuple[automata.Table | None, ...]


@cache
def compiled(rules: tuple[Rule, ...] = RULES) -> Compiled:
    """Raises ValueError for a rule that the automaton cannot follow without reading bytes twice."""
    trees = [automata.parse(rule.search, rule.fold_case) for rule in rules]
    return Compiled(
        tuple(rule.kind for rule in rules),
        automata.combine(trees),
        tuple(automata.anchored(automata.reverse(tree)) for tree in trees),
        tuple(
            automata.anchored(automata.parse(rule.whole, rule.fold_case)) if rule.whole else None
            for rule in rules
        ),
    )


class SecretFinder:
    """Spans (start, end, number of the rule) of a text given as UTF-8, in code points."""

    def __init__(self, tables: Compiled) -> None:
        self.scanner = automata.Scanner(tables.together, tables.backward)
        self.whole = [t and (t.next.tolist(), t.outputs.tolist(), t.start * 256) for t in tables.whole]

    def _holds(self, rule: int, data: bytes) -> bool:
        if not self.whole[rule]:
            return True
        moves, outputs, state = self.whole[rule]
        for byte in data:
            state = moves[state + byte]
        return outputs[state >> 8] == 2

    def find(self, data: bytes) -> list[tuple[int, int, int]]:
        """By start, then by the order of the rules."""
        found = sorted(
            (start, rule, end)
            for rule, start, end in self.scanner.scan(data)
            if self._holds(rule, data[start:end])
        )
        if found and not data.isascii():
            codes = np.frombuffer(data, dtype=np.uint8)
            before = np.concatenate(([0], np.cumsum((codes & 0xC0) != 0x80)))
            found = [(int(before[a]), rule, int(before[b])) for a, rule, b in found]
        return [(start, end, rule) for start, rule, end in found]


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id and ``spans``, an array of (start, end, kind), of each row of ``docs``.

    Spans of one kind do not overlap; those of different kinds may. They stand by start, then in the
    order of the rules; places are code points, ends exclusive. A null or empty text has none. A null
    doc_id and repeated rows pass through, other columns are ignored, and no row is moved.
    """
    tables = compiled(tuple(rules))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = SecretFinder(tables)
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            spans = []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                found = finder.find(data[a:b].tobytes())
                spans.append([{"start": s, "end": e, "kind": tables.kinds[r]} for s, e, r in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(spans, pa.list_(span))], ["doc_id", "spans"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id bigint, spans array<struct<start:bigint,end:bigint,kind:string>>"
    )


def secrets_digest(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, a count of each kind, base_sha256 and spans of each row of ``docs``."""
    found = find_secrets(docs, rules)
    kinds = tuple(rule.kind for rule in rules)
    base = tuple(rule.kind for rule in BASE)
    return found.select(
        "doc_id",
        *(
            F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}")
            for k in kinds
        ),
        F.sha2(F.expr(span_text("spans", base)), 256).alias("base_sha256"),
        F.expr(span_text("spans", kinds)).alias("spans"),
    )
