"""Quality rules as a bitmask ledger.

Each rule is evaluated once per document. The ledger keeps the measurements and one bit per failed
rule; policies and ablations are bitwise operations on the ledger and never read the texts again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import fresh_name
from llm.words import batch_words

WINDOW = 5
_SYMBOL_BYTES = np.zeros(256, dtype=bool)
_SYMBOL_BYTES[list(b"#*$%&|<>")] = True
_STRIP = "".join(map(chr, (0x20, *range(0x09, 0x0E))))

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

@dataclass(frozen=True)
class Rule:
    """A document fails if the weighted sum of its measurements plus ``constant`` is above 0."""

    name: str
    weights: tuple[tuple[str, int], ...]
    constant: int = 0

    def excess(self, measure: Callable[[str], Any]) -> Any:
        total = self.constant
        for name, weight in self.weights:
            total = measure(name) * weight + total
        return total


#: In the order of their bits. New rules go to the end, so that stored bits keep their meaning.
RULES: tuple[Rule, ...] = (
    Rule("too_few_words", (("n_words", -1),), 10),
    Rule("repeated_words", (("n_repeat_words", 100), ("n_words", -20))),
    Rule("many_symbols", (("n_symbols", 100), ("word_chars", -15))),
    Rule("short_words", (("n_words", 15), ("word_chars", -10))),
    Rule("duplicate_lines", (("n_dup_lines", 2), ("n_words", -1))),
)


@dataclass(frozen=True)
class Policy:
    """A named set of rules; a document passes if it fails none of them."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << rule_bit(name) for name in self.rules)


BASE = Policy("base", ("too_few_words", "repeated_words"))
STRICT = Policy("v2", tuple(rule.name for rule in RULES))


def rule_bit(name: str) -> int:
    return [rule.name for rule in RULES].index(name)


def repeated_positions(ids: np.ndarray) -> int:
    """Number of words that stand in a ``WINDOW``-word run found twice or more; exact.

    Runs are named by the rank of the pair of names of two shorter runs, so equal names mean equal
    runs.
    """
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    runs = ids.astype(np.int64)
    size = np.int64(len(ids) + 1)
    for length in range(2, WINDOW + 1):
        pairs = runs[: len(ids) - length + 1] * size + ids[length - 1 :]
        _, runs, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if length < WINDOW and len(counts) == len(pairs):
            return 0
    starts = np.flatnonzero(counts[runs] > 1)
    covered = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + WINDOW, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.strip(_STRIP)]
    return len(lines) - len(set(lines))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        found = np.zeros((len(MEASURES), len(batch)), dtype=np.int64)
        for row, counts, hashes, starts, ends in batch_words(texts, fold_case=False):
            bounds = np.concatenate(([0], np.cumsum(counts)))
            for i, n in enumerate(counts.tolist()):
                text = texts[row + i].as_py() or ""
                raw = np.frombuffer(text.encode(), dtype=np.uint8)
                first, last = bounds[i], bounds[i + 1]
                # Code points are the bytes that do not continue another; white space is one byte.
                points = int(((raw & 0xC0) != 0x80).sum())
                spaces = len(raw) - int((ends[first:last] - starts[first:last]).sum())
                _, ids = np.unique(hashes[first:last], return_inverse=True)
                found[:, row + i] = (
                    n,
                    points - spaces,
                    int(_SYMBOL_BYTES[raw].sum()),
                    duplicate_lines(text),
                    repeated_positions(ids),
                )
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *map(pa.array, found)], ["doc_id", *MEASURES]
        )


def ledger(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, the measurements and ``failed``, a bit per failed rule.

    A null or empty text has no words and fails ``too_few_words``. A null doc_id and repeated rows
    pass through; other columns are ignored. An empty table gives an empty ledger.
    """
    schema = ", ".join(["doc_id bigint", *(f"{name} bigint" for name in MEASURES)])
    measured = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_measure, schema)
    return measured.withColumn("failed", failure_bits(F.col))


def failure_bits(value: Callable[[str], Column]) -> Column:
    """A bit for each rule that a row fails, from its measurements; each rule is evaluated once."""
    failed = F.lit(0)
    for bit, rule in enumerate(RULES):
        failed = failed.bitwiseOR(F.when(rule.excess(value) > 0, F.lit(1 << bit)).otherwise(F.lit(0)))
    return failed.cast("long")


def passes(policy: Policy, failed: Column | str = "failed") -> Column:
    """Whether a ledger row passes ``policy``."""
    column = F.col(failed) if isinstance(failed, str) else failed
    return column.bitwiseAND(F.lit(policy.mask)) == 0


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """What each rule of ``policy`` does: rule, n_failed, n_only (failed by no other rule of it).

    ``n_only`` is the number of documents that would be kept if the rule were dropped. The ledger is
    first counted by its failure bits, so only as many rows as there are bit patterns go on.
    """
    mask = policy.mask
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(
        F.count(F.lit(1)).alias("n")
    )
    rules = F.explode(
        F.array(
            *(
                F.struct(F.lit(name).alias("rule"), F.lit(1 << rule_bit(name)).alias("bit"))
                for name in policy.rules
            )
        )
    )
    each = patterns.select("bits", "n", rules.alias("r"))
    has = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias(
            "n_only"
        ),
    )


def judge(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """Measurements of each document, ``base_failed``, and ``kept`` by ``policy``."""
    return ledger(docs).select(
        "doc_id",
        *MEASURES,
        (~passes(BASE)).alias("base_failed"),
        (passes(BASE) & passes(policy)).alias("kept"),
        "failed",
    )


def keep_good(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that pass the base rules and ``policy``.

    The ledger's columns are added to the rows themselves and dropped after the verdict, so no join is
    needed. Null and empty texts fail for their lack of words; a null doc_id is no fault, and of rows
    that repeat all stay or go.
    """
    columns, place = docs.columns, docs.columns.index("text")
    own = {name: fresh_name(docs, f"_{name}") for name in MEASURES}
    with_measures = docs.select("*", *(F.lit(0).cast("long").alias(name) for name in own.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = pa.array(np.arange(len(batch))), batch.column(place)
            named = pa.RecordBatch.from_arrays([rows, texts], ["doc_id", "text"])
            (measured,) = _measure(iter([named]))
            found = [measured.column(name) for name in MEASURES]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*columns, *own.values()])

    measured = docs.mapInArrow(run, with_measures.schema)
    failed = failure_bits(lambda name: F.col(f"`{own[name]}`"))
    return measured.where(passes(BASE, failed) & passes(policy, failed)).drop(*own.values())
