"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source whose target is r times its size should be taken r times on average: floor(r)
times for sure, and once more with probability r - floor(r). These probabilities are rounded in
dependence: two documents with fractional probabilities exchange mass (probability times size) until
one of them is 0 or 1, in a direction drawn so that each keeps its probability on average. The mass
of the source does not change by an exchange, so the words taken differ from the target by less than
the one document that is left at the end. Groups of documents are rounded in parallel; each leaves
one residual, and the residuals of neighbouring groups meet on the next level of a tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from llm.common import fresh_name, store

#: Documents of one leaf group, and residuals of one group on each level above.
GROUP = 4096
MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: float = MAX_COPIES
) -> DataFrame:
    """source, source_size, n_docs, weight, target of each source.

    ``sizes`` has source and size. Sources by code point, null last, weigh ``weights`` in turn. All
    sources together get the size of all documents; none gets more than ``max_copies`` times its own
    size, and what it cannot take is shared by weight among the others, until none is above.
    """
    totals = store(
        sizes.groupBy("source").agg(
            F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")
        ),
        "mix-sources",
    )
    # One row per source here, whatever the number of documents.
    place = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    weighed = store(
        totals.withColumn(
            "weight", F.element_at(cycle, (F.row_number().over(place) - 1) % len(weights) + 1)
        ),
        "mix-weights",
    )
    cap = F.col("source_size") * F.lit(float(max_copies))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    # Each turn fixes the sources above their cap; the level only rises, so they stay there.
    level, above = -1.0, -1
    while True:
        capped = cap <= F.lit(level) * F.col("weight")
        row = weighed.agg(
            F.count_if(capped).alias("n"),
            F.sum(F.when(capped, cap)).alias("mass"),
            F.sum(F.when(~capped, F.col("weight"))).alias("open"),
        ).first()
        if row.n == above or not row.open:
            break
        above = row.n
        level = (total - (row.mass or 0.0)) / row.open
    return weighed.select(
        "source",
        "source_size",
        "n_docs",
        "weight",
        F.least(cap, F.lit(level) * F.col("weight")).alias("target"),
    )


def pivot(mass: np.ndarray, size: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Round ``mass`` (between 0 and ``size``) to 0 or size, one exchange after another.

    Returns the rounded masses and the place of the one that is left between, or -1.
    """
    mass, size, draws, left = mass.tolist(), size.tolist(), draws.tolist(), -1
    for i in range(len(mass)):
        if mass[i] <= 0 or mass[i] >= size[i]:
            continue
        if left < 0:
            left = i
            continue
        a, b = left, i
        up = min(size[a] - mass[a], mass[b])  # what can go from b to a
        down = min(mass[a], size[b] - mass[b])  # and from a to b
        if draws[i] * (up + down) < down:
            moved, full = up, up == size[a] - mass[a]
            mass[a], mass[b] = mass[a] + moved, mass[b] - moved
            if full:
                mass[a] = size[a]
            if up == mass[b] + moved:
                mass[b] = 0.0
        else:
            moved, full = down, down == size[b] - mass[b]
            mass[a], mass[b] = mass[a] - moved, mass[b] + moved
            if full:
                mass[b] = size[b]
            if down == mass[a] + moved:
                mass[a] = 0.0
        left = next((j for j in (a, b) if 0 < mass[j] < size[j]), -1)
    return np.array(mass), left


_LEVEL = "source string, doc bigint, no bigint, size bigint, mass double, bucket bigint, open boolean"


def _rounded(rows: DataFrame) -> DataFrame:
    """Round within each (source, bucket); at most one row of each stays open.

    Rows come sorted by group and go through one by one: a group is never gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the rows of the group that is not ended
        for batch in batches:
            whole = batch if held is None else pa.concat_batches([held, batch])
            source, bucket = whole.column("source").to_pylist(), whole.column("bucket").to_numpy()
            ends = [
                i
                for i in range(1, len(whole))
                if bucket[i] != bucket[i - 1] or source[i] != source[i - 1]
            ]
            last = ends[-1] if ends else 0
            for first, end in zip([0, *ends[:-1]], ends, strict=False):
                yield _round_group(whole.slice(first, end - first))
            held = whole.slice(last)
        if held is not None and len(held):
            yield _round_group(held)

    return rows.mapInArrow(run, _LEVEL)


def _round_group(group: pa.RecordBatch) -> pa.RecordBatch:
    size = group.column("size").to_numpy().astype(np.float64)
    draws = group.column("draw").to_numpy()
    mass, left = pivot(group.column("mass").to_numpy(), size, draws)
    still = np.zeros(len(mass), dtype=bool)
    if left >= 0:
        still[left] = True
    names = ["source", "doc", "no", "size", "mass", "bucket", "open"]
    columns = [group.column(n) for n in ("source", "doc", "no", "size")]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array(mass), group.column("bucket"), pa.array(still)], names
    )


def _draw(seed: int, level: int) -> Column:
    """A number in [0, 1) that depends on the document and the level only."""
    bits = F.xxhash64(F.lit(seed), F.lit(level), F.col("source"), F.col("doc"), F.col("no"))
    return F.pmod(bits, F.lit(1 << 52)) / float(1 << 52)


def mix_counts(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    max_copies: float = MAX_COPIES,
    seed: int = 0,
    group: int = GROUP,
) -> DataFrame:
    """doc_id, no, size, source, source_size, target, copies: how often each row of ``docs`` is taken.

    ``no`` tells rows with the same doc_id, source and size apart. A null or empty text has size 0
    and is taken floor(r) times. Null sources are one source, null doc_ids are rows like others.
    Draws depend on seed, source, doc_id and ``no`` only, so reruns agree however rows are split.
    A source, however large, is spread over groups of about ``group`` documents; the tree has as many
    levels as the largest source needs, each a job over the residuals of the one below.
    """
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc"),
        F.col("source").cast("string"),
        word_count(F.col("text")).alias("size"),
    )
    alike = base.groupBy("doc", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    sizes = store(
        alike.withColumn("no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("n"),
        "mix-sizes",
    )
    targets = store(source_targets(sizes, weights, max_copies), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    marked = sizes.join(
        targets.select(F.col("source").alias("s"), "source_size", "n_docs", "target"),
        F.col("source").eqNullSafe(F.col("s")),
    ).drop("s")
    # Rounding noise in the ratio must not make a whole number of copies fractional.
    marked = marked.withColumn("ratio", F.round(ratio, 12)).withColumn("whole", F.floor("ratio"))
    fraction = F.col("ratio") - F.col("whole")
    open_rows = marked.where((F.col("size") > 0) & (fraction > 0)).select(
        "source",
        "doc",
        "no",
        "size",
        (fraction * F.col("size")).alias("mass"),
        F.pmod(
            F.xxhash64(F.lit(seed), F.col("doc"), F.col("no")),
            F.ceil(F.col("n_docs") / group).cast("long"),
        ).alias("bucket"),
    )
    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    levels, groups = 0, math.ceil(largest / group)
    while groups > 1:
        levels, groups = levels + 1, math.ceil(groups / group)
    decided = None
    for level in range(levels + 1):
        ordered = (
            open_rows.withColumn("draw", _draw(seed, level))
            .repartition("source", "bucket")
            .sortWithinPartitions("source", "bucket", "draw", "doc", "no")
        )
        done = store(_rounded(ordered), f"mix-level{level}")
        last = level == levels
        closed = done if last else done.where(~F.col("open"))
        # What is left of the last group is taken with its probability.
        taken = F.when(
            F.col("open"), _draw(seed, -1) * F.col("size") < F.col("mass")
        ).otherwise(F.col("mass") > 0)
        some = closed.select("source", "doc", "no", "size", taken.cast("int").alias("extra"))
        decided = some if decided is None else decided.unionByName(some)
        if last:
            break
        open_rows = done.where("open").select(
            "source",
            "doc",
            "no",
            "size",
            "mass",
            F.floor(F.col("bucket") / group).cast("long").alias("bucket"),
        )
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"d.{c}")) for c in ("source", "doc", "no", "size")]
    return (
        marked.alias("m")
        .join(decided.alias("d"), same, "left")
        .select(
            F.col("m.doc").alias("doc_id"),
            "m.no",
            "m.size",
            "m.source",
            "m.source_size",
            "m.target",
            (F.col("m.whole") + F.coalesce(F.col("d.extra"), F.lit(0))).cast("long").alias("copies"),
        )
    )


def _row_key(doc: Column, source: Column, size: Column) -> Column:
    """Tells (doc, source, size) apart, nulls included, as one text."""
    part = F.coalesce(doc.cast("string"), F.lit("-"))
    return F.concat_ws("/", part, size.cast("string"), F.when(source.isNull(), "n").otherwise("s"), source)


def mixed(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mix takes each.

    The texts are shuffled once: rows are numbered and joined to their counts by the same key.
    """
    columns = docs.columns
    key, number = fresh_name(docs, "_key"), fresh_name(docs, "_number")
    copies, copy = fresh_name(docs, "_copies"), fresh_name(docs, "_copy")
    counts = (
        mix_counts(docs, **options)
        .groupBy(_row_key(F.col("doc_id"), F.col("source"), F.col("size")).alias(key))
        .agg(F.sort_array(F.collect_list(F.struct("no", "copies"))).alias(copies))
    )
    keyed = docs.withColumn(
        key, _row_key(F.col("doc_id"), F.col("source").cast("string"), word_count(F.col("text")))
    )
    same = W.partitionBy(key).orderBy(F.xxhash64("text"))
    joined = keyed.withColumn(number, F.row_number().over(same)).join(counts, key)
    times = F.element_at(F.col(copies), F.col(number)).getField("copies")
    return (
        joined.withColumn(copy, times)
        .where(F.col(copy) > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copy))))
        .select(*columns)
    )
