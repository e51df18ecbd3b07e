"""Exact top-k search by distributed selection on score histograms.

All scores are computed block by block in each pass and never stored. A pass counts the scores of
each query in equal bins between two bounds; the counts of all candidate blocks are added up, which
shows the bin of the k-th highest score, and this bin is the next pass's range. Once a bin is one
integer wide, the k-th score is known exactly. A last pass keeps what scores above it, and of the
rows that score exactly it the smallest ids, as many as are needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from llm.common import store

BINS = 128
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
SCALE = 64
#: Sums below this are exact in double arithmetic, whatever their order.
EXACT_SUM = 2.0**52
#: Scores are returned as 64-bit numbers; those beyond are ranked by their exact values and shown as
#: the nearest end of that range.
LARGEST = 2**63 - 1
#: Query blocks whose histograms a task holds at a time.
HELD_BLOCKS = 32


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and ``v``: floor(scale * x) of each component, x as double.

    Vectors that are null, hold a null or a component that is not finite, or whose vec_id is null,
    take no part. The components are whole numbers kept as doubles, which hold them exactly.
    """
    x = F.col("embedding").cast("array<double>")
    usable = F.col("embedding").isNotNull() & ~F.exists(
        x,
        lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))),
    )
    return (
        vectors.where(usable & F.col("vec_id").isNotNull())
        .select(F.col("vec_id").cast("long"), F.transform(x, lambda c: _floor(c * scale)).alias("v"))
    )


def _floor(c: Column) -> Column:
    """The whole number below, as a double; doubles from 2**52 on are whole numbers."""
    return F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(c)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros, which add nothing to a product."""
    lengths = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products: 64-bit, or Python integers if some do not fit.

    Rows so large that doubles might round are multiplied as Python integers.
    """
    bounds = np.abs(rows).max(axis=1, initial=0) * np.abs(queries).max(initial=0) * max(1, rows.shape[1])
    large = np.flatnonzero(bounds >= EXACT_SUM)
    if not len(large):
        return (queries @ rows.T).astype(np.int64)
    scores = np.zeros((len(queries), len(rows)), dtype=object)
    small = np.flatnonzero(bounds < EXACT_SUM)
    scores[:, small] = (queries @ rows[small].T).astype(np.int64)
    whole = [np.array([[int(c) for c in v] for v in part], dtype=object) for part in (queries, rows[large])]
    scores[:, large] = whole[0] @ whole[1].T
    return scores.astype(np.int64) if bounds.max() < LARGEST / 2 else scores


def _integers(column: pa.Array) -> np.ndarray:
    """Whole numbers given as text: 64-bit, or Python integers if some do not fit."""
    values = [int(text) for text in column.to_pylist()]
    fits = all(abs(value) < LARGEST // 4 for value in values)
    return np.array(values, dtype=np.int64 if fits else object)


def _blocks(df: DataFrame, size: int, label: str) -> DataFrame:
    """Rows with a block number below count / size, spread whatever ids repeat."""
    blocks = max(1, -(-df.count() // size))
    spread = F.xxhash64(F.monotonically_increasing_id())
    return df.withColumn(label, F.pmod(spread, F.lit(blocks)).cast("int"))


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """query_id, rank from 1, vec_id and score of the ``k`` highest scores of each query.

    ``vectors`` has vec_id and embedding; other columns are ignored. ``is_query`` picks the queries;
    candidates are all rows but those with the query's own vec_id. Ties go to the smaller vec_id;
    rows that repeat a vec_id are candidates (and queries) of their own, ranked next to each other.
    Vectors of different lengths are filled up with zeros. Any finite vector takes part: ranks follow
    the exact scores, and a score that does not fit 64 bits is shown as the end of their range.
    With fewer than ``k`` candidates all are returned; without queries or candidates, no row.
    """
    spark = vectors.sparkSession
    base = quantized(vectors)
    rows = store(_blocks(base, candidate_block, "block"), "topk-rows")
    limits = rows.agg(
        F.max(F.size("v")).alias("width"),
        F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))).alias("norm"),
    ).first()
    result = "query_id bigint, rank int, vec_id bigint, score bigint"
    if limits.width is None:
        return spark.createDataFrame([], result)
    width = limits.width
    # No score is larger than the product of the two largest norms.
    top = int(limits.norm * limits.norm * 1.000001) + 1
    queries = _blocks(rows.where(is_query).drop("block"), query_block, "qblock").select(
        F.monotonically_increasing_id().alias("query_row"),
        F.col("vec_id").alias("query_id"),
        F.col("v").alias("q"),
        "qblock",
        F.lit(str(-top)).alias("low"),
        F.lit(str(2 * top + 1)).alias("span"),
        F.lit(k).cast("long").alias("need"),
    )
    queries = store(queries, "topk-queries")
    n_blocks = queries.agg(F.max("qblock")).first()[0]
    if n_blocks is None:
        return spark.createDataFrame([], result)
    packed = rows.groupBy("block").agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))
    packed = store(packed, "topk-blocks")
    state = queries
    while True:
        counts = _pass(packed, state, width, k, final=False)
        state = store(_refined(state, counts), "topk-state")
        if state.where("span <> '1'").isEmpty():
            break
    found = _pass(packed, state, width, k, final=True, top=top)
    order = W.partitionBy("query_row").orderBy(F.desc("place"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _refined(state: DataFrame, counts: DataFrame) -> DataFrame:
    """The bin that holds the k-th score becomes the range; ``need`` is the rank within it."""
    above = W.partitionBy("query_row").orderBy(F.desc("bin"))
    reached = F.sum("n").over(above)
    cut = (
        counts.withColumn("reached", reached)
        .join(state.select("query_row", "need"), "query_row")
        .where((F.col("reached") >= F.col("need")) & (F.col("reached") - F.col("n") < F.col("need")))
        .select("query_row", "bin", (F.col("reached") - F.col("n")).alias("higher"))
    )

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows, spans = _integers(batch.column("low")), _integers(batch.column("span"))
            steps, bins = _steps(spans), batch.column("bin").to_pylist()
            # A query with fewer than k candidates has no such bin: its range shrinks to its lowest value.
            low = [
                str(x if n is None else int(x) + n * int(s))
                for x, n, s in zip(lows, bins, steps, strict=True)
            ]
            span = ["1" if n is None else str(s) for n, s in zip(bins, steps, strict=True)]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns |= {"low": pa.array(low, pa.string()), "span": pa.array(span, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    names = state.columns
    need = (F.col("need") - F.coalesce(F.col("higher"), F.lit(0))).cast("long")
    found = state.join(cut, "query_row", "left").withColumn("need", need)
    return found.mapInArrow(narrowed, state.schema)


def _steps(spans: np.ndarray) -> np.ndarray:
    """Width of a bin; whole numbers of any size."""
    return np.maximum(1, -(-spans // BINS))


def _pass(
    packed: DataFrame, state: DataFrame, width: int, k: int, final: bool, top: int = 0
) -> DataFrame:
    """Score each block of queries against each block of candidates.

    Not final: query_row, bin, n (scores of the query in that bin of its range).
    Final: query_row, query_id, vec_id, score of what may be among the highest ``k``, and ``place``,
    text in the order of the exact scores, none of which is beyond ``top``.
    """
    spark = packed.sparkSession
    n_qblocks = state.agg(F.max("qblock")).first()[0] + 1
    # Every block of candidates meets every block of queries: the stated query set against all rows.
    # A task takes a block of queries and a slab of candidate blocks and adds up its histograms, so
    # there are as many rows as queries, bins and tasks ask for, however many blocks there are.
    slabs = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // n_qblocks))
    asked = (
        state.groupBy("qblock")
        .agg(
            F.collect_list(F.struct("query_row", "query_id", "q", "low", "span", "need")).alias(
                "asked"
            )
        )
        .withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))))
    )
    pairs = packed.select(
        "rows",
        F.pmod("block", F.lit(slabs)).alias("slab"),
        F.explode(F.sequence(F.lit(0), F.lit(n_qblocks - 1))).alias("qblock"),
    ).join(asked, ["qblock", "slab"])
    digits = len(str(2 * top + 1))

    def scored(batch: pa.RecordBatch, i: int) -> Iterator[tuple]:
        asked_of, given = batch.column("asked")[i].values, batch.column("rows")[i].values
        part = {name: np.asarray(asked_of.field(name)) for name in ("query_row", "query_id", "need")}
        part |= {name: _integers(asked_of.field(name)) for name in ("low", "span")}
        ids = np.asarray(given.field("vec_id"))
        matrix = _matrix(given.field("v"), width)
        wanted = _matrix(asked_of.field("q"), width)
        for at in range(0, len(wanted), 256):
            some = slice(at, at + 256)
            chosen = {name: values[some] for name, values in part.items()}
            other = ids[None, :] != chosen["query_id"][:, None]
            yield chosen, _scores(wanted[some], matrix), other, ids

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                for found in scored(batch, i):
                    yield _candidates(*found, top, digits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i in range(len(batch)):
                block = batch.column("qblock")[i].as_py()
                if block not in held:
                    if len(held) == HELD_BLOCKS:
                        yield from map(_counted, held.values())
                        held = {}
                    rows = np.sort(np.asarray(batch.column("asked")[i].values.field("query_row")))
                    held[block] = rows, np.zeros((len(rows), BINS), dtype=np.int64)
                # The same rows of a block may come in another order for another slab.
                rows, counts = held[block]
                for chosen, scores, other, _ in scored(batch, i):
                    counts[np.searchsorted(rows, chosen["query_row"])] += _histogram(chosen, scores, other)
        yield from map(_counted, held.values())

    if final:
        schema = "query_row bigint, query_id bigint, vec_id bigint, score bigint, place string"
        return pairs.mapInArrow(select, schema)
    counted = pairs.mapInArrow(count, "query_row bigint, bin int, n bigint")
    return counted.groupBy("query_row", "bin").agg(F.sum("n").alias("n"))


def _counted(held: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """The bins of a block of queries that hold a score."""
    rows, counts = held
    query, bins = np.nonzero(counts)
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[query]), pa.array(bins.astype(np.int32)), pa.array(counts[query, bins])],
        ["query_row", "bin", "n"],
    )


def _histogram(part, scores, other) -> np.ndarray:
    """Counts by query and bin of the scores within each query's range."""
    low, span, step = (x[:, None] for x in (part["low"], part["span"], _steps(part["span"])))
    inside = other & (scores >= low) & (scores < low + span)
    query, row = np.nonzero(inside)
    bins = ((scores - low) // step)[query, row].astype(np.int64)
    counts = np.bincount(query * BINS + bins, minlength=len(scores) * BINS)
    return counts.reshape(len(scores), BINS)


def _candidates(part, scores, other, ids, top, digits) -> pa.RecordBatch:
    """What scores above the k-th value, and the smallest ids that score just it."""
    order = np.argsort(ids, kind="stable")
    scores, other, ids = scores[:, order], other[:, order], ids[order]
    kth = part["low"][:, None]
    ties = other & (scores == kth)
    keep = (other & (scores > kth)) | (ties & (np.cumsum(ties, axis=1) <= part["need"][:, None]))
    query, row = np.nonzero(keep)
    exact = [int(score) for score in scores[query, row]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(part["query_row"][query]),
            pa.array(part["query_id"][query]),
            pa.array(ids[row]),
            pa.array([max(-LARGEST - 1, min(LARGEST, score)) for score in exact], pa.int64()),
            pa.array([str(score + top).zfill(digits) for score in exact], pa.string()),
        ],
        ["query_row", "query_id", "vec_id", "score", "place"],
    )
