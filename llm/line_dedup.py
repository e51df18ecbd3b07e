"""Removal of lines that many documents share, with two Bloom filters before any shuffle of lines.

First pass: each task puts the hashes of its documents' lines into a filter of hashes seen once and,
where they are already there, into a filter of hashes seen twice. Filters of tasks are merged by
segment: what both have seen once has been seen twice. Second pass: only lines that the second filter
holds are suspected of being repeated; their digests, not their texts, are shuffled, counted exactly
and given the document that keeps them. A filter's false positives cost a little traffic and never
change a result, and it has no false negatives.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import fresh_name, store

MIN_CHARS = 20
MIN_DOCS = 3
#: The bound of what is broadcast: one filter of 2**28 bits is 32 MiB, however large the input is.
#: Beyond some 100 million different lines it fills up, and more lines are confirmed by the shuffle.
MAX_BITS = 28
BITS_PER_LINE = 12
SEGMENT_BITS = 16
PROBES = 2
_STRIP = "".join(map(chr, (0x20, *range(0x09, 0x0E))))


def long_keys(text: str | None, min_chars: int) -> list[str | None]:
    """The key of each line; None where it is shorter than ``min_chars`` code points."""
    keys = []
    for line in (text or "").split("\n"):
        stripped = line.strip(_STRIP)
        if len(stripped) < min_chars:
            keys.append(None)
        else:
            # Bytes lower A-Z only, which are no part of other characters in UTF-8.
            keys.append(stripped.encode().lower().decode())
    return keys


def digest(key: str) -> bytes:
    """128 bits stand for the line; two different lines never meet in practice."""
    return hashlib.blake2b(key.encode(), digest_size=16).digest()


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit places of each hash: one column per probe, all within one segment of the filter."""
    segment = (hashes >> np.uint64(64 - max(0, bits - SEGMENT_BITS))) if bits > SEGMENT_BITS else 0
    within = min(bits, SEGMENT_BITS)
    mask = np.uint64((1 << within) - 1)
    places = [
        (segment << np.uint64(within)) | ((hashes >> np.uint64(16 * i)) & mask)
        if bits > SEGMENT_BITS
        else (hashes >> np.uint64(16 * i)) & mask
        for i in range(PROBES)
    ]
    return np.stack(places, axis=1).astype(np.int64)


def task_filters(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places set in a task's two filters, from one hash for each (document, line), in any order."""
    different, counts = np.unique(hashes, return_counts=True)
    once = np.unique(probes(different, bits))
    twice = np.unique(probes(different[counts > 1], bits))
    return once, twice


def merge(filters: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Both filters of one segment, as bits, over several tasks."""
    once = np.zeros(1 << (SEGMENT_BITS - 3), dtype=np.uint8)
    twice = once.copy()
    for their_once, their_twice in filters:
        twice |= their_twice | (once & their_once)
        once |= their_once
    return once, twice


def _packed(places: np.ndarray) -> bytes:
    bits = np.zeros(1 << SEGMENT_BITS, dtype=np.uint8)
    bits[places] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=np.uint8)


def _document_hashes(text: str | None, min_chars: int) -> list[int]:
    keys = {key for key in long_keys(text, min_chars) if key is not None}
    return [xxhash.xxh3_64_intdigest(key) for key in keys]


_FILTERS = "segment bigint, once binary, twice binary"


def _set_bits(bloom: np.ndarray, places: np.ndarray) -> None:
    """Set bits by their places; those of one byte are put together before."""
    places = np.unique(places)
    if len(places):
        first = np.flatnonzero(np.append(True, np.diff(places >> 3) != 0))
        bits = (1 << (places & 7)).astype(np.uint8)
        bloom[places[first] >> 3] |= np.bitwise_or.reduceat(bits, first)


def twice_filter(docs: DataFrame, min_chars: int, bits: int) -> np.ndarray:
    """The merged filter of hashes seen in two documents or more, as bytes of ``2**bits`` bits.

    A task sends its segments compressed. They are merged by segment and salt, so each merge handles
    a part of the tasks, then by segment.
    """
    segments = 1 << max(0, bits - SEGMENT_BITS)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Filters of the batches so far, by segment: memory is bounded by the size of two filters.
        size = 1 << max(bits, SEGMENT_BITS) >> 3
        once, twice = np.zeros(size, dtype=np.uint8), np.zeros(size, dtype=np.uint8)
        for batch in batches:
            found: list[int] = []
            for text in batch.column("text").to_pylist():
                found += _document_hashes(text, min_chars)
            some_once, some_twice = task_filters(np.array(found, dtype=np.uint64), bits)
            was = (once[some_once >> 3] >> (some_once & 7)) & 1
            again = np.concatenate((some_twice, some_once[was == 1]))
            _set_bits(twice, again)
            _set_bits(once, some_once)
        step = 1 << (SEGMENT_BITS - 3)
        for segment in range(segments):
            part = slice(segment * step, (segment + 1) * step)
            if once[part].any():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([segment], pa.int64()),
                        pa.array([zlib.compress(once[part].tobytes(), 1)]),
                        pa.array([zlib.compress(twice[part].tobytes(), 1)]),
                    ],
                    ["segment", "once", "twice"],
                )

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, once, twice = None, None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([current], pa.int64()),
                    pa.array([zlib.compress(once.tobytes(), 1)]),
                    pa.array([zlib.compress(twice.tobytes(), 1)]),
                ],
                ["segment", "once", "twice"],
            )

        for batch in batches:
            for segment, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment != current:
                    if current is not None:
                        yield row()
                    current, once, twice = segment, *merge(iter(()))
                their_once, their_twice = _unpacked(a), _unpacked(b)
                twice |= their_twice | (once & their_once)
                once |= their_once
        if current is not None:
            yield row()

    built = docs.select("text").mapInArrow(build, _FILTERS)
    salted = built.withColumn("salt", F.spark_partition_id() % 16)
    first = (
        salted.repartition("segment", "salt")
        .sortWithinPartitions("segment", "salt")
        .select("segment", "once", "twice")
        .mapInArrow(merged, _FILTERS)
    )
    second = first.repartition("segment").sortWithinPartitions("segment").mapInArrow(merged, _FILTERS)
    # At most 2**MAX_BITS bits in all: a bound that does not depend on the input.
    whole = np.zeros(segments << (SEGMENT_BITS - 3), dtype=np.uint8)
    step = 1 << (SEGMENT_BITS - 3)
    for row in second.select("segment", "twice").toLocalIterator():
        whole[row.segment * step : (row.segment + 1) * step] = _unpacked(bytes(row.twice))
    return whole


def filter_bits(docs: DataFrame, max_bits: int = MAX_BITS) -> int:
    """Bits of the filter as a power of two: by the number of lines, up to the fixed bound."""
    lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0]
    return min(max_bits, max(SEGMENT_BITS, int(BITS_PER_LINE * (lines or 1) - 1).bit_length()))


def shared_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """doc_id and ``keys``: digests of the lines that all rows of this doc_id lose.

    A line is lost by all documents that hold its key but the one with the largest doc_id, if it has
    ``min_chars`` code points and ``min_docs`` documents hold it. Rows with the same doc_id are one
    document; rows with a null doc_id take no part.
    """
    spark = docs.sparkSession
    given = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    bits = filter_bits(given, max_bits)
    suspects_filter = spark.sparkContext.broadcast(twice_filter(given, min_chars, bits))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = suspects_filter.value
        for batch in batches:
            ids, digests = [], []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = list({k for k in long_keys(text, min_chars) if k is not None})
                if not keys:
                    continue
                hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
                places = probes(hashes, bits)
                hit = ((bloom[places >> 3] >> (places & 7)) & 1).all(axis=1)
                for i in np.flatnonzero(hit):
                    ids.append(doc_id)
                    digests.append(digest(keys[i]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(digests, pa.binary())], ["doc_id", "key"]
            )

    # Both sides of the join are stored tables, so a line of very many documents is split in it.
    suspected = store(given.mapInArrow(suspects, "doc_id bigint, key binary"), "line-suspects")
    repeated = store(
        suspected.groupBy("key")
        .agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .select("key", "keeper"),
        "line-keepers",
    )
    return (
        suspected.join(repeated, "key")
        .where(F.col("doc_id") != F.col("keeper"))
        .groupBy("doc_id")
        .agg(F.collect_set("key").alias("keys"))
    )


def drop_shared_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    max_bits: int = MAX_BITS,
    with_counts: bool = False,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, without the lines they lose.

    A null or empty text is one empty line and stays as it is. With ``with_counts``, the columns
    ``n_lines`` (before dropping) and ``n_dropped`` follow, with an underscore after the name where
    ``docs`` has it already.
    """
    keys = fresh_name(docs, "_keys")
    lost = shared_lines(docs, min_chars, min_docs, max_bits).withColumnsRenamed({"keys": keys})
    lost_id = fresh_name(docs, "_lost_id")
    lost = lost.withColumnRenamed("doc_id", lost_id)
    joined = docs.join(lost, docs["doc_id"].cast("long") == F.col(lost_id), "left").drop(lost_id)
    names = docs.columns
    schema = docs.schema
    if with_counts:
        zero = F.lit(0).cast("long")
        counts = [fresh_name(docs, "n_lines"), fresh_name(docs, "n_dropped")]
        schema = docs.select("*", *(zero.alias(name) for name in counts)).schema
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            lost_keys = batch.column(len(names)).to_pylist()
            n_lines, n_dropped = [], []
            for i, (text, lose) in enumerate(zip(texts, lost_keys, strict=True)):
                lines = (text or "").split("\n")
                n_lines.append(len(lines))
                n_dropped.append(0)
                if lose:
                    lose = set(lose)
                    kept = [
                        line
                        for line, key in zip(lines, long_keys(text, min_chars), strict=True)
                        if key is None or digest(key) not in lose
                    ]
                    texts[i] = "\n".join(kept)
                    n_dropped[i] = len(lines) - len(kept)
            columns = list(batch.columns[: len(names)])
            columns[place] = pa.array(texts, pa.string())
            if with_counts:
                columns += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return joined.mapInArrow(run, schema)
