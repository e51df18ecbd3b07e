"""Byte-level BPE encoding of whole texts, long ones in overlapping chunks, and decoding.

A text of up to ``chunk_chars`` is encoded where it stands. A longer one is cut into chunks that
overlap. All chunks are pre-tokenized in parallel. Since a pre-token depends only on the text from
its start on, two runs of the pattern that share a boundary agree from there on; so the chunks of a
text are cut at the first boundary that both neighbours have, which takes the boundaries of their
overlaps only. The pieces between the cuts are again encoded in parallel, and their ids put together in
order. Where a pre-token is longer than the overlap, the text from there on is stitched in one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from llm.common import store

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 1 << 9
#: Rows whose texts and ids a task holds as objects at a time.
PART_ROWS = 256
#: Characters a pre-token must be able to see after its end, where the text goes on.
LOOKAHEAD = 2


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@cache
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding(
        path, pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={}
    )


@cache
def token_bytes(path: str) -> list[bytes]:
    table = [b""] * (max(ranks(path).values()) + 1)
    for token, rank in ranks(path).items():
        table[rank] = token
    return table


def encode_text(text: str, path: str, pattern: str) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return encoding(path, pattern).encode_to_numpy(text).astype("<u4").tobytes()


def decode_ids(ids: bytes, path: str) -> bytes:
    """The raw bytes of the tokens, put together; they need not be valid UTF-8 piece by piece."""
    return b"".join(map(token_bytes(path).__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows, so many at a time that the strings and ids made of them take little memory."""
    for batch in batches:
        for at in range(0, len(batch), PART_ROWS):
            yield batch.slice(at, PART_ROWS)


def _encoded(
    batches: Iterator[pa.RecordBatch], path: str, pattern: str, names: list[str]
) -> Iterator[pa.RecordBatch]:
    """Rows with the ids of their whole ``text`` in its place, as the last of the columns ``names``."""
    for batch in _parts(batches):
        texts = batch.column("text").to_pylist()
        ids = pa.array([encode_text(t or "", path, pattern) for t in texts], pa.binary())
        others = [batch.column(c) for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*others, ids], names)


def boundaries(text: str, pattern: regex.Pattern, last: bool) -> list[int]:
    """Starts and ends of the pre-tokens from the start of ``text``.

    If the text goes on after it (``last`` is false), only those that cannot change by that.
    """
    ends, limit = [0], len(text) if last else len(text) - LOOKAHEAD
    for match in pattern.finditer(text):
        if match.end() > limit:
            break
        ends.append(match.end())
    return ends


def stitch(chunks: list[tuple[int, str, list[int]]], pattern: regex.Pattern) -> list[str]:
    """Pieces of a text that can be encoded on their own, from its chunks in order.

    A chunk is (start in the text, its text, its boundaries). A piece ends where two neighbours
    first agree after a character that is not white space: no later text can change the pre-tokens
    before such a place. Where neighbours do not agree within the overlap (a pre-token longer than
    it), the pattern runs on from the last sure boundary over the joined text.
    """
    pieces: list[str] = []
    start, text, ends = chunks[0]
    for next_start, next_text, next_ends in chunks[1:]:
        theirs = {next_start + e for e in next_ends}
        joined = text + next_text[start + len(text) - next_start :]
        cut = _first_agreement(start, joined, ends, theirs)
        if cut is None:
            sure = max(ends)
            more = boundaries(joined[sure:], pattern, False)
            ends = ends + [sure + e for e in more[1:]]
            cut = _first_agreement(start, joined, ends, theirs)
        if cut is None:
            text = joined
            continue
        pieces.append(joined[: cut - start])
        text = next_text[cut - next_start :]
        ends = [next_start + e - cut for e in next_ends if next_start + e >= cut]
        start = cut
    return [*pieces, text]


def _first_agreement(start: int, text: str, ends: list[int], theirs: set[int]) -> int | None:
    for end in ends:
        if end and start + end in theirs and not text[end - 1].isspace():
            return start + end
    return None


def seam_cuts(chunks: DataFrame) -> DataFrame:
    """row, no, begin, end, alone: where each chunk's own piece lies in its text.

    ``chunks`` has, besides row and no, the boundaries ``head`` in the overlap with the chunk before,
    and ``tail`` in that with the next one, after characters that are not white space. Neighbours are
    cut at the first boundary that both have. A chunk whose neighbours behind it all agree on from the
    start of the text is ``alone``; where two do not agree, those from the first of them on are not.
    Only boundaries of overlaps are joined here, and two numbers per chunk are ordered within a text.
    """
    left = chunks.select("row", (F.col("no") + 1).alias("no"), "tail")
    both = chunks.select("row", "no", "head").join(left, ["row", "no"], "left")
    cut = F.when(F.col("no") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("tail", "head")))
    cuts = both.select("row", "no", cut.cast("long").alias("begin"))
    text = W.partitionBy("row")
    bad = F.min(F.when(F.col("begin").isNull(), F.col("no"))).over(text)
    return cuts.withColumn("bad", bad).select(
        "row",
        "no",
        "begin",
        F.lead("begin").over(text.orderBy("no")).alias("end"),
        (F.col("bad").isNull() | (F.col("no") < F.col("bad") - 1)).alias("alone"),
    )


def encode(
    docs: DataFrame,
    path: str,
    pattern: str,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: doc_id, the columns named in ``carry``, ``ids``.

    ``ids`` holds little-endian unsigned 32-bit token ids, without special tokens. A null or empty
    text has no ids; a null doc_id and repeated rows keep their place as rows of their own. Only
    texts longer than ``chunk_chars`` are shuffled, twice as chunks, spread by chunk, so that one very
    long text is encoded by many tasks and no task holds more of it than a chunk and the ids.
    """
    # Carried columns have names of their own on the way.
    named = [docs[c].alias(f"_carried{i}") for i, c in enumerate(carry)]
    kept = docs.select("doc_id", "text", *named)
    schema = kept.drop("text").withColumn("ids", F.lit(b"")).schema
    is_long = F.coalesce(F.length("text"), F.lit(0)) > chunk_chars

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encoded(batches, path, pattern, schema.names)

    short = kept.where(~is_long).mapInArrow(whole, schema)

    # ``row`` tells rows apart that share a doc_id. It is stored with the long texts, so that a task
    # that runs again, on rows in another order, cannot give the chunks of a text another number.
    others = [c for c in kept.columns if c != "text"]
    number = F.monotonically_increasing_id().alias("row")
    marked = store(kept.where(is_long).select("text", *others, number), "bpe-long-texts")
    window_schema = marked.select(
        "row",
        *others,
        F.lit(0).alias("no"),
        F.col("text").alias("chunk"),
        F.lit(True).alias("last"),
    ).schema

    def windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                text = batch.column("text")[i].as_py()
                starts = range(0, len(text), chunk_chars)
                repeat = pa.array([i] * len(starts))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(repeat) for c in ("row", *others)),
                        pa.array(range(len(starts)), pa.int32()),
                        pa.array([text[at : at + chunk_chars + overlap_chars] for at in starts]),
                        pa.array([at == starts[-1] for at in starts]),
                    ],
                    window_schema.names,
                )

    windows = marked.mapInArrow(windowed, window_schema)

    def pretokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for batch in batches:
            heads, tails = [], []
            for no, chunk, last in zip(
                *(batch.column(c).to_pylist() for c in ("no", "chunk", "last")), strict=True
            ):
                start, ends = no * chunk_chars, boundaries(chunk, compiled, last)
                heads.append([start + e for e in ends if e <= overlap_chars])
                tails.append(
                    [start + e for e in ends if e >= chunk_chars and not chunk[e - 1].isspace()]
                )
            seams = [pa.array(x, pa.list_(pa.int64())) for x in (heads, tails)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *seams], [*batch.schema.names, "head", "tail"]
            )

    seam = F.lit(None).cast("array<bigint>")
    with_seams = windows.select("*", seam.alias("head"), seam.alias("tail")).schema
    chunks = store(windows.repartition("row", "no").mapInArrow(pretokenize, with_seams), "bpe-chunks")
    placed = chunks.drop("head", "tail").join(seam_cuts(chunks), ["row", "no"])

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("no", "chunk", "begin", "end"))
            pieces = [
                chunk[begin - no * chunk_chars : None if end is None else end - no * chunk_chars]
                for no, chunk, begin, end in zip(*columns, strict=True)
            ]
            kept = [batch.column(c) for c in ("row", *others, "no")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(pieces, pa.string())], ["row", *others, "no", "piece"]
            )

    gathered = (
        placed.where(~F.col("alone"))
        .groupBy("row")
        .agg(
            *(F.first(c).alias(c) for c in others),
            F.sort_array(F.collect_list(F.struct("no", "chunk", "last", "begin"))).alias("chunks"),
        )
    )

    def stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for batch in batches:
            for i in range(len(batch)):
                parts = batch.column("chunks")[i].as_py()
                # The first of them begins at the last sure seam, the others where they were cut.
                starts = [parts[0]["begin"], *(p["no"] * chunk_chars for p in parts[1:])]
                texts = [p["chunk"][at - p["no"] * chunk_chars :] for p, at in zip(parts, starts, strict=True)]
                ends = [boundaries(t, compiled, p["last"]) for t, p in zip(texts, parts, strict=True)]
                pieces = stitch(list(zip(starts, texts, ends, strict=True)), compiled)
                repeat = pa.array([i] * len(pieces))
                first = parts[0]["no"]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(repeat) for c in ("row", *others)),
                        pa.array(range(first, first + len(pieces)), pa.int32()),
                        pa.array(pieces, pa.string()),
                    ],
                    ["row", *others, "no", "piece"],
                )

    piece_schema = windows.select("row", *others, "no", F.col("chunk").alias("piece")).schema

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            pieces = batch.column("piece").to_pylist()
            ids = pa.array([encode_text(p, path, pattern) for p in pieces], pa.binary())
            rest = [batch.column(c) for c in ("row", *others, "no")]
            yield pa.RecordBatch.from_arrays([*rest, ids], ["row", *others, "no", "ids"])

    id_schema = windows.select("row", *others, "no", F.lit(b"").alias("ids")).schema

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [b"".join(p["ids"] for p in parts) for parts in batch.column("parts").to_pylist()]
            rest = [batch.column(c) for c in others]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(ids, pa.binary())], schema.names)

    sure = placed.where("alone").mapInArrow(cut_out, piece_schema)
    rest = gathered.mapInArrow(stitched, piece_schema).repartition("row", "no")
    long = (
        sure.unionByName(rest)
        .mapInArrow(encode_pieces, id_schema)
        .groupBy("row")
        .agg(
            *(F.first(c).alias(c) for c in others),
            F.sort_array(F.collect_list(F.struct("no", "ids"))).alias("parts"),
        )
        .mapInArrow(joined, schema)
    )
    return short.unionByName(long).toDF("doc_id", *carry, "ids")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``ids`` replaced by ``decoded``: the bytes of the text. Null ids: null."""
    schema = encoded.drop("ids").withColumn("decoded", F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            raw = pa.array([None if x is None else decode_ids(x, path) for x in ids], pa.binary())
            others = [batch.column(c) for c in batch.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([*others, raw], schema.names)

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, by encoding and decoding it."""
    encoded = encode(docs, path, pattern)
    digests = encoded.select(
        "doc_id",
        "ids",
        F.expr("length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
    )
    return decode(digests, path).select(
        F.col("doc_id").cast("long"),
        F.col("n_tokens").cast("long"),
        "ids_sha256",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
