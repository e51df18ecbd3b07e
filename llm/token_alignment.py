"""Alignment of two tokenizers' ids by the ends that their tokens share.

The ends of a text's tokens, counted in bytes, are looked up for both tokenizers in dictionaries from
end to index. The intersection of their keys, sorted, cuts both lists of ids into groups, and links
are counted per group. Texts are taken apart at spaces where both tokenizers end a token whatever
stands around, so each different piece is encoded and aligned once and remembered.

How many documents of the corpus hold a link is counted in two steps without a hot key: each task
counts its distinct links by buckets of documents of bounded size, these counts are added up by link,
and every bucket gets the totals of its own links back.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tiktoken import Encoding

from llm.common import store
from llm.words import begins_solid, ends_solid, solid, utf8

#: Pieces remembered by a worker, and their bytes, at most; then the memory starts anew.
CACHED_PIECES = 1 << 19
CACHED_BYTES = 1 << 24
#: Distinct links of the documents of a bucket, at most (a single document may have more).
BUCKET_LINKS = 1 << 20
#: Pieces of a text whose groups are joined at a time.
PIECES = 1 << 16
#: A link as one number: the id of the first tokenizer times this, plus that of the second.
SHIFT = 32


# --- tokenizers: ids and the bytes of each token ---------------------------------------------


class ByteLevel:
    """A byte-level tokenizer in the format of the tokenizers library.

    Where its merges stand in the order of their ids, and it splits and normalises as usual, the same
    ids come several times faster from the tiktoken library with these entries as ranks.
    """

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        stored = json.loads(self.tokenizer.to_str())
        # The printable stand-ins of bytes: themselves if visible, else the next from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [byte for byte in range(256) if byte not in shown]
        table = {chr(c): c for c in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {token["id"] for token in stored["added_tokens"]}
        self.token_bytes = {
            i: entry.encode() if i in special else bytes(map(table.__getitem__, entry))
            for entry, i in self.tokenizer.get_vocab().items()
        }
        ranks = {self.token_bytes[i]: i for i in self.token_bytes if i not in special}
        vocabulary = stored["model"]["vocab"]
        merged = [vocabulary["".join(pair)] for pair in stored["model"]["merges"]]
        usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        splits = stored["pre_tokenizer"] or {}
        self.fast = None
        if (
            merged == sorted(merged)
            and stored["normalizer"] is None
            and usual.items() <= splits.items()
            and not stored["model"].get("ignore_merges")
        ):
            self.fast = Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        """Ids of a text that begins with the space already."""
        if self.fast:
            return self.fast.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class Pieces:
    """A tokenizer in the format of the sentencepiece library, which puts a space before a text."""

    SPACE = "▁"

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.token_bytes = {
            i: bytes([int(p[3:5], 16)])
            if self.model.is_byte(i)
            else p.replace(self.SPACE, " ").encode()
            for i, p in enumerate(pieces)
        }
        #: No piece goes on behind a space that follows another character.
        self.splits_at_spaces = not any(self.SPACE in p.lstrip(self.SPACE) for p in pieces)

    def encode(self, text: str) -> list[int]:
        """Ids of a text that begins with a space, which the library adds by itself."""
        return self.model.encode(text[1:])


def shared_ends(
    a_ends: list[int], b_ends: list[int]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of groups in rising order, and how many tokens of both lists lie before each.

    Where several tokens end at the same place, since one is empty, the last counts.
    """
    a_index = dict(zip(a_ends, range(1, len(a_ends) + 1), strict=True))
    b_index = dict(zip(b_ends, range(1, len(b_ends) + 1), strict=True))
    ends = sorted(a_index.keys() & b_index.keys())
    n = len(ends)
    return (
        np.array(ends, dtype=np.int64),
        np.fromiter(map(a_index.__getitem__, ends), np.int64, n),
        np.fromiter(map(b_index.__getitem__, ends), np.int64, n),
    )


class Aligner:
    """Alignments of texts, with those of the pieces that came before remembered."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        # Ids as text with the sign that follows: a comma, or what ends the half of a group.
        first, second = _shown(self.a.token_bytes, "|"), _shown(self.b.token_bytes, ";")
        self.shown, self.second = np.concatenate((first, second)), len(first)
        self.a_sizes, self.b_sizes = _sizes(self.a.token_bytes), _sizes(self.b.token_bytes)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.size = 0
        # Of each piece: ids of both, groups, links, and whether its bytes came back.
        self.counts = np.zeros((1 << 12, 5), dtype=np.int32)
        # Ends of each piece in its lists: places in ``shown`` of its groups; distinct links and how
        # often they occur.
        self.ends = np.zeros((1 << 12, 2), dtype=np.int64)
        self.parts = np.empty(1 << 14, dtype=np.int32)
        self.links = np.empty(1 << 14, dtype=np.int64)
        self.times = np.empty(1 << 14, dtype=np.int32)

    def learn(self, pieces: list[bytes]) -> None:
        """Align new pieces: those with safe ends as one text, if it comes back, others one by one."""
        together = [p for p in pieces if _is_safe(p)]
        found = self._aligned(together, [*itertools.accumulate(map(len, together))])
        if found is None:
            together, found = [], self._aligned([], [])
        self._keep(together, *found)
        done = set(together)
        for piece in pieces:
            if piece not in done:
                alone = self._aligned([piece], [len(piece)])
                self._keep([piece], *(alone or NOTHING))

    def _keep(self, pieces: list[bytes], counts, ends, parts, links, times) -> None:
        n, new = len(self.known), len(self.known) + len(pieces)
        self.known.update(zip(pieces, range(n, new), strict=True))
        self.counts, self.ends = _room(self.counts, new), _room(self.ends, new + 1)
        used = self.ends[n]
        self.counts[n:new], self.ends[n + 1 : new + 1] = counts, used + ends
        self.parts = _put(self.parts, used[0], parts)
        self.links, self.times = _put(self.links, used[1], links), _put(self.times, used[1], times)
        self.size += sum(map(len, pieces))

    def _aligned(self, pieces: list[bytes], bounds: list[int]) -> tuple | None:
        """Of each piece, where all are encoded as one text: counts, ends in its lists, places in
        ``shown`` of its groups, distinct links and how often they occur.

        None if a tokenizer does not give the text back, or has no end where a piece ends.
        """
        data = b"".join(pieces)
        if not data:
            empty = np.empty(0, np.int64)
            return np.zeros((0, 5), np.int64), np.zeros((0, 2), np.int64), empty, empty, empty
        text = data.decode()
        a_ids, b_ids = self.a.encode(text), self.b.encode(text)
        for ids, token_bytes in ((a_ids, self.a.token_bytes), (b_ids, self.b.token_bytes)):
            if b"".join(map(token_bytes.__getitem__, ids)) != data:
                return None
        a_ids, b_ids = np.array(a_ids), np.array(b_ids)
        ends, a_to, b_to = shared_ends(
            np.cumsum(self.a_sizes[a_ids]).tolist(), np.cumsum(self.b_sizes[b_ids]).tolist()
        )
        last = np.searchsorted(ends, bounds)  # the group that ends with each piece
        if not np.array_equal(ends[np.minimum(last, len(ends) - 1)], bounds):
            return None
        a_from, b_from = np.append(0, a_to[:-1]), np.append(0, b_to[:-1])
        a_n, b_n = a_to - a_from, b_to - b_from
        # The ids of a group stand behind those of both kinds in the groups before it.
        parts = np.empty(len(a_ids) + len(b_ids), dtype=np.int64)
        parts[np.arange(len(a_ids)) + np.repeat(b_from, a_n)] = 2 * a_ids + _closes(a_to)
        b_parts = 2 * b_ids + self.second + _closes(b_to)
        parts[np.arange(len(b_ids)) + np.repeat(a_to, b_n)] = b_parts
        totals = np.column_stack((a_to, b_to, np.arange(1, len(ends) + 1), np.cumsum(a_n * b_n)))
        totals = np.diff(totals[last], axis=0, prepend=0)
        counts = np.column_stack((totals, np.ones(len(pieces), dtype=np.int64)))
        piece = np.searchsorted(last, np.arange(len(ends)))
        stops, links, times = _links(a_ids, b_ids, a_from, b_from, a_n, b_n, piece, len(pieces))
        return counts, np.column_stack(((a_to + b_to)[last], stops)), parts, links, times

    def numbers(self, pieces: list[bytes]) -> np.ndarray:
        """Where each piece is remembered."""
        found = list(map(self.known.get, pieces))
        if None in found:
            missing = list({p for p, at in zip(pieces, found, strict=True) if at is None})
            if len(self.known) + len(missing) > CACHED_PIECES or self.size > CACHED_BYTES:
                self.forget()
                missing = list(set(pieces))
            for at in range(0, len(missing), 4096):
                self.learn(missing[at : at + 4096])
            found = list(map(self.known.get, pieces))
        return np.array(found, dtype=np.int64)

    def align(self, texts: Iterable[bytes]) -> Iterator[tuple]:
        """Of each text: its groups in parts, n_a, n_b, n_groups and n_links, and its distinct links
        with their numbers of occurrences. All are empty if the text has no tokens."""
        for block in _blocks(texts):
            pieces, stops = [], []
            for text in block:
                pieces += self._pieces(text)
                stops.append(len(pieces))
            found: list[list[tuple]] = [[] for _ in block]
            for first in range(0, len(pieces), PIECES):
                some = pieces[first : first + PIECES]
                numbers = self.numbers(some)
                for i, (start, stop) in enumerate(zip([0, *stops[:-1]], stops, strict=True)):
                    inside = numbers[max(start - first, 0) : max(stop - first, 0)]
                    if len(inside):
                        found[i].append(self._gathered(inside))
            for text, parts in zip(block, found, strict=True):
                if not all(whole for *_, whole in parts):
                    # A piece did not come back: align the text without taking it apart.
                    data = b" " + text
                    counts, _, shown, links, times = self._aligned([data], [len(data)]) or NOTHING
                    shown = [self._text(shown)] if counts[0, 4] else []
                    yield shown, counts[0, :4], *_summed(links, times)
                    continue
                shown = [part[0] for part in parts]
                counts = sum((part[1] for part in parts), np.zeros(4, dtype=np.int64))
                links = np.concatenate([np.empty(0, np.int64), *(part[2] for part in parts)])
                times = np.concatenate([np.empty(0, np.int64), *(part[3] for part in parts)])
                yield shown, counts, *_summed(links, times)

    def _pieces(self, text: bytes) -> list[bytes]:
        if not text:
            return []
        data = b" " + text
        bounds = [0, *(safe_cuts(data).tolist() if self.b.splits_at_spaces else ()), len(data)]
        return [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _text(self, parts: np.ndarray) -> str:
        return "".join(self.shown[parts].tolist())[:-1]

    def _gathered(self, numbers: np.ndarray) -> tuple:
        """Groups, counts and links of pieces that follow each other, and whether all came back."""
        counts = self.counts[numbers].sum(axis=0, dtype=np.int64)
        shown = self._text(self.parts[_ranges(self.ends[numbers, 0], self.ends[numbers + 1, 0])])
        distinct, copies = _summed(numbers, np.ones(len(numbers), dtype=np.int64))
        begin, end = self.ends[distinct, 1], self.ends[distinct + 1, 1]
        at = _ranges(begin, end)
        links, times = _summed(self.links[at], self.times[at] * np.repeat(copies, end - begin))
        return shown, counts[:4], links, times, counts[4] == len(numbers)


#: What is kept of a text that does not come back.
NOTHING = (
    np.zeros((1, 5), np.int64),
    np.zeros((1, 2), np.int64),
    *(np.empty(0, np.int64) for _ in range(3)),
)


def _blocks(texts: Iterable[bytes], most: int = 1 << 20) -> Iterator[list[bytes]]:
    """Neighbouring texts of about so many bytes together."""
    block, size = [], 0
    for text in texts:
        block.append(text)
        size += len(text)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def _is_safe(piece: bytes) -> bool:
    """Whether the piece begins and ends as if cut at safe places on both sides."""
    return len(piece) > 1 and piece[0] == 32 and begins_solid(piece, 1) and ends_solid(piece)


def _shown(token_bytes: dict[int, bytes], end: str) -> np.ndarray:
    """Text of the id ``i`` with a comma behind it at place 2i, and with ``end`` at the next."""
    ids = range(max(token_bytes) + 1)
    return np.array([f"{i}{sign}" for i in ids for sign in (",", end)], dtype=object)


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All places from each begin to before its end, one range after the other."""
    count = end - begin
    before = np.cumsum(count) - count
    return np.arange(int(count.sum())) + np.repeat(begin - before, count)


def _put(values: np.ndarray, at: int, new: np.ndarray) -> np.ndarray:
    values = _room(values, at + len(new))
    values[at : at + len(new)] = new
    return values


def _sizes(token_bytes: dict[int, bytes]) -> np.ndarray:
    sizes = np.zeros(max(token_bytes) + 1, dtype=np.int64)
    for i, data in token_bytes.items():
        sizes[i] = len(data)
    return sizes


def _closes(to: np.ndarray) -> np.ndarray:
    """1 for the last id of each group, 0 for the others."""
    closes = np.zeros(int(to[-1]), dtype=np.int64)
    closes[to - 1] = 1
    return closes


#: Groups with more links than this are counted by their distinct ids, never link by link.
LARGE_GROUP = 64


def _links(a_ids, b_ids, a_from, b_from, a_n, b_n, piece, n) -> tuple:
    """End of each piece's distinct links, the links, and how often each occurs in the piece."""
    small = np.flatnonzero(a_n * b_n <= LARGE_GROUP)
    size = (a_n * b_n)[small]
    group = np.repeat(small, size)
    k = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
    keys = (a_ids[a_from[group] + k // b_n[group]] << SHIFT) | b_ids[b_from[group] + k % b_n[group]]
    owner, times = piece[group], np.ones(len(group), dtype=np.int64)
    for g in np.flatnonzero(a_n * b_n > LARGE_GROUP):
        a, a_times = np.unique(a_ids[a_from[g] : a_from[g] + a_n[g]], return_counts=True)
        b, b_times = np.unique(b_ids[b_from[g] : b_from[g] + b_n[g]], return_counts=True)
        keys = np.append(keys, ((a << SHIFT)[:, None] | b[None, :]).reshape(-1))
        times = np.append(times, (a_times[:, None] * b_times[None, :]).reshape(-1))
        owner = np.append(owner, np.full(len(a) * len(b), piece[g]))
    order = np.lexsort((keys, owner))
    keys, owner, times = keys[order], owner[order], times[order]
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])))
    return (
        np.searchsorted(owner[first], np.arange(n), side="right"),
        keys[first],
        np.add.reduceat(times, first),
    )


def _room(values: np.ndarray, n: int) -> np.ndarray:
    """``values``, with room for twice as many as needed once there are too few."""
    if n <= len(values):
        return values
    grown = np.empty((n + n // 2, *values.shape[1:]), dtype=values.dtype)
    grown[: len(values)] = values
    return grown


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in rising order, with the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(values, first)


def safe_cuts(data: bytes) -> np.ndarray:
    """Places of spaces between two solid characters, where pieces begin.

    Byte-level patterns end a token before white space, and piece models before a space that follows
    another character, so both tokenizers have a token end there in any text.
    """
    codes = np.frombuffer(data, dtype=np.uint8)
    before, after = solid(codes)
    return np.flatnonzero((codes[1:-1] == 0x20) & before[:-2] & after[2:]) + 1


@cache
def _aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker process; it serves all its tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Aligner(a_path, b_path)


# --- operators -------------------------------------------------------------------------------

ALIGNED = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string,"
    " links array<bigint>, times array<int>, bucket bigint"
)


def align(docs: DataFrame, a_path: str, b_path: str, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, links, times and bucket of each row of ``docs``.

    ``groups`` lists the ids of both tokenizers by group, as ``a1,a2|b1;a3|b2,b3``; with ``digest``
    it is the lowercase hex SHA-256 of that. ``links`` are the distinct links, an id of the first
    tokenizer times 2**32 plus one of the second, in rising order, and ``times`` how often each
    occurs. Texts are encoded with a space before them and without special tokens. Texts that are
    null or empty, or that one of the tokenizers does not give back byte by byte, have no tokens:
    zeros, empty arrays and an empty text, which is not hashed. ``bucket`` numbers neighbouring rows
    that have at most ``BUCKET_LINKS`` links together, or are one row; it depends on how the rows were
    dealt to tasks, so store the result before using it twice. A null doc_id and repeated rows pass
    through, other columns are ignored, and no row is moved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        bucket, held = TaskContext.get().partitionId() << 32, 0
        for doc_id, (shown, counts, links, times) in _each(aligner, batches):
            if held and held + len(links) > BUCKET_LINKS:
                bucket, held = bucket + 1, 0
            held += len(links)
            groups = _hashed(shown) if digest else ";".join(shown)
            yield [doc_id, *(int(n) for n in counts), groups, links, times.astype(np.int32), bucket]

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _in_batches(run), ALIGNED
    )


def link_counts(aligned: DataFrame) -> DataFrame:
    """The rows of a stored ``align`` without links and buckets, but with n_best and count_sum.

    A link's count is the number of rows that hold it. ``count_sum`` adds it up over the links of the
    row, each as often as it occurs; ``n_best`` is how many of them have the highest count that their
    id of the first tokenizer has with any other id. Rows without tokens have zeros.
    """
    in_bucket = (
        aligned.select("bucket", F.explode("links").alias("link"))
        .groupBy("bucket", "link")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    in_bucket = store(in_bucket, "alignment-buckets")
    totals = store(in_bucket.groupBy("link").agg(F.sum("n").alias("count")), "alignment-totals")
    a_id = F.shiftright("link", SHIFT).alias("a_id")
    # One row per id of the first tokenizer, so no more than its vocabulary.
    highest = totals.groupBy(a_id).agg(F.max("count").alias("highest"))
    flagged = totals.withColumn("a_id", a_id).join(F.broadcast(highest), "a_id").select(
        "link", "count", (F.col("count") == F.col("highest")).alias("best")
    )
    known = in_bucket.join(flagged, "link").select("bucket", "link", "count", "best")
    kept = [c for c in aligned.columns if c not in ("links", "times", "bucket")]

    def look_up(rows: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known["link"].to_numpy())
        links = known["link"].to_numpy()[order]
        count, best = known["count"].to_numpy()[order], known["best"].to_numpy()[order]
        n_best, count_sum = [], []
        for some, times in zip(rows["links"], rows["times"], strict=True):
            at = np.searchsorted(links, np.asarray(some.values))
            times = np.asarray(times.values).astype(np.int64)
            n_best.append(int(times[best[at]].sum()))
            count_sum.append(int((times * count[at]).sum()))
        out = rows.select(kept)
        out = out.append_column("n_best", pa.array(n_best, pa.int64()))
        return out.append_column("count_sum", pa.array(count_sum, pa.int64()))

    types = {f.name: f.dataType.simpleString() for f in aligned.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", n_best bigint, count_sum bigint"
    return (
        aligned.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(look_up, schema)
    )


def alignment_digest(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of ``docs``."""
    aligned = store(align(docs, a_path, b_path, digest=True), "alignment")
    return link_counts(aligned).withColumnRenamed("groups", "groups_sha256")


def _each(aligner: Aligner, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        offsets, data = utf8(batch.column("text"))
        texts = (data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True))
        yield from zip(batch.column("doc_id").to_pylist(), aligner.align(texts), strict=True)


def _hashed(shown: list[str]) -> str:
    if not shown:
        return ""
    digest = hashlib.sha256()
    for i, part in enumerate(shown):
        digest.update((";" + part if i else part).encode())
    return digest.hexdigest()


_TYPES = {
    **dict.fromkeys(("doc_id", "n_a", "n_b", "n_groups", "n_links"), pa.int64()),
    "groups": pa.string(),
    "links": pa.list_(pa.int64()),
    "times": pa.list_(pa.int32()),
    "bucket": pa.int64(),
}


def _in_batches(run: Callable, most: int = 1 << 18) -> Callable:
    """Rows of ``run`` as record batches, each of so many links at most, or of one row."""

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for row in run(batches):
            if waiting and size + len(row[6]) > most:
                yield _batch(waiting)
                waiting, size = [], 0
            waiting.append(row)
            size += len(row[6]) + 64
        if waiting:
            yield _batch(waiting)

    return batches_of


def _batch(rows: Sequence[list]) -> pa.RecordBatch:
    columns = [
        pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), _TYPES.values(), strict=True)
    ]
    return pa.RecordBatch.from_arrays(columns, list(_TYPES))
