"""Token ids in a chunked binary file format with bit planes.

Documents are encoded in ascending doc_id order and their ids put into chunks that hold whole
documents. A chunk's ids are cut into blocks of a fixed size, the last one filled up with zeros;
each block is transposed, so that bit ``b`` of all its ids stands together, and the planes of equal
``b`` of all blocks are compressed with zstandard on their own. High planes are nearly all zero and
cost next to nothing. The chunk index has the documents, counts and place of each chunk, so one
document can be read without its neighbours.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from llm.words import begins_solid, ends_solid, mix, utf8

MAGIC = b"TIDP"
VERSION = 1
BLOCK_IDS = 4096
CHUNK_IDS = 1 << 16
LEVEL = 3
#: Pieces remembered by a worker, and their bytes, at most; then the memory starts anew.
CACHED_PIECES = 1 << 20
CACHED_BYTES = 1 << 24
#: Letters of ASCII or Latin-1, in UTF-8, with or without a space: one token of a byte-level pattern.
WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
PLAIN_FIRST = frozenset(b" ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
#: Bytes of such words that are not spelled as themselves.
SPELLED = [" ", *map(chr, range(0x80, 0xA1)), "\xad"]
#: Pieces encoded by one call.
BATCH = 4096

FILES = (
    "part int, chunk int, part_start bigint, n_ids bigint, doc_ids array<bigint>,"
    " counts array<bigint>, data binary"
)


# --- one chunk -------------------------------------------------------------------------------


def _turned(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number as an 8 by 8 matrix of bits, transposed; doing it twice changes nothing."""
    for shift, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0)):
        t = (x ^ (x >> np.uint64(shift))) & np.uint64(mask)
        x = x ^ t ^ (t << np.uint64(shift))
    return x


def _planes(values: np.ndarray) -> np.ndarray:
    """Bits of bytes, whose number is a multiple of 8, as eight rows: bit 0 of all values first.

    Eight values make a byte of each row, the first value in its highest bit.
    """
    eight = np.ascontiguousarray(values).view(">u8").astype(np.uint64)
    return np.ascontiguousarray(_turned(eight).astype("<u8").view(np.uint8).reshape(-1, 8).T)


def _from_planes(planes: np.ndarray) -> np.ndarray:
    eight = np.ascontiguousarray(planes.T).reshape(-1).view("<u8").astype(np.uint64)
    return _turned(eight).astype(">u8").view(np.uint8)


def pack(ids: np.ndarray, block_ids: int = BLOCK_IDS) -> bytes:
    """Header (magic, version, planes, block size, ids, bytes of each plane), then the planes.

    ``block_ids`` is a multiple of 8.
    """
    ids = np.ascontiguousarray(ids, dtype="<u4")
    bits = int(ids.max(initial=0)).bit_length()
    blocks = -(-len(ids) // block_ids)
    filled = np.zeros(blocks * block_ids, dtype="<u4")
    filled[: len(ids)] = ids
    lanes = filled.view(np.uint8).reshape(-1, 4)
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    planes = [
        compressor.compress(plane.tobytes())
        for lane in range(-(-bits // 8))
        for plane in _planes(lanes[:, lane])[: bits - 8 * lane]
    ]
    header = struct.pack("<4sHHIQ", MAGIC, VERSION, bits, block_ids, len(ids))
    return header + struct.pack(f"<{bits}I", *map(len, planes)) + b"".join(planes)


def unpack(data: bytes) -> np.ndarray:
    """The ids of a chunk."""
    magic, version, bits, block_ids, n = struct.unpack_from("<4sHHIQ", data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a chunk of token ids")
    at = struct.calcsize("<4sHHIQ")
    sizes = struct.unpack_from(f"<{bits}I", data, at)
    at += 4 * bits
    filled = -(-n // block_ids) * block_ids
    lanes = np.zeros((filled, 4), dtype=np.uint8)
    planes = np.zeros((32, filled // 8), dtype=np.uint8)
    reader = zstandard.ZstdDecompressor()
    for bit, size in enumerate(sizes):
        planes[bit] = np.frombuffer(reader.decompress(data[at : at + size]), dtype=np.uint8)
        at += size
    for lane in range(-(-bits // 8)):
        lanes[:, lane] = _from_planes(planes[8 * lane : 8 * lane + 8])
    return lanes.reshape(-1).view("<u4")[:n].astype(np.uint32)


# --- encoding --------------------------------------------------------------------------------


class PieceEncoder:
    """The library's ids of texts, with the ids of pieces that came before remembered.

    Texts, given as UTF-8, are cut where a byte-level pattern ends a token whatever stands around (see
    ``cuts``), so a text's ids are those of its pieces in order. New pieces are encoded many at a time,
    as one text where they can be put together, and told apart by the bytes of their tokens. Plain
    words, which the pattern would not split, go to the library's model without its pattern, already
    spelled in its byte-level alphabet.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = WhitespaceSplit()
        # The printable stand-ins of bytes: themselves if visible, else the next from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [byte for byte in range(256) if byte not in shown]
        self.alphabet = {chr(byte): chr(256 + i) for i, byte in enumerate(hidden)}
        # A character of an ordinary entry stands for a byte; a special entry is text itself.
        special = self.tokenizer.get_added_tokens_decoder()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for entry, i in vocabulary.items():
            self.sizes[i] = len(entry.encode()) if i in special else len(entry)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.empty(1 << 16, dtype=np.uint32)
        self.ends = np.zeros(1 << 12, dtype=np.int64)
        self.size = 0

    def _encoded(self, pieces: list[bytes], plain: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of pieces encoded as one text, and the end of each piece in them.

        None if a piece does not end with a token there.
        """
        if plain:
            text, library = b"\n".join(pieces).decode("latin-1"), self.words
            # Only spaces and second bytes of letters stand for others.
            for byte in SPELLED if not text.isascii() else " ":
                text = text.replace(byte, self.alphabet[byte])
        else:
            text, library = b"".join(pieces).decode(), self.tokenizer
        (found,) = library.encode_batch_fast([text], add_special_tokens=False)
        ids = np.array(found.ids, dtype=np.uint32)
        reached = np.cumsum(self.sizes[ids])
        bounds = np.cumsum([len(piece) for piece in pieces])
        ends = np.searchsorted(reached, bounds)
        if not len(ids) or ends[-1] + 1 != len(ids) or not np.array_equal(reached[ends], bounds):
            return None
        return ids, ends + 1

    def learn(self, pieces: list[bytes]) -> None:
        """Encode pieces that are not known, each once."""
        plain, joined, alone = [], [], []
        for piece in pieces:
            if piece[1:].isalpha() and piece[0] in PLAIN_FIRST or WORD.fullmatch(piece):
                plain.append(piece)
            else:
                (joined if _is_word(piece) else alone).append(piece)
        for some, is_plain in ((plain, True), (joined, False)):
            found = self._encoded(some, is_plain) if some else None
            if found:
                self._keep(some, *found)
            else:
                alone += some
        texts = [piece.decode() for piece in alone]
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(encoded), np.uint32, sum(map(len, encoded)))
        self._keep(alone, ids, np.cumsum([len(e) for e in encoded], dtype=np.int64))

    def _keep(self, pieces: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        n, new = len(self.known), len(self.known) + len(pieces)
        self.known.update(zip(pieces, range(n, new), strict=True))
        used = int(self.ends[n])
        if new + 1 > len(self.ends):
            self.ends = np.resize(self.ends, new + new // 2 + 1)
        if used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, (used + len(ids)) * 3 // 2)
        self.ends[n + 1 : new + 1] = used + ends
        self.ids[used : used + len(ids)] = ids
        self.size += sum(map(len, pieces))

    def _numbers(self, pieces: list[bytes]) -> np.ndarray:
        found = list(map(self.known.get, pieces))
        if None in found:
            missing = list({p for p, at in zip(pieces, found, strict=True) if at is None})
            if len(self.known) + len(missing) > CACHED_PIECES or self.size > CACHED_BYTES:
                self.forget()
                missing = list(set(pieces))
            for at in range(0, len(missing), BATCH):
                self.learn(missing[at : at + BATCH])
            found = list(map(self.known.get, pieces))
        return np.array(found, dtype=np.int64)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        data = b"".join(texts)
        stops = np.cumsum([len(text) for text in texts])
        is_start = np.zeros(len(data) + 1, dtype=bool)
        is_start[cuts(data)] = True
        is_start[0], is_start[stops] = True, True
        bounds = np.flatnonzero(is_start)
        starts, sizes = bounds[:-1], np.diff(bounds)
        first, inverse = distinct_pieces(data, starts, sizes)
        ends = (starts + sizes)[first].tolist()
        pieces = [data[i:j] for i, j in zip(starts[first].tolist(), ends, strict=True)]
        numbers = self._numbers(pieces)[inverse]
        begin, count = self.ends[numbers], self.ends[numbers + 1] - self.ends[numbers]
        after = np.cumsum(count)
        ids = self.ids[np.arange(int(count.sum())) + np.repeat(begin - (after - count), count)]
        return np.split(ids, np.append(0, after)[np.searchsorted(starts, stops)][:-1])


#: Keeps the first n bytes of a little-endian number, for n from 0 to 8.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def distinct_pieces(
    data: bytes, starts: np.ndarray, sizes: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of pieces that stand for all others, and for each piece the place of its stand-in.

    Pieces of up to 16 bytes are compared as two numbers and their size; longer ones stand for
    themselves.
    """
    padded = data + bytes(16)
    eight = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded, strides=(1,))
    low = eight[starts] & _KEEP[np.minimum(sizes, 8)]
    high = eight[starts + 8] & _KEEP[np.clip(sizes - 8, 0, 8)]
    key = mix(low + mix(high + sizes.astype(np.uint64)))
    order = np.argsort(key)
    ranked = key[order]
    fresh = np.append(True, ranked[1:] != ranked[:-1])[: len(order)]
    first = order[fresh]
    inverse = np.empty(len(order), dtype=np.int64)
    inverse[order] = np.cumsum(fresh) - 1
    stand_in = first[inverse]
    same = (low == low[stand_in]) & (high == high[stand_in]) & (sizes == sizes[stand_in])
    own = np.flatnonzero(~same | (sizes > 16))
    inverse[own] = len(first) + np.arange(len(own))
    return np.concatenate((first, own)), inverse


# What a byte may be, as bits: a visible ASCII character, the first byte of a Latin-1 letter, a single
# mark, an ASCII letter, the second byte of a letter, a space, a line end.
_SOLID, _FIRST, _MARK, _LETTER, _SECOND, _SPACE, _LINE = (1 << i for i in range(7))
_KINDS = bytes(
    (_SOLID if 32 < c < 127 else 0)
    | (_FIRST if c == 0xC3 else 0)
    | (_MARK if c in b".,!?;:" else 0)
    | (_LETTER if chr(c).isascii() and chr(c).isalpha() else 0)
    | (_SECOND if c >= 0x80 and c & 0x9F != 0x97 else 0)
    | (_SPACE if c == 0x20 else 0)
    | (_LINE if c == 0x0A else 0)
    for c in range(256)
)


def cuts(data: bytes) -> np.ndarray:
    """Places where pieces begin: a space or line end between two solid characters, what follows such a
    line end, and a mark behind a letter. Byte-level patterns end a token there in any text, and no
    special entry goes on."""
    kinds = np.frombuffer(data.translate(_KINDS), dtype=np.uint8)
    if len(kinds) < 3:
        return np.empty(0, dtype=np.int64)
    second = np.zeros(len(kinds), dtype=bool)
    second[1:] = (kinds[:-1] & _FIRST) != 0
    ends = ((kinds & _SOLID) != 0) | second
    begins = (kinds & (_SOLID | _FIRST)) != 0
    letters = ((kinds & _LETTER) != 0) | second & ((kinds & _SECOND) != 0)
    inside, around = kinds[1:-1], ends[:-2] & begins[2:]
    lines = ((inside & _LINE) != 0) & around
    found = np.zeros(len(kinds), dtype=bool)
    found[1:-1] = lines | ((inside & _SPACE) != 0) & around | ((inside & _MARK) != 0) & letters[:-2]
    found[2:] |= lines
    return np.flatnonzero(found)


def _is_word(piece: bytes) -> bool:
    """Whether another piece may follow this one, and stand before it, without any change."""
    return len(piece) > 1 and piece[0] == 32 and begins_solid(piece, 1) and ends_solid(piece)


@cache
def _encoder(path: str) -> PieceEncoder:
    """One per worker process; it serves all its tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PieceEncoder(path)


def _in_pieces(texts: Iterable[bytes], size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Neighbouring texts of about so many bytes together."""
    some, held = [], 0
    for text in texts:
        some.append(text)
        held += len(text)
        if held >= size:
            yield some
            some, held = [], 0
    if some:
        yield some


# --- files -----------------------------------------------------------------------------------


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode ``docs`` (doc_id, text) and store the ids, ``end_id`` after each document, in ``path``.

    The stored rows are chunks (columns of ``FILES``): ``data`` is the chunk itself, the other
    columns its index entry. Ascending (part, chunk) is ascending doc_id; a null doc_id comes first,
    and rows that repeat one follow each other. Null and empty texts have the end id only. Texts are
    encoded as the library does it by itself, so the name of a special entry in a text is that entry.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(tokenizer), TaskContext.get().partitionId()
        chunk, start, waiting, ids_of, size = 0, 0, [], [], 0
        end = np.array([end_id], dtype=np.uint32)

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(ids_of)
            counts = [len(x) + 1 for x in ids_of[::2]]
            values = [part, chunk, start, len(ids), waiting, counts, pack(ids)]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            types += [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = [field.split()[0] for field in FILES.split(", ")]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, types, strict=True)], names
            )

        for batch in batches:
            doc_ids = iter(batch.column("doc_id").to_pylist())
            offsets, data = utf8(batch.column("text"))
            texts = (data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True))
            for some in _in_pieces(texts):
                for ids in encoder.encode(some):
                    waiting.append(next(doc_ids))
                    ids_of += [ids, end]
                    size += len(ids) + 1
                    if size >= CHUNK_IDS:
                        yield flush()
                        chunk, start, waiting, ids_of, size = chunk + 1, start + size, [], [], 0
        if waiting:
            yield flush()

    ordered = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id")
    )
    ordered.mapInArrow(run, FILES).write.parquet(path)


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """The index: part, chunk, start (ids before the chunk), n_ids, doc_ids, counts.

    Only one row per part, that is per task that wrote, goes through the running total.
    """
    stored = spark.read.schema(FILES).parquet(path)
    sizes = stored.groupBy("part").agg(F.sum("n_ids").alias("size"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    return stored.join(F.broadcast(starts), "part").select(
        "part",
        "chunk",
        (F.col("before") + F.col("part_start")).alias("start"),
        "n_ids",
        "doc_ids",
        "counts",
        "data",
    )


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The documents in the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers), and ``ids`` if asked for.

    Null doc_ids and rows that repeat one come back as they were written; files without documents
    give no row.
    """
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if with_ids:
        schema += ", ids array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                doc_ids = batch.column("doc_ids")[i].values
                counts = np.asarray(batch.column("counts")[i].values)
                ids = unpack(batch.column("data")[i].as_py()).astype("<u4")
                bounds = np.concatenate(([0], np.cumsum(counts)))
                each = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                columns = [
                    doc_ids,
                    pa.array(batch.column("start")[i].as_py() + bounds[:-1], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.tolist() for x in each], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return chunk_index(spark, path).mapInArrow(run, schema)
