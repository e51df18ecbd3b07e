"""Near duplicates by a multi-index Hamming join of MinHash signatures.

A document's signature has ``SYMBOLS`` values of 16 bits, each from the minimum of its shingle set
under another hash. It is split into ``CHUNKS`` chunks. By pigeonhole, two signatures that differ in
at most ``2 * CHUNKS - 1`` values differ in at most one value of some chunk; so each chunk is indexed
once for every single value left out, and such a pair meets under at least one key. A pair of the
wanted similarity differs more often than that, and meets nowhere, with a chance below 1e-6.

Documents that meet under a key and whose short signatures are close make candidate groups. Links are
then confirmed on full shingle sets, exactly, group by group. Neither step writes pairs: both write,
of what is connected within a group, one edge per document.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import fresh_name, store
from llm.components import connected_components
from llm.words import batch_words, mix, shingles

CHUNKS, CHUNK = 12, 5
SYMBOLS = CHUNKS * CHUNK
#: Rows of one key that a task compares at once; more are dealt out as pairs of slabs.
SLAB = 1 << 14
#: Shingles of one candidate group that a task compares at once; more are dealt out as block pairs.
BLOCK_SHINGLES = 1 << 21

_rng = np.random.Generator(np.random.PCG64(7))
_FACTORS = _rng.integers(0, 1 << 31, SYMBOLS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_LOW_BITS = np.uint64(0x5555555555555555)


# --- sets and signatures ---------------------------------------------------------------------


def document_sets(column: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Sorted distinct shingle hashes of neighbouring rows: (first row, one set per row)."""
    for row, counts, hashes, _, _ in batch_words(column):
        bounds = np.concatenate(([0], np.cumsum(counts)))
        rolled = shingles(hashes, width) if len(hashes) >= width else None
        sets = []
        for first, n in zip(bounds[:-1].tolist(), counts.tolist(), strict=True):
            if n >= width:
                found = rolled[first : first + n - width + 1]
            else:
                found = shingles(hashes[first : first + n], width)
            sets.append(np.unique(found))
        yield row, sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 16-bit values per set; sets must not be empty.

    The set's members are hashes already, so a multiplication is enough to order them anew.
    """
    members = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), SYMBOLS), dtype=np.uint16)
    for i, factor in enumerate(_FACTORS):
        least = np.minimum.reduceat(members * factor, starts).astype(np.uint64)
        out[:, i] = (mix(least + np.uint64(i)) >> np.uint64(48)).astype(np.uint16)
    return out


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """For each row, a key for each chunk and each value of it left out."""
    keys = []
    for chunk in range(CHUNKS):
        values = signature[:, chunk * CHUNK : (chunk + 1) * CHUNK].astype(np.uint64)
        for gone in range(CHUNK):
            rest = [i for i in range(CHUNK) if i != gone]
            packed = np.zeros(len(signature), dtype=np.uint64)
            for i in rest:
                packed = (packed << np.uint64(16)) | values[:, i]
            keys.append(mix(packed ^ mix(np.uint64(chunk * CHUNK + gone + 1) + np.zeros(1, np.uint64))))
    return np.stack(keys, axis=1)


def short_signatures(signature: np.ndarray) -> np.ndarray:
    """Two bits of each value, in two 64-bit words per row."""
    bits = (signature & np.uint16(3)).astype(np.uint64)
    words = np.zeros((len(signature), 2), dtype=np.uint64)
    for i in range(SYMBOLS):
        words[:, i % 2] |= bits[:, i] << np.uint64(2 * (i // 2))
    return words


def short_distance(percent: int) -> int:
    """Short signatures of a pair of this similarity differ in more values with a chance of 1e-9."""
    p = 0.75 * (100 - percent) / 100
    tail, k = 1.0, -1
    while tail > 1e-9 and k < SYMBOLS:
        k += 1
        tail -= math.comb(SYMBOLS, k) * p**k * (1 - p) ** (SYMBOLS - k)
    return k


# --- connected groups within one task --------------------------------------------------------


def within_reach(n: int, close: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each of ``n`` items the first item of its component, where ``close(i, rest)`` tells which
    of ``rest`` are linked to ``i``. What is linked leaves the rest, so copies cost little."""
    first = np.arange(n)
    rest = np.arange(n)
    while len(rest):
        root, rest = rest[0], rest[1:]
        frontier = [root]
        while frontier and len(rest):
            linked = close(frontier.pop(), rest)
            if linked.any():
                first[rest[linked]] = root
                frontier += rest[linked].tolist()
                rest = rest[~linked]
    return first


def close_tags(tags: np.ndarray, limit: int) -> np.ndarray:
    def close(i: int, rest: np.ndarray) -> np.ndarray:
        x = tags[rest] ^ tags[i]
        x = (x | (x >> np.uint64(1))) & _LOW_BITS
        return np.bitwise_count(x).sum(axis=1) <= limit

    return within_reach(len(tags), close)


def linked_sets(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """First item of each set's component under 100 * intersection >= percent * union; exact."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([0, 0 if 100 * common >= percent * (sizes.sum() - common) else 1])
    _, members, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Members of one set only never count; the others are numbered anew.
    shared = counts > 1
    number = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(sets)), sizes)
    keep = shared[members]
    members, owner = number[members[keep]], owner[keep]
    bounds = np.searchsorted(owner, np.arange(len(sets) + 1))
    mark = np.zeros(int(shared.sum()) + 1, dtype=bool)
    state: dict[str, np.ndarray] = {}

    def close(i: int, rest: np.ndarray) -> np.ndarray:
        if state.get("rest") is not rest:
            # Members of the rest, put together anew whenever the rest has changed.
            inside = np.zeros(len(sets), dtype=bool)
            inside[rest] = True
            chosen = inside[owner]
            state.update(rest=rest, members=members[chosen], owner=owner[chosen])
        own = members[bounds[i] : bounds[i + 1]]
        mark[own] = True
        hit = state["owner"][mark[state["members"]]]
        mark[own] = False
        common = np.bincount(hit, minlength=len(sets))[rest]
        return 100 * common >= percent * (sizes[i] + sizes[rest] - common)

    return within_reach(len(sets), close)


def _groups(
    batches: Iterator[pa.RecordBatch], keys: list[str]
) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Whole groups of rows that are sorted by ``keys``: a batch and the bounds of its groups."""
    held = None
    for batch in batches:
        whole = batch if held is None else pa.concat_batches([held, batch])
        if not len(whole):
            continue
        change = np.zeros(len(whole) - 1, dtype=bool)
        for key in keys:
            values = whole.column(key).to_numpy(zero_copy_only=False)
            change |= values[1:] != values[:-1]
        bounds = np.concatenate(([0], np.flatnonzero(change) + 1))
        last = int(bounds[-1])
        if last:
            yield whole.slice(0, last), bounds
        held = whole.slice(last)
    if held is not None and len(held):
        yield held, np.array([0, len(held)])


# --- operators -------------------------------------------------------------------------------


def signed_documents(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the set, null if empty), signature of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in document_sets(batch.column("text"), width):
                full = [s for s in sets if len(s)]
                values = iter(signatures(full)) if full else iter(())
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                signed = [next(values).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(signed, pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "digest", "signature"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id bigint, n_shingles bigint, digest binary, signature binary"
    )


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 2048):
            some = batch.slice(at, 2048)
            raw = b"".join(some.column("signature").to_pylist())
            signature = np.frombuffer(raw, dtype=np.uint16).reshape(len(some), SYMBOLS)
            n_keys = CHUNKS * CHUNK
            tags = np.repeat(short_signatures(signature), n_keys, axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(chunk_keys(signature).view(np.int64).ravel()),
                    pa.array(np.repeat(some.column("node").to_numpy(), n_keys)),
                    pa.array(tags[:, 0].copy()),
                    pa.array(tags[:, 1].copy()),
                ],
                ["key", "node", "tag0", "tag1"],
            )


_MET = "a bigint, b bigint, key bigint, slab int, tag0 bigint, tag1 bigint"


def _edges(nodes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    linked = first != np.arange(len(nodes))
    return nodes[linked], nodes[first[linked]]


def _meetings(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges of the candidate graph from index rows sorted by key.

    A key with more than ``SLAB`` rows is not gathered: its rows go on as they are, with the number
    of their slab.
    """

    def batch_of(a, b, key=None, slab=None, tag0=None, tag1=None) -> pa.RecordBatch:
        types = {"key": pa.int64(), "slab": pa.int32(), "tag0": pa.int64(), "tag1": pa.int64()}
        rest = dict(key=key, slab=slab, tag0=tag0, tag1=tag1)
        columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64())]
        columns += [
            pa.nulls(len(a), types[k]) if v is None else pa.array(v, types[k])
            for k, v in rest.items()
        ]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", *types])

    def compare(rows: pa.RecordBatch, bounds: np.ndarray) -> pa.RecordBatch | None:
        nodes = rows.column("node").to_numpy()
        tags = np.stack([rows.column(t).to_numpy() for t in ("tag0", "tag1")], axis=1).view(np.uint64)
        sizes = np.diff(bounds)
        starts = bounds[:-1][sizes == 2]
        x = tags[starts] ^ tags[starts + 1]
        x = (x | (x >> np.uint64(1))) & _LOW_BITS
        near = starts[np.bitwise_count(x).sum(axis=1) <= limit]
        a, b = [nodes[near + 1]], [nodes[near]]
        for i in np.flatnonzero(sizes > 2):
            part = slice(bounds[i], bounds[i + 1])
            linked, to = _edges(nodes[part], close_tags(tags[part], limit))
            a.append(linked)
            b.append(to)
        a, b = np.concatenate(a), np.concatenate(b)
        return batch_of(a, b) if len(a) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot, passed = None, None, 0  # the key whose rows go on ungathered, and how many did
        for batch in batches:
            whole = batch if held is None else pa.concat_batches([held, batch])
            if not len(whole):
                continue
            keys = whole.column("key").to_numpy()
            bounds = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
            if hot is not None and keys[0] == hot:  # its next slabs, up to where it ends
                end = int(bounds[1])
                number = (passed + np.arange(end)) // SLAB
                part = whole.slice(0, end)
                yield batch_of(
                    part.column("node").to_numpy(),
                    part.column("node").to_numpy(),
                    part.column("key"),
                    number.astype(np.int32),
                    part.column("tag0"),
                    part.column("tag1"),
                )
                passed += end
                whole, bounds = whole.slice(end), bounds[1:] - end
                if not len(whole):
                    held = None
                    continue
            last = int(bounds[-2])
            if last and (edges := compare(whole.slice(0, last), bounds[:-1])) is not None:
                yield edges
            held = whole.slice(last)
            if len(held) > SLAB:
                yield batch_of(
                    held.column("node").to_numpy(),
                    held.column("node").to_numpy(),
                    held.column("key"),
                    (np.arange(len(held)) // SLAB).astype(np.int32),
                    held.column("tag0"),
                    held.column("tag1"),
                )
                hot, passed, held = held.column("key")[0].as_py(), len(held), None
        if held is not None and len(held):
            edges = compare(held, np.array([0, len(held)]))
            if edges is not None:
                yield edges

    return run


def candidate_edges(nodes: DataFrame, percent: int) -> DataFrame:
    """Edges a, b between nodes (node, signature) that meet under a key and are close."""
    limit = short_distance(percent)
    index = nodes.select("node", "signature").mapInArrow(
        _index, "key bigint, node bigint, tag0 bigint, tag1 bigint"
    )
    met = store(
        index.repartition("key").sortWithinPartitions("key", "node").mapInArrow(
            _meetings(limit), _MET
        ),
        "near-met",
    )
    slabs = met.where("key IS NOT NULL")
    edges = met.where("key IS NULL").select("a", "b")
    if slabs.isEmpty():
        return edges
    return edges.unionByName(_slab_edges(slabs, limit))


def _slab_edges(slabs: DataFrame, limit: int) -> DataFrame:
    """Edges within the keys of many rows: every pair of a key's slabs is a task's group."""
    count = slabs.groupBy("key").agg((F.max("slab") + 1).alias("n"))
    other = F.explode(F.expr("sequence(0, n - 1)"))
    dealt = slabs.join(count, "key").select("*", other.alias("other")).select(
        "key",
        F.least("slab", "other").alias("i"),
        F.greatest("slab", "other").alias("j"),
        F.col("a").alias("node"),
        "tag0",
        "tag1",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _groups(batches, ["key", "i", "j"]):
            nodes = rows.column("node").to_numpy()
            tags = [rows.column(t).to_numpy() for t in ("tag0", "tag1")]
            tags = np.stack(tags, axis=1).view(np.uint64)
            for first, end in zip(bounds[:-1], bounds[1:], strict=True):
                a, b = _edges(nodes[first:end], close_tags(tags[first:end], limit))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    ordered = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return ordered.mapInArrow(run, "a bigint, b bigint")


def confirmed_edges(docs: DataFrame, groups: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges a, b that span what is linked on full sets within each candidate group.

    ``groups`` has node (a doc_id), root (its group) and n_shingles. A group with more shingles than
    a task should hold is cut into blocks; each pair of blocks is compared by a task of its own.
    """
    total = groups.groupBy("root").agg(F.sum("n_shingles").alias("total"))
    blocks = F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int")
    placed = groups.join(total, "root").select(
        "node",
        "root",
        blocks.alias("n"),
        F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"),
    )
    chosen = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(placed, "node")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, found in document_sets(batch.column("text"), width):
                part = batch.slice(row, len(found))
                packed = pa.array([s.tobytes() for s in found], pa.binary())
                names = ["node", "root", "n", "block"]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), packed], [*names, "members"]
                )

    with_sets = chosen.select("node", "root", "n", "block", "text").mapInArrow(
        sets, "node bigint, root bigint, n int, block int, members binary"
    )
    dealt = with_sets.select(
        "*", F.explode(F.expr("sequence(0, n - 1)")).alias("other")
    ).select(
        "root",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        "node",
        "members",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _groups(batches, ["root", "i", "j"]):
            nodes = rows.column("node").to_numpy()
            members = rows.column("members")
            found_a, found_b = [], []
            for first, end in zip(bounds[:-1], bounds[1:], strict=True):
                if end - first < 2:
                    continue
                some = [
                    np.frombuffer(members[i].as_buffer(), dtype=np.uint64)
                    for i in range(first, end)
                ]
                a, b = _edges(nodes[first:end], linked_sets(some, percent))
                found_a.append(a)
                found_b.append(b)
            if found_a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))],
                    ["a", "b"],
                )

    ordered = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
    return ordered.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs`` (doc_id, text).

    Texts are linked if 100 * intersection >= percent * union of their sets of ``width``-word
    shingles; a text with fewer words is one shingle, one without words (or null) has none and is
    linked with nothing. A component is named by its smallest doc_id, and that document is kept.
    Rows that share a doc_id are one document with several texts. A row with a null doc_id takes no
    part: its component is null and it is kept.
    """
    signed = store(signed_documents(docs, width), "near-signed")
    known = signed.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    # Equal sets are one node, named by their smallest doc_id.
    classes = store(
        known.groupBy("digest").agg(
            F.min("doc_id").alias("node"),
            F.first("signature").alias("signature"),
            F.first("n_shingles").alias("n_shingles"),
        ),
        "near-classes",
    )
    same_doc = known.join(classes.select("digest", "node"), "digest")
    groups = connected_components(candidate_edges(classes, percent))
    sizes = classes.groupBy("node").agg(F.sum("n_shingles").alias("n_shingles"))
    edges = confirmed_edges(docs, groups.join(sizes, "node"), width, percent)
    # A doc_id with several texts belongs to the classes of all of them.
    spread = (
        same_doc.groupBy("doc_id")
        .agg(F.min("node").alias("low"), F.max("node").alias("high"))
        .where("low <> high")
        .select(F.col("doc_id").alias("a"))
    )
    bridges = same_doc.join(spread, same_doc["doc_id"] == spread["a"]).select(
        "a", F.col("node").alias("b")
    )
    components = connected_components(edges.unionByName(bridges))
    node = classes.select("digest", "node").join(components, "node", "left")
    node = node.select("digest", F.coalesce("root", "node").alias("root"))
    named = signed.join(node, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return named.select(
        "doc_id",
        F.col("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, of the kept document of each component."""
    gone = near_duplicates(docs, width, percent).where(~F.col("kept"))
    name = fresh_name(docs, "_gone")
    gone = gone.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col(name), "left_anti")
