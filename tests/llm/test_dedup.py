import hashlib
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm import line_dedup, near_dedup, substring_dedup
from llm import words as text_words
from llm.common import FREE_SHUFFLES, WORD
from llm.components import connected_components

SPACES = " \t\n\x0b\x0c\r"
FOLD = {c: c + 32 for c in range(65, 91)}


def fold(text):
    return text.translate(FOLD)


def shingle_set(text, width):
    words = WORD.findall(fold(text or ""))
    if not words:
        return set()
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def components(rows, width, percent):
    """Brute force: doc_id -> smallest doc_id reachable."""
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingle_set(t, width)) for i, t in rows if i is not None]
    for n, (i, s) in enumerate(sets):
        for j, t in sets[:n]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in parent}


def check_near(docs, width, percent):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    expected = components(rows, width, percent)
    got = near_dedup.near_duplicates(docs, width, percent).collect()
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter(
        (i, len(shingle_set(t, width))) for i, t in rows
    )
    for r in got:
        assert r.component_id == (None if r.doc_id is None else expected[r.doc_id])
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_of_odd_rows(odd_docs, width, percent):
    check_near(odd_docs, width, percent)


def test_near_duplicates_of_the_table(documents):
    check_near(documents, 3, 85)


def test_near_duplicates_of_nothing(no_docs):
    assert near_dedup.near_duplicates(no_docs).count() == 0
    assert near_dedup.drop_near_duplicates(no_docs).columns == no_docs.columns


def edited(rng, words, edits):
    words = list(words)
    for i in rng.choice(len(words), edits, replace=False):
        words[i] = f"e{rng.integers(1 << 30)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies(spark):
    """A group of near copies around the threshold, one of exact copies, and short texts."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, edited(rng, base, int(rng.integers(0, 7)))) for i in range(150)]
    rows += [(200 + i, "the same words in each copy") for i in range(40)]
    rows += [(300 + i, text) for i, text in enumerate(["a", "A", "a b", "A B", "b a", "a b c"])]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_large_groups(copies, width, percent):
    check_near(copies, width, percent)


def test_large_groups_in_slabs_and_blocks(copies, monkeypatch):
    monkeypatch.setattr(near_dedup, "SLAB", 16)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 2000)
    check_near(copies, 3, 85)


def test_shared_doc_id_joins_texts(spark):
    long = " ".join(f"x{i}" for i in range(30))
    docs = spark.createDataFrame(
        [(1, long), (2, long), (2, long[::-1]), (3, long[::-1])], "doc_id bigint, text string"
    )
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def test_one_document_of_each_group_stays(copies):
    kept = near_dedup.drop_near_duplicates(copies, 3, 85).collect()
    expected = components([(r.doc_id, r.text) for r in copies.collect()], 3, 85)
    assert sorted(r.doc_id for r in kept) == sorted(set(expected.values()))


def test_pigeonhole_finds_every_pair_below_the_distance():
    rng = np.random.default_rng(2)
    limit = 2 * near_dedup.CHUNKS - 1
    a = rng.integers(0, 1 << 16, (200, near_dedup.SYMBOLS), dtype=np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(near_dedup.SYMBOLS, limit, replace=False)
        row[at] ^= rng.integers(1, 1 << 16, limit, dtype=np.uint16)
    assert (near_dedup.chunk_keys(a) == near_dedup.chunk_keys(b)).any(axis=1).all()


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in got} == {
        **{i: 0 for i in range(41)},
        **{i: 100 for i in range(100, 160)},
    }


# --- words -----------------------------------------------------------------------------------


def test_word_hashes(some_texts, monkeypatch):
    texts = [*some_texts, None, "", " ", "ABC abc É\x0bz"]
    seen = {}
    for block in (1 << 20, 300):
        monkeypatch.setattr(text_words, "BLOCK_BYTES", block)
        for row, counts, hashes, starts, ends in text_words.batch_words(pa.array(texts)):
            at = 0
            for i, n in enumerate(counts):
                raw = (texts[row + i] or "").encode()
                words = [raw[a:b].decode() for a, b in zip(starts[at : at + n], ends[at : at + n])]
                assert words == WORD.findall(texts[row + i] or "")
                for word, value in zip(words, hashes[at : at + n].tolist()):
                    assert seen.setdefault(fold(word), value) == value
                at += n
    assert len(set(seen.values())) == len(seen)


# --- lines -----------------------------------------------------------------------------------


def without_shared_lines(rows, min_chars=20, min_docs=3):
    def key(line):
        return fold(line.strip(SPACES))

    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars and doc is not None:
                holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [
            line
            for line in lines
            if doc is None
            or len(holders.get(key(line), ())) < min_docs
            or doc == max(holders[key(line)])
        ]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("bits", [28, 8])
def test_lines_of_odd_rows(odd_docs, bits):
    got = line_dedup.drop_shared_lines(odd_docs, max_bits=bits, with_counts=True)
    assert got.columns == [*odd_docs.columns, "n_lines", "n_dropped"]
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()) == (
        Counter(without_shared_lines(rows))
    )
    assert sum(r.n_dropped for r in got.collect()) == 3


def test_clashing_columns(odd_docs):
    names = ["_lost_id", "_keys", "_gone", "n_lines", "n_dropped", "key", "node", "root"]
    docs = odd_docs.select("*", *(F.lit(7).alias(name) for name in names))
    kept = line_dedup.drop_shared_lines(docs, with_counts=True)
    assert kept.columns == [*docs.columns, "n_lines_", "n_dropped_"]
    assert {r.n_lines for r in kept.collect()} == {7}
    assert sum(r.n_dropped_ for r in kept.collect()) == 3
    assert near_dedup.drop_near_duplicates(docs).columns == docs.columns


def test_lines_of_nothing(no_docs):
    assert line_dedup.drop_shared_lines(no_docs).count() == 0


def test_a_full_filter_only_costs_traffic(documents, monkeypatch):
    expected = sorted(map(tuple, line_dedup.drop_shared_lines(documents, with_counts=True)
                          .select("doc_id", "n_dropped").collect()))
    assert sum(n for _, n in expected) > 0
    got = line_dedup.shared_lines(documents, max_bits=10)
    held = got.select("doc_id", F.size("keys")).collect()
    assert {i for i, n in held if n} == {i for i, n in expected if n}


def test_filters_hold_all_repeats():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    tasks = [np.concatenate((hashes[:100], rng.choice(hashes[100:], 500))) for _ in range(3)]
    bits = 16
    segments = []
    for task in tasks:
        once, twice = line_dedup.task_filters(task, bits)
        pair = []
        for places in (once, twice):
            flags = np.zeros(1 << bits, dtype=np.uint8)
            flags[places] = 1
            pair.append(np.packbits(flags, bitorder="little"))
        segments.append(tuple(pair))
    _, twice = line_dedup.merge(iter(segments))
    flags = np.unpackbits(twice, bitorder="little")
    counts = Counter(h for task in tasks for h in task.tolist())
    repeated = np.array([h for h, n in counts.items() if n > 1], dtype=np.uint64)
    assert flags[line_dedup.probes(repeated, bits)].all()


def test_keys_of_lines_beyond_ascii_take_no_longer():
    odd = " \tÉcole ÀZ İSTANBUL \u212aELVIN \U0001d400Z \x0b\r\nSHORT Ä\n\u2003Kept ends ÄÖÜ stay AZ\u2003"
    keys = [fold(line.strip(SPACES)) for line in odd.split("\n")]
    assert line_dedup.long_keys(odd, 20) == [k if len(k) >= 20 else None for k in keys]

    def seconds(text):
        took = []
        for _ in range(5):
            began = time.process_time()
            line_dedup.long_keys(text, 20)
            took.append(time.process_time() - began)
        return min(took)

    line = "Words Of A Line " * 50_000
    # One by one, characters took some hundred times as long.
    assert seconds(line + "é") < 20 * seconds(line)


# --- passages --------------------------------------------------------------------------------


def exact_runs(rows, width=50):
    """Brute force: (doc_id, place of the first word) of runs that a smaller doc_id holds too."""
    first = {}
    found = set()
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = WORD.findall(fold(text or ""))
        for i in range(len(words) - width + 1):
            run = hashlib.md5(" ".join(words[i : i + width]).encode()).digest()
            if first.setdefault(run, doc) != doc:
                found.add((doc, i))
    return found


def check_passages(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = substring_dedup.repeated_passages(docs).collect()
    spans = defaultdict(list)
    for r in got:
        spans[r.doc_id].append((r.start, r.end))
        assert r.end - r.start >= 50 and all(other < r.doc_id for other in r.others)
    missed = [
        (doc, i)
        for doc, i in exact_runs(rows)
        if not any(a <= i + 10 and i + 40 <= b for a, b in spans[doc])
    ]
    assert not missed, missed[:10]
    return got


def test_passages_of_odd_rows(odd_docs):
    got = check_passages(odd_docs)
    assert {(r.doc_id, tuple(r.others)) for r in got} == {(5, (4,)), (10, (9,))}


def test_passages_of_the_table(documents):
    check_passages(documents)


def test_passages_of_nothing(no_docs):
    assert substring_dedup.repeated_passages(no_docs).count() == 0


def test_fuzzy_passages_and_clean_documents(spark):
    rng = np.random.default_rng(9)
    passage = [f"p{i}" for i in range(90)]

    def noise(n):
        return [f"n{rng.integers(1 << 40)}" for _ in range(n)]

    changed = list(passage)
    changed[30], changed[61] = "other", "words"
    del changed[45]
    rows = [
        (1, " ".join([*noise(70), *passage, *noise(20)])),
        (2, " ".join([*noise(10), *changed, *noise(40)])),
        (3, " ".join(noise(300))),
        (4, " ".join([*noise(100), *passage[:30], *noise(100)])),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    (found,) = substring_dedup.repeated_passages(docs).collect()
    assert (found.doc_id, found.others, found.start, found.end) == (2, [1], 10, 99)
    assert found.n_equal == 87


@pytest.mark.parametrize("period", [1, 5, 15, 16, 40])
def test_passages_of_a_short_period(spark, period):
    rng = np.random.default_rng(period)

    def noise(n):
        return [f"n{rng.integers(1 << 40)}" for _ in range(n)]

    line = [f"w{i}" for i in range(period)]
    shared = (line * 300)[:300]
    rows = [
        (1, " ".join([*noise(40), *shared, *noise(40)])),
        (2, " ".join([*noise(7), *shared, *noise(60)])),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    (found,) = substring_dedup.repeated_passages(docs).collect()
    assert (found.doc_id, found.start, found.end, found.others) == (2, 7, 307, [1])
    assert found.n_equal == 300


def test_chains_follow_the_fenwick_tree():
    a = np.array([0, 10, 20, 30, 40, 50, 60])
    b = np.array([5, 15, 400, 35, 300, 55, 65])
    (first, *rest) = substring_dedup.chain(a, b)
    assert first.tolist() == [0, 1, 3, 5, 6]
    assert sorted(len(c) for c in rest) == [1, 1]


def longest_alike(x, y, identity=80):
    """Brute force: the most words of ``x`` in one part of some diagonal that is alike enough."""
    best = 0
    for shift in range(-len(y) + 1, len(x)):
        first, end = max(0, shift), min(len(x), len(y) + shift)
        equal = np.array([x[i] == y[i - shift] for i in range(first, end)], dtype=int)
        sums = np.concatenate(([0], np.cumsum(100 * equal - identity)))
        for i in range(len(sums)):
            reached = np.flatnonzero(sums >= sums[i])
            best = max(best, int(reached[-1]) - i)
    return best


def test_recall_of_fuzzy_passages(spark):
    """Of the pairs that share a passage alike enough, nine in ten are found at least, by length and
    number of changed words; and nothing else."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30_000)]

    def noise(n):
        return [rng.choice(words) for _ in range(n)]

    rows, planted = [], defaultdict(list)
    for n, pairs in ((50, 100), (100, 40), (200, 20)):
        for percent in (0, 10, 20):
            for _ in range(pairs):
                passage = noise(n)
                changed = list(passage)
                for i in rng.sample(range(n), n * percent // 100):
                    changed[i] = f"new{rng.choice(words)}"
                doc = len(rows)
                rows += [(doc, noise(60) + passage + noise(60)), (doc + 1, noise(60) + changed + noise(60))]
                planted[n, percent].append(doc + 1)
    rows += [(len(rows) + i, noise(300)) for i in range(100)]
    docs = spark.createDataFrame([(i, " ".join(text)) for i, text in rows], "doc_id bigint, text string")
    found = defaultdict(list)
    for r in substring_dedup.repeated_passages(docs).collect():
        found[r.doc_id].append((r.start, r.end, r.others))
    for (n, percent), ids in planted.items():
        held = sum(
            sum(max(0, min(b, 60 + n) - max(a, 60)) for a, b, others in found[i] if others == [i - 1])
            >= n / 2
            for i in ids
        )
        assert held >= 0.9 * len(ids), (n, percent, held)
        for i in ids[:3]:
            assert longest_alike(rows[i][1], rows[i - 1][1]) >= n
    assert {i for i, spans in found.items() if spans} <= {i for ids in planted.values() for i in ids}


def test_chains_are_cut_where_words_differ(spark):
    """A passage counts by itself, whatever repeats behind it or in other documents."""
    rng = np.random.default_rng(2)

    def noise(n):
        return [f"n{rng.integers(1 << 40)}" for _ in range(n)]

    shared, more = noise(50), noise(23)
    stock = [shared[i : i + 6] for i in range(0, 48, 6)]
    rows = [(i, noise(30) + part + noise(30)) for i, part in enumerate(stock)]
    rows += [(20, noise(40) + shared + noise(20) + more + noise(40))]
    rows += [(21, noise(9) + shared + noise(20) + more + noise(40))]
    docs = spark.createDataFrame([(i, " ".join(text)) for i, text in rows], "doc_id bigint, text string")
    (found,) = substring_dedup.repeated_passages(docs).collect()
    assert (found.doc_id, found.start, found.end, found.n_equal) == (21, 9, 59, 50)
    assert 20 in found.others


def test_alike_parts_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        equal = rng.random(60) < rng.choice([0.5, 0.8, 0.95])
        lost = (rng.random(60) < 0.05).astype(int)
        parts = substring_dedup.alike_parts(equal, lost, 10, 10)
        score = np.concatenate(([0], np.cumsum(np.where(equal, 1, -4) - 4 * lost)))
        longest = max(j - i for i in range(61) for j in range(i, 61) if score[j] >= score[i])
        assert bool(parts) == (longest >= 10)
        places = [i for a, b, _ in parts for i in range(a, b)]
        assert len(places) == len(set(places))
        for a, b, n in parts:
            assert b - a >= 10 and n == equal[a:b].sum() and n >= 0.8 * (b - a) - 1e-9


def test_alike_parts_of_many_rows():
    rng = np.random.default_rng(13)
    rows = [rng.random(int(rng.integers(0, 160))) < rng.choice([0.3, 0.75, 0.8, 0.95]) for _ in range(300)]
    rows[5:7] = [np.ones(40, dtype=bool), np.zeros(40, dtype=bool)]
    wanted = []
    for i, equal in enumerate(rows):
        parts = substring_dedup.alike_parts(equal, np.zeros(len(equal), dtype=int), 25, 50)
        wanted += [(i, *part) for part in parts]
    bounds = np.concatenate(([0], np.cumsum([len(equal) for equal in rows])))
    found = substring_dedup.alike_parts_of_rows(np.concatenate(rows), bounds, 25, 50)
    assert sorted(zip(*(c.tolist() for c in found), strict=True)) == sorted(wanted)
    may = substring_dedup.may_hold_part(np.concatenate(rows), bounds, 25)
    assert {i for i, *_ in wanted} <= set(np.flatnonzero(may).tolist())
    assert len(wanted) > 100 and not may.all()


def test_seeds_leave_no_window_empty():
    rng = np.random.default_rng(1)
    for n in (4, 5, 50, 400):
        words = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        places, after, before = substring_dedup.seed_places(words)
        assert len(after) == len(before) == len(places)
        assert (after < places).all() and (before > places).all() and before[-1] == n - 3
        bounds = np.concatenate(([-1], places, [n - substring_dedup.K + 1]))
        assert len(places) and np.diff(bounds).max() <= substring_dedup.WINDOW
        inner, *_ = substring_dedup.seed_places(words[1:])
        kept = (places >= substring_dedup.WINDOW) & (places < n - 2 * substring_dedup.WINDOW)
        assert np.isin(places[kept] - 1, inner).all()


def test_passages_of_seeds_that_other_documents_share(spark):
    """The source is neither the first nor the last document that holds the words of the passage."""
    rng = np.random.default_rng(3)

    def noise(n):
        return [f"n{rng.integers(1 << 40)}" for _ in range(n)]

    shared = noise(60)
    changed = list(shared)
    for i in (14, 29, 44):
        changed[i] = "other"
    parts = [shared[i : i + 8] for i in range(0, 57, 4)]
    rows = [(i, noise(30) + part + noise(30)) for i, part in enumerate(parts)]
    rows += [(50, noise(30) + shared + noise(30))]
    rows += [(60 + i, noise(30) + part + noise(30)) for i, part in enumerate(parts)]
    rows += [(90, noise(30) + changed + noise(30))]
    docs = spark.createDataFrame([(i, " ".join(text)) for i, text in rows], "doc_id bigint, text string")
    (found,) = substring_dedup.repeated_passages(docs).collect()
    assert (found.doc_id, found.start, found.end, found.n_equal) == (90, 30, 90, 57)
    assert found.others == [50]


def test_partners_of_a_seed():
    """Groups: a seed of four rows in three documents, one of a single document, one of many rows."""
    docs = np.array([1, 2, 2, 3, 5, 5, *range(10, 50)])
    bounds = np.array([0, 4, 6, 46])
    held, first, size = substring_dedup._shared_rows(docs, bounds)
    assert held.tolist() == [0, 1, 2, 3, *range(6, 46)]
    assert first.tolist() == [0] * 4 + [6] * 40

    def pairs(partners):
        found = substring_dedup._other_partners(docs, held, first, size, partners)
        return {pair for own, other in found for pair in zip(own.tolist(), other.tolist(), strict=True)}

    assert pairs(32) == {(3, 2)} | {(i, i - 1) for i in range(8, 46)}
    assert pairs(None) == {(3, 2)} | {(i, j) for i in range(8, 46) for j in range(7, i)}


def test_passages_of_seeds_of_very_many_documents(spark):
    """Without a bound, the source is found however many documents share the words of the passage."""
    rng = np.random.default_rng(4)

    def noise(n):
        return [f"n{rng.integers(1 << 40)}" for _ in range(n)]

    shared = noise(60)
    changed = list(shared)
    for i in (14, 29, 44):
        changed[i] = "other"
    parts = [shared[i : i + 8] for i in range(0, 57, 4)] * 20
    rows = [(i, noise(30) + part + noise(30)) for i, part in enumerate(parts)]
    rows += [(1000, noise(30) + shared + noise(30))]
    rows += [(2000 + i, noise(30) + part + noise(30)) for i, part in enumerate(parts)]
    rows += [(9000, noise(30) + changed + noise(30))]
    docs = spark.createDataFrame([(i, " ".join(text)) for i, text in rows], "doc_id bigint, text string")
    (found,) = substring_dedup.repeated_passages(docs, partners=None).collect()
    assert (found.doc_id, found.start, found.end, found.n_equal) == (9000, 30, 90, 57)
    assert found.others == [1000]


def _with_noise(rng, *texts, around=30):
    def noise(n):
        return [f"n{rng.integers(1 << 40)}" for _ in range(n)]

    return [noise(around) + text + noise(around) for text in texts]


@pytest.mark.parametrize("hot_rows", [substring_dedup.HOT_ROWS, 0])
def test_passages_of_frequent_seeds(spark, monkeypatch, hot_rows):
    """All earlier documents with a passage are found, though more hold its seeds than ``PARTNERS``."""
    monkeypatch.setattr(substring_dedup, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 20_000)  # some blocks, not one
    rng = np.random.default_rng(10)
    shared = [f"s{i}" for i in range(60)]
    parts = [shared[i : i + 8] for i in range(0, 57, 4)] * 4
    changed = []
    for i in range(40):
        text = list(shared)
        text[10 + i % 5], text[30 + i % 7], text[45] = "other", "words", f"here{i}"
        if i % 4 == 0:
            text.insert(20, "more")
        changed.append(text)
    texts = _with_noise(rng, *parts, *changed, *parts, *changed)
    docs = spark.createDataFrame(
        [(i, " ".join(text)) for i, text in enumerate(texts)], "doc_id bigint, text string"
    )
    found = substring_dedup.repeated_passages(docs).collect()
    holders = [*range(60, 100), *range(160, 200)]
    assert [r.doc_id for r in sorted(found)] == holders[1:]
    for r in found:
        assert set(r.others) == {d for d in holders if d < r.doc_id}
        # A part of fewer than 50 words takes in some beyond its end.
        assert 20 <= r.start <= 30 <= len(texts[r.doc_id]) - r.end + 10 <= 40


def test_fuzzy_passages_of_repeated_words(spark):
    """Too short a run of one word to be a verbatim passage, at any place of a document that has more."""
    rng = np.random.default_rng(11)
    tail = [f"t{i}" for i in range(20)]
    other = [*tail[:5], "else", *tail[6:]]
    texts = _with_noise(rng, ["again"] * 40 + tail, ["again"] * 40 + other, tail)
    texts[0] += ["again"] * 9 + _with_noise(rng, [])[0]
    docs = spark.createDataFrame(
        [(i, " ".join(text)) for i, text in enumerate(texts)], "doc_id bigint, text string"
    )
    (found,) = substring_dedup.repeated_passages(docs).collect()
    assert (found.doc_id, found.start, found.end, found.others) == (1, 30, 90, [0])


def test_blocks_find_what_rows_find(spark, monkeypatch):
    """Matched in rows or in blocks, seeds lead to the same passages."""
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 100_000)
    monkeypatch.setattr(substring_dedup, "HELD_MATCHES", 500)
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(120):
        text = rng.choice(words, 250).tolist()
        if i >= 20:
            source = rows[int(rng.integers(len(rows)))][1].split()
            first, n = int(rng.integers(0, 150)), int(rng.integers(30, 100))
            passage = source[first : first + n]
            for k in rng.integers(0, n, n // 12):
                passage[k] = "changed"
            if i % 3 == 0:
                del passage[n // 2]
            text[60 : 60 + n] = passage
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    in_rows, in_blocks = (
        sorted(map(tuple, substring_dedup.repeated_passages(docs, partners=n).collect()))
        for n in (None, 1)
    )
    assert len(in_rows) > 50
    assert in_blocks == in_rows


def test_passages_of_hot_seeds(spark, monkeypatch):
    """Hot seeds and runs, which are not shuffled by their value, are matched with the first document."""
    monkeypatch.setattr(substring_dedup, "HOT_ROWS", 0)
    rng = np.random.default_rng(6)

    def noise(n):
        return [f"n{rng.integers(1 << 40)}" for _ in range(n)]

    shared = noise(90)
    rows = [(i, " ".join([*noise(20 + i), *shared, *noise(9)])) for i in range(1, 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = substring_dedup.repeated_passages(docs).collect()
    spans = sorted((r.doc_id, r.start, r.end, r.others) for r in found)
    assert spans == [(2, 22, 112, [1]), (3, 23, 113, [1])]


def test_passages_are_stored_in_few_files(spark, monkeypatch):
    texts = [
        " ".join([f"own{d}x{i}" for i in range(80)] + [f"shared{d % 150}x{i}" for i in range(70)])
        for d in range(300)
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)
    conf = {
        "spark.sql.shuffle.partitions": "100",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key) for key in conf}
    files = {}

    def stored(df, label, store=substring_dedup.store_and_free):
        table = store(df, label)
        files[label] = len(table.inputFiles())
        return table

    monkeypatch.setattr(substring_dedup, "store_and_free", stored)
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        got = substring_dedup.repeated_passages(docs).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert {r.doc_id for r in got} == set(range(150, 300))
    assert all((r.start, r.end, r.others) == (80, 150, [r.doc_id - 150]) for r in got)
    # Before, some 80 files for most tables: one for each partition with a row.
    assert len(files) >= 8
    assert max(files.values()) <= 2 * spark.sparkContext.defaultParallelism


def test_passages_leave_no_shuffle_files(spark, odd_docs):
    """They go with the query that made them; else they add up until the driver collects its garbage."""

    def shuffles():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        names = [blocks.apply(i).name().split("_") for i in range(blocks.size())]
        return {name[1] for name in names if name[0] == "shuffle"}

    setting, before = spark.conf.get(FREE_SHUFFLES), shuffles()
    found = substring_dedup.repeated_passages(odd_docs)
    until = time.monotonic() + 20  # they go in the background
    # What is left are three totals of one row each, which are not stored.
    while len(left := shuffles() - before) > 3 and time.monotonic() < until:
        time.sleep(0.2)
    assert len(left) <= 3
    assert spark.conf.get(FREE_SHUFFLES) == setting
    assert {r.doc_id for r in found.collect()} == {5, 10}


def _chain_rows(rng, n: int) -> pa.RecordBatch:
    """Chains of texts that are alike in part, every other one with a word more on one side."""
    rows = []
    for i in range(n):
        x = rng.integers(0, 1 << 32, int(rng.integers(60, 400)), dtype=np.uint32)
        y = np.where(rng.random(len(x)) < rng.choice([0, 0.1, 0.5]), np.uint32(7), x)
        at = np.unique(rng.integers(0, len(x) - substring_dedup.K, 5))
        at, bt, x_from, y_from = at + 9, at + 5, 9, 5
        if i % 2:
            y = np.insert(y, at[1] - 9, 3)
            bt = bt + (np.arange(len(bt)) > 0)
        rows.append((i, i - 1, at.tolist(), bt.tolist(), x_from, x.tobytes(), y_from, y.tobytes()))
    names = ["a", "b", "pa", "pb", "x_from", "x", "y_from", "y"]
    types = [pa.int64()] * 2 + [pa.list_(pa.int32())] * 2 + [pa.int32(), pa.binary()] * 2
    columns = zip(zip(*rows, strict=True), types, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names)


def test_chains_on_one_diagonal_are_compared_together(monkeypatch):
    batch = _chain_rows(np.random.default_rng(8), 200).slice(3)
    aligned, wanted = [], []
    for i, row in enumerate(batch.to_pylist()):
        x, y = (np.frombuffer(row[c], dtype=np.uint32) for c in "xy")
        places = (np.array(row[c]) for c in ("pa", "pb"))
        begin, equal, lost = substring_dedup.align(x, y, row["x_from"], row["y_from"], *places)
        parts = substring_dedup.alike_parts(equal, lost, 25, 50)
        wanted += [(i, begin + a, begin + b, n) for a, b, n in parts]
    one_by_one = substring_dedup.align

    def counted(*args):
        aligned.append(args)
        return one_by_one(*args)

    monkeypatch.setattr(substring_dedup, "align", counted)
    monkeypatch.setattr(substring_dedup, "HELD_ROWS", 1000)
    found = list(substring_dedup._alike_chains(batch, 25, 50))
    assert sorted(found) == sorted(wanted) and len(found) > 100
    assert len(aligned) == sum(row["a"] % 2 for row in batch.to_pylist())


def test_rows_alone_with_their_seed_go_first():
    batches = [([1, 2, 2], [5, 9, 4]), ([2, 3, 4], [4, 1, 8]), ([4], [2])]
    given = [
        pa.RecordBatch.from_pydict({"seed": s, "doc": d, "pos": list(range(len(s), 0, -1))})
        for s, d in batches
    ]
    found = [(rows.to_pylist(), b.tolist()) for rows, b in substring_dedup._repeated(iter(given), "seed")]
    rows = [tuple(row.values()) for part, _ in found for row in part]
    assert rows == [(2, 4, 1), (2, 4, 3), (2, 9, 2), (4, 2, 1), (4, 8, 1)]
    assert [b for _, b in found] == [[0, 3], [0, 2]]


def test_seeds_of_a_block_are_those_of_its_texts():
    rng = np.random.default_rng(9)
    counts = rng.integers(0, 300, 60)
    hashes = rng.integers(0, 1 << 63, counts.sum(), dtype=np.uint64)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    hashes[bounds[7] : bounds[8]] = 1  # one k-mer only
    rolled = substring_dedup.shingles(hashes, substring_dedup.K)
    at, owner, around, rest = substring_dedup._block_places(rolled, counts, 50)
    assert sorted({*owner.tolist(), *rest.tolist()}) == np.flatnonzero(counts >= 50).tolist()
    for i in set(owner.tolist()):
        own = substring_dedup.seed_places(hashes[bounds[i] : bounds[i + 1]])
        for found, wanted in zip((at, *around), own, strict=True):
            assert found[owner == i].tolist() == wanted.tolist()
