"""Aligned tokens against a plain walk over both lists of ids."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from llm import token_alignment

A_PATH = public_tokenizers.path("byte_bpe_50k.json")
B_PATH = public_tokenizers.path("piece_bpe_32k.model")
TOKENS = [
    *"the a é ▁ <|endoftext|> </s> <0x0A> 日本 😀 ing 's 12 0 !! . = === \x00 <unk> ﬁ İ é".split(),
    " ", "  ", "\n", "\t", "\r\n", "　", "x" * 50, "ab" * 60,
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B_PATH)


def piece_bytes(piece):
    if len(piece) == 6 and piece.startswith("<0x"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def by_walking(text, libraries):
    """Groups of ids, from the lengths that the libraries' own decoders give."""
    a, b = libraries
    if not text:
        return []
    found = a.encode(" " + text, add_special_tokens=False)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(c): c for c in shown}
    table |= {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
    a_bytes = [bytes(table[c] for c in token) for token in found.tokens]
    b_ids = b.encode(text)
    b_bytes = [piece_bytes(b.id_to_piece(i)) for i in b_ids]
    whole = (" " + text).encode()
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return []
    groups, left, right = [], 0, 0
    a_at, b_at, group = iter(zip(found.ids, a_bytes)), iter(zip(b_ids, b_bytes)), ([], [])
    while left < len(whole) or right < len(whole):
        if left <= right:
            i, data = next(a_at)
            group[0].append(i)
            left += len(data)
        else:
            i, data = next(b_at)
            group[1].append(i)
            right += len(data)
        if left == right:
            groups.append(group)
            group = ([], [])
    return groups


def shown(groups):
    return ";".join("|".join(",".join(map(str, ids)) for ids in group) for group in groups)


def links_of(groups):
    return Counter((x, y) for a, b in groups for x in a for y in b)


def expected_rows(docs, libraries):
    groups = [(r.doc_id, by_walking(r.text, libraries)) for r in docs.collect()]
    count = Counter(link for _, g in groups for link in links_of(g))
    highest = defaultdict(int)
    for (a, _), n in count.items():
        highest[a] = max(highest[a], n)
    out = Counter()
    for doc_id, g in groups:
        links = links_of(g)
        out[
            doc_id,
            sum(len(a) for a, _ in g),
            sum(len(b) for _, b in g),
            len(g),
            links.total(),
            sum(n for link, n in links.items() if count[link] == highest[link[0]]),
            sum(n * count[link] for link, n in links.items()),
            hashlib.sha256(shown(g).encode()).hexdigest() if g else "",
        ] += 1
    return out


COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def digest(docs):
    frame = token_alignment.alignment_digest(docs, A_PATH, B_PATH)
    return Counter(map(tuple, frame.select(*COLUMNS).collect()))


def test_random_texts(libraries, monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choices(TOKENS, k=rng.randint(0, 20))) for _ in range(2000)]
    aligner = token_alignment.Aligner(A_PATH, B_PATH)
    for pieces, cached in ((1 << 16, 1 << 20), (3, 50)):
        monkeypatch.setattr(token_alignment, "PIECES", pieces)
        monkeypatch.setattr(token_alignment, "CACHED_PIECES", cached)
        found = aligner.align(text.encode() for text in texts)
        for text, (parts, counts, links, times) in zip(texts, found, strict=True):
            groups = by_walking(text, libraries)
            assert ";".join(parts) == shown(groups), text
            both = [(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in links]
            assert dict(zip(both, times.tolist())) == links_of(groups)
            assert counts[3] == times.sum()


def test_both_libraries_agree(some_texts):
    """The fast way gives the ids of the tokenizers library."""
    fast, slow = token_alignment.ByteLevel(A_PATH), token_alignment.ByteLevel(A_PATH)
    assert fast.fast
    slow.fast = None
    for text in [*some_texts, "".join(TOKENS)]:
        assert fast.encode(" " + text) == slow.encode(" " + text)


def test_large_groups_are_not_written_out(libraries):
    aligner = token_alignment.Aligner(A_PATH, B_PATH)
    text = "😀" * 50 + "·" * 300 + "日" * 200
    _, counts, links, times = next(aligner.align([text.encode()]))
    assert dict(zip(links.tolist(), times.tolist())) == {
        a << 32 | b: n for (a, b), n in links_of(by_walking(text, libraries)).items()
    }


def test_rows_by_brute_force(spark, documents, odd_docs, libraries, monkeypatch):
    monkeypatch.setattr(token_alignment, "BUCKET_LINKS", 3000)
    for docs in (odd_docs, documents.limit(60).repartition(3)):
        docs = docs.select("doc_id", "text").persist()
        assert digest(docs) == expected_rows(docs, libraries)


def test_odd_tables(odd_docs, no_docs):
    assert digest(no_docs) == Counter()
    few = odd_docs.where("doc_id < 4 OR doc_id > 5 OR doc_id IS NULL")
    names = "links times bucket groups link n count best a_id highest n_a".split()
    clashing = few.select("*", *(F.lit(7).alias(name) for name in names))
    assert digest(clashing) == digest(few)
    nulls = few.withColumn("text", F.lit(None).cast("string"))
    assert all(row[1:7] == (0,) * 6 and row[7] == "" for row in digest(nulls))
