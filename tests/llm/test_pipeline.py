"""The pipeline and each of its stages against plain Python."""

from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from test_dedup import components, without_shared_lines

import corpus_pipeline
from llm import byte_bpe
from llm.common import WORD

SF_DIR = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def is_good(text):
    words = WORD.findall(text or "")
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    runs = defaultdict(list)
    for i in range(len(words) - 4):
        runs[tuple(words[i : i + 5])].append(i)
    repeated = {i + j for at in runs.values() if len(at) > 1 for i in at for j in range(5)}
    chars = sum(map(len, words))
    return not (
        len(words) < 10
        or 100 * len(repeated) > 20 * len(words)
        or 100 * sum(c in "#*$%&|<>" for c in text) > 15 * chars
        or 15 * len(words) > 10 * chars
        or 2 * (len(lines) - len(set(lines))) > len(words)
    )


def targets(sizes):
    """Exact water-filling: source -> target, by weights 1, 2, 3 and at most 3 times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: Fraction(rest * weight[s], sum(weight[f] for f in free)) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: Fraction(3 * sizes[s]) for s in above}


def staged(rows):
    """doc_id -> (text, source) of what the first three stages keep; doc_ids are unique."""
    source = {i: s for i, _, s in rows}
    rows = [(i, t) for i, t, _ in rows if is_good(t)]
    rows = [(i, text) for i, _, _, text in without_shared_lines(rows)]
    root = components(rows, corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.PERCENT)
    return {i: (t, source[i]) for i, t in rows if root[i] == i}


def check_mix(kept, taken):
    """``taken`` (doc_id -> copies) is a mix of ``kept``."""
    size = {i: len(WORD.findall(t)) for i, (t, _) in kept.items()}
    sizes, words, largest = Counter(), Counter(), Counter()
    for i, (_, source) in kept.items():
        sizes[source] += size[i]
        words[source] += size[i] * taken[i]
        largest[source] = max(largest[source], size[i])
    wanted = targets(sizes)
    assert set(taken) <= set(kept)
    for i, (_, source) in kept.items():
        ratio = wanted[source] / sizes[source]
        assert int(ratio) <= taken[i] <= -(-ratio.numerator // ratio.denominator)
    for source in sizes:
        assert abs(words[source] - wanted[source]) <= largest[source]


@pytest.fixture(scope="module")
def rows(documents):
    return [(r.doc_id, r.text, r.source) for r in documents.collect()]


def test_the_first_stages_keep_what_plain_python_keeps(spark, documents, rows):
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == documents.columns
    got = docs.collect()
    assert {r.doc_id: (r.text, r.source) for r in got} == staged(rows)
    assert all(r.n_chars == len(r.text) for r in got)


def test_the_whole_pipeline(spark, rows):
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    again = corpus_pipeline.run(spark, SF_DIR).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    kept = staged(rows)
    check_mix(kept, Counter(r.doc_id for r in got))
    encoder = byte_bpe.encoding(PATH, public_tokenizers.PATTERN)
    for r in got:
        text, source = kept[r.doc_id]
        assert r.source == source
        assert np.frombuffer(r.ids, "<u4").tolist() == encoder.encode_ordinary(text)
