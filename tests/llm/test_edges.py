"""Nulls, empty tables, repeated rows and clashing columns, for each operator and pipeline stage."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm import (
    byte_bpe,
    chat_format,
    line_dedup,
    mixing,
    near_dedup,
    personal_data,
    quality_rules,
    substring_dedup,
    token_files,
    topk_search,
)
from llm.common import scratch_path

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
#: Names that some operator uses for columns of its own.
CLASHING = (
    "ids decoded row no chunk last ends piece parts chunks copies copy size mass bucket draw open doc"
    " target ratio whole keys key node root a b digest signature seed pos spans failed n_words"
    " _key _number _copies _copy _lost_id _keys _gone _carried0 part start counts data"
).split()
VECTOR_CLASHES = "v block qblock query_row query_id q low span need rows asked bin n rank score".split()


@pytest.fixture(scope="module")
def odd_table(odd_docs):
    """Odd rows with the columns of documents, and nulls among the counted characters."""
    return odd_docs.drop("keys").withColumn("n_chars", F.length("text"))


@pytest.fixture(scope="module")
def clashing(odd_table):
    return odd_table.select("*", *(F.lit(7).alias(name) for name in CLASHING))


def rows_of(df, *columns):
    return Counter(map(tuple, df.select(*columns).collect()))


OPERATORS = {
    "near_duplicates": near_dedup.near_duplicates,
    "near_kept": near_dedup.drop_near_duplicates,
    "personal_data": personal_data.personal_data_digest,
    "redacted": personal_data.redact,
    "judged": quality_rules.judge,
    "good": quality_rules.keep_good,
    "lines": line_dedup.drop_shared_lines,
    "round_trip": lambda docs: byte_bpe.round_trip(docs, RANKS, PATTERN),
    "encoded": lambda docs: byte_bpe.encode(docs, RANKS, PATTERN, carry=("lang", "source")),
    "passages": substring_dedup.repeated_passages,
    "counts": mixing.mix_counts,
    "mixed": mixing.mixed,
}


def comparable(df, columns):
    """Rows without columns that are arrays, which cannot be counted."""
    plain = [c for c in columns if not df.schema[c].dataType.simpleString().startswith("array")]
    return rows_of(df, *plain)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_columns_change_nothing(odd_table, clashing, name):
    plain, extra = OPERATORS[name](odd_table), OPERATORS[name](clashing)
    assert set(plain.columns) <= set(extra.columns)
    if extra.columns != plain.columns:  # all columns of the input are kept as they are
        assert extra.columns == clashing.columns
        assert rows_of(extra, *CLASHING).keys() <= {(7,) * len(CLASHING)}
    assert comparable(extra, plain.columns) == comparable(plain, plain.columns)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(odd_table, name):
    assert OPERATORS[name](odd_table.where("doc_id = -5")).count() == 0


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_tables_of_nulls_only(odd_table, name):
    nulls = odd_table.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in odd_table.schema))
    rows = OPERATORS[name](nulls).collect()
    gone = {"good", "mixed", "passages"}  # no words, nothing to take, no passage
    assert len(rows) == (0 if name in gone else nulls.count())


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stages_of_the_pipeline(spark, odd_table, clashing, at):
    name, stage = corpus_pipeline.STAGES[at]
    for docs in (odd_table, clashing):
        out = stage(spark, docs, "")
        assert out.where("doc_id = 4").count() >= (name != "mixing")  # a very long, clean text
        if at < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        assert stage(spark, docs.where("doc_id = -5"), "").count() == 0


# --- token files -----------------------------------------------------------------------------


def test_token_files_of_odd_rows(spark, odd_table, clashing):
    found = []
    for docs in (odd_table, clashing):
        path = scratch_path(spark, "edge-tokens")
        token_files.write_tokens(docs, path, JSON, end_id=2)
        found.append(rows_of(token_files.read_tokens(spark, path), "doc_id", "n_tokens", "ids_crc32"))
    assert found[0] == found[1]
    end_only = zlib.crc32(np.array([2], "<u4").tobytes())
    assert found[0][(2, 1, end_only)] == found[0][(3, 1, end_only)] == 1


def test_token_files_of_nothing(spark, odd_table):
    path = scratch_path(spark, "edge-tokens")
    token_files.write_tokens(odd_table.where("doc_id = -5"), path, JSON, end_id=2)
    assert token_files.read_tokens(spark, path).count() == 0


# --- chats -----------------------------------------------------------------------------------


def test_chats_of_odd_rows(spark):
    turn = '{"role": "assistant", "text": "ok"}'
    rows = [
        (1, 0, turn),
        (1, 0, turn),
        (None, None, turn),
        (2, None, turn),
        (2, 0, '{"role": "user", "text": ""}'),
        (3, 0, None),
        (4, 0, '{"role": "assistant", "text": "' + "x" * 300_000 + '"}'),
    ]
    records = spark.createDataFrame(rows, "conv_id bigint, position bigint, role string")
    records = records.withColumn("text", F.lit(1)).withColumn("formatted", F.lit(2))
    turns = chat_format.canonical_turns(records, "conv_id", "position", "role")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.formatted_turns(turns)).collect()}
    assert set(got) == {1, None, 2, 4}  # the turn of an unknown layout is in ``turns`` only
    assert turns.where("layout LIKE 'unknown:%'").count() == 1
    assert (got[1].n_turns, got[1].loss_chars) == (2, 4)
    assert got[1].loss_sha256 == hashlib.sha256(b"okok").hexdigest()
    assert (got[2].n_turns, got[2].loss_chars) == (2, 2)
    assert got[2].turns_sha256 == hashlib.sha256(b"assistant\nok\nuser\n\n").hexdigest()
    assert got[4].loss_chars == 300_000
    nothing = chat_format.canonical_turns(records.where("conv_id = -5"), "conv_id", "position", "role")
    assert chat_format.read_back(chat_format.formatted_turns(nothing)).count() == 0


# --- search ----------------------------------------------------------------------------------


def test_search_of_odd_rows(spark):
    rows = [(0, [1.0, 0.5]), (20, [1.0, 0.5]), (20, [1.0, 0.5]), (3, [1.0, 0.5]), (None, [1.0, 1.0])]
    rows += [(4, None), (5, [None, 1.0]), (6, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    wide = df.select("*", *(F.lit(7).alias(name) for name in VECTOR_CLASHES))
    is_query = F.col("vec_id") % 20 == 0
    score = 64 * 64 + 32 * 32
    for vectors in (df, wide):
        got = rows_of(topk_search.top_k(vectors, is_query, k=2), "query_id", "rank", "vec_id", "score")
        # Ties go to the smaller id; both rows of 20 are queries and, for 0, candidates.
        assert got == {(0, 1, 3, score): 1, (0, 2, 20, score): 1, (20, 1, 0, score): 2,
                       (20, 2, 3, score): 2}
    none = df.where("vec_id IN (4, 5, 6)")
    assert topk_search.top_k(none, F.lit(True)).count() == 0
