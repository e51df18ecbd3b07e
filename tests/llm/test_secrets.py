"""The combined automaton against regular expressions."""

import random
import re

import pytest

from llm import automata, secret_scan

FINDER = secret_scan.SecretFinder(secret_scan.compiled())
TOKENS = (
    "password passwd SeCret token api_key apikey AKIA a b0 = ' \" : deadbee _ . / @ - pwd key secret_ private"
    " eyJ ghp_ ABCDEF123456 xxxxxxx bearer é \x00 RSA https://"
).split() + [" ", "\n", "-----BEGIN ", "PRIVATE KEY-----", "deadbeef" * 4]


def by_expressions(text):
    found = []
    for number, rule in enumerate(secret_scan.RULES):
        flags = re.IGNORECASE | re.ASCII if rule.fold_case else 0
        for m in re.finditer(rule.search, text, flags):
            if not rule.whole or re.fullmatch(rule.whole, m.group(), flags):
                found.append((m.start(), number, m.end()))
    return [(a, b, n) for a, n, b in sorted(found)]


def test_random_texts():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choices(TOKENS, k=rng.randint(0, 25)))
        assert FINDER.find(text.encode()) == by_expressions(text), text


def test_tables_are_minimal():
    small = automata.anchored(automata.parse("(a|b)*abb"))
    # Four states, and the dead one for other bytes.
    assert len(small.outputs) == 5
    tables = automata.combine([automata.parse("ab+"), automata.parse("[0-9]{2,}")])
    moves = tables.next.reshape(-1, 256)
    assert len({(o, *row) for o, row in zip(tables.outputs, moves.tolist())}) == len(moves)


@pytest.mark.parametrize("pattern", ["a(bc)?", "a*", "a{9999}", "(a", "*a", "\\d"])
def test_refused_rules(pattern):
    with pytest.raises(ValueError):
        automata.combine([automata.parse(pattern)])


def test_rows(spark, odd_docs, no_docs):
    token = "t0ken = 'abcdefgh'; token = 'é' TOKEN:abcdefgh"
    extra = spark.createDataFrame([(None, token, "en", "s", 0)], odd_docs.schema)
    docs = odd_docs.unionByName(extra)
    rows = secret_scan.secrets_digest(docs).collect()
    assert len(rows) == docs.count()
    assert [r.spans for r in rows if r.spans] == ["assign:32:46"]
    assert secret_scan.secrets_digest(no_docs).count() == 0
    spans = secret_scan.find_secrets(docs.withColumn("spans", docs.doc_id)).collect()
    assert sum(len(r.spans) for r in spans) == 1
    long = spark.createDataFrame([(1, "x " * 500_000 + "AKIA" + "Z" * 100_000)], "doc_id int, text string")
    assert secret_scan.secrets_digest(long).first().spans == "access:1000000:1100004"
