"""Personal data by anchor expansion.

One pass of an Aho-Corasick automaton over each whole text finds anchors: at-signs, plus signs,
digits, URL schemes, cues that name an identifier or a secret, and beginnings of known keys. From each anchor a small parser expands to
both sides and checks the boundaries and the value. Text without an anchor is never looked at again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache
from math import log2

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base kinds in their order of listing, then those that the method adds.
KINDS = ("email", "ip", "card", "phone", "account", "iban", "url_login", "secret")
BASE = KINDS[:4]

DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
ALPHANUMERIC = DIGITS | LETTERS
LOCAL = ALPHANUMERIC | set("._%+-")
LABEL = ALPHANUMERIC | {"-"}
PHONE = DIGITS | set(" ().-")
SPACES = frozenset(" \t\n\r\x0b\x0c")

SCHEMES = ("http://", "https://", "ftp://", "ssh://")
#: Words that name an identifier; it follows after a sign and at most a few spaces.
CUES = ("account", "acct", "iban", "passport", "ssn", "social security", "tax id", "customer id")
#: Words that name a secret, in lower case; its value follows after a sign.
SECRET_CUES = (
    *("password", "passwd", "passphrase", "pwd", "secret", "token", "api_key", "api-key", "apikey"),
    *("access_key", "access-key", "auth_key", "auth-key", "private_key", "private-key", "credential"),
)
#: Words before a secret that needs no sign, and beginnings of keys, as they are spelled.
BEARER = "bearer "
PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "eyJ")
SECRET = ALPHANUMERIC | set("+/_.=-~")
LEAST_SECRET, LEAST_KEY = 8, 16
#: Least bits per character, by the shares of the characters of the value itself.
LEAST_ENTROPY = 2.5
_LOWER = {code: code + 32 for code in range(65, 91)}

Span = tuple[int, int, str]


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in (
        ("at", ("@",)),
        ("plus", ("+",)),
        ("digit", tuple(DIGITS)),
        ("scheme", SCHEMES),
        ("cue", CUES),
        ("secret", SECRET_CUES),
        ("bearer", (BEARER,)),
        ("prefix", PREFIXES),
    ):
        for word in words:
            found.add_word(word.lower(), (kind, len(word)))
    found.make_automaton()
    return found


def _run(text: str, at: int, allowed: frozenset | set) -> int:
    """First place from ``at`` on whose character is not allowed."""
    while at < len(text) and text[at] in allowed:
        at += 1
    return at


# --- parsers: each returns the place where to go on, and appends what it finds ----------------


def email(text: str, at: int, floor: int, out: list[Span]) -> int:
    """Around the at-sign at ``at``, starting not before ``floor``."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return floor
    labels = 1
    while end < len(text) and text[end] == ".":
        after = _run(text, end + 1, LABEL)
        if after == end + 1:
            break
        end, labels = after, labels + 1
    if labels < 2:
        return floor
    out.append((start, end, "email"))
    return end


def ips(text: str, at: int, out: list[Span]) -> int:
    """All addresses in the chain of numbers with single dots that starts at ``at``."""
    numbers, end = [], at
    while True:
        stop = _run(text, end, DIGITS)
        numbers.append((end, stop))
        if not (stop + 1 < len(text) and text[stop] == "." and text[stop + 1] in DIGITS):
            break
        end = stop + 1
    for first in range(0, len(numbers) - 3, 4):
        four = numbers[first : first + 4]
        if all(_at_most_255(text[a:b]) for a, b in four):
            out.append((four[0][0], four[3][1], "ip"))
    return stop


def _at_most_255(number: str) -> bool:
    number = number.lstrip("0")
    return len(number) < 3 or (len(number) == 3 and number <= "255")


def card(text: str, at: int, out: list[Span]) -> int:
    """The chain of digits, with single spaces or hyphens between them, that starts at ``at``."""
    digits, end = [], at
    while True:
        digits.append(text[end])
        end += 1
        following = end + 1 if end < len(text) and text[end] in " -" else end
        if following >= len(text) or text[following] not in DIGITS:
            break
        end = following
    if 12 <= len(digits) <= 19 and luhn(digits):
        out.append((at, end, "card"))
    return end


def luhn(digits: list[str]) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) << (i & 1)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def phone(text: str, at: int, out: list[Span]) -> int:
    """After the plus sign at ``at``."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return at + 1
    end = _run(text, at + 2, PHONE)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= at + 3:
        return at + 1
    if 9 <= sum(c in DIGITS for c in text[at:end]) <= 15:
        out.append((at, end, "phone"))
    return end


def account(text: str, cue: int, at: int, out: list[Span]) -> int:
    """An identifier after the cue from ``cue`` to ``at``.

    The cue must be a word of its own. Then come, if at all, ``no``, ``number`` or ``id`` and one of
    ``: # =``; at least one of these must be there, with any number of spaces around. The identifier
    has letters, digits and hyphens, 6 to 34 in all, four or more of them digits; an IBAN may be
    printed in groups with single spaces between them.
    """
    if cue and text[cue - 1] in ALPHANUMERIC or at < len(text) and text[at] in LETTERS:
        return at
    named, place = False, _run(text, at, {" "})
    for word in ("number", "no.", "no", "id"):
        if text[place : place + len(word)].translate(_LOWER) == word:
            after = place + len(word)
            if after == len(text) or text[after] not in ALPHANUMERIC:
                place, named = _run(text, after, {" "}), True
                break
    if place < len(text) and text[place] in ":#=":
        place, named = _run(text, place + 1, {" "}), True
    if not named:
        return at
    printed = grouped_iban(text, place)
    if printed:
        out.append((place, printed, "iban"))
        return printed
    end = _run(text, place, ALPHANUMERIC)
    while end + 1 < len(text) and text[end] == "-" and text[end + 1] in ALPHANUMERIC:
        end = _run(text, end + 1, ALPHANUMERIC)
    value = text[place:end]
    if 6 <= len(value) <= 34 and sum(c in DIGITS for c in value) >= 4:
        out.append((place, end, "iban" if iban(value) else "account"))
        return end
    return at


def grouped_iban(text: str, at: int) -> int:
    """End of the longest IBAN that starts at ``at``, with or without single spaces; 0 if none does."""
    value, end, found = "", at, 0
    while True:
        stop = _run(text, end, ALPHANUMERIC)
        value += text[end:stop]
        if stop == end or len(value) > 34:
            return found
        if iban(value):
            found = stop
        if not (stop < len(text) and text[stop] == " "):
            return found
        end = stop + 1


def entropy(value: str) -> float:
    """Bits per character."""
    shares = [n / len(value) for n in Counter(value).values()]
    return -sum(share * log2(share) for share in shares)


def secret(text: str, at: int, out: list[Span], signed: bool, floor: int) -> int:
    """The value behind the cue that ends at ``at``, but not before ``floor``.

    ``signed``: a colon or an equals sign must come first; quotes and spaces may stand around it. The
    value has letters, digits and ``+/_.=-~``, a digit among them, and looks random.
    """
    place = at
    if signed:
        if place < len(text) and text[place] in "'\"":
            place += 1
        place = _run(text, place, {" "})
        if place >= len(text) or text[place] not in ":=":
            return floor
        place = _run(text, place + 1, {" "})
        if place < len(text) and text[place] in "'\"":
            place += 1
    else:
        place = _run(text, place, {" "})
    if place < floor:
        return floor
    end = _run(text, place, SECRET)
    return _random_value(text, place, end, LEAST_SECRET if signed else LEAST_KEY, out) or floor


def known_key(text: str, at: int, prefix: int, out: list[Span], floor: int) -> int:
    """The key whose known beginning lies from ``at`` to ``prefix``, as a word of its own."""
    if at < floor or text[at:prefix] not in PREFIXES or at and text[at - 1] in ALPHANUMERIC:
        return floor
    return _random_value(text, at, _run(text, prefix, SECRET), LEAST_KEY, out) or floor


def _random_value(text: str, start: int, end: int, least: int, out: list[Span]) -> int:
    while end > start and text[end - 1] in ".-~":  # the end of a sentence
        end -= 1
    value = text[start:end]
    if len(value) < least or DIGITS.isdisjoint(value) or entropy(value) < LEAST_ENTROPY:
        return 0
    out.append((start, end, "secret"))
    return end


def iban(value: str) -> bool:
    """Two letters, two check digits, and the remainder that the check digits make 1."""
    value = value.upper()
    if not (15 <= len(value) <= 34 and value.isalnum() and value[:2].isalpha()):
        return False
    if not value[2:4].isdigit():
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def url_login(text: str, scheme: int, at: int, out: list[Span]) -> int:
    """``user:password`` between the scheme that ends at ``at`` and the at-sign of its host."""
    end, colon = at, -1
    while end < len(text) and text[end] not in SPACES and text[end] not in '/?#"<>@':
        if text[end] == ":" and colon < 0:
            colon = end
        end += 1
    if at < colon < end - 1 and end + 1 < len(text) and text[end] == "@":
        if text[end + 1] in LABEL:
            out.append((scheme, end, "url_login"))
    return at


def find(text: str) -> list[Span]:
    """All spans by start, then by kind as listed; places are code points, ends exclusive."""
    out: list[Span] = []
    lowered = text.lower() if text.isascii() else text.translate(_LOWER)
    after_email = after_ip = after_card = after_phone = after_secret = 0
    for last, (kind, length) in automaton().iter(lowered):
        at = last + 1 - length
        if kind == "digit":
            if at >= after_ip:
                after_ip = ips(text, at, out)
            if at >= after_card:
                after_card = card(text, at, out)
        elif kind == "at":
            if at >= after_email:
                after_email = email(text, at, after_email, out)
        elif kind == "plus":
            if at >= after_phone:
                after_phone = phone(text, at, out)
        elif kind == "cue":
            account(text, at, last + 1, out)
        elif kind == "prefix":
            after_secret = known_key(text, at, last + 1, out, after_secret)
        elif kind in ("secret", "bearer"):
            after_secret = secret(text, last + 1, out, kind == "secret", after_secret)
        else:
            url_login(text, at, last + 1, out)
    return sorted(set(out), key=lambda span: (span[0], KINDS.index(span[2]), span[1]))


# --- operators -------------------------------------------------------------------------------


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans``, an array of (start, end, kind), of each row of ``docs``.

    A null or empty text has none. A null doc_id and repeated rows pass through, other columns are
    ignored; no row is moved.
    """
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [{"start": a, "end": b, "kind": k} for a, b, k in find(text or "")]
                for text in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(spans, pa.list_(span))], ["doc_id", "spans"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id bigint, spans array<struct<start:bigint,end:bigint,kind:string>>"
    )


def span_text(spans: str, kinds: tuple[str, ...] = KINDS) -> str:
    """SQL for the spans of these kinds as ``kind:start:end``, joined with commas."""
    listed = ", ".join(f"'{kind}'" for kind in kinds)
    return (
        f"array_join(transform(filter({spans}, s -> s.kind IN ({listed})),"
        " s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    )


def redact(docs: DataFrame, mark: str = "[{kind}]") -> DataFrame:
    """The rows of ``docs`` with each span replaced by ``mark``.

    Spans that overlap are replaced together, by the mark of the first. A null text stays null, an
    empty one empty; all other columns, and rows that repeat, stay as they are.
    """
    names = docs.columns
    place = names.index("text")

    def clean(text: str) -> str:
        parts, at = [], 0
        for start, end, kind in find(text):
            if start >= at:
                parts += [text[at:start], mark.format(kind=kind)]
            at = max(at, end)
        return "".join([*parts, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else clean(t) for t in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def personal_data_digest(docs: DataFrame) -> DataFrame:
    """doc_id, a count of each kind, base_sha256 and spans of each row of ``docs``."""
    found = find_personal_data(docs)
    return found.select(
        "doc_id",
        *(
            F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}")
            for k in KINDS
        ),
        F.sha2(F.expr(span_text("spans", BASE)), 256).alias("base_sha256"),
        F.expr(span_text("spans")).alias("spans"),
    )
