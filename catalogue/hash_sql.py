"""SQL text for the 64-bit hash behind the synthetic workloads (the published XXH64 algorithm).

It lets a SQL engine without that function recompute every generated row. Numbers are kept as
unsigned 128-bit integers and reduced modulo 2**64 after each product.
"""

from __future__ import annotations

# Primes of the algorithm, and the seed of Spark's hash function.
PRIME_1 = 11400714785074694791
PRIME_2 = 14029467366897019727
PRIME_3 = 1609587929392839161
PRIME_4 = 9650029242287828579
PRIME_5 = 2870177450012600261
SEED = 42
WORD = 1 << 64


def _big(number: int) -> str:
    return f"{number}::UHUGEINT"


def _add(number: int):
    return lambda c: f"({c} + {_big(number % WORD)}) % {_big(WORD)}"


def _xor(number: int):
    return lambda c: f"xor({c}, {_big(number % WORD)})"


def _multiply_add(factor: int, number: int = 0):
    return lambda c: f"({c} * {_big(factor)} + {_big(number)}) % {_big(WORD)}"


def _rotate(bits: int):
    return lambda c: f"({c} * {_big(1 << bits)}) % {_big(WORD)} + {c} // {_big(1 << (64 - bits))}"


def _xor_shift(bits: int):
    return lambda c: f"xor({c}, {c} // {_big(1 << bits)})"


AVALANCHE = [
    _xor_shift(33),
    _multiply_add(PRIME_2),
    _xor_shift(29),
    _multiply_add(PRIME_3),
    _xor_shift(32),
]


def _rotated(number: int, bits: int) -> int:
    number %= WORD
    return ((number << bits) | (number >> (64 - bits))) % WORD


def _text_steps(text: str) -> list:
    """Steps that turn the hash so far into the hash with a short constant text appended."""
    data = text.encode()
    steps = [_add(PRIME_5 + len(data))]
    while len(data) >= 8:
        word = int.from_bytes(data[:8], "little")
        steps += [
            _xor(_rotated(word * PRIME_2, 31) * PRIME_1),
            _rotate(27),
            _multiply_add(PRIME_1, PRIME_4),
        ]
        data = data[8:]
    if len(data) >= 4:
        word = int.from_bytes(data[:4], "little")
        steps += [_xor(word * PRIME_1), _rotate(23), _multiply_add(PRIME_2, PRIME_3)]
        data = data[4:]
    for byte in data:
        steps += [_xor(byte * PRIME_5), _rotate(11), _multiply_add(PRIME_1)]
    return steps + AVALANCHE


def hashed_ids(ids_sql: str, salts: list[str]) -> str:
    """CTE list that ends in ``hashed(id, h_<salt>...)``; each hash is a signed 128-bit number."""
    mixed = f"(id::UHUGEINT * {_big(PRIME_2)}) % {_big(WORD)}"
    turned = _rotate(31)("h")
    ctes = [
        f"ids AS ({ids_sql})",
        f"k0 AS (SELECT id, {mixed} AS h FROM ids)",
        f"k1 AS (SELECT id, {turned} AS h FROM k0)",
        f"k2 AS (SELECT id, xor({_big((SEED + PRIME_5 + 8) % WORD)}, "
        f"{_multiply_add(PRIME_1)('h')}) AS h FROM k1)",
    ]
    last = "k2"
    for number, step in enumerate([_rotate(27), _multiply_add(PRIME_1, PRIME_4), *AVALANCHE]):
        ctes.append(f"a{number} AS (SELECT id, {step('h')} AS h FROM {last})")
        last = f"a{number}"
    chains = {f"h_{salt}": _text_steps(salt) for salt in salts}
    copies = ", ".join(f"h AS {column}" for column in chains)
    ctes.append(f"s0 AS (SELECT id, {copies} FROM {last})")
    last = "s0"
    for number in range(max(len(chain) for chain in chains.values())):
        columns = ", ".join(
            f"{chain[number](column)} AS {column}" if number < len(chain) else column
            for column, chain in chains.items()
        )
        ctes.append(f"t{number} AS (SELECT id, {columns} FROM {last})")
        last = f"t{number}"
    signed = ", ".join(
        f"{column}::HUGEINT - CASE WHEN {column} >= {_big(1 << 63)} THEN {WORD}::HUGEINT "
        f"ELSE 0::HUGEINT END AS {column}"
        for column in chains
    )
    ctes.append(f"hashed AS (SELECT id, {signed} FROM {last})")
    return ",\n".join(ctes)


def modulo(salt: str, domain: int) -> str:
    """The positive remainder of a hash."""
    return f"(((h_{salt} % {domain}) + {domain}) % {domain})"
