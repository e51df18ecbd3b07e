"""Regular expressions over bytes as one minimal deterministic automaton for many rules.

Rules are compiled to nondeterministic automata, these together to a deterministic one by subset
construction, and that is minimised and laid out as one flat array of transitions. Its state holds,
for each rule, the unfinished matches in order of their starts, so that the one pass over the bytes
tells where the leftmost match of each rule ends; matches of one rule do not overlap. The start is
found from the end by the automaton of the reversed rule.

A rule that has matched may only grow by bytes that keep it matched. Then the byte that ends a match
is known at once, and no byte is read twice. ``combine`` rejects other rules.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

ALL = frozenset(range(256))
#: A repetition without an upper bound, or with one above this, is refused beyond this count.
MOST_REPEATS = 4096


# --- syntax ----------------------------------------------------------------------------------
# A parsed rule is a tuple: ("set", bytes), ("cat", parts), ("or", parts), ("rep", part, low, high).


class _Parser:
    """Literals, ``\\`` escapes, ``[...]`` sets, groups, ``|``, and ``? * + {m} {m,} {m,n}``."""

    def __init__(self, pattern: str, fold_case: bool) -> None:
        self.source = pattern.encode("ascii")
        self.at, self.fold_case = 0, fold_case

    def parse(self) -> tuple:
        tree = self.either()
        if self.at < len(self.source):
            raise ValueError(f"unexpected {chr(self.source[self.at])!r} in a rule")
        return tree

    def peek(self) -> str:
        return chr(self.source[self.at]) if self.at < len(self.source) else ""

    def take(self) -> int:
        if self.at == len(self.source):
            raise ValueError("a rule ends too early")
        self.at += 1
        return self.source[self.at - 1]

    def either(self) -> tuple:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence(self) -> tuple:
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def atom(self) -> tuple:
        char = chr(self.take())
        if char == "(":
            tree = self.either()
            if chr(self.take()) != ")":
                raise ValueError("a group is not closed")
            return tree
        if char == "[":
            return ("set", self.charset())
        if char == ".":
            return ("set", ALL - {10})
        if char in "*+?{":
            raise ValueError(f"nothing to repeat before {char!r}")
        return ("set", self.folded({self.escaped() if char == "\\" else ord(char)}))

    def escaped(self) -> int:
        char = self.take()
        if char == ord("x"):
            return int(bytes((self.take(), self.take())), 16)
        if chr(char).isalnum():
            raise ValueError(f"unknown escape {chr(char)!r}")
        return char

    def charset(self) -> frozenset[int]:
        inverse, found = self.peek() == "^", set()
        self.at += inverse
        while (char := self.take()) != ord("]"):
            first = self.escaped() if char == ord("\\") else char
            last = first
            if self.peek() == "-" and self.source[self.at + 1 : self.at + 2] != b"]":
                self.at += 1
                last = self.escaped() if (end := self.take()) == ord("\\") else end
            found |= set(range(first, last + 1))
        return ALL - self.folded(found) if inverse else self.folded(found)

    def folded(self, found: set[int]) -> frozenset[int]:
        if not self.fold_case:
            return frozenset(found)
        both = {c ^ 32 for c in found if 65 <= c & ~32 <= 90}
        return frozenset(found | both)

    def repeated(self, part: tuple) -> tuple:
        while (char := self.peek()) and char in "?*+{":
            self.at += 1
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(char, (0, 0))
            if char == "{":
                inside = bytes(iter(self.take, ord("}"))).decode()
                first, _, last = inside.partition(",")
                low = int(first)
                high = (int(last) if last else None) if "," in inside else low
            if max(low, high or 0) > MOST_REPEATS:
                raise ValueError("a rule repeats too often")
            part = ("rep", part, low, high)
        return part


def parse(pattern: str, fold_case: bool = False) -> tuple:
    return _Parser(pattern, fold_case).parse()


def reverse(tree: tuple) -> tuple:
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "rep":
        return ("rep", reverse(tree[1]), *tree[2:])
    parts = [reverse(part) for part in tree[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


# --- nondeterministic automata ---------------------------------------------------------------


class Nfa:
    """States with byte-set edges and empty edges; state 0 starts, ``accept`` ends."""

    def __init__(self, tree: tuple) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []
        start = self._state()
        self.accept = self._add(tree, start)

    def _state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def _add(self, tree: tuple, start: int) -> int:
        """States for ``tree`` behind ``start``; the state where it ends."""
        kind = tree[0]
        if kind == "set":
            end = self._state()
            self.edges[start].append((tree[1], end))
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self._add(part, start)
            return start
        if kind == "or":
            end = self._state()
            for part in tree[1]:
                first = self._state()
                self.empty[start].append(first)
                self.empty[self._add(part, first)].append(end)
            return end
        _, part, low, high = tree
        for _ in range(low):
            start = self._add(part, start)
        if high is None:
            loop, end = self._state(), self._state()
            self.empty[start] += [loop, end]
            self.empty[self._add(part, loop)] += [loop, end]
            return end
        end = self._state()
        self.empty[start].append(end)
        for _ in range(high - low):
            start = self._add(part, start)
            self.empty[start].append(end)
        return end

    def closed(self, states: set[int]) -> frozenset[int]:
        """With all that empty edges reach; only states with byte edges, and the accepting one."""
        seen, waiting = set(states), list(states)
        while waiting:
            for following in self.empty[waiting.pop()]:
                if following not in seen:
                    seen.add(following)
                    waiting.append(following)
        return frozenset(s for s in seen if self.edges[s] or s == self.accept)

    def step(self, states: frozenset[int], byte: int) -> frozenset[int]:
        return self.closed({end for s in states for allowed, end in self.edges[s] if byte in allowed})


def byte_classes(nfas: Sequence[Nfa]) -> np.ndarray:
    """Class of each byte; bytes of one class are in the same sets of all edges."""
    sets = sorted({tuple(sorted(a)) for nfa in nfas for edges in nfa.edges for a, _ in edges})
    member = np.zeros((256, len(sets)), dtype=bool)
    for i, members in enumerate(sets):
        member[list(members), i] = True
    return np.unique(member, axis=0, return_inverse=True)[1].reshape(256)


# --- deterministic automata ------------------------------------------------------------------


@dataclass(frozen=True)
class Table:
    """Transitions as one array: the state ``s`` and byte ``b`` lead to ``next[256 * s + b] / 256``.

    ``outputs[s]`` is the value of each state; states are numbered by rising output.
    """

    next: np.ndarray
    outputs: np.ndarray
    start: int


def _minimal(moves: np.ndarray, outputs: np.ndarray, classes: np.ndarray, start: int) -> Table:
    """Merge states that no text tells apart: split blocks by output, then by where bytes lead."""
    block = np.unique(outputs, return_inverse=True)[1].reshape(-1)
    while True:
        signature = np.column_stack((block, block[moves]))
        finer = np.unique(signature, axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    # np.unique sorts by the first column, so blocks stay in the order of their outputs.
    first = np.unique(block, return_index=True)[1]
    rows = block[moves[first]][:, classes].astype(np.int64) * 256
    return Table(rows.reshape(-1).astype(np.int32), outputs[first], int(block[start]))


def anchored(tree: tuple) -> Table:
    """Automaton of whole matches: output 0 dead, 1 alive, 2 a match."""
    nfa = Nfa(tree)
    classes = byte_classes([nfa])
    examples = np.unique(classes, return_index=True)[1]
    states = {nfa.closed({0}): 0}
    listed, moves = list(states), []
    for state in listed:
        row = []
        for byte in examples:
            following = nfa.step(state, int(byte))
            if following not in states:
                states[following] = len(listed)
                listed.append(following)
            row.append(states[following])
        moves.append(row)
    outputs = np.array([2 if nfa.accept in s else bool(s) for s in listed], dtype=np.int64)
    return _minimal(np.array(moves), outputs, classes, 0)


def combine(trees: Sequence[tuple]) -> Table:
    """One automaton that follows all rules over a whole text.

    The output of a state has bit ``i`` set if a match of rule ``i`` ended before the byte that led
    to it, and bit ``i + n`` (for n rules) if rule ``i`` has a match that would end here.
    """
    nfas = [Nfa(tree) for tree in trees]
    n, classes = len(nfas), byte_classes(nfas)
    examples = np.unique(classes, return_index=True)[1]
    fresh = [nfa.closed({0}) for nfa in nfas]
    if any(nfa.accept in first for nfa, first in zip(nfas, fresh, strict=True)):
        raise ValueError("a rule may not match the empty text")

    def step(i: int, threads: tuple, byte: int) -> tuple[tuple, bool]:
        """Unfinished matches of rule ``i`` by rising start, and whether one has ended."""
        nfa = nfas[i]
        matched = bool(threads) and nfa.accept in threads[0]
        if matched:
            grown = nfa.step(threads[0], byte)
            if grown and nfa.accept not in grown:
                raise ValueError("a rule may only grow by bytes that keep it matched")
            if grown:
                return (grown,), False
            threads = ()
        seen, kept = set(), []
        for thread in (*threads, fresh[i]):
            new = nfa.step(thread, byte) - seen
            if new:
                kept.append(new)
                seen |= new
                if nfa.accept in new:
                    # Earlier starts without a match may still find one; later ones no longer.
                    break
        if kept and nfa.accept in kept[-1] and len(kept) > 1:
            raise ValueError("a later start may not match before an earlier one is decided")
        return tuple(kept), matched

    start = (0, tuple(() for _ in nfas))
    states, listed, moves = {start: 0}, [start], []
    known: dict[tuple, tuple] = {}
    for _, rules in listed:
        row = []
        for byte in examples:
            ended, following = 0, []
            for i, threads in enumerate(rules):
                key = (i, threads, byte)
                if key not in known:
                    known[key] = step(i, threads, int(byte))
                threads, done = known[key]
                ended |= done << i
                following.append(threads)
            state = (ended, tuple(following))
            if state not in states:
                states[state] = len(listed)
                listed.append(state)
            row.append(states[state])
        moves.append(row)
    outputs = np.array(
        [
            (sum((bool(t) and nfas[i].accept in t[0]) << i for i, t in enumerate(rules)), ended)
            for ended, rules in listed
        ],
        dtype=np.int64,
    )
    # States that follow the end of a match have the highest numbers.
    return _minimal(np.array(moves), (outputs[:, 1] << n) | outputs[:, 0], classes, 0)


# --- matching --------------------------------------------------------------------------------


class Scanner:
    """Finds the leftmost non-overlapping matches of each rule in one pass over the bytes."""

    def __init__(self, rules: Table, backward: Sequence[Table]) -> None:
        self.count = len(backward)
        self.next = rules.next.tolist()
        self.outputs = rules.outputs.tolist()
        self.start = rules.start * 256
        ending = np.flatnonzero(rules.outputs >> self.count)
        self.ending = (int(ending[0]) if len(ending) else len(rules.outputs)) * 256
        self.backward = [
            (b.next.tolist(), [int(x) for x in b.outputs], b.start * 256) for b in backward
        ]

    def _first(self, rule: int, data: bytes, floor: int, end: int) -> int:
        """The first place from ``floor`` on from which the rule matches up to ``end``."""
        moves, outputs, state = self.backward[rule]
        first = end
        for at in range(end - 1, floor - 1, -1):
            state = moves[state + data[at]]
            output = outputs[state >> 8]
            if output == 2:
                first = at
            elif not output:
                break
        return first

    def scan(self, data: bytes) -> Iterator[tuple[int, int, int]]:
        """(rule, start, end) in bytes, by rising end."""
        moves, ending, state = self.next, self.ending, self.start
        floors = [0] * self.count
        for at, byte in enumerate(data):
            state = moves[state + byte]
            if state >= ending:
                ended = self.outputs[state >> 8] >> self.count
                for rule in range(self.count):
                    if ended >> rule & 1:
                        yield rule, self._first(rule, data, floors[rule], at), at
                        floors[rule] = at
        here = self.outputs[state >> 8]
        for rule in range(self.count):
            if here >> rule & 1:
                yield rule, self._first(rule, data, floors[rule], len(data)), len(data)
