"""Regular expressions compiled to minimal deterministic automata held in numpy arrays.

The expressions are read with the standard library's own parser; literals, classes, groups, alternatives and
bounded or unbounded repeats over ASCII are supported. Everything works on bytes.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

import numpy as np


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1


def _either_case(codes: frozenset[int]) -> frozenset[int]:
    return codes | {c ^ 32 for c in codes if chr(c).isascii() and chr(c).isalpha()}


def _codes_of(items) -> frozenset[int]:
    found: set[int] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            found.add(arg)
        elif op is sre.RANGE:
            found.update(range(arg[0], arg[1] + 1))
        else:
            raise ValueError(f"not supported in a class: {op}")
    if max(found) > 127:
        raise ValueError("only ASCII is supported")
    return frozenset(found)


def _build(nfa: _Nfa, items, start: int, fold: bool, back: bool) -> int:
    """Adds the items after state start; returns the state behind them. back: the reversed language."""
    for op, arg in reversed(items) if back else items:
        if op in (sre.LITERAL, sre.IN):
            codes = frozenset([arg]) if op is sre.LITERAL else _codes_of(arg)
            end = nfa.state()
            nfa.moves[start].append((_either_case(codes) if fold else codes, end))
            start = end
        elif op is sre.SUBPATTERN:
            start = _build(nfa, arg[-1], start, fold, back)
        elif op is sre.BRANCH:
            end = nfa.state()
            for branch in arg[1]:
                nfa.empty[_build(nfa, branch, start, fold, back)].append(end)
            start = end
        elif op is sre.MAX_REPEAT:
            low, high, inner = arg
            for _ in range(low):
                start = _build(nfa, inner, start, fold, back)
            if high is sre.MAXREPEAT:
                loop = nfa.state()
                nfa.empty[start].append(loop)
                nfa.empty[_build(nfa, inner, loop, fold, back)].append(loop)
                start = loop
            else:
                end = nfa.state()
                nfa.empty[start].append(end)
                for _ in range(high - low):
                    start = _build(nfa, inner, start, fold, back)
                    nfa.empty[start].append(end)
                start = end
        else:
            raise ValueError(f"not supported: {op}")
    return start


@dataclass(frozen=True)
class Dfa:
    """``step[state * width + byte_class[byte]]`` is the next state; state 0 starts. States from ``first_accept`` on accept,
    ``accepts[state]`` being the bits of the rules. ``dead`` is the state without a way out, or -1."""

    step: np.ndarray
    byte_class: np.ndarray
    width: int
    accepts: np.ndarray
    first_accept: int
    dead: int


def compile_rules(rules: list[tuple[str, bool]], search: bool, back: bool = False) -> Dfa:
    """One automaton for all rules (expression, either case?): subset construction, then minimisation.

    search: a match may begin at any byte, else at the first one only. back: of the reversed expressions."""
    nfa, finals = _Nfa(), {}
    root = nfa.state()
    for bit, (pattern, fold) in enumerate(rules):
        begin = nfa.state()
        nfa.empty[root].append(begin)
        finals[_build(nfa, sre_parser.parse(pattern), begin, fold, back)] = 1 << bit
    sets = sorted({codes for moves in nfa.moves for codes, _ in moves}, key=sorted)
    signatures = {}
    byte_class = np.zeros(256, np.int32)
    for byte in range(256):
        byte_class[byte] = signatures.setdefault(tuple(byte in s for s in sets), len(signatures))
    width = len(signatures)
    classes_of = {s: [k for signature, k in signatures.items() if signature[i]] for i, s in enumerate(sets)}

    def closed(states: set[int]) -> frozenset[int]:
        stack = list(states)
        while stack:
            for x in nfa.empty[stack.pop()]:
                if x not in states:
                    states.add(x)
                    stack.append(x)
        return frozenset(s for s in states if nfa.moves[s] or s in finals)

    first = closed({root})
    numbers, todo, rows = {first: 0}, [first], []
    while todo:
        nexts: list[set[int]] = [set(first) if search else set() for _ in range(width)]
        for s in todo.pop(0):
            for codes, to in nfa.moves[s]:
                for k in classes_of[codes]:
                    nexts[k].add(to)
        row = []
        for states in map(closed, nexts):
            if states not in numbers:
                numbers[states] = len(numbers)
                todo.append(states)
            row.append(numbers[states])
        rows.append(row)
    step = np.array(rows, np.int64)
    accepts = np.array([sum({finals[s] for s in states if s in finals}) for states in numbers], np.int64)

    block = np.unique(accepts, return_inverse=True)[1]
    while True:  # refinement: states stay together while all their moves lead to the same blocks
        keys = np.column_stack([block, block[step]])
        finer = np.unique(keys, axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    kept = np.unique(block, return_index=True)[1]
    small_step, small_accepts = block[step[kept]], accepts[kept]
    order = sorted(range(len(kept)), key=lambda b: (small_accepts[b] > 0, b != block[0], b))
    if order[0] != block[0]:
        raise ValueError("a rule matches the empty text")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    small_step, small_accepts = rank[small_step[order]], small_accepts[order]
    dead = [s for s in range(len(order)) if not small_accepts[s] and (small_step[s] == s).all()]
    return Dfa(small_step.astype(np.int32).reshape(-1), byte_class, width, small_accepts, int((small_accepts == 0).sum()), dead[0] if dead and not search else -1)


def accepting(dfa: Dfa, data: np.ndarray, lane: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Ends (exclusive) of all matches in the bytes, in order, and the accepting states there.

    The bytes are cut into lanes that step together; each lane first assumes the start state, and lanes whose
    neighbour ended elsewhere are stepped again until they agree with what is there already."""
    n = len(data)
    lanes = -(-n // lane)
    classes = np.zeros(lanes * lane, np.int32)
    classes[:n] = dfa.byte_class[data]
    classes = np.ascontiguousarray(classes.reshape(lanes, lane).T)
    states = np.empty((lane, lanes), np.int16 if len(dfa.accepts) < 1 << 15 else np.int32)
    now = np.zeros(lanes, np.int32)
    for i in range(lane):
        now = dfa.step[now * dfa.width + classes[i]]
        states[i] = now
    again = np.flatnonzero(states[-1][:-1]) + 1
    while len(again):
        now, which, ended = states[-1][again - 1].astype(np.int32), again, []
        for i in range(lane):
            now = dfa.step[now * dfa.width + classes[i, which]]
            differs = now != states[i, which]
            if not differs.any():
                break
            now, which = now[differs], which[differs]
            states[i, which] = now
        else:
            ended = which[which + 1 < lanes] + 1
        again = np.asarray(ended, np.int64)
    flat = states.T.reshape(-1)[:n]
    at = np.flatnonzero(flat >= dfa.first_accept)
    return at + 1, flat[at]
