"""Rule patterns as deterministic automata over bytes.

A pattern is read by Python's own pattern parser, made into a nondeterministic
automaton, then by subset construction into a deterministic one, and minimised.
Supported: literals, sets, groups, alternatives and greedy repeats.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass, field

ANY = (1 << 256) - 1


@dataclass
class Graph:
    """edges[s]: (set of bytes as bits, target); jumps[s]: targets without a byte."""

    edges: list[list[tuple[int, int]]] = field(default_factory=list)
    jumps: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.edges.append([])
        self.jumps.append([])
        return len(self.edges) - 1


def _members(items) -> int:
    bits, negated = 0, False
    for op, value in items:
        if op is sre.NEGATE:
            negated = True
        elif op is sre.LITERAL:
            bits |= 1 << value
        elif op is sre.RANGE:
            bits |= sum(1 << b for b in range(value[0], value[1] + 1))
        else:
            raise ValueError(f"not supported in a set: {op}")
    return ANY & ~bits if negated else bits


def _add(graph: Graph, start: int, items, backwards: bool) -> int:
    """Adds ``items`` behind ``start``; gives the state behind them."""
    for op, value in reversed(list(items)) if backwards else items:
        if op in (sre.LITERAL, sre.NOT_LITERAL, sre.IN, sre.ANY):
            if op is sre.IN:
                bits = _members(value)
            else:
                bits = {sre.LITERAL: lambda: 1 << value, sre.NOT_LITERAL: lambda: ANY & ~(1 << value), sre.ANY: lambda: ANY}[op]()
            end = graph.state()
            graph.edges[start].append((bits, end))
        elif op is sre.SUBPATTERN:
            end = _add(graph, start, value[3], backwards)
        elif op is sre.BRANCH:
            end = graph.state()
            for choice in value[1]:
                graph.jumps[_add(graph, start, choice, backwards)].append(end)
        elif op is sre.MAX_REPEAT:
            least, most, inner = value
            at = start
            for _ in range(least):
                at = _add(graph, at, inner, backwards)
            end = graph.state()
            if most is sre.MAXREPEAT:
                loop = graph.state()
                graph.jumps[at].append(loop)
                graph.jumps[_add(graph, loop, inner, backwards)].append(loop)
                at = loop
            else:
                for _ in range(most - least):
                    graph.jumps[at].append(end)
                    at = _add(graph, at, inner, backwards)
            graph.jumps[at].append(end)
        else:
            raise ValueError(f"not supported: {op}")
        start = end
    return start


def _closure(graph: Graph, states) -> frozenset[int]:
    found, todo = set(states), list(states)
    while todo:
        for target in graph.jumps[todo.pop()]:
            if target not in found:
                found.add(target)
                todo.append(target)
    return frozenset(found)


def _byte_classes(graph: Graph) -> list[int]:
    """One byte of each class of bytes that no edge tells apart, by byte."""
    first: dict[tuple, int] = {}
    sets = sorted({bits for edges in graph.edges for bits, _ in edges})
    return [first.setdefault(tuple(bits >> b & 1 for bits in sets), b) for b in range(256)]


def compile_rules(patterns: list[bytes], anywhere: bool = False, backwards: bool = False) -> tuple[list[list[int]], list[tuple[int, ...]]]:
    """(transitions, accepted): minimal deterministic automaton of all patterns at once.

    ``transitions[state][byte]`` is the next state, state 0 the first one;
    ``accepted[state]`` are the numbers of the patterns that end there. With
    ``anywhere`` a match may begin at any byte; else a state from which nothing
    can be accepted is -1. ``backwards`` reads the patterns from their end.
    """
    graph = Graph()
    root = graph.state()
    if anywhere:
        graph.edges[root].append((ANY, root))
    ends: dict[int, int] = {}
    for number, pattern in enumerate(patterns):
        first = graph.state()
        graph.jumps[root].append(first)
        ends[_add(graph, first, parser.parse(pattern), backwards)] = number
    classes = _byte_classes(graph)
    symbols = sorted(set(classes))

    start = _closure(graph, [root])
    numbers, todo, table = {start: 0}, [start], []
    for subset in todo:  # grows while it is walked
        row = {}
        for byte in symbols:
            reached = {target for s in subset for bits, target in graph.edges[s] if bits >> byte & 1}
            target = _closure(graph, reached)
            if target not in numbers:
                numbers[target] = len(todo)
                todo.append(target)
            row[byte] = numbers[target]
        table.append(row)
    accepted = [tuple(sorted(ends[s] for s in subset if s in ends)) for subset in todo]

    # minimise: split groups of states until the states of a group agree on all moves
    group = {a: i for i, a in enumerate(dict.fromkeys(accepted))}
    of = [group[a] for a in accepted]
    while True:
        keys = [(of[s], *(of[table[s][b]] for b in symbols)) for s in range(len(table))]
        names = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        if len(names) == len(set(of)):
            break
        of = [names[k] for k in keys]
    order = {g: i for i, g in enumerate(dict.fromkeys(of))}  # the first state keeps number 0
    one = {order[of[s]]: s for s in reversed(range(len(table)))}
    moves = [[order[of[table[one[g]][classes[b]]]] for b in range(256)] for g in range(len(order))]
    accepts = [accepted[one[g]] for g in range(len(order))]
    dead = {g for g in range(len(order)) if not accepts[g] and set(moves[g]) == {g}}
    return [[-1 if t in dead else t for t in row] for row in moves], accepts
