"""Connectivity of small directed graphs given by a weight matrix."""

from __future__ import annotations

import numpy as np


def _reach(adjacent: list[np.ndarray], start: int, seen: np.ndarray) -> list[int]:
    """Post-order of a depth-first walk."""
    out, stack = [], [(start, 0)]
    seen[start] = True
    while stack:
        node, i = stack.pop()
        nexts = adjacent[node]
        while i < len(nexts) and seen[nexts[i]]:
            i += 1
        if i < len(nexts):
            stack.append((node, i + 1))
            seen[nexts[i]] = True
            stack.append((nexts[i], 0))
        else:
            out.append(node)
    return out


def connected_sets(c: np.ndarray, directed: bool = True) -> list[np.ndarray]:
    """Strongly (directed) or weakly connected components: largest first, ties by smallest member, members ascending."""
    a = np.asarray(c) != 0
    if not directed:
        a = a | a.T
    forward, backward = [np.flatnonzero(r) for r in a], [np.flatnonzero(r) for r in a.T]
    seen, order = np.zeros(len(a), bool), []
    for i in range(len(a)):
        if not seen[i]:
            order += _reach(forward, i, seen)
    seen, sets = np.zeros(len(a), bool), []
    for i in reversed(order):
        if not seen[i]:
            sets.append(np.sort(np.array(_reach(backward, i, seen))))
    return sorted(sets, key=lambda s: (-len(s), s[0]))


def largest_connected_set(c: np.ndarray, directed: bool = True) -> np.ndarray:
    return connected_sets(c, directed)[0]


def largest_connected_submatrix(c: np.ndarray, directed: bool = True, lcc: np.ndarray | None = None) -> np.ndarray:
    chosen = largest_connected_set(c, directed) if lcc is None else lcc
    return c[np.ix_(chosen, chosen)]


def is_connected(c: np.ndarray, directed: bool = True) -> bool:
    return len(connected_sets(c, directed)) == 1


def compute_connected_sets(c: np.ndarray, threshold: float = 0.0, directed: bool = True) -> list[np.ndarray]:
    """Components after entries strictly below the threshold are set to zero."""
    c = np.asarray(c, float)
    return connected_sets(np.where(c < threshold, 0, c) if threshold > 0 else c, directed)


def closed_sets(c: np.ndarray, threshold: float = 0.0) -> list[np.ndarray]:
    """Strong components that nothing leaves."""
    c = np.where(np.asarray(c, float) < threshold, 0, c)
    out = []
    for s in connected_sets(c, True):
        rest = np.setdiff1d(np.arange(len(c)), s)
        if not c[np.ix_(s, rest)].any():
            out.append(s)
    return out


def has_connection(c: np.ndarray, a, b) -> bool:
    """Whether any of b can be reached from any of a."""
    seen, todo, goal = set(a), list(a), set(b)
    while todo:
        i = todo.pop()
        if i in goal:
            return True
        for j in np.flatnonzero(np.asarray(c)[i]):
            if j not in seen:
                seen.add(int(j))
                todo.append(int(j))
    return False
