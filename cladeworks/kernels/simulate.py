"""Simulation of histories down a tree: indels by Gillespie's algorithm on each branch, then substitutions by column."""

from __future__ import annotations

import numpy as np

from .model import Model


def indels(rng: np.random.Generator, m: Model, length: int, t: float) -> list[int]:
    """The child's sequence of origins after time t: indices of parent residues, and -1 for inserted ones."""
    now, clock = list(range(length)), 0.0
    while True:
        total = m.insrate * (len(now) + 1) + m.delrate * len(now)
        if total <= 0:
            return now
        clock += rng.exponential(1 / total)
        if clock >= t:
            return now
        if rng.random() * total < m.insrate * (len(now) + 1):
            at, n = int(rng.integers(len(now) + 1)), int(rng.geometric(1 - m.insext))
            now[at:at] = [-1] * n
        else:
            at, n = int(rng.integers(len(now))), int(rng.geometric(1 - m.delext))
            del now[at : at + n]


def history(m: Model, parent: list[int], blen: list[float], root_length: int, seed: int) -> list[str]:
    """Gapped rows for all nodes (postorder, root last), residues by state, of one simulated history."""
    rng = np.random.default_rng(seed)
    n = len(parent)
    columns: list[int] = list(range(root_length))  # column ids in order
    rows: dict[int, list[int]] = {n - 1: list(range(root_length))}
    born, fresh = dict.fromkeys(columns, n - 1), root_length
    for v in range(n - 2, -1, -1):
        above = rows[parent[v]]
        own: list[int] = []
        last = -1
        for origin in indels(rng, m, len(above), blen[v]):
            if origin >= 0:
                own.append(above[origin])
                last = columns.index(above[origin])
            else:
                last += 1
                columns.insert(last, fresh)
                born[fresh] = v
                own.append(fresh)
                fresh += 1
        rows[v] = own
    where = {c: i for i, c in enumerate(columns)}
    weights = np.array([c.weight for c in m.components])
    component = rng.choice(len(weights), len(columns), p=weights)
    state = np.full((n, len(columns)), -1)
    for v in range(n - 1, -1, -1):
        p = None if v == n - 1 else m.probs(blen[v])
        for c in rows[v]:
            i = where[c]
            k = component[i]
            dist = m.components[k].root if born[c] == v else p[k][state[parent[v], i]]
            state[v, i] = rng.choice(len(m.alphabet), p=dist / dist.sum())
    return ["".join("-" if s < 0 else m.alphabet[s] for s in row) for row in state]
