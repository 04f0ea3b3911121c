"""Progressive reconstruction of a family's history: profiles from the leaves to the root, and the best path there."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import profile as pf
from .model import Model
from .trees import Node, children


@dataclass(frozen=True)
class Options:
    """band: how far paths may stray from the guide, in matches (None: any distance). samples: paths sampled for a profile, least_posterior
    instead of them, if given. most_states: 0 for no limit."""

    band: int | None = 20
    samples: int = 10
    least_posterior: float | None = None
    most_states: int = 0
    best: bool = True
    keep_gaps: bool = False
    seed: int = 5489


@dataclass(frozen=True)
class History:
    """Rows by node (postorder, root last): residues of leaves, a wildcard for each residue of an ancestor, gaps."""

    tree: list[Node]
    rows: list[str]
    loglik: float  # over all alignments that the last step looked at
    path_loglik: float  # of the alignment itself


def prepared(tree: list[Node], names: list[str]) -> tuple[list[int | None], list[int]]:
    """For each node the index of its sequence (None for an ancestor), and its closest leaf. The tree is binary and its leaves' names are those
    of the sequences, each once."""
    if len(set(names)) != len(names):
        raise ValueError("a sequence name occurs twice")
    at, kids = {n: i for i, n in enumerate(names)}, children(tree)
    own: list[int | None] = []
    closest: list[tuple[float, int]] = []
    for v, node in enumerate(tree):
        if not kids[v]:
            if node.name not in at:
                raise ValueError(f"no sequence is named after leaf {node.name!r}")
            own.append(at[node.name])
            closest.append((0.0, v))
        elif len(kids[v]) != 2:
            raise ValueError(f"node {v} has {len(kids[v])} children")
        else:
            own.append(None)
            closest.append(min(((closest[k][0] + tree[k].blen, closest[k][1]) for k in kids[v]), key=lambda x: x[0]))
    return own, [c for _, c in closest]


def most_states(memory: float, fraction: float = 0.05) -> int:
    """How many states a profile may have, so that a matrix of two such takes no more than its fraction of the memory (bytes)."""
    return int((memory * fraction / (5 * 8)) ** 0.5)


def lattice(x: pf.Profile, y: pf.Profile, m: Model, left: float, right: float, row: int, guide: dict[int, np.ndarray] | None, leaves: tuple[int, int], band: int | None) -> pf.Lattice:
    """The lattice of two profiles within a band around the guide. Where no path fits, the band gets wider, and goes in the end."""
    while True:
        limits = None if guide is None or band is None else pf.Band.of(guide, *leaves, band)
        out = pf.Lattice(x, y, m, left, right, row, limits)
        if out.total > pf.NO:
            return out
        if limits is None:
            raise ValueError("the two children have no common history under this model")
        band = None if 2 * band > len(next(iter(guide.values()))) else max(1, 2 * band)


def profiles(m: Model, tree: list[Node], seqs: list[str], names: list[str], o: Options, guide: list[np.ndarray] | None = None) -> tuple[list[pf.Profile], pf.Lattice | None]:
    """The profiles of all nodes but the root, and the lattice of the root's children (None for a tree of one leaf)."""
    own, closest = prepared(tree, names)
    kids, rng = children(tree), np.random.default_rng(o.seed)
    by_leaf = None if guide is None else {v: guide[i] for v, i in enumerate(own) if i is not None}
    done: list[pf.Profile] = []
    last = None
    for v in range(len(tree)):
        if own[v] is not None:
            done.append(pf.Profile.leaf(m, seqs[own[v]], v))
            continue
        a, b = kids[v]
        last = lattice(done[a], done[b], m, tree[a].blen, tree[b].blen, v, by_leaf, (closest[a], closest[b]), o.band)
        if v == len(tree) - 1:
            break
        if o.least_posterior is None:
            done.append(last.sampled_profile(rng, o.samples, o.most_states, o.best))
        else:
            done.append(last.likely_profile(o.least_posterior, o.most_states, o.best))
    return done, last


def rows_of(columns: pf.Columns, tree: list[Node], seqs: list[str], own: list[int | None], wildcard: str = "*") -> list[str]:
    """Gapped rows of all nodes."""
    out = []
    for v in range(len(tree)):
        letters = None if own[v] is None else iter(seqs[own[v]])
        out.append("".join("-" if v not in col else wildcard if letters is None else next(letters) for col in columns))
    return out


def reconstruct(m: Model, tree: list[Node], seqs: list[str], names: list[str], o: Options = Options(), guide: list[np.ndarray] | None = None) -> History:
    """The history with the best path at the root. Sequences may be empty."""
    own, _ = prepared(tree, names)
    done, last = profiles(m, tree, seqs, names, o, guide)
    if last is None:
        return History(tree, [seqs[own[0]]], done[0].path_sum(log_root(m)), done[0].path_sum(log_root(m)))
    best = last.best()
    return History(tree, rows_of(last.alignment(best), tree, seqs, own), last.total, last.profile(best).path_sum(last.insert))


def log_root(m: Model) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(np.stack([c.root * c.weight for c in m.components]))
