"""Sum-product over a tree for many alignment columns at once.

A tree is an array of parents in postorder (root last, parent -1) with branch lengths. Columns are a matrix (columns, nodes) of
token numbers, -1 for a gap and -2 for an unknown residue. A residue whose parent has a gap is a root of its own.
"""

from __future__ import annotations

import numpy as np

from .model import Counts, Eigen, Model

GAP, WILD = -1, -2


class Columns:
    """Upward and downward messages of a batch of columns under a model."""

    def __init__(self, m: Model, parent: np.ndarray, blen: np.ndarray, tokens: np.ndarray):
        self.m, self.parent, self.blen, self.tokens = m, np.asarray(parent), np.asarray(blen, float), np.asarray(tokens)
        self.c, self.n, (self.cols, self.nodes) = len(m.components), len(m.alphabet), self.tokens.shape
        self.kids = [np.flatnonzero(self.parent == v) for v in range(self.nodes)]
        self.p = np.stack([m.probs(max(t, 0.0)) for t in self.blen], 1)  # (components, nodes, n, n)
        self.is_root = (self.tokens != GAP) & np.stack([self.tokens[:, q] == GAP if q >= 0 else np.ones(self.cols, bool) for q in self.parent], 1)
        one = np.ones((self.c, self.cols, self.n))
        self.up, self.msg, self.scale = np.zeros((self.nodes, *one.shape)), np.ones((self.nodes, *one.shape)), np.zeros((self.nodes, self.c, self.cols))
        for v in range(self.nodes):
            t = self.tokens[:, v]
            x = np.where(t[:, None] >= 0, np.eye(self.n)[np.maximum(t, 0)], (t != GAP)[:, None].astype(float))[None] * one
            for k in self.kids[v]:
                x = x * self.msg[k]
                self.scale[v] += np.where(self.is_root[:, k], 0, self.scale[k])
            small = x.max(2)
            low = (small > 0) & (small < 1e-30)
            f = np.where(low, small, 1.0)
            self.up[v], self.scale[v] = x / f[:, :, None], self.scale[v] + np.log(f)
            passes = (t != GAP) & ~self.is_root[:, v]
            self.msg[v] = np.where(passes[None, :, None], np.einsum("cij,ckj->cki", self.p[:, v], self.up[v]), 1.0)
        root = np.stack([x.root for x in m.components])
        with np.errstate(divide="ignore"):
            self.of_root = np.stack([np.log(np.einsum("ci,cki->ck", root, self.up[v])) + self.scale[v] for v in range(self.nodes)])  # (nodes, c, cols)
        by_component = np.where(self.is_root.T[:, None], self.of_root, 0).sum(0)
        weighted = by_component + np.log([x.weight for x in m.components])[:, None]
        top = weighted.max(0)
        with np.errstate(invalid="ignore"):
            self.loglik = np.where(np.isfinite(top), top + np.log(np.exp(weighted - np.where(np.isfinite(top), top, 0)).sum(0)), -np.inf)
            self.component = np.exp(weighted - self.loglik)  # posterior of each component (c, cols)

    def fill_down(self) -> None:
        self.down = np.zeros_like(self.up)
        root = np.stack([x.root for x in self.m.components])[:, None]
        self.around = np.zeros_like(self.up)  # at a node's parent: all but the node's own part
        self.down_scale, self.own_root = np.zeros_like(self.scale), np.zeros_like(self.scale)  # the latter: likelihood of the connected part that a node is in
        for v in range(self.nodes - 1, -1, -1):
            q = self.parent[v]
            if q >= 0:
                t = self.tokens[:, q]
                x = np.where(t[:, None] >= 0, np.eye(self.n)[np.maximum(t, 0)], 1.0)[None] * self.down[q]
                for k in self.kids[q]:
                    if k != v:
                        x = x * self.msg[k]
                top = x.max(2, keepdims=True)
                top = np.where(top > 0, top, 1)
                self.around[v] = x / top
                beside = sum(np.where(self.is_root[:, k], 0, self.scale[k]) for k in self.kids[q] if k != v)
                fresh = self.is_root[:, v]
                self.down_scale[v] = np.where(fresh, 0, self.down_scale[q] + np.log(top[:, :, 0]) + beside)
                self.own_root[v] = np.where(fresh, self.of_root[v], self.own_root[q])
                self.down[v] = np.where(self.is_root[:, v][None, :, None], root, np.einsum("cki,cij->ckj", self.around[v], self.p[:, v]))
            else:
                self.down[v] = np.broadcast_to(root, self.up[v].shape)
                self.own_root[v] = self.of_root[v]

    def posterior(self) -> np.ndarray:
        """P(state of node) for each node with a residue, zero elsewhere (nodes, columns, n)."""
        x = self.up * self.down
        with np.errstate(invalid="ignore", divide="ignore"):
            x = x / x.sum(3, keepdims=True)
        return np.where((self.tokens.T != GAP)[:, :, None], (x * self.component[None, :, :, None]).sum(1), 0.0)

    def loglik_at(self, v: int) -> np.ndarray:
        """The log likelihood of each column by the states of one node, from both passes; where the node has a gap, that of the column."""
        with np.errstate(divide="ignore", invalid="ignore"):
            part = np.log((self.up[v] * self.down[v]).sum(2)) + self.scale[v] + self.down_scale[v]
            others = np.where(self.is_root.T[:, None], self.of_root, 0).sum(0) - self.own_root[v]
            weighted = part + others + np.log([x.weight for x in self.m.components])[:, None]
        top = weighted.max(0)
        return np.where(self.tokens[:, v] == GAP, self.loglik, top + np.log(np.exp(weighted - top).sum(0)))

    def excluded(self, v: int) -> np.ndarray:
        """What all but v's clade says about the state of v's parent (columns, n), adding up to one; zero where the parent has a gap."""
        x = (self.around[v] * self.component[:, :, None]).sum(0)
        total = x.sum(1, keepdims=True)
        return np.where((self.tokens[:, self.parent[v]] != GAP)[:, None] & (total > 0), x / np.where(total > 0, total, 1), 0.0)

    def branch_posterior(self, v: int) -> np.ndarray:
        """The joint posterior of the states of v's parent and v (columns, n, n); zero where either has a gap."""
        live = (self.tokens[:, v] != GAP) & ~self.is_root[:, v]
        x = self.around[v][:, :, :, None] * self.p[:, v][:, None] * self.up[v][:, :, None, :]
        x = x / np.maximum(x.sum((2, 3), keepdims=True), 1e-300)
        return np.where(live[:, None, None], (x * self.component[:, :, None, None]).sum(0), 0.0)

    def counts(self, weights: np.ndarray | None = None, eigen: bool = True) -> Counts:
        """Expected root, substitution and waiting counts of all columns, each counted weights times. With eigen, in the eigenbasis,
        transformed once at the end; else each pair of states and event by itself."""
        w = np.ones(self.cols) if weights is None else weights
        out = Counts.zero(self.c, self.n)
        out.loglik = float((w * self.loglik).sum())
        roots = np.stack([x.root for x in self.m.components])[:, None]
        basis = [Eigen.of(x.rate) for x in self.m.components] if not self.m.eigen else list(self.m.eigen)
        total = [np.zeros((self.n, self.n), complex) for _ in basis]
        for v in range(self.nodes):
            at_root = roots * self.up[v]
            at_root = at_root / np.maximum(at_root.sum(2, keepdims=True), 1e-300)
            out.root += np.einsum("k,ck,cki->ci", w * self.is_root[:, v], self.component, at_root)
            live = (self.tokens[:, v] != GAP) & ~self.is_root[:, v]
            if not live.any():
                continue
            for c, e in enumerate(basis):
                above, below = self.around[v, c][live], self.up[v, c][live]
                z = np.einsum("ki,ij,kj->k", above, self.p[c, v], below)
                share = w[live] * self.component[c, live] / np.maximum(z, 1e-300)
                j = e.occupancy(self.blen[v])
                if eigen:
                    a, b = above @ e.right, below @ e.left.T
                    total[c] = total[c] + j * np.einsum("k,kx,ky->xy", share, a, b)
                else:
                    rate = self.m.components[c].rate
                    pair = np.einsum("k,ka,kb->ab", share, above, below)
                    inner = np.einsum("ak,ki,kl,jl,lb->abij", e.right, e.left, j, e.right, e.left).real
                    got = np.einsum("ab,abij->ij", pair, inner)
                    out.sub[c] += np.where(np.eye(self.n, dtype=bool), got, got * rate)
        if eigen:
            for c, e in enumerate(basis):
                got = (e.left.T @ total[c] @ e.right.T).real
                out.sub[c] += np.where(np.eye(self.n, dtype=bool), got, got * self.m.components[c].rate)
        return out


def indel_counts(m: Model, parent: np.ndarray, blen: np.ndarray, present: np.ndarray, decay) -> tuple[np.ndarray, float]:
    """Counts of insertions, deletions, extensions and waiting times of an alignment of whole histories (columns, nodes), and the log
    likelihood of its branches. On each branch, deletions between two matches come after insertions."""
    out, loglik = np.zeros(6), 0.0
    for v, q in enumerate(parent):
        if q < 0:
            continue
        a, b, t = present[:, q], present[:, v], blen[v]
        kinds = np.where(a & b, "M", np.where(b, "I", "D"))[a | b]
        group = np.cumsum(kinds == "M")
        kinds = kinds[np.lexsort((kinds == "D", kinds != "M", group))]
        moves, now = m.transitions(t), "M"
        for x in [*kinds.tolist(), "E"]:
            p = moves[now, x]
            loglik += np.log(p) if p > 0 else -np.inf
            if x == now == "M":
                out[4:] += t
            elif x == "I":
                out[2 if now == "I" else 0] += 1
                out[4] += 0 if now == "I" else decay(m.insrate, t)
            elif x == "D":
                out[3 if now == "D" else 1] += 1
                out[5] += 0 if now == "D" else decay(m.delrate, t)
            now = x
    return out, float(loglik)
