"""Histories as states of a Markov chain: their likelihood, moves on alignment and tree, and hill climbing over branches.

A history has a tree (postorder, root last), and a presence matrix of columns by nodes; ancestors have residues of unknown kind. Moves draw an
alignment of one branch, or of a node with its children and its parent, from its distribution given everything else; of a node
by a lattice of its two children's clades. Heights and scales are drawn at random. Metropolis and Hastings' rule accepts them.
Histories in which a residue is lost on both branches below its node are out of reach of the lattice: a move from one is refused.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np

from . import profile as pf, sumprod
from .model import Model, decay_wait
from .trees import Node, children

BAND = 20


@dataclass(frozen=True)
class History:
    tree: tuple[Node, ...]
    tokens: np.ndarray  # (columns, nodes): -1 gap, -2 unknown, else a token

    @property
    def parent(self) -> np.ndarray:
        return np.array([n.parent for n in self.tree])

    @property
    def blen(self) -> np.ndarray:
        return np.array([max(n.blen, 0.0) for n in self.tree])

    @classmethod
    def of(cls, m: Model, tree: list[Node], rows: list[str]) -> History:
        code = {s: i for i, s in enumerate(m.alphabet)}
        code = {s.swapcase(): i for s, i in code.items()} | code
        return cls(tuple(tree), np.array([[sumprod.GAP if x in "-." else code.get(x, sumprod.WILD) for x in r] for r in rows]).T.reshape(-1, len(tree)))

    def rows(self, m: Model) -> list[str]:
        return ["".join("-" if t == sumprod.GAP else "*" if t < 0 else m.alphabet[t] for t in col) for col in self.tokens.T]

    def below(self, v: int) -> list[int]:
        """v and its descendants."""
        out = {v}
        for i in range(v - 1, -1, -1):
            if self.tree[i].parent in out:
                out.add(i)
        return sorted(out)


def coalescent(tree: tuple[Node, ...], population: float) -> float:
    """The log prior of node heights: -C(k, 2) / population over time with k lineages."""
    depth = np.zeros(len(tree))
    for v in range(len(tree) - 2, -1, -1):
        depth[v] = depth[tree[v].parent] + tree[v].blen
    kids = children(list(tree))
    events = sorted((round(float(depth.max() - d), 9), 1 if not kids[v] else 1 - len(kids[v])) for v, d in enumerate(depth))
    out, lines = 0.0, 0
    for (h, step), (later, _) in zip(events, events[1:], strict=False):
        lines += step
        out -= lines * (lines - 1) / 2 / population * (later - h)
    return out


def parts_of_loglik(m: Model, h: History, population: float | None = None) -> dict[str, float]:
    """The log likelihood of a history: the root's length (geometric), indels of branches, substitutions of columns, and the prior of the tree."""
    n = int((h.tokens[:, -1] != sumprod.GAP).sum())
    x = m.insext
    root = (n * math.log(x) if n else 0.0) + math.log(1 - x) if 0 < x < 1 else 0.0
    _, indel = sumprod.indel_counts(m, h.parent, h.blen, h.tokens != sumprod.GAP, decay_wait)
    some = h.tokens[(h.tokens != sumprod.GAP).any(1)]
    sub = float(sumprod.Columns(m, h.parent, h.blen, some).loglik.sum()) if len(some) else 0.0
    return {"root": root, "indel": indel, "substitution": sub, "prior": 0.0 if population is None else coalescent(h.tree, population)}


def loglik(m: Model, h: History, population: float | None = None) -> float:
    return sum(parts_of_loglik(m, h, population).values())


def _sub(h: History, nodes: list[int]) -> np.ndarray:
    """Numbers of the columns in which any of the nodes has a residue."""
    return np.flatnonzero((h.tokens[:, nodes] != sumprod.GAP).any(1))


def messages(m: Model, h: History, v: int) -> tuple[np.ndarray, np.ndarray]:
    """For each column with a residue of v, what its clade says about v's state; and for each with one of v's parent, what all else says about the
    parent's: likelihoods (columns, components, symbols), scaled by column."""
    inside = h.below(v)
    outside = [u for u in range(len(h.tree)) if u not in set(inside)]
    p = h.tree[v].parent

    def towards(node: int, nodes: list[int], rows: np.ndarray) -> np.ndarray:
        """Messages into node from a connected set of nodes that has it, over the columns where it has a residue."""
        t = h.tokens[rows]
        near: dict[int, list[tuple[int, int]]] = {u: [] for u in nodes}  # neighbour, and the child end of the branch
        for u in nodes:
            q = h.tree[u].parent
            if q in near:
                near[u].append((q, u))
                near[q].append((u, u))
        probs = {u: m.probs(max(h.tree[u].blen, 0.0)) for u in nodes}
        roots = np.stack([c.root for c in m.components])

        def into(u: int, came: int | None) -> np.ndarray:
            x = np.where(t[:, u, None] >= 0, np.eye(len(m.alphabet))[np.maximum(t[:, u], 0)], 1.0)[:, None] * np.ones((1, len(m.components), 1))
            top = h.tree[u].parent not in near
            if top and u != v:  # the root, or where the residue was inserted
                x = x * roots[None]
            for w, child in near[u]:
                if w == came:
                    continue
                there = t[:, w] != sumprod.GAP
                if child == w:
                    got = np.einsum("cij,kcj->kci", probs[w], into(w, u))
                    x = np.where(there[:, None, None], x * got, x)
                else:
                    got = np.einsum("cij,kci->kcj", probs[u], into(w, u))
                    x = np.where(there[:, None, None], x * got, x * roots[None])
            peak = x.max((1, 2), keepdims=True)
            return x / np.where(peak > 0, peak, 1.0)

        return into(node, None)

    own = np.flatnonzero(h.tokens[:, v] != sumprod.GAP)
    up = towards(v, inside, own)
    if p < 0:
        return up, np.zeros((0, *up.shape[1:]))
    above = np.flatnonzero(h.tokens[:, p] != sumprod.GAP)
    return up, towards(p, outside, above)


class Branch:
    """The alignments of a parent's and a child's sequence, each residue known by its messages: forward probabilities of match, insert, delete."""

    def __init__(self, m: Model, t: float, above: np.ndarray, below: np.ndarray, inside: Callable[[int, int], bool] | None = None):
        weights = np.array([c.weight for c in m.components])
        roots = np.stack([c.root for c in m.components])
        with np.errstate(divide="ignore"):
            self.match = np.log(np.einsum("c,aci,cij,bcj->ab", weights, above, m.probs(t), below))
            self.delete = np.log(np.einsum("c,aci->a", weights, above))
            self.insert = np.log(np.einsum("c,ci,bci->b", weights, roots, below))
            self.move = {k: (math.log(x) if x > 0 else -math.inf) for k, x in m.transitions(t).items()}
        self.n, self.k = len(above), len(below)
        f = self.f = {(0, 0): {"M": 0.0, "I": -math.inf, "D": -math.inf}}
        for i in range(self.n + 1):
            for j in range(self.k + 1):
                if (i, j) != (0, 0) and (inside is None or inside(i, j)):
                    f[i, j] = {s: pf.lse(w for _, w in self.into(i, j, s)) for s in "MID"}
        self.total = pf.lse(f[self.n, self.k][s] + self.move[s, "E"] for s in "MID") if (self.n, self.k) in f else -math.inf

    def into(self, i: int, j: int, s: str) -> list[tuple[tuple[int, int, str], float]]:
        a, b = (i - (s != "I")), (j - (s != "D"))
        if a < 0 or b < 0 or (a, b) not in self.f:
            return []
        own = self.match[a, b] if s == "M" else self.insert[b] if s == "I" else self.delete[a]
        return [((a, b, q), self.f[a, b][q] + self.move[q, s] + own) for q in "MID"]

    def path(self, choose: Callable[[list[tuple]], tuple]) -> str:
        """Moves from the beginning to the end."""
        options = [((self.n, self.k, s), self.f[self.n, self.k][s] + self.move[s, "E"]) for s in "MID"]
        out = []
        while True:
            i, j, s = choose([o for o in options if o[1] > -math.inf])
            if (i, j) == (0, 0):
                return "".join(reversed(out))
            out.append(s)
            options = self.into(i, j, s)

    def sample(self, rng: np.random.Generator) -> str:
        return self.path(lambda o: _draw(rng, o))

    def best(self) -> str:
        return self.path(lambda o: max(o, key=lambda x: x[1])[0])

    def log_prob(self, moves: str) -> float:
        """The log probability of a path given that there is one."""
        i = j = 0
        was, out = "M", 0.0
        for s in moves:
            own = self.match[i, j] if s == "M" else self.insert[j] if s == "I" else self.delete[i]
            out, i, j, was = out + self.move[was, s] + own, i + (s != "I"), j + (s != "D"), s
            if (i, j) not in self.f:
                return -math.inf
        return float(out + self.move[was, "E"] - self.total)


def _draw(rng: np.random.Generator, options: list[tuple]) -> tuple:
    p = np.exp(np.array([w for _, w in options]) - max(w for _, w in options))
    return options[int(rng.choice(len(options), p=p / p.sum()))][0]


def moves_between(h: History, v: int) -> str:
    """The path of a node and its parent, deletions between two matches after insertions."""
    a, b = (h.tokens[:, u] != sumprod.GAP for u in (h.tree[v].parent, v))
    kinds = np.where(a & b, "M", np.where(b, "I", "D"))[a | b]
    return "".join(kinds[np.lexsort((kinds == "D", kinds != "M", np.cumsum(kinds == "M")))])


def _band(h: History, v: int, width: int | None) -> Callable[[int, int], bool] | None:
    """Which places of parent and child lie within width matches of the alignment of the two."""
    if width is None:
        return None
    a, b = (h.tokens[:, u] != sumprod.GAP for u in (h.tree[v].parent, v))
    matches = np.append(0, np.cumsum(a & b))
    at_a, at_b = (matches[np.append(0, np.flatnonzero(x) + 1)] for x in (a, b))
    return lambda i, j: abs(at_a[i] - at_b[j]) <= width


def branch(m: Model, h: History, v: int, width: int | None = None, around: History | None = None) -> Branch:
    up, above = messages(m, h, v)
    return Branch(m, h.tree[v].blen, above, up, _band(around or h, v, width))


def joined(h: History, v: int, moves: str) -> History:
    """The history with the clade of v aligned to the rest by these moves of v and its parent."""
    inside = h.below(v)
    outside = [u for u in range(len(h.tree)) if u not in set(inside)]
    p = h.tree[v].parent

    def parts(nodes: list[int], key: int) -> list[np.ndarray]:
        """Rows of the columns of nodes, cut before each residue of key."""
        t = np.full((len(cols := _sub(h, nodes)), len(h.tree)), sumprod.GAP)
        t[:, nodes] = h.tokens[np.ix_(cols, nodes)]
        return np.split(t, np.flatnonzero(t[:, key] != sumprod.GAP))

    one, two = parts(outside, p), parts(inside, v)
    out, i, j = [one[0], two[0]], 0, 0
    for s in moves:
        a = one[i + 1] if s != "I" else None
        b = two[j + 1] if s != "D" else None
        i, j = i + (s != "I"), j + (s != "D")
        if s == "M":
            both = a[:1].copy()
            both[:, inside] = b[:1, inside]
            out += [both, a[1:], b[1:]]
        else:
            out.append(a if b is None else b)
    return replace(h, tokens=np.concatenate(out))


def realign_branch(m: Model, h: History, v: int, rng: np.random.Generator, width: int | None = BAND) -> tuple[History, float]:
    """A draw of the alignment of a branch, and the log ratio of the probabilities of drawing the old and the new one."""
    there = branch(m, h, v, width)
    moves = there.sample(rng)
    new = joined(h, v, moves)
    back = there if width is None else branch(m, new, v, width)
    return new, back.log_prob(moves_between(h, v)) - there.log_prob(moves)


def _chain(m: Model, up: np.ndarray, row: int) -> pf.Profile:
    """A profile of one sequence whose residues are known by their messages."""
    with np.errstate(divide="ignore"):
        logs = np.log(up)
    n = len(up)
    own = (frozenset((row,)),)
    out = pf.Profile(row, [None, *logs, None], [(), *[own] * n, ()], [{row: i} for i in range(n + 1)] + [{row: n}], [pf.Edge(i, i + 1, 0.0) for i in range(n + 1)])
    out.ready = [True] * len(out)  # its only null move is into the end, which both profiles make together: so gaps may lie behind its last residue
    return out


def _pair_lattice(m: Model, h: History, v: int) -> pf.Lattice:
    a, b = children(list(h.tree))[v]
    return pf.Lattice(_chain(m, messages(m, h, a)[0], a), _chain(m, messages(m, h, b)[0], b), m, h.tree[a].blen, h.tree[b].blen, v)


def _path_weight(cells: pf.Lattice, path: list[pf.Cell]) -> float:
    out = 0.0
    for before, cell in zip(path, path[1:], strict=False):
        out += next(w for c, w, _ in cells.into(cell) if c == before) + cells.own(cell)
    return out


def _old_path(cells: pf.Lattice, h: History, v: int) -> list[pf.Cell] | None:
    """The lattice's path of the alignment that the history has around v; None where it has none."""
    a, b = cells.x.row, cells.y.row
    cols = [tuple(bool(x) for x in c) for c in (h.tokens[:, [a, b, v]] != sumprod.GAP)]
    steps = [c for c in cols if any(c)]
    if (False, False, True) in steps:
        return None
    kind = {(True, True, True): pf.IMM, (True, False, True): pf.IMD, (False, True, True): pf.IDM, (False, True, False): pf.IMI, (True, False, False): pf.IIW}
    if (True, True, False) in steps:
        return None
    path, i, j, n, k = [cells.start], 0, 0, len(cells.x) - 1, len(cells.y) - 1
    # y's insertions come before x's between residues of the parent
    ordered: list[tuple] = []
    run: list[tuple] = []
    for c in [*steps, None]:
        if c is None or c[2]:
            ordered += sorted(run, key=lambda x: x[0])
            run = []
            if c is not None:
                ordered.append(c)
        else:
            run.append(c)
    for c in ordered:
        i, j = i + c[0], j + c[1]
        path.append((i, j, kind[c]))
    if (i, j) != (n - 1, k - 1):
        return None
    path.append(cells.end)
    for before, cell in zip(path, path[1:], strict=False):
        if all(src != before for src, w, _ in cells.into(cell) if w > -math.inf):
            return None
    return path


def realign_node(m: Model, h: History, v: int, rng: np.random.Generator) -> tuple[History, float] | None:
    """A draw of an inner node's residues, of the alignment of its children's clades, and of that with its parent; and the log ratio as for a branch.
    None if the old history is out of reach."""
    was, drawn = _node_log_prob(m, h, v), _draw_node(m, h, v, rng)
    return None if was is None or drawn is None else (drawn[0], was - drawn[1])


def move_height(h: History, v: int, rng: np.random.Generator) -> tuple[History, float]:
    """A new height of an inner node: anywhere between its parent and its higher child; of the root, half to twice its height above that child."""
    kids = children(list(h.tree))[v]
    least = min(h.tree[k].blen for k in kids)
    if v == len(h.tree) - 1:
        f = math.exp(rng.uniform(-math.log(2), math.log(2)))
        shift, ratio = least * (f - 1), math.log(f)
    else:
        shift, ratio = rng.uniform(-least, h.tree[v].blen), 0.0
    tree = list(h.tree)
    for k in kids:
        tree[k] = replace(tree[k], blen=max(tree[k].blen + shift, 1e-9))
    if v != len(h.tree) - 1:
        tree[v] = replace(tree[v], blen=max(tree[v].blen - shift, 1e-9))
    return replace(h, tree=tuple(tree)), ratio


def rescale(h: History, rng: np.random.Generator) -> tuple[History, float]:
    """All branches by one factor, half to twice."""
    f = math.exp(rng.uniform(-math.log(2), math.log(2)))
    tree = tuple(replace(n, blen=n.blen * f if n.parent >= 0 else n.blen) for n in h.tree)
    return replace(h, tree=tree), math.log(f) * sum(n.parent >= 0 for n in h.tree)


def regraft(m: Model, h: History, v: int, rng: np.random.Generator) -> tuple[History, float] | None:
    """Moves a clade, with its parent at the height that it has, to another branch that passes there; nearer ones (in branches) are likelier, by a
    factor of 1.5 each. The parent's residues and alignments are drawn anew. None where there is no such branch, or the old history is out of reach."""
    tree, p = list(h.tree), h.tree[v].parent
    if p < 0 or h.tree[p].parent < 0:
        return None
    sibling = next(k for k in children(tree)[p] if k != v)
    depth = np.zeros(len(tree))
    for u in range(len(tree) - 2, -1, -1):
        depth[u] = depth[tree[u].parent] + tree[u].blen
    gone = set(h.below(v)) | {p}

    def near(nodes: list[Node], start: int) -> list[int]:
        """Branches (by lower end) that pass the parent's height, the nearest to start first."""
        links: dict[int, list[int]] = {}
        for u, n in enumerate(nodes):
            if n.parent >= 0 and u not in gone:
                q = n.parent if n.parent != p else nodes[p].parent
                links.setdefault(u, []).append(q)
                links.setdefault(q, []).append(u)
        seen, queue = {start: 0}, [start]
        for u in queue:
            for w in sorted(links.get(u, [])):
                if w not in seen:
                    seen[w] = seen[u] + 1
                    queue.append(w)
        up = lambda u: nodes[u].parent if nodes[u].parent != p else nodes[p].parent
        return sorted((u for u in seen if u not in gone and nodes[u].parent >= 0 and depth[up(u)] < depth[p] < depth[u]), key=lambda u: (seen[u], u))

    ranks = near(tree, sibling)
    others = [u for u in ranks if u != sibling]
    if not others:
        return None
    weigh = lambda n: np.array([1.5**-i for i in range(n)])
    w = weigh(len(others))
    pick = int(rng.choice(len(others), p=w / w.sum()))
    target = others[pick]
    back = [u for u in near(tree, target) if u != target]
    ratio = math.log(weigh(len(back))[back.index(sibling)] / weigh(len(back)).sum()) - math.log(w[pick] / w.sum())
    parent = [n.parent for n in tree]
    blen = [n.blen for n in tree]
    grand = parent[p]
    parent[sibling], blen[sibling] = grand, blen[sibling] + blen[p]
    above = parent[target]
    parent[p], blen[p] = above, float(depth[p] - depth[above])
    parent[target], blen[target] = p, float(depth[target] - depth[p])
    # postorder again: the old number of each new node
    kids: dict[int, list[int]] = {}
    for u, q in enumerate(parent):
        kids.setdefault(q, []).append(u)
    order, stack = [], [(len(tree) - 1, False)]
    while stack:
        u, done = stack.pop()
        if done:
            order.append(u)
        else:
            stack += [(u, True), *((k, False) for k in reversed(kids.get(u, [])))]
    number = {u: i for i, u in enumerate(order)}
    moved = History(tuple(Node(number[parent[u]] if parent[u] >= 0 else -1, tree[u].name, blen[u]) for u in order), h.tokens[:, order])
    was = _node_log_prob(m, h, p)
    if was is None:
        return None
    drawn = _draw_node(m, moved, number[p], rng)
    return None if drawn is None else (drawn[0], ratio + was - drawn[1])


def _node_log_prob(m: Model, h: History, v: int) -> float | None:
    """The log probability of drawing the alignments around v that the history has."""
    cells = _pair_lattice(m, h, v)
    path = _old_path(cells, h, v)
    if path is None:
        return None
    out = _path_weight(cells, path) - cells.total
    return out if v == len(h.tree) - 1 else out + branch(m, h, v).log_prob(moves_between(h, v))


def _draw_node(m: Model, h: History, v: int, rng: np.random.Generator) -> tuple[History, float] | None:
    """A draw of the alignments around v, which don't need to be valid before, and its log probability."""
    blank = h.tokens.copy()
    blank[:, v] = sumprod.GAP
    empty = replace(h, tokens=blank[(blank != sumprod.GAP).any(1)])
    got = _realigned(m, empty, v, rng)
    prob = _node_log_prob(m, got, v)
    return None if prob is None else (got, prob)


def _realigned(m: Model, h: History, v: int, rng: np.random.Generator) -> History:
    """Both children of v aligned anew, with v's residues, and v with its parent."""
    cells = _pair_lattice(m, h, v)
    path = cells.sample(rng)
    columns: list[np.ndarray] = []
    a, b = cells.x.row, cells.y.row

    def pieces(u: int) -> list[np.ndarray]:
        nodes = h.below(u)
        rows = _sub(h, nodes)
        t = np.full((len(rows), len(h.tree)), sumprod.GAP)
        t[:, nodes] = h.tokens[np.ix_(rows, nodes)]
        return np.split(t, np.flatnonzero(t[:, u] != sumprod.GAP))

    one, two, i, j = pieces(a), pieces(b), 0, 0
    columns += [one[0], two[0]]
    for _, _, s in path[1:-1]:
        first, second = s in (pf.IMM, pf.IMD, pf.IIW), s in (pf.IMM, pf.IDM, pf.IMI)
        i, j = i + first, j + second
        lead = (one[i] if first else two[j])[:1].copy()
        if first and second:
            lead[:, h.below(b)] = two[j][:1, h.below(b)]
        if s in (pf.IMM, pf.IMD, pf.IDM):
            lead[:, v] = sumprod.WILD
        columns += [lead, *([one[i][1:]] if first else []), *([two[j][1:]] if second else [])]
    clade = np.concatenate(columns)
    if v == len(h.tree) - 1:
        return replace(h, tokens=clade)
    outside = [u for u in range(len(h.tree)) if u not in set(h.below(v))]
    rows = _sub(h, outside)
    rest = np.full((len(rows), len(h.tree)), sumprod.GAP)
    rest[:, outside] = h.tokens[np.ix_(rows, outside)]
    apart = replace(h, tokens=np.concatenate([clade, rest]))
    return joined(apart, v, branch(m, apart, v).sample(rng))


@dataclass
class Chain:
    """A Markov chain's state, the best history met (proposed ones too), and counts of moves tried and accepted."""

    now: History
    value: float
    best: History
    best_value: float
    tried: dict[str, int]
    taken: dict[str, int]


MIX = {"branch": 1.0, "node": 1.0, "regraft": 1.0, "height": 2.0, "rescale": 2.0}


def run(m: Model, start: History, steps: int, seed: int, *, population: float | None = None, width: int | None = BAND, fix_tree: bool = False, fix_alignment: bool = False, log: Callable[[int, Chain], None] | None = None) -> Chain:
    """A chain of Metropolis-Hastings steps. Moves are drawn by MIX, without those of what is fixed."""
    rng = np.random.default_rng(seed)
    value = loglik(m, start, population)
    chain = Chain(start, value, start, value, dict.fromkeys(MIX, 0), dict.fromkeys(MIX, 0))
    allowed = {k: w for k, w in MIX.items() if not (fix_tree and k in ("regraft", "height", "rescale") or fix_alignment and k in ("branch", "node", "regraft"))}
    kids = children(list(start.tree))
    if not allowed or len(start.tree) < 3:
        return chain
    for step in range(steps):
        h = chain.now
        name = list(allowed)[int(rng.choice(len(allowed), p=np.array(list(allowed.values())) / sum(allowed.values())))]
        kids = children(list(h.tree))
        inner = [v for v in range(len(h.tree)) if len(kids[v]) == 2]
        chain.tried[name] += 1
        if name == "branch":
            got = realign_branch(m, h, int(rng.integers(len(h.tree) - 1)), rng, width)
        elif name == "node":
            got = realign_node(m, h, inner[int(rng.integers(len(inner)))], rng)
        elif name == "regraft":
            got = regraft(m, h, int(rng.integers(len(h.tree) - 1)), rng)
        elif name == "height":
            got = move_height(h, inner[int(rng.integers(len(inner)))], rng)
        else:
            got = rescale(h, rng)
        if got is not None:
            new, ratio = got
            value = loglik(m, new, population)
            if value > chain.best_value:
                chain.best, chain.best_value = new, value
            if math.isfinite(value) and math.log(max(rng.random(), 1e-300)) < value - chain.value + ratio:
                chain.now, chain.value = new, value
                chain.taken[name] += 1
        if log:
            log(step, chain)
    return chain


def refine(m: Model, h: History, width: int | None = BAND) -> tuple[History, float]:
    """Hill climbing: the best alignment of one branch after the other, kept if the history gets likelier, until as many in a row as there are branches
    gained nothing."""
    value, stalled, v = loglik(m, h), 0, 0
    branches = len(h.tree) - 1
    while stalled < branches:
        new = joined(h, v, branch(m, h, v, width).best())
        got = loglik(m, new)
        h, value, stalled = (new, got, 0) if got > value + 1e-9 else (h, value, stalled + 1)
        v = (v + 1) % branches
    return h, value
