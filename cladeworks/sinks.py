"""Writers of reconstructions as text: Stockholm, Nexus, FASTA, JSON; finite-time models, profiles, graphs and traces."""

from __future__ import annotations

import json
import math

from .kernels import profile as pf, trees
from .kernels.model import Model
from .kernels.trees import Node, children
from .sources import formats


def stockholm(rows: dict[str, str], *, notes: dict[str, str] | None = None, of_rows: dict[str, dict[str, str]] | None = None, of_columns: dict[str, str] | None = None, width: int | None = 80) -> str:
    """An alignment with annotation of the file, of residues by tag and row, and of columns by tag, names padded to one width, wrapped into blocks of
    width columns (None: one block)."""
    of_rows, of_columns = of_rows or {}, of_columns or {}
    labels = [*rows, *(f"#=GR {n} {tag}" for tag, by in of_rows.items() for n in by), *(f"#=GC {tag}" for tag in of_columns)]
    pad = max(map(len, labels), default=0) + 1
    out = ["# STOCKHOLM 1.0", *(f"#=GF {k} {v}" for k, v in (notes or {}).items())]
    n = max(map(len, rows.values()), default=0)
    step = width or max(n, 1)
    for at in range(0, max(n, 1), step):
        for name, row in rows.items():
            out.append(f"{name:{pad}}{row[at : at + step]}")
            out += [f"{f'#=GR {name} {tag}':{pad}}{by[name][at : at + step]}" for tag, by in of_rows.items() if name in by]
        out += [f"{f'#=GC {tag}':{pad}}{text[at : at + step]}" for tag, text in of_columns.items()]
        out.append("")
    return "\n".join([*out[:-1], "//", ""])


def fasta(rows: dict[str, str], width: int = 50) -> str:
    return "".join(f">{n}\n" + "".join(r[i : i + width] + "\n" for i in range(0, len(r), width)) for n, r in rows.items())


def fastq(rows: dict[str, tuple[str, str]]) -> str:
    """Sequences with qualities."""
    return "".join(f"@{n}\n{s}\n+\n{q}\n" for n, (s, q) in rows.items())


def quality_symbols(scores: list[int]) -> str:
    return "".join(chr(33 + min(93, max(0, x))) for x in scores)


def recon_json(tree: list[Node], rows: dict[str, str], posteriors: dict[str, list[list[tuple[str, float]]]] | None = None) -> str:
    """Root, branches (parent, child, length), and rows by node; rows of nodes with posteriors are lists of (symbol, probability) by column."""
    names = [n.name for n in tree]
    branches = [[names[n.parent], n.name, n.blen] for n in tree if n.parent >= 0]
    return json.dumps({"root": names[-1], "branches": branches, "rowData": {n: (posteriors or {}).get(n, r) for n, r in rows.items()}})


def written(kind: str, tree: list[Node], gapped: list[str], *, leaves_only: bool = False, wildcard: str = "*", notes: dict[str, str] | None = None, posteriors: dict | None = None) -> str:
    """A reconstruction in a format. Inner nodes without a name get one; unknown residues are written as the model's wildcard."""
    tree = trees.name_inner(tree)
    kids = children(tree)
    rows = {n.name: r.replace("*", wildcard) for i, (n, r) in enumerate(zip(tree, gapped, strict=True)) if not (leaves_only and kids[i])}
    newick = trees.format_newick(tree)
    if kind == "fasta":
        return fasta(rows)
    if kind == "nexus":
        return formats.nexus(list(rows.items()), newick)
    if kind == "json":
        return recon_json(tree, rows, posteriors)
    return stockholm(rows, notes={"NH": newick} | (notes or {}))


def profile_json(p: pf.Profile, alphabet: str) -> str:
    """States with their emissions (as logs; components, then symbols), alignment columns and outgoing edges."""
    number = lambda x: x if math.isfinite(x) else None
    states = [
        {"n": i, "emit": None if e is None else [{a: number(float(v)) for a, v in zip(alphabet, row, strict=True)} for row in e], "columns": [sorted(c) for c in cols], "seqPos": {str(k): v for k, v in at.items()}, "ready": ready}
        for i, (e, cols, at, ready) in enumerate(zip(p.emit, p.columns, p.coords, p.ready, strict=True))
    ]
    return json.dumps({"row": p.row, "state": states, "trans": [{"from": e.src, "to": e.dst, "lpTrans": number(e.weight), "columns": [sorted(c) for c in e.columns]} for e in p.edges]})


def trace_line(step: int, tree: list[Node], rows: list[str], loglik: float) -> str:
    """A sampled history as one alignment of a Stockholm stream."""
    named = trees.name_inner(tree)
    return stockholm({n.name: r for n, r in zip(named, rows, strict=True)}, notes={"ID": str(step), "NH": trees.format_newick(named), "LP": f"{loglik:.6f}"}, width=None)


def sequence_graph(p: pf.Profile, m: Model, least: float = 0.01) -> tuple[dict[int, str], set[tuple[int, int]]]:
    """The graph of sequences that a profile stands for: labels of nodes, and edges. A state's symbols are those with at least this posterior by the
    root distribution. Null states are bridged, nodes with the same label, predecessors and successors are one, symbols of nodes that differ in the
    label alone are put into one class, and chains are one node each."""
    import numpy as np

    root = np.stack([c.root * c.weight for c in m.components])
    label: dict[int, str] = {0: "", len(p) - 1: ""}
    for s, e in enumerate(p.emit):
        if e is not None:
            post = (np.exp(e - e.max()) * root).sum(0)
            post = post / post.sum()
            label[s] = "".join(a for a, x in zip(m.alphabet, post, strict=True) if x >= least)
    after: dict[int, set[int]] = {s: set() for s in range(len(p))}
    for s in range(len(p) - 1, -1, -1):  # edges of null states are those of what follows them
        for e in p.edges:
            if e.src == s:
                after[s] |= {e.dst} if e.dst in label else after[e.dst]
    edges = {(s, d) for s in label for d in after[s]}

    def around() -> tuple[dict[int, frozenset[int]], dict[int, frozenset[int]]]:
        before, behind = {s: set() for s in label}, {s: set() for s in label}
        for a, b in edges:
            behind[a].add(b)
            before[b].add(a)
        return {s: frozenset(x) for s, x in before.items()}, {s: frozenset(x) for s, x in behind.items()}

    changed = True
    while changed:
        changed = False
        before, behind = around()
        groups: dict[tuple, list[int]] = {}
        for s in sorted(label):
            if label[s]:
                groups.setdefault((before[s], behind[s]), []).append(s)
        for same in groups.values():
            if len(same) > 1:
                label[same[0]] = "".join(sorted({ch for s in same for ch in label[s]}))
                drop = set(same[1:])
                label = {s: x for s, x in label.items() if s not in drop}
                edges = {(a, b) for a, b in edges if a not in drop and b not in drop}
                changed = True
                break
    text = {s: x if len(x) < 2 else f"[{x}]" for s, x in label.items()}
    before, behind = around()
    for s in sorted(text):
        while s in text and text[s] and len(behind[s]) == 1:
            (d,) = behind[s]
            if not text[d] or len(before[d]) != 1:
                break
            text[s] += text.pop(d)
            edges = {(s if a == d else a, b) for a, b in edges if b != d}
            behind[s] = behind.pop(d)
            before = {k: frozenset(s if x == d else x for x in v) for k, v in before.items()}
    return text, edges


def dot(text: dict[int, str], edges: set[tuple[int, int]]) -> str:
    """A sequence graph for Graphviz; start and end have no symbols."""
    ends = {s: name for s, name in ((min(text), "START"), (max(text), "END"))}
    nodes = [f'  {s} [label="{ends.get(s, x) if not x else x}"];' for s, x in sorted(text.items())]
    return "\n".join(["digraph sequences {", *nodes, *(f"  {a} -> {b};" for a, b in sorted(edges)), "}", ""])
