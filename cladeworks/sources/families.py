"""Whole families from files, for the command line and for loading many files into data sets: sequences, guides, trees, reconstructions."""

from __future__ import annotations

import gzip
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from ..kernels import trees
from . import formats


@dataclass(frozen=True)
class Family:
    """One family: ungapped sequences by name; gapped rows of a guide or of a finished reconstruction; a tree."""

    name: str
    seqs: dict[str, str] = field(default_factory=dict)
    gapped: dict[str, str] = field(default_factory=dict)
    tree: list[trees.Node] | None = None

    @property
    def reconstructed(self) -> bool:
        """Whether every node of the tree has a name and a row."""
        return self.tree is not None and bool(self.gapped) and all(n.name in self.gapped for n in self.tree)


def text_of(path: str) -> str:
    """A file's text, inflated if it's gzip."""
    with open(path, "rb") as f:
        data = f.read()
    return (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode()


def kind_of(text: str) -> str:
    """stockholm, nexus, newick, json, fastq, gapped_fasta or fasta, from the first line that isn't blank (and gaps in the rows)."""
    line = next((x.strip() for x in text.splitlines() if x.strip()), "")
    for pattern, kind in ((r"#\s*STOCKHOLM", "stockholm"), (r"(?i)#NEXUS", "nexus"), (r"\(", "newick"), (r"\{", "json"), ("@", "fastq")):
        if re.match(pattern, line):
            return kind
    if line.startswith(">"):
        return "gapped_fasta" if any(re.search(r"[-.]", x) for x in text.splitlines() if not x.startswith(">")) else "fasta"
    raise ValueError(f"unknown format: {line[:40]!r}")


def parse_fasta(text: str) -> dict[str, str]:
    """Rows by name, which is the first word behind '>' (or '@' in FASTQ, whose qualities are dropped)."""
    out: dict[str, str] = {}
    if text.lstrip().startswith("@"):
        lines = text.split("\n")
        for i in range(0, len(lines) - 3, 4):
            out[lines[i][1:].split()[0]] = lines[i + 1].strip()
        return out
    for record in re.split(r"(?m)^>", text)[1:]:
        head, _, body = record.partition("\n")
        name = (head.split() or [""])[0]
        if name in out:
            raise ValueError(f"the name {name!r} occurs twice")
        out[name] = re.sub(r"[^\x21-\x7E]", "", body)
    return out


def parse_stockholm(text: str) -> list[tuple[dict[str, str], dict[str, str], str | None]]:
    """Gapped rows, annotation of the file (GF), and the tree (GF NH), of each alignment."""
    out = []
    for block in re.split(r"(?m)^//\s*$", text):
        rows: dict[str, str] = {}
        notes: dict[str, str] = {}
        for line in block.splitlines():
            if m := re.match(r"#=GF\s+(\S+)\s+(.*)", line):
                notes[m[1]] = notes.get(m[1], "") + m[2]
            elif not line.startswith("#") and (m := re.match(r"(\S+)\s+(\S+)\s*$", line)):
                rows[m[1]] = rows.get(m[1], "") + m[2]
        if rows:
            out.append((rows, notes, notes.get("NH")))
    return out


def ungapped(rows: dict[str, str]) -> dict[str, str]:
    return {k: re.sub(r"[-.]", "", v) for k, v in rows.items()}


def load(path: str, *, reroot: str | None = None) -> list[Family]:
    """The families of a file of any format. A Newick file gives a tree alone; Nexus and Stockholm files may have rows and a tree."""
    text, name = text_of(path), re.sub(r".*/|\.\w+$", "", path)

    def tree(newick: str | None) -> list[trees.Node] | None:
        if newick is None:
            return None
        t = trees.parse_newick(newick)
        return t if reroot is None else trees.reroot_above(t, [n.name for n in t].index(reroot))

    kind = kind_of(text)
    if kind == "newick":
        return [Family(name, tree=tree(text))]
    if kind == "nexus":
        rows, newick = formats.parse_nexus(text)
        return [Family(name, gapped=rows, tree=tree(newick))]
    if kind == "stockholm":
        return [Family(notes.get("ID", f"{name}{i or ''}"), gapped=rows, tree=tree(newick)) for i, (rows, notes, newick) in enumerate(parse_stockholm(text))]
    if kind == "json":
        raise ValueError(f"{path} is JSON, not sequences or a tree")
    rows = parse_fasta(text)
    return [Family(name, gapped=rows) if kind == "gapped_fasta" else Family(name, seqs=rows)]


def routed(paths: list[str], *, reroot: str | None = None) -> list[Family]:
    """Files in any order, each taken for what it is: trees go to the families without one that have the same leaves; a family's sequences are those of its
    leaves' rows, unless it's a whole reconstruction."""
    found = [f for p in paths for f in load(p, reroot=reroot)]
    spare = [f.tree for f in found if f.tree is not None and not f.gapped and not f.seqs]
    out = []
    for f in found:
        if not f.gapped and not f.seqs:
            continue
        if f.tree is None:
            names = set(f.gapped or f.seqs)
            match = [t for t in spare if {n.name for i, n in enumerate(t) if not any(m.parent == i for m in t)} <= names]
            f = replace(f, tree=match[0] if match else None)
        leaves = None if f.tree is None else {n.name for i, n in enumerate(f.tree) if not any(m.parent == i for m in f.tree)}
        kept = f.gapped if leaves is None or f.reconstructed else {k: v for k, v in f.gapped.items() if k in leaves}
        out.append(replace(f, gapped=kept, seqs=f.seqs or ungapped(kept)))
    return out


def frames(spark: SparkSession, families: list[Family]) -> tuple[DataFrame, DataFrame]:
    """Sequences (ds, name, seq, gapped; null without a guide) and trees (ds, node, parent, name, blen) of families, ds being their names."""
    seqs = [(f.name, n, s, f.gapped.get(n)) for f in families for n, s in f.seqs.items()]
    nodes = [(f.name, i, n.parent, n.name, n.blen) for f in families if f.tree for i, n in enumerate(f.tree)]
    return spark.createDataFrame(seqs, "ds string, name string, seq string, gapped string"), spark.createDataFrame(nodes, "ds string, node long, parent long, name string, blen double")
