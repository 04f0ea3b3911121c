"""Likelihoods, posteriors, expected counts and EM over alignment columns.

Columns are compressed to distinct patterns first, as equal columns have equal likelihoods and counts; a numpy kernel handles a whole
Arrow batch of patterns at a time. Partial counts of batches are summed by Spark, so the driver sees one row for each cell."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..kernels import model as km, sumprod
from ..kernels.model import Counts, Model


@dataclass(frozen=True)
class Tree:
    """Parents in postorder and branch lengths; driver-side, small."""

    parent: tuple[int, ...]
    blen: tuple[float, ...]

    @property
    def leaves(self) -> list[int]:
        return [i for i in range(len(self.parent)) if i not in self.parent]


def patterns(aln: DataFrame) -> DataFrame:
    """(pattern, n): the distinct columns of a long alignment as sorted arrays of (node, sym), with their numbers."""
    cells = aln.groupBy("ds", "col").agg(F.array_sort(F.collect_list(F.struct(F.col("node").cast("int").alias("node"), "sym"))).alias("pattern"))
    return cells.groupBy("pattern").agg(F.count("*").alias("n"))


def _tokens(column: pa.Array, model: Model, tree: Tree) -> np.ndarray:
    """Matrix of tokens; inner nodes are unknown where their clade and what is around it have residues, and gaps elsewhere."""
    code = {s: i for i, s in enumerate(model.alphabet)}
    flat = column.flatten()
    node = flat.field("node").to_numpy(zero_copy_only=False)
    coded = flat.field("sym").dictionary_encode()
    known = np.array([code.get(s, sumprod.WILD) for s in coded.dictionary.to_pylist()] or [sumprod.WILD], np.int64)
    sym = known[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    out = np.full((len(column), len(tree.parent)), sumprod.GAP, np.int64)
    out[row, node] = sym
    inner = [i for i in range(len(tree.parent)) if i in tree.parent]
    below = (out != sumprod.GAP).astype(int)
    for v, q in enumerate(tree.parent):
        if q >= 0:
            below[:, q] += below[:, v]
    total = below[:, -1]
    for v in inner:
        kids = [k for k, q in enumerate(tree.parent) if q == v]
        sides = sum((below[:, k] > 0).astype(int) for k in kids) + (total > below[:, v])
        missing = out[:, v] == sumprod.GAP
        out[missing & (sides > 1), v] = sumprod.WILD
    return out


def _kernel(rows: DataFrame, model: Model, tree: Tree, emit, schema: str) -> DataFrame:
    """Runs emit(columns, batch) over batches of patterns (pattern, n, ...)."""
    shared = rows.sparkSession.sparkContext.broadcast((model.with_eigen(), tree))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, tr = shared.value
        for b in batches:
            if b.num_rows:
                tokens = _tokens(b.column(b.schema.get_field_index("pattern")), m, tr)
                yield from emit(sumprod.Columns(m, np.array(tr.parent), np.array(tr.blen), tokens), tokens, b)

    return rows.mapInArrow(run, schema)


def log_likelihoods(aln: DataFrame, model: Model, tree: Tree) -> DataFrame:
    """(pattern, n, loglik) of each distinct column."""

    def emit(c: sumprod.Columns, _: np.ndarray, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(c.loglik)], ["pattern", "n", "loglik"])

    return _kernel(patterns(aln), model, tree, emit, "pattern array<struct<node:int,sym:string>>, n long, loglik double")


def by_column(aln: DataFrame, per_pattern: DataFrame) -> DataFrame:
    """Results of patterns for each column (ds, col)."""
    cells = aln.groupBy("ds", "col").agg(F.array_sort(F.collect_list(F.struct(F.col("node").cast("int").alias("node"), "sym"))).alias("pattern"))
    return cells.join(per_pattern, "pattern").drop("pattern")


def posteriors(aln: DataFrame, model: Model, tree: Tree, least: float = 0.01) -> DataFrame:
    """(pattern, n, node, sym, prob) for inner nodes that have a residue, where prob is at least `least`."""
    inner = [i for i in range(len(tree.parent)) if i in tree.parent]

    def emit(c: sumprod.Columns, tokens: np.ndarray, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c.fill_down()
        p = c.posterior()[inner]
        v, row, s = np.nonzero((p >= least) & (tokens.T[inner] != sumprod.GAP)[:, :, None])
        pick = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pick), b.column(1).take(pick), pa.array(np.array(inner, np.int32)[v]), pa.array([model.alphabet[i] for i in s], pa.string()), pa.array(p[v, row, s])], ["pattern", "n", "node", "sym", "prob"]
        )

    return _kernel(patterns(aln), model, tree, emit, "pattern array<struct<node:int,sym:string>>, n long, node int, sym string, prob double")


def most_probable(post: DataFrame) -> DataFrame:
    """The most probable symbol of each node and pattern; the first in the alphabet of several."""
    return post.groupBy("pattern", "n", "node").agg(F.max(F.struct(F.round("prob", 9).alias("p"), (-F.ascii("sym")).alias("order"), "sym")).alias("x")).select("pattern", "n", "node", F.col("x.sym").alias("sym"), F.col("x.p").alias("prob"))


COUNTS = "cpt int, kind string, i string, j string, value double"


def expected_counts(pats: DataFrame, model: Model, tree: Tree, eigen: bool = True) -> DataFrame:
    """Long counts (cpt, kind, i, j, value) of patterns: root, sub, wait, and loglik; batches are summed by Spark."""
    a = model.alphabet

    def emit(c: sumprod.Columns, _: np.ndarray, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c.fill_down()
        got = c.counts(b.column(1).to_numpy().astype(float), eigen)
        rows = [(0, "loglik", "", "", got.loglik)]
        for k in range(c.c):
            rows += [(k, "root", a[i], "", got.root[k, i]) for i in range(c.n)]
            rows += [(k, "wait" if i == j else "sub", a[i], "" if i == j else a[j], got.sub[k, i, j]) for i in range(c.n) for j in range(c.n)]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["cpt", "kind", "i", "j", "value"])

    return _kernel(pats.select("pattern", "n"), model, tree, emit, COUNTS).groupBy("cpt", "kind", "i", "j").agg(F.sum("value").alias("value"))


def sum_counts(*counts: DataFrame) -> DataFrame:
    """The monoid sum of long counts."""
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy("cpt", "kind", "i", "j").agg(F.sum("value").alias("value"))


def collect_counts(counts: DataFrame, model: Model, indels: np.ndarray | None = None) -> Counts:
    """Long counts on the driver: at most components * n * (n + 2) cells."""
    out = Counts.zero(len(model.components), len(model.alphabet))
    at = {s: i for i, s in enumerate(model.alphabet)}
    for r in counts.collect():
        if r.kind == "root":
            out.root[r.cpt, at[r.i]] += r.value
        elif r.kind in ("sub", "wait"):
            out.sub[r.cpt, at[r.i], at[r.j or r.i]] += r.value
        else:
            out.loglik += r.value
    if indels is not None:
        out.indel = out.indel + indels
    return out


def indel_statistics(branches: DataFrame, model: Model, tree: Tree) -> np.ndarray:
    """Six indel statistics from operators.alignment.indel_counts, summed over data sets by branch first."""
    rows = branches.groupBy("node").agg(*[F.sum(x).alias(x) for x in ("ins", "del", "ins_ext", "del_ext", "waits")]).collect()
    out = np.zeros(6)
    for r in rows:
        t = tree.blen[r.node]
        out += [r["ins"], r["del"], r["ins_ext"], r["del_ext"], r["waits"] * t + (r["ins"] * km.decay_wait(model.insrate, t) if r["ins"] else 0), r["waits"] * t + (r["del"] * km.decay_wait(model.delrate, t) if r["del"] else 0)]
    return out


def log_likelihoods_at(aln: DataFrame, model: Model, tree: Tree, node: int) -> DataFrame:
    """(pattern, n, loglik) as seen from one node: the sum over its states of what lies below and around it. Where it has a residue it's that of the column."""

    def emit(c: sumprod.Columns, tokens: np.ndarray, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c.fill_down()
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(c.loglik_at(node))], ["pattern", "n", "loglik"])

    return _kernel(patterns(aln), model, tree, emit, "pattern array<struct<node:int,sym:string>>, n long, loglik double")


def excluded(aln: DataFrame, model: Model, tree: Tree, node: int) -> DataFrame:
    """(pattern, n, sym, prob): what all but a node's clade says about its parent's state, in patterns where the parent has a residue."""

    def emit(c: sumprod.Columns, tokens: np.ndarray, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c.fill_down()
        p = c.excluded(node)
        row, s = np.nonzero((p > 0) & (tokens[:, tree.parent[node]] != sumprod.GAP)[:, None])
        pick = pa.array(row)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pick), b.column(1).take(pick), pa.array([model.alphabet[i] for i in s], pa.string()), pa.array(p[row, s])], ["pattern", "n", "sym", "prob"])

    return _kernel(patterns(aln), model, tree, emit, "pattern array<struct<node:int,sym:string>>, n long, sym string, prob double")


def branch_posteriors(aln: DataFrame, model: Model, tree: Tree, node: int) -> DataFrame:
    """(pattern, n, parent_sym, sym, prob): the joint posterior of a branch's two ends, in patterns where both have a residue."""

    def emit(c: sumprod.Columns, tokens: np.ndarray, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c.fill_down()
        p = c.branch_posterior(node)
        row, i, j = np.nonzero(p > 1e-12)
        pick = pa.array(row)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pick), b.column(1).take(pick), *(pa.array([model.alphabet[x] for x in xs], pa.string()) for xs in (i, j)), pa.array(p[row, i, j])], ["pattern", "n", "parent_sym", "sym", "prob"])

    return _kernel(patterns(aln), model, tree, emit, "pattern array<struct<node:int,sym:string>>, n long, parent_sym string, sym string, prob double")


def count(aln: DataFrame, model: Model, tree: Tree, branches: DataFrame | None = None) -> Counts:
    """All expected counts of data sets that share a tree: root, substitution, waiting, and, with branches, those of indels."""
    got = expected_counts(patterns(aln), model, tree)
    return collect_counts(got, model, None if branches is None else indel_statistics(branches, model, tree))


def fit(aln: DataFrame, model: Model, tree: Tree, *, iterations: int = 100, least_gain: float = 0.001, branches: DataFrame | None = None, fix_sub: bool = False, fix_indel: bool = True, pseudo: Counts | None = None) -> tuple[Model, list[float]]:
    """EM on a fixed alignment: one Spark job for each E step over cached patterns; stops when the log likelihood, with the prior's if there are pseudocounts,
    gains at most least_gain of its size. A likelihood of zero is an error. Gives the model and the log likelihoods with priors."""
    pats = patterns(aln).cache()
    trace: list[float] = []
    try:
        for _ in range(iterations):
            got = collect_counts(expected_counts(pats, model, tree), model, None if branches is None else indel_statistics(branches, model, tree))
            if not np.isfinite(got.loglik):
                raise ValueError("the alignment has no likelihood under the model")
            trace.append(got.loglik + (0.0 if pseudo is None else pseudo.log_prior(model)))
            if len(trace) > 1 and trace[-1] - trace[-2] <= least_gain * abs(trace[-2]):
                break
            model = (got if pseudo is None else got + pseudo).maximise(model, fix_sub=fix_sub, fix_indel=fix_indel or branches is None)
    finally:
        pats.unpersist()
    return model, trace
