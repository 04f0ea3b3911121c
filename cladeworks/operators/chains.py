"""Markov chains over histories as a grouped operator: chains are independent, so a data set and chain is a group."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..kernels import sampler
from ..kernels.model import Model
from ..kernels.trees import Node

SCHEMA = "node long, parent long, name string, blen double, gapped string, loglik double, best_loglik double, accepted long, step long"


def _history(table: pa.Table, m: Model) -> sampler.History:
    rows = sorted(zip(*(table.column(n).to_pylist() for n in ("node", "parent", "name", "blen", "gapped")), strict=True))
    return sampler.History.of(m, [Node(p, n or "", t) for _, p, n, t, _ in rows], [g for *_, g in rows])


def sampled(histories: DataFrame, model: Model, *, chains: int = 1, per_node: int = 100, seed: int = 5489, every: int | None = None, population: float | None = None, width: int | None = sampler.BAND, fix_tree: bool = False, fix_alignment: bool = False) -> DataFrame:
    """histories (ds, node, parent, name, blen, gapped) to (ds, chain, node, ..., step): the best history that each chain met (step -1), and with `every`
    the chain's state at every so many steps. A chain has per_node steps a node; its draws depend on the seed, the data set and the chain only."""
    shared = histories.sparkSession.sparkContext.broadcast(model.with_eigen())
    kind = histories.schema["ds"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        m = shared.value
        start = _history(table, m)
        ds, chain = table.column("ds")[0].as_py(), table.column("chain")[0].as_py()
        out: list[tuple] = []

        def put(h: sampler.History, value: float, best: float, taken: int, step: int) -> None:
            out.extend((ds, chain, v, n.parent, n.name, n.blen, r, value, best, taken, step) for v, (n, r) in enumerate(zip(h.tree, h.rows(m), strict=True)))

        def log(step: int, c: sampler.Chain) -> None:
            if every and (step + 1) % every == 0:
                put(c.now, c.value, c.best_value, sum(c.taken.values()), step + 1)

        own = int.from_bytes(f"{seed}/{ds}/{chain}".encode().ljust(8, b"\0")[-8:], "big")
        c = sampler.run(m, start, per_node * len(start.tree), own, population=population, width=width, fix_tree=fix_tree, fix_alignment=fix_alignment, log=log)
        put(c.best, c.best_value, c.best_value, sum(c.taken.values()), -1)
        names = ["ds", "chain", *(x.split()[0] for x in SCHEMA.split(", "))]
        kinds = [table.schema.field("ds").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        return pa.table({n: pa.array(col, k) for n, col, k in zip(names, zip(*out, strict=True), kinds, strict=True)})

    rows = histories.select("ds", F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"), "name", "blen", "gapped")
    many = rows.withColumn("chain", F.explode(F.expr(f"sequence(0L, {chains - 1}L)")))
    return many.groupBy("ds", "chain").applyInArrow(run, f"ds {kind}, chain long, {SCHEMA}")


def refined(histories: DataFrame, model: Model, width: int | None = sampler.BAND) -> DataFrame:
    """histories (ds, node, parent, name, blen, gapped) with branch alignments improved one after the other until none gets likelier; and loglik."""
    shared = histories.sparkSession.sparkContext.broadcast(model.with_eigen())
    kind = histories.schema["ds"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        m = shared.value
        h, value = sampler.refine(m, _history(table, m), width)
        n = len(h.tree)
        return pa.table({"ds": pa.array([table.column("ds")[0].as_py()] * n, table.schema.field("ds").type), "node": pa.array(range(n), pa.int64()), "parent": pa.array([x.parent for x in h.tree], pa.int64()), "name": [x.name for x in h.tree], "blen": [x.blen for x in h.tree], "gapped": h.rows(m), "loglik": [value] * n})

    rows = histories.select("ds", F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"), "name", "blen", "gapped")
    return rows.groupBy("ds").applyInArrow(run, f"ds {kind}, node long, parent long, name string, blen double, gapped string, loglik double")


def likelihoods(histories: DataFrame, model: Model, population: float | None = None) -> DataFrame:
    """The parts of each whole history's log likelihood: (ds, root, indel, substitution, prior)."""
    shared = histories.sparkSession.sparkContext.broadcast(model.with_eigen())
    kind = histories.schema["ds"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        parts = sampler.parts_of_loglik(shared.value, _history(table, shared.value), population)
        return pa.table({"ds": pa.array([table.column("ds")[0].as_py()], table.schema.field("ds").type), **{k: [v] for k, v in parts.items()}})

    rows = histories.select("ds", F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"), "name", "blen", "gapped")
    return rows.groupBy("ds").applyInArrow(run, f"ds {kind}, root double, indel double, substitution double, prior double")
