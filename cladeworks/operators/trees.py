"""Trees as DataFrames (ds, node, parent, name, blen), nodes in postorder, the root's parent -1."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..kernels import trees as kernel

EDGES = "node long, parent long, name string, blen double"


def ancestors(tree: DataFrame, steps: int = 64) -> DataFrame:
    """(ds, node, ancestor, hops, dist) for every node and each of its ancestors, itself included, by pointer doubling: after k joins
    paths of up to 2^k branches are known, so a tree of depth d takes log d of them. steps bounds the loop."""
    one = tree.select("ds", "node", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("hops"), F.col("blen").alias("dist")).where("ancestor >= 0")
    known, jump = one, one
    for _ in range(steps):
        if jump.isEmpty():
            break
        far = jump.select("ds", F.col("node").alias("ancestor"), F.col("ancestor").alias("top"), F.col("hops").alias("more"), F.col("dist").alias("extra"))
        grow = known.join(far, ["ds", "ancestor"]).select("ds", "node", F.col("top").alias("ancestor"), F.expr("hops + more").alias("hops"), F.expr("dist + extra").alias("dist"))
        new_jump = jump.join(far, ["ds", "ancestor"]).select("ds", "node", F.col("top").alias("ancestor"), F.expr("hops + more").alias("hops"), F.expr("dist + extra").alias("dist"))
        known, jump = known.union(grow), new_jump
    self_ = tree.select("ds", "node", F.col("node").alias("ancestor"), F.lit(0).cast("long").alias("hops"), F.lit(0.0).alias("dist"))
    return self_.union(known)


def relations(tree: DataFrame) -> DataFrame:
    """Children, siblings, leaf flag and length of each node."""
    kids = tree.groupBy("ds", F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.array_join(F.transform(F.array_sort(F.collect_list("node")), lambda x: x.cast("string")), ",").alias("children"))
    n = F.count("*").over(Window.partitionBy("ds", "parent"))
    return tree.withColumn("n_siblings", F.when(F.col("parent") < 0, 0).otherwise(n - 1)).join(kids, ["ds", "node"], "left").select(
        "ds", "node", "parent", "n_siblings", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("children", F.lit("")).alias("children"), F.col("n_children").isNull().alias("is_leaf"), "blen"
    )


def preorder(tree: DataFrame) -> DataFrame:
    """The place of each node when parents come before children and children in their order: paths from the root, compared as text of
    fixed width."""
    up = ancestors(tree)
    path = up.groupBy("ds", "node").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("hops")).alias("h"), F.format_string("%010d", "ancestor").alias("a")))), lambda x: x["a"]), "/").alias("path"))
    return path.select("ds", "node", F.row_number().over(Window.partitionBy("ds").orderBy("path")).alias("place"))


def root_distance(tree: DataFrame) -> DataFrame:
    """Branches and length from the root."""
    return ancestors(tree).groupBy("ds", "node").agg(F.max("hops").alias("depth"), F.max("dist").alias("dist"))


def mrca(tree: DataFrame) -> DataFrame:
    """The most recent common ancestor of each pair of leaves of a tree, and their distance."""
    leaves = tree.join(tree.select("ds", F.col("parent").alias("node")).distinct(), ["ds", "node"], "left_anti").select("ds", "node")
    up = ancestors(tree).join(leaves, ["ds", "node"], "left_semi")
    a = up.select("ds", "ancestor", F.col("node").alias("leaf1"), F.col("dist").alias("d1"))
    b = up.select("ds", "ancestor", F.col("node").alias("leaf2"), F.col("dist").alias("d2"))
    both = a.join(b, ["ds", "ancestor"]).where("leaf1 < leaf2")
    return both.groupBy("ds", "leaf1", "leaf2").agg(F.min_by("ancestor", F.col("d1") + F.col("d2") + F.col("ancestor") * 1e-12).alias("mrca"), F.min(F.col("d1") + F.col("d2")).alias("dist"))


def closest_leaf(tree: DataFrame) -> DataFrame:
    """The nearest leaf below each node; the smaller of two."""
    leaves = tree.join(tree.select("ds", F.col("parent").alias("node")).distinct(), ["ds", "node"], "left_anti").select("ds", "node")
    up = ancestors(tree).join(leaves, ["ds", "node"], "left_semi")
    return up.groupBy("ds", F.col("ancestor").alias("node")).agg(F.min(F.struct(F.round("dist", 9).alias("d"), F.col("node").alias("leaf"))).alias("x")).select("ds", "node", "x.leaf", F.col("x.d").alias("dist"))


def checks(tree: DataFrame) -> DataFrame:
    """Whether each tree is binary, ultrametric (1e-4), in postorder, and has valid lengths."""
    kids = tree.where("parent >= 0").groupBy("ds", "parent").agg(F.count("*").alias("n")).groupBy("ds").agg((F.min("n") + F.max("n") == 4).alias("binary"))
    d = root_distance(tree).join(tree.select("ds", F.col("parent").alias("node")).distinct(), ["ds", "node"], "left_anti").groupBy("ds").agg((F.max("dist") - F.min("dist") <= 1e-4).alias("ultrametric"))
    order = tree.groupBy("ds").agg(F.bool_and((F.col("parent") < 0) | (F.col("parent") > F.col("node"))).alias("postorder"), F.bool_and((F.col("parent") < 0) | (F.col("blen") >= 0)).alias("lengths_valid"))
    return order.join(kids, "ds", "left").join(d, "ds", "left")


def scaled(tree: DataFrame, k: float) -> DataFrame:
    return tree.withColumn("blen", F.when(F.col("parent") < 0, F.col("blen")).otherwise(F.col("blen") * k))


def coalescent(tree: DataFrame, population: float) -> DataFrame:
    """The coalescent log prior of each tree: the sum of -C(k, 2) / N over time, k lineages at a time; times are heights above the leaf
    that is furthest from the root."""
    d = root_distance(tree)
    top = d.groupBy("ds").agg(F.max("dist").alias("top"))
    kids = tree.where("parent >= 0").groupBy("ds", F.col("parent").alias("node")).agg(F.count("*").alias("k"))
    events = d.join(top, "ds").join(kids, ["ds", "node"], "left").select("ds", "node", F.round(F.col("top") - F.col("dist"), 9).alias("h"), (1 - F.coalesce("k", F.lit(0))).alias("step"))
    w = Window.partitionBy("ds").orderBy("h", "node")
    lines = events.select("ds", "h", F.sum("step").over(w).alias("k"), F.lead("h").over(w).alias("next"))
    return lines.groupBy("ds").agg(F.sum(F.when(F.col("next").isNotNull(), -(F.col("k") * (F.col("k") - 1) / 2) / population * (F.col("next") - F.col("h")))).alias("log_prior"))


def build(distances: DataFrame, method: str = "upgma") -> DataFrame:
    """Trees (ds, node, parent, name, blen) from distances (ds, node1, node2, t), one task for each data set. Methods: upgma, upgma_textbook, nj."""

    def run(table: pa.Table) -> pa.Table:
        ds, a, b, t = (table.column(i).to_pylist() for i in range(4))
        rows = sorted({*a, *b})
        number = {r: i for i, r in enumerate(rows)}
        d = np.zeros((len(rows), len(rows)))
        for x, y, z in zip(a, b, t, strict=True):
            d[number[x], number[y]] = d[number[y], number[x]] = z
        names = [str(r) for r in rows]
        nodes = kernel.neighbour_joining(d, names) if method == "nj" else kernel.upgma(d, names, method == "upgma_textbook")
        return pa.table({"ds": pa.array([ds[0]] * len(nodes), table.schema.field(0).type), "node": list(range(len(nodes))), "parent": [n.parent for n in nodes], "name": [n.name for n in nodes], "blen": [n.blen for n in nodes]})

    rows = distances.select("ds", F.col("node1").cast("long"), F.col("node2").cast("long"), F.col("t").cast("double"))
    return rows.groupBy("ds").applyInArrow(run, f"ds {distances.schema['ds'].dataType.simpleString()}, {EDGES}")
