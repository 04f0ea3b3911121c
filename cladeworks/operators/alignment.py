"""Alignment algebra on DataFrames. A long alignment has the columns (ds, node, col, sym), gaps absent; ds names the data set.

Running counts along the columns of a data set are made by ranges of columns, so that one long alignment is dealt over tasks: see counted()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import sequences as sq

RANGE = 1 << 16


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two alignments over the same columns; they must not share rows."""
    return a.unionByName(b)


def columns(gapped: DataFrame) -> DataFrame:
    """(ds, gapped): number of columns, of rows, and whether all rows have the same length."""
    n = F.length("gapped")
    return gapped.groupBy("ds").agg(F.max(n).alias("n_cols"), F.count("*").alias("n_rows"), (F.min(n) == F.max(n)).alias("flush"))


def concat(a: DataFrame, b: DataFrame) -> DataFrame:
    """Lengthwise: gapped rows (ds, node, gapped) of b behind those of a; a row that one lacks is gaps there."""
    wide = lambda df: df.groupBy("ds").agg(F.max(F.length("gapped")).alias("n"))
    la, lb = wide(a).withColumnRenamed("n", "na"), wide(b).withColumnRenamed("n", "nb")
    both = a.select("ds", "node", F.col("gapped").alias("ga")).join(b.select("ds", "node", F.col("gapped").alias("gb")), ["ds", "node"], "full")
    both = both.join(la, "ds", "left").join(lb, "ds", "left")
    return both.select("ds", "node", F.concat(F.coalesce("ga", F.expr("repeat('-', coalesce(na, 0))")), F.coalesce("gb", F.expr("repeat('-', coalesce(nb, 0))"))).alias("gapped"))


def counted(rows: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """rows (keys, col, ...; one for each col) with running sums of flags along col, that row's own included. Each RANGE of column numbers is summed by
    itself, and begins with the totals of the ranges before it: one row for each key and range, whose own running sum is small."""
    part = F.expr(f"col div {RANGE}")
    marked = rows.withColumn("_part", part)
    for name, flag in flags.items():
        marked = marked.withColumn(name, flag.cast("long"))
    totals = marked.groupBy(*keys, "_part").agg(*[F.sum(n).alias(n) for n in flags])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, "_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in flags])
    own = Window.partitionBy(*keys, "_part").orderBy("col")
    out = marked.join(base, [*keys, "_part"])
    for name in flags:
        out = out.withColumn(name, F.sum(name).over(own) + F.col(f"_{name}"))
    return out.drop("_part", *[f"_{n}" for n in flags])


def residues(aln: DataFrame) -> DataFrame:
    """(ds, node, residues) of the rows."""
    return aln.groupBy("ds", "node").agg(F.count("*").alias("residues"))


def has_gaps(gapped: DataFrame) -> DataFrame:
    """Whether any row (ds, node, gapped) of a data set has a gap."""
    return gapped.groupBy("ds").agg(F.bool_or(sq.has_gaps(F.col("gapped"))).alias("has_gaps"))


def subalignment(gapped: DataFrame, first: int, n: int) -> DataFrame:
    """n columns from the one numbered first, of rows (ds, node, gapped), and start: how many residues of the row come before them."""
    g = F.col("gapped")
    return gapped.select("ds", "node", sq.subalignment(g, first, n).alias("gapped"), sq.residues(sq.subalignment(g, 0, first)).alias("start"))


def column(gapped: DataFrame, number: int) -> DataFrame:
    """The cells of one column, in the order of nodes, by data set."""
    cells = F.array_sort(F.collect_list(F.struct("node", sq.subalignment(F.col("gapped"), number, 1).alias("c"))))
    return gapped.groupBy("ds").agg(F.array_join(F.transform(cells, lambda x: x["c"]), "").alias("cells"))


def ordered(gapped: DataFrame, tree: DataFrame) -> DataFrame:
    """Rows (ds, name, gapped) with the numbers of the tree's nodes (ds, node, name) that have their names; others are left out."""
    return gapped.join(tree.select("ds", "node", "name"), ["ds", "name"]).select("ds", "node", "name", "gapped")


def drop_empty(aln: DataFrame) -> DataFrame:
    """Renumbers columns 0, 1, ... over those with any residue. Numbers are ranks within a data set, over distinct columns only."""
    used = counted(aln.select("ds", "col").distinct(), ["ds"], {"new": F.lit(1)}).withColumn("new", F.col("new") - 1)
    return aln.join(used, ["ds", "col"]).select("ds", "node", F.col("new").alias("col"), "sym")


def ensure_rows(aln: DataFrame, rows: DataFrame, width: DataFrame) -> DataFrame:
    """Gapped rows (ds, node, gapped) for all of rows (ds, node); those that aln lacks are gaps of the width of the data set."""
    return rows.join(aln, ["ds", "node"], "left").join(width, "ds").select("ds", "node", F.coalesce("gapped", F.expr("repeat('-', n_cols)")).alias("gapped"))


def clade(aln: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of some nodes, without the columns that are empty then."""
    return drop_empty(aln.join(nodes, "node", "left_semi"))


def ungapped_columns(aln: DataFrame, nodes: list[int]) -> DataFrame:
    """For each data set: columns where some but not all of the nodes have residues, and whether there are none."""
    per = aln.where(F.col("node").isin(nodes)).groupBy("ds", "col").agg(F.count("*").alias("n"))
    return per.groupBy("ds").agg(F.count_if(F.col("n") < len(nodes)).alias("ragged")).withColumn("ungapped", F.col("ragged") == 0)


def _steps(per: DataFrame, late: Column, kept: list[str], keys: list[str], lead: Column) -> DataFrame:
    """Places (step, from 1) of columns sorted by their group, that of the last lead column at or before them, then late, then col. A column's step is
    the number of columns in groups before its own, and of those of its group before it; only a group is in one window."""
    per = counted(per, keys, {"g": lead})
    size = per.groupBy(*keys, F.col("g").alias("col")).agg(F.count("*").alias("n"))
    base = counted(size, keys, {"upto": F.col("n")}).select(*keys, F.col("col").alias("g"), (F.col("upto") - F.col("n")).alias("base"))
    inside = F.row_number().over(Window.partitionBy(*keys, "g").orderBy(late, "col"))
    return per.join(base, [*keys, "g"]).select(*keys, "col", *kept, "g", (F.col("base") + inside).alias("step"))


def pair_columns(aln: DataFrame, a: int, b: int) -> DataFrame:
    """The pair path of two rows in order: moves M, I (only b) and D (only a), with insertions before deletions between matches."""
    per = aln.where(F.col("node").isin(a, b)).groupBy("ds", "col").agg(F.bool_or(F.col("node") == a).alias("x"), F.bool_or(F.col("node") == b).alias("y"))
    per = per.withColumn("move", F.when(F.col("x") & F.col("y"), "M").when(F.col("y"), "I").otherwise("D"))
    late = F.when(F.col("move") == "M", 0).when(F.col("move") == "I", 1).otherwise(2)
    return _steps(per, late, ["move"], ["ds"], F.col("move") == "M").select("ds", "col", "move", "step")


def triple_columns(aln: DataFrame, left: int, right: int, parent: int) -> DataFrame:
    """The path of two siblings and their parent, with columns of the left sibling alone last between columns of the parent."""
    per = aln.where(F.col("node").isin(left, right, parent)).groupBy("ds", "col").agg(*[F.bool_or(F.col("node") == n).alias(x) for n, x in ((left, "l"), (right, "r"), (parent, "p"))])
    kind = F.concat(*[F.when(F.col(x), x.upper()).otherwise("-") for x in "lrp"])
    late = F.when(F.col("p"), 0).when(F.col("r"), 1).otherwise(2)
    return _steps(per.withColumn("kind", kind), late, ["kind"], ["ds"], F.col("p")).select("ds", "col", "kind", "step")


def positions(aln: DataFrame) -> DataFrame:
    """Adds pos, the number of residues of the row before the column."""
    return counted(aln, ["ds", "node"], {"pos": F.lit(1)}).withColumn("pos", F.col("pos") - 1)


def envelope(aln: DataFrame, a: int, b: int) -> DataFrame:
    """For each column with a residue of a or b: matches of the two before it and with it, and the positions in both rows."""
    per = aln.where(F.col("node").isin(a, b)).groupBy("ds", "col").agg(F.bool_or(F.col("node") == a).alias("x"), F.bool_or(F.col("node") == b).alias("y"))
    return counted(per, ["ds"], {"matches": F.col("x") & F.col("y"), "pos_a": F.col("x"), "pos_b": F.col("y")}).select("ds", "col", "matches", "pos_a", "pos_b")


def band_pairs(env: DataFrame, width: int) -> DataFrame:
    """Pairs of columns of one data set whose match counts differ by at most width: a range join by buckets of width + 1, so that each
    pair is met in one bucket or its neighbour."""
    size = width + 1
    left = env.select("ds", F.col("col").alias("col_a"), F.col("matches").alias("m_a")).withColumn("bucket", F.explode(F.expr(f"transform(array(-1, 0, 1), d -> m_a div {size} + d)")))
    right = env.select("ds", F.col("col").alias("col_b"), F.col("matches").alias("m_b")).withColumn("bucket", F.expr(f"m_b div {size}"))
    return left.join(right, ["ds", "bucket"]).where(F.abs(F.col("m_a") - F.col("m_b")) <= width).select("ds", "col_a", "col_b")


def repeated_names(seqs: DataFrame) -> DataFrame:
    return seqs.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def bijective(seqs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: names only in seqs, only among nodes, and whether both have the same names."""
    both = seqs.select("name", F.lit(1).alias("s")).join(nodes.select("name", F.lit(1).alias("t")), "name", "full")
    return both.agg(F.count_if(F.col("t").isNull()).alias("only_seqs"), F.count_if(F.col("s").isNull()).alias("only_nodes")).withColumn("bijective", (F.col("only_seqs") == 0) & (F.col("only_nodes") == 0))


def indel_counts(aln: DataFrame, edges: DataFrame) -> DataFrame:
    """For each data set and branch (edges: parent, node): openings and extensions of insertions and deletions, and matches that follow
    matches (those wait for both). Moves are in the order of pair_columns; a branch begins as behind a match."""
    present = aln.select("ds", "col", "node")
    own = edges.select("parent", "node").join(present, "node").select("ds", "col", "parent", "node", F.lit(True).alias("y"))
    above = edges.select("parent", "node").join(present.withColumnRenamed("node", "parent"), "parent").select("ds", "col", "parent", "node", F.lit(True).alias("x"))
    per = own.join(above, ["ds", "col", "parent", "node"], "full").withColumn("move", F.when(F.col("x").isNull(), "I").when(F.col("y").isNull(), "D").otherwise("M"))
    late = F.when(F.col("move") == "M", 0).when(F.col("move") == "I", 1).otherwise(2)
    keys = ["ds", "parent", "node"]
    steps = _steps(per, late, ["move"], keys, F.col("move") == "M")
    # what a move follows: within a group of moves behind one match it's the move before; the first of a group follows the last of the one before
    own = F.lag("move").over(Window.partitionBy(*keys, "g").orderBy("step"))
    last = steps.groupBy(*keys, "g").agg(F.max_by("move", "step").alias("tail"))
    per = steps.withColumn("own", own).join(last.select(*keys, (F.col("g") + 1).alias("g"), "tail"), [*keys, "g"], "left").withColumn("was", F.coalesce("own", "tail", F.lit("M")))
    n = lambda c: F.count_if(c)
    m, was = F.col("move"), F.col("was")
    return per.groupBy("ds", "parent", "node").agg(
        n((m == "I") & (was != "I")).alias("ins"), n((m == "D") & (was != "D")).alias("del"), n((m == "I") & (was == "I")).alias("ins_ext"),
        n((m == "D") & (was == "D")).alias("del_ext"), n((m == "M") & (was == "M")).alias("waits"),
    )
