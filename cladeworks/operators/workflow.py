"""From sequences to histories: the stages of a reconstruction, each a DataFrame operator over all families at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..kernels import recon
from ..kernels.model import Model
from . import pairs, reconstruction, trees


def numbered(seqs: DataFrame) -> DataFrame:
    """seqs (ds, name, ...) with row, the place of the name in its family."""
    return seqs.withColumn("row", (F.row_number().over(Window.partitionBy("ds").orderBy("name")) - 1).cast("long"))


def guides(seqs: DataFrame, model: Model, *, sparse: bool = False, seed: int = 5489, kmatch: int | None = None, kmatchn: int | None = None, band: int = 64) -> DataFrame:
    """Guide alignments (ds, name, gapped) of seqs (ds, name, seq): pairs (all, or a sparse random graph) aligned, and merged along the maximum spanning
    tree; within bands around diagonals with k-mer matches, if kmatch is given. A family of one sequence is its own guide."""
    rows = numbered(seqs)
    some = pairs.sparse_pairs(rows.select("ds", "row"), seed) if sparse else pairs.all_pairs(rows.select("ds", "row"))
    plain = rows.select("ds", "row", "seq")
    diagonals = None
    if kmatch is not None:
        hits = pairs.diagonal_hits(pairs.kmer_index(plain, kmatch))
        diagonals = pairs.bands(hits, kmatchn or 2, band)
    scored = pairs.aligned_pairs(plain, some, model, diagonals=diagonals)
    merged = pairs.guide_alignments(scored, plain, model, diagonals=diagonals)
    return rows.join(merged, ["ds", "row"], "left").select("ds", "name", F.coalesce("gapped", "seq").alias("gapped"))


def long_form(gapped: DataFrame) -> DataFrame:
    """(ds, node, col, sym) of gapped rows (ds, row, gapped)."""
    cells = gapped.select("ds", F.col("row").alias("node"), F.posexplode(F.split("gapped", "")).alias("col", "sym"))
    return cells.where("sym NOT IN ('-', '.', '')").select("ds", "node", F.col("col").cast("long").alias("col"), "sym")


def trees_of(guide: DataFrame, model: Model, *, method: str = "upgma", jc: bool = False) -> DataFrame:
    """Trees (ds, node, parent, name, blen) of guide alignments (ds, name, gapped), from distances of their pairs: by maximum likelihood, or of the
    equal-rates model."""
    rows = numbered(guide)
    aln = long_form(rows.select("ds", "row", "gapped"))
    counts = pairs.pair_counts(aln)
    known = pairs.jukes_cantor(counts, len(model.alphabet)) if jc else pairs.ml_distances(counts, model)
    every = pairs.all_pairs(rows.select("ds", "row")).select("ds", F.col("row1").alias("node1"), F.col("row2").alias("node2"))
    distances = every.join(known.select("ds", F.col("node1").cast("long").alias("node1"), F.col("node2").cast("long").alias("node2"), "t"), ["ds", "node1", "node2"], "left")
    built = trees.build(distances.withColumn("t", F.coalesce("t", F.lit(1e-9))), method)
    names = rows.select("ds", F.col("row").cast("string").alias("name"), F.col("name").alias("own"))
    return built.join(names, ["ds", "name"], "left").select("ds", "node", "parent", F.coalesce("own", F.lit("")).alias("name"), "blen")


def reconstructed(seqs: DataFrame, model: Model, options: recon.Options = recon.Options(), *, sparse: bool = False, method: str = "upgma", jc: bool = False, guide: DataFrame | None = None, tree: DataFrame | None = None, **kw: int) -> DataFrame:
    """Histories (ds, node, name, gapped, loglik, path_loglik) of seqs (ds, name, seq); guides and trees are made where they aren't given."""
    guide = guides(seqs, model, sparse=sparse, seed=options.seed, **kw) if guide is None else guide
    tree = trees_of(guide, model, method=method, jc=jc) if tree is None else tree
    return reconstruction.reconstruct(seqs.join(guide.select("ds", "name", "gapped"), ["ds", "name"], "left"), tree, model, options)
