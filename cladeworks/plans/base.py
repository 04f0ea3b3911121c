"""Relations of the domain derived from the supplied tables, as DataFrames and as the same SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..kernels.model import Model
from ..operators.counting import Tree

#: leaves s1 to s7 are the line numbers 1 to 7
NODES = [
    (0, 2, "s1", 0.1), (1, 2, "s2", 0.2), (2, 4, "a", 0.15), (3, 4, "s3", 0.3), (4, 12, "b", 0.05), (5, 7, "s4", 0.12), (6, 7, "s5", 0.22),
    (7, 11, "c", 0.08), (8, 10, "s6", 0.4), (9, 10, "s7", 0.35), (10, 11, "d", 0.06), (11, 12, "e", 0.09), (12, -1, "root", 0.0),
]
LEAF = {1: 0, 2: 1, 3: 3, 4: 5, 5: 6, 6: 8, 7: 9}
TREE = Tree(tuple(n[1] for n in NODES), tuple(n[3] for n in NODES))
JC3 = Model.jukes_cantor("ANR")
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "acgtacgtacgtacgtacgtacgtac"

TREE_SQL = "tree AS (SELECT * FROM (VALUES " + ", ".join(f"({n}, {p}, '{name}', CAST({t} AS DOUBLE))" for n, p, name, t in NODES) + ") v(node, parent, name, blen))"
SEQS_SQL = f"seqs AS (SELECT doc_id AS row, translate(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}') AS seq FROM documents)"
FAMILY_SQL = f"fam AS (SELECT item_id AS row, translate(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}') AS seq FROM benchmark)"
ALN_SQL = "aln AS (SELECT l_orderkey AS col, CASE l_linenumber " + " ".join(f"WHEN {k} THEN {v}" for k, v in LEAF.items()) + " END AS node, min(l_returnflag) AS sym FROM lineitem GROUP BY 1, 2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tree(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, *n) for n in NODES], "ds int, node long, parent long, name string, blen double")


def _bases(text):
    return F.translate(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", "")), LETTERS, BASES)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ds, row, seq): every whole document as a nucleotide string."""
    return table(spark, sf_dir, "documents").select(F.lit(0).alias("ds"), F.col("doc_id").alias("row"), _bases(F.col("text")).alias("seq"))


def family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ds, row, seq): the benchmark items as one family."""
    return table(spark, sf_dir, "benchmark").select(F.lit(0).alias("ds"), F.col("item_id").alias("row"), _bases(F.col("text")).alias("seq"))


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ds, node, col, sym): orders are columns, line numbers rows, return flags symbols, missing lines gaps."""
    node = F.create_map(*[F.lit(x) for k, v in LEAF.items() for x in (k, v)])[F.col("l_linenumber")]
    return table(spark, sf_dir, "lineitem").groupBy(F.lit(0).alias("ds"), node.alias("node"), F.col("l_orderkey").alias("col")).agg(F.min("l_returnflag").alias("sym"))
