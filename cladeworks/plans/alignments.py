"""Queries on alignment algebra, trees and distances, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import sequences as sq
from ..operators import alignment as al, pairs, trees
from . import base as b

Q: dict = {}
S: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return put


#: gapped rows of a small alignment for each customer nation: part names padded to one length
_ROWS = "g AS (SELECT p_size AS ds, p_partkey AS node, rpad(replace(p_name, ' ', '-'), 40, '-') AS gapped FROM part)"


def _gapped(spark, d):
    return b.table(spark, d, "part").select(F.col("p_size").alias("ds"), F.col("p_partkey").alias("node"), F.rpad(F.replace("p_name", F.lit(" "), F.lit("-")), 40, "-").alias("gapped"))


@query("aln01_columns", f"WITH {_ROWS} SELECT ds, CAST(max(length(gapped)) AS INT) AS n_cols, CAST(count(*) AS BIGINT) AS n_rows, min(length(gapped)) = max(length(gapped)) AS flush FROM g GROUP BY 1")
def _(spark, d):
    return al.columns(_gapped(spark, d))


@query("aln02_residues", f"WITH {b.ALN_SQL} SELECT node, CAST(count(*) AS BIGINT) AS residues FROM aln GROUP BY 1")
def _(spark, d):
    return al.residues(b.alignment(spark, d)).select("node", "residues")


@query("aln03_union", f"WITH {b.ALN_SQL} SELECT node, sym, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM aln WHERE node < 4 UNION ALL SELECT * FROM aln WHERE node >= 4) GROUP BY 1, 2")
def _(spark, d):
    a = b.alignment(spark, d)
    return al.union(a.where("node < 4"), a.where("node >= 4")).groupBy("node", "sym").agg(F.count("*").alias("n"))


@query("aln04_concat", f"""WITH {_ROWS}, x AS (SELECT ds, node, left(gapped, 20) AS gapped FROM g WHERE node % 3 < 2), y AS (SELECT ds, node, substr(gapped, 21) AS gapped FROM g WHERE node % 3 > 0),
lx AS (SELECT ds, max(length(gapped)) AS n FROM x GROUP BY 1), ly AS (SELECT ds, max(length(gapped)) AS n FROM y GROUP BY 1)
SELECT ds, node, coalesce(x.gapped, repeat('-', coalesce(lx.n, 0))) || coalesce(y.gapped, repeat('-', coalesce(ly.n, 0))) AS gapped FROM x FULL JOIN y USING (ds, node) LEFT JOIN lx USING (ds) LEFT JOIN ly USING (ds)""")
def _(spark, d):
    g = _gapped(spark, d)
    return al.concat(g.where("node % 3 < 2").withColumn("gapped", F.substring("gapped", 1, 20)), g.where("node % 3 > 0").withColumn("gapped", F.expr("substring(gapped, 21)")))


@query("aln06_drop_empty", f"WITH {b.ALN_SQL} SELECT CAST(dense_rank() OVER (ORDER BY col) - 1 AS BIGINT) AS col, CAST(node AS INT) AS node, sym FROM aln")
def _(spark, d):
    return al.drop_empty(b.alignment(spark, d)).select("col", "node", "sym")


@query("aln07_has_gaps", f"WITH {_ROWS} SELECT ds, bool_or(contains(gapped, '-')) AS has_gaps FROM g GROUP BY 1")
def _(spark, d):
    return al.has_gaps(_gapped(spark, d))


@query("aln08_ensure_rows", f"WITH {_ROWS}, w AS (SELECT ds, max(length(gapped)) AS n FROM g GROUP BY 1) SELECT g.ds, g.node, CASE WHEN g.node % 2 = 0 THEN gapped ELSE repeat('-', n) END AS gapped FROM g JOIN w USING (ds)")
def _(spark, d):
    g = _gapped(spark, d)
    return al.ensure_rows(g.where("node % 2 = 0"), g.select("ds", "node"), al.columns(g).select("ds", "n_cols"))


_ENV_SQL = f"{b.ALN_SQL}, pr AS (SELECT col, bool_or(node = 0) AS x, bool_or(node = 9) AS y FROM aln WHERE node IN (0, 9) GROUP BY 1), env AS (SELECT col, CAST(sum(CAST(x AND y AS INT)) OVER (ORDER BY col) AS BIGINT) AS matches, CAST(sum(CAST(x AS INT)) OVER (ORDER BY col) AS BIGINT) AS pos_a, CAST(sum(CAST(y AS INT)) OVER (ORDER BY col) AS BIGINT) AS pos_b FROM pr)"


@query("aln09_envelope", f"WITH {_ENV_SQL} SELECT * FROM env")
def _(spark, d):
    return al.envelope(b.alignment(spark, d), 0, 9).drop("ds")


@query("aln10_band_join", f"WITH {_ENV_SQL} SELECT a.col AS col_a, CAST(count(*) AS BIGINT) AS n, CAST(max(b.col) AS BIGINT) AS last FROM env a JOIN env b ON b.matches BETWEEN a.matches - 2 AND a.matches + 2 GROUP BY 1")
def _(spark, d):
    return al.band_pairs(al.envelope(b.alignment(spark, d), 0, 9), 2).groupBy("col_a").agg(F.count("*").alias("n"), F.max("col_b").alias("last"))


@query("aln11_pair_path", f"""WITH {b.ALN_SQL}, pr AS (SELECT col, bool_or(node = 0) AS x, bool_or(node = 1) AS y FROM aln WHERE node IN (0, 1) GROUP BY 1), m AS (SELECT col, CASE WHEN x AND y THEN 'M' WHEN y THEN 'I' ELSE 'D' END AS move FROM pr),
g AS (SELECT *, sum(CAST(move = 'M' AS INT)) OVER (ORDER BY col) AS g FROM m) SELECT col, move, CAST(row_number() OVER (ORDER BY g, CASE move WHEN 'M' THEN 0 WHEN 'I' THEN 1 ELSE 2 END, col) AS BIGINT) AS step FROM g""")
def _(spark, d):
    return al.pair_columns(b.alignment(spark, d), 0, 1).drop("ds")


@query("aln12_triple_path", f"""WITH {b.ALN_SQL}, pr AS (SELECT col, bool_or(node = 0) AS l, bool_or(node = 1) AS r, bool_or(node = 3) AS p FROM aln WHERE node IN (0, 1, 3) GROUP BY 1),
g AS (SELECT *, sum(CAST(p AS INT)) OVER (ORDER BY col) AS g FROM pr) SELECT col, CASE WHEN l THEN 'L' ELSE '-' END || CASE WHEN r THEN 'R' ELSE '-' END || CASE WHEN p THEN 'P' ELSE '-' END AS kind,
CAST(row_number() OVER (ORDER BY g, CASE WHEN p THEN 0 WHEN r THEN 1 ELSE 2 END, col) AS BIGINT) AS step FROM g""")
def _(spark, d):
    return al.triple_columns(b.alignment(spark, d), 0, 1, 3).drop("ds")


@query("aln13_clade", f"WITH {b.ALN_SQL}, s AS (SELECT * FROM aln WHERE node IN (0, 1, 3)) SELECT node, CAST(count(*) AS BIGINT) AS n, CAST(max(col) AS BIGINT) AS last FROM (SELECT dense_rank() OVER (ORDER BY col) - 1 AS col, node FROM s) GROUP BY 1")
def _(spark, d):
    below = trees.ancestors(b.tree(spark)).where("ancestor = 4").select(F.col("node").cast("int").alias("node"))
    return al.clade(b.alignment(spark, d), below).groupBy("node").agg(F.count("*").alias("n"), F.max("col").cast("long").alias("last"))


@query("aln14_ungapped", f"WITH {b.ALN_SQL} SELECT CAST(count(*) FILTER (n < 3) AS BIGINT) AS ragged, count(*) FILTER (n < 3) = 0 AS ungapped FROM (SELECT col, count(*) AS n FROM aln WHERE node IN (0, 1, 3) GROUP BY 1)")
def _(spark, d):
    return al.ungapped_columns(b.alignment(spark, d), [0, 1, 3]).drop("ds")


@query("aln15_positions", f"WITH {b.ALN_SQL} SELECT col, CAST(node AS INT) AS node, CAST(row_number() OVER (PARTITION BY node ORDER BY col) - 1 AS BIGINT) AS pos FROM aln")
def _(spark, d):
    return al.positions(b.alignment(spark, d)).select("col", "node", "pos")


@query("aln16_repeated_names", "SELECT p_name AS name, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return al.repeated_names(b.table(spark, d, "part").select(F.col("p_name").alias("name")))


@query("aln17_bijective", "SELECT CAST(count(*) FILTER (b.n IS NULL) AS BIGINT) AS only_seqs, CAST(count(*) FILTER (a.n IS NULL) AS BIGINT) AS only_nodes, count(*) FILTER (b.n IS NULL OR a.n IS NULL) = 0 AS bijective FROM (SELECT c_custkey AS n FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey AS n FROM orders) b ON a.n = b.n")
def _(spark, d):
    return al.bijective(b.table(spark, d, "customer").select(F.col("c_custkey").alias("name")), b.table(spark, d, "orders").select(F.col("o_custkey").alias("name")).distinct())


@query("aln18_subalign", f"WITH {_ROWS} SELECT ds, node, substr(gapped, 5, 12) AS gapped, CAST(length(replace(left(gapped, 4), '-', '')) AS INT) AS start FROM g")
def _(spark, d):
    return al.subalignment(_gapped(spark, d), 4, 12)


@query("aln18b_column", f"WITH {_ROWS} SELECT ds, string_agg(substr(gapped, 8, 1), '' ORDER BY node) AS cells FROM g GROUP BY 1")
def _(spark, d):
    return al.column(_gapped(spark, d), 7)


@query("aln05_merge", f"WITH {b.FAMILY_SQL} SELECT row, seq AS residues FROM fam")
def _(spark, d):
    """Pair alignments of each row with the next, merged: residues must come through in order."""
    fam = b.family(spark, d)
    w = Window.partitionBy("ds").orderBy("row")
    rows = fam.withColumn("n", F.row_number().over(w).cast("long"))
    pair = rows.select("ds", F.col("n").alias("row1"), (F.col("n") + 1).alias("row2"), F.col("seq").alias("s1"), F.lead("seq").over(w).alias("s2"), F.col("n").alias("k")).where("s2 IS NOT NULL")
    wide = F.greatest(F.length("s1"), F.length("s2"))
    flush = pair.select("ds", "row1", "row2", F.rpad("s1", wide, "-").alias("gapped1"), F.rpad("s2", wide, "-").alias("gapped2"), "k")
    merged = pairs.merged(flush).select(F.col("row").alias("n"), sq.ungap(F.col("gapped")).alias("residues"))
    return rows.select("row", "n").join(merged, "n").select("row", "residues")


_UP = f"""{b.TREE_SQL}, up(node, ancestor, hops, dist) AS (SELECT node, node, 0, CAST(0 AS DOUBLE) FROM tree UNION ALL SELECT u.node, t.parent, u.hops + 1, u.dist + t.blen FROM up u JOIN tree t ON t.node = u.ancestor WHERE t.parent >= 0)"""


@query("tre03_relations", f"""WITH {b.TREE_SQL}, k AS (SELECT parent AS node, count(*) AS n, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS c FROM tree GROUP BY 1)
SELECT CAST(t.node AS BIGINT) AS node, CAST(t.parent AS BIGINT) AS parent, CAST(CASE WHEN t.parent < 0 THEN 0 ELSE count(*) OVER (PARTITION BY t.parent) - 1 END AS BIGINT) AS n_siblings, CAST(coalesce(n, 0) AS BIGINT) AS n_children, coalesce(c, '') AS children, n IS NULL AS is_leaf, blen FROM tree t LEFT JOIN k USING (node)""")
def _(spark, d):
    return trees.relations(b.tree(spark)).drop("ds")


@query("tre04_preorder", f"WITH RECURSIVE {b.TREE_SQL}, p(node, path) AS (SELECT node, lpad(CAST(node AS VARCHAR), 10, '0') FROM tree WHERE parent < 0 UNION ALL SELECT t.node, p.path || '/' || lpad(CAST(t.node AS VARCHAR), 10, '0') FROM p JOIN tree t ON t.parent = p.node) SELECT CAST(node AS BIGINT) AS node, CAST(row_number() OVER (ORDER BY path) AS INT) AS place FROM p")
def _(spark, d):
    return trees.preorder(b.tree(spark)).drop("ds")


@query("tre05_ancestors", f"WITH RECURSIVE {_UP} SELECT CAST(node AS BIGINT) AS node, CAST(ancestor AS BIGINT) AS ancestor, CAST(hops AS BIGINT) AS hops, round(dist, 9) AS dist FROM up")
def _(spark, d):
    return trees.ancestors(b.tree(spark)).select("node", "ancestor", "hops", F.round("dist", 9).alias("dist"))


@query("tre05b_mrca", f"""WITH RECURSIVE {_UP}, l AS (SELECT node FROM tree WHERE node NOT IN (SELECT parent FROM tree)), p AS (SELECT a.node AS leaf1, b.node AS leaf2, a.ancestor, a.dist + b.dist AS dist FROM up a JOIN up b ON a.ancestor = b.ancestor AND a.node < b.node WHERE a.node IN (SELECT node FROM l) AND b.node IN (SELECT node FROM l))
SELECT CAST(leaf1 AS BIGINT) AS leaf1, CAST(leaf2 AS BIGINT) AS leaf2, CAST(arg_min(ancestor, dist) AS BIGINT) AS mrca, round(min(dist), 9) AS dist FROM p GROUP BY 1, 2""")
def _(spark, d):
    return trees.mrca(b.tree(spark)).select("leaf1", "leaf2", "mrca", F.round("dist", 9).alias("dist"))


@query("tre06_root_distance", f"WITH RECURSIVE {_UP} SELECT CAST(node AS BIGINT) AS node, CAST(max(hops) AS BIGINT) AS depth, round(max(dist), 9) AS dist FROM up GROUP BY 1")
def _(spark, d):
    return trees.root_distance(b.tree(spark)).select("node", "depth", F.round("dist", 9).alias("dist"))


@query("tre07_closest_leaf", f"WITH RECURSIVE {_UP}, x AS (SELECT ancestor AS node, node AS leaf, round(dist, 9) AS dist FROM up WHERE node NOT IN (SELECT parent FROM tree)) SELECT CAST(node AS BIGINT) AS node, CAST(leaf AS BIGINT) AS leaf, dist FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY dist, leaf) AS k FROM x) WHERE k = 1")
def _(spark, d):
    return trees.closest_leaf(b.tree(spark)).drop("ds")


@query("tre09_checks", f"""WITH RECURSIVE {_UP}, k AS (SELECT parent, count(*) AS n FROM tree WHERE parent >= 0 GROUP BY 1), d AS (SELECT node, max(dist) AS dist FROM up WHERE node NOT IN (SELECT parent FROM tree) GROUP BY 1)
SELECT (SELECT bool_and(parent < 0 OR parent > node) FROM tree) AS postorder, (SELECT bool_and(parent < 0 OR blen >= 0) FROM tree) AS lengths_valid, (SELECT min(n) = 2 AND max(n) = 2 FROM k) AS "binary", (SELECT max(dist) - min(dist) <= 1e-4 FROM d) AS ultrametric""")
def _(spark, d):
    return trees.checks(b.tree(spark)).drop("ds")


@query("tre13_scaled", f"WITH {b.TREE_SQL} SELECT CAST(node AS BIGINT) AS node, round(CASE WHEN parent < 0 THEN blen ELSE blen * 2.5 END, 9) AS blen FROM tree")
def _(spark, d):
    return trees.scaled(b.tree(spark), 2.5).select("node", F.round("blen", 9).alias("blen"))


@query("tre14_coalescent", f"""WITH RECURSIVE {_UP}, r AS (SELECT node, max(dist) AS dist FROM up GROUP BY 1), k AS (SELECT parent AS node, count(*) AS k FROM tree WHERE parent >= 0 GROUP BY 1),
e AS (SELECT node, round((SELECT max(dist) FROM r) - dist, 9) AS h, 1 - coalesce(k, 0) AS step FROM r LEFT JOIN k USING (node)), l AS (SELECT h, sum(step) OVER w AS n, lead(h) OVER w AS nxt FROM e WINDOW w AS (ORDER BY h, node))
SELECT round(sum(-(n * (n - 1) / 2) / 2.0 * (nxt - h)), 6) AS log_prior FROM l WHERE nxt IS NOT NULL""")
def _(spark, d):
    return trees.coalescent(b.tree(spark), 2.0).select(F.round("log_prior", 6).alias("log_prior"))


_PAIRS_SQL = f"{b.ALN_SQL}, pc AS (SELECT a.node AS node1, b.node AS node2, a.sym AS sym1, b.sym AS sym2, count(*) AS n FROM aln a JOIN aln b ON a.col = b.col AND a.node < b.node GROUP BY 1, 2, 3, 4)"


@query("dst01_pair_counts", f"WITH {_PAIRS_SQL} SELECT CAST(node1 AS INT) AS node1, CAST(node2 AS INT) AS node2, sym1, sym2, CAST(n AS BIGINT) AS n FROM pc")
def _(spark, d):
    return pairs.pair_counts(b.alignment(spark, d)).drop("ds")


_JC_SQL = f"{_PAIRS_SQL}, s AS (SELECT node1, node2, sum(n) FILTER (sym1 = sym2) AS same, sum(n) AS n FROM pc GROUP BY 1, 2), jc AS (SELECT node1, node2, same, n - same AS diff, CASE WHEN (n - same) / CAST(n AS DOUBLE) >= 2 / CAST(3 AS DOUBLE) THEN 10 ELSE greatest(1e-9, least(10, -2 / CAST(3 AS DOUBLE) * ln(1 - (n - same) / CAST(n AS DOUBLE) / (2 / CAST(3 AS DOUBLE))))) END AS t FROM s)"


@query("dst02_jukes_cantor", f"WITH {_JC_SQL} SELECT CAST(node1 AS INT) AS node1, CAST(node2 AS INT) AS node2, CAST(same AS BIGINT) AS same, CAST(diff AS BIGINT) AS diff, round(t, 6) AS t FROM jc")
def _(spark, d):
    return pairs.jukes_cantor(pairs.pair_counts(b.alignment(spark, d)), 3).select("node1", "node2", "same", "diff", F.round("t", 6).alias("t"))


@query("dst04_matrix", f"WITH {_JC_SQL} SELECT CAST(node1 AS INT) AS i, CAST(node2 AS INT) AS j, round(t, 6) AS t FROM jc UNION ALL SELECT CAST(node2 AS INT), CAST(node1 AS INT), round(t, 6) FROM jc")
def _(spark, d):
    t = pairs.jukes_cantor(pairs.pair_counts(b.alignment(spark, d)), 3).select("node1", "node2", F.round("t", 6).alias("t"))
    return t.select(F.col("node1").alias("i"), F.col("node2").alias("j"), "t").union(t.select("node2", "node1", "t"))


@query("dst03_ml_distances", f"WITH {_JC_SQL} SELECT CAST(node1 AS INT) AS node1, CAST(node2 AS INT) AS node2, round(t, 3) AS t FROM jc")
def _(spark, d):
    """Under equal rates the closed form is the maximum."""
    return pairs.ml_distances(pairs.pair_counts(b.alignment(spark, d)), b.JC3, tolerance=1e-6).select("node1", "node2", F.round("t", 3).alias("t"))


def _centroids(spark, d):
    e = b.table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    pair = e.select(F.col("label").alias("node1"), "i", F.col("x").alias("x1")).join(e.select(F.col("label").alias("node2"), "i", F.col("x").alias("x2")), "i").where("node1 < node2")
    return pair.groupBy(F.lit(0).alias("ds"), "node1", "node2").agg(F.sqrt(F.sum((F.col("x1") - F.col("x2")) ** 2)).alias("t"))


@query("tre01_neighbour_joining")
def _(spark, d):
    return trees.build(_centroids(spark, d), "nj").drop("ds")


@query("tre02_upgma")
def _(spark, d):
    return trees.build(_centroids(spark, d)).drop("ds")
