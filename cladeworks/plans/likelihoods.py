"""Queries on models, likelihoods, counting, fitting and simulation, with DuckDB SQL where a closed form exists."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..kernels import recon
from ..kernels.model import Model
from ..operators import alignment as al, chains, counting, pairs, rates, reconstruction, simulation, workflow
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


#: P(t) of the equal-rates model of three symbols, one substitution a unit of time
_P = "(CASE WHEN {i} = {j} THEN 1 / CAST(3 AS DOUBLE) + 2 / CAST(3 AS DOUBLE) * exp(-1.5 * {t}) ELSE 1 / CAST(3 AS DOUBLE) - 1 / CAST(3 AS DOUBLE) * exp(-1.5 * {t}) END)"
_STATES = "st AS (SELECT * FROM (VALUES ('A'), ('N'), ('R')) v(s))"


@query("mod03_probabilities", f"WITH {b.TREE_SQL}, {_STATES} SELECT CAST(node AS BIGINT) AS node, x.s AS i, y.s AS j, round({_P.format(i='x.s', j='y.s', t='blen')}, 6) AS p FROM tree, st x, st y WHERE parent >= 0")
def _(spark, d):
    lengths = sorted({t for q, t in zip(b.TREE.parent, b.TREE.blen, strict=True) if q >= 0})
    m = b.JC3.with_eigen()
    rows = [(t, a, c, float(p)) for t in lengths for a, row in zip("ANR", m.probs(t)[0], strict=True) for c, p in zip("ANR", row, strict=True)]
    table = spark.createDataFrame(rows, "blen double, i string, j string, p double")
    return b.tree(spark).where("parent >= 0").join(F.broadcast(table), "blen").select("node", "i", "j", F.round("p", 6).alias("p"))


_RATES_SQL = "r AS (SELECT a.l_returnflag AS i, b.l_returnflag AS j, a.n * b.n / CAST(1000000 AS DOUBLE) AS s FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1) a, (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1) b WHERE a.l_returnflag <> b.l_returnflag), pi AS (SELECT l_returnflag AS i, count(*) / CAST((SELECT count(*) FROM lineitem) AS DOUBLE) AS p FROM lineitem GROUP BY 1)"


def _exchange(spark, d):
    n = b.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n")).first()[0]
    pi = n.select(F.col("l_returnflag").alias("i"), (F.col("n") / F.lit(float(total))).alias("p"))
    a, c = n.select(F.col("l_returnflag").alias("i"), F.col("n").alias("x")), n.select(F.col("l_returnflag").alias("j"), F.col("n").alias("y"))
    return a.join(c, F.col("i") != F.col("j")).select("i", "j", (F.col("x") * F.col("y") / F.lit(1e6)).alias("s")), pi


@query("src15_exchangeabilities", f"WITH {_RATES_SQL}, q AS (SELECT r.i, r.j, s * b.p AS q, a.p AS pi FROM r JOIN pi a ON a.i = r.i JOIN pi b ON b.i = r.j) SELECT i, j, round(q / (SELECT sum(q * pi) FROM q), 9) AS rate FROM q")
def _(spark, d):
    s, pi = _exchange(spark, d)
    return rates.normalised(rates.exchangeable(s, pi), pi).select("i", "j", F.round("rate", 9).alias("rate"))


@query("mod05_expected_rate", f"WITH {_RATES_SQL} SELECT round(sum(s * p), 6) AS rate, round(1 / (1 - 0.66), 6) AS indel_length FROM r JOIN pi USING (i)")
def _(spark, d):
    s, pi = _exchange(spark, d)
    return rates.expected_rate(s.withColumnRenamed("s", "rate"), pi).select(F.round("whole", 6).alias("rate"), F.round(rates.indel_length(0.66), 6).alias("indel_length"))


@query("mod06_normalised", f"WITH {_RATES_SQL} SELECT i, j, round(s / (SELECT sum(s * p) FROM r JOIN pi USING (i)), 9) AS rate FROM r")
def _(spark, d):
    s, pi = _exchange(spark, d)
    return rates.normalised(s.withColumnRenamed("s", "rate"), pi).select("i", "j", F.round("rate", 9).alias("rate"))


@query("mod07_transitions", f"""WITH {b.TREE_SQL}, p AS (SELECT node, 1 - exp(-0.3 * blen) AS i, 1 - exp(-0.2 * blen) AS d, CAST(0.6 AS DOUBLE) AS x, CAST(0.5 AS DOUBLE) AS y FROM tree WHERE parent >= 0),
m AS (SELECT node, unnest(['MM', 'MI', 'MD', 'ME', 'IM', 'II', 'ID', 'IE', 'DM', 'DI', 'DD', 'DE']) AS move, unnest([(1 - i) * (1 - d), i, (1 - i) * d, 1 - i, (1 - x) * (1 - d), x, (1 - x) * d, 1 - x, 1 - y, 0, y, 1 - y]) AS p FROM p)
SELECT CAST(node AS BIGINT) AS node, move, round(p, 9) AS p FROM m""")
def _(spark, d):
    m = Model.jukes_cantor("ANR", insrate=0.3, delrate=0.2, insext=0.6, delext=0.5)
    rows = [(t, a + c, p) for t in sorted(set(b.TREE.blen[:-1])) for (a, c), p in m.transitions(t).items()]
    return b.tree(spark).where("parent >= 0").join(F.broadcast(spark.createDataFrame(rows, "blen double, move string, p double")), "blen").select("node", "move", F.round("p", 9).alias("p"))


@query("mod12_decay_wait", "SELECT l_orderkey AS k, round(sum(1 / l_quantity - l_discount / (exp(l_quantity * l_discount) - 1)), 5) AS wait FROM lineitem WHERE l_discount > 0 GROUP BY 1")
def _(spark, d):
    wait = rates.decay_wait(F.col("l_quantity"), F.col("l_discount"))
    return b.table(spark, d, "lineitem").where("l_discount > 0").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum(wait), 5).alias("wait"))


def _pruning() -> str:
    """Upward messages level by level: f(node) holds for each column and state the likelihood below; missing leaves send one."""
    out, kids = [f"{b.ALN_SQL}, {_STATES}, cols AS (SELECT DISTINCT col FROM aln)"], {}
    for n, p, _, t in b.NODES:
        kids.setdefault(p, []).append((n, t))
    for n, _, _, _ in b.NODES:
        if n in kids:
            parts = " * ".join(f"m{k}.m" for k, _ in kids[n])
            joins = " ".join(f"JOIN m{k} ON m{k}.col = c.col AND m{k}.s = st.s" for k, _ in kids[n])
            out.append(f"f{n} AS (SELECT c.col, st.s, {parts} AS f FROM cols c CROSS JOIN st {joins})")
        else:
            out.append(f"f{n} AS (SELECT c.col, st.s, CASE WHEN a.sym IS NULL OR a.sym = st.s THEN CAST(1 AS DOUBLE) ELSE 0 END AS f FROM cols c CROSS JOIN st LEFT JOIN aln a ON a.col = c.col AND a.node = {n})")
        t = next(x[3] for x in b.NODES if x[0] == n)
        if n != 12:
            out.append(f"m{n} AS (SELECT f.col, st.s, sum({_P.format(i='st.s', j='f.s', t=f'CAST({t} AS DOUBLE)')} * f.f) AS m FROM f{n} f CROSS JOIN st GROUP BY 1, 2)")
    return ", ".join(out)


_UP = _pruning()
_ROOT = "root AS (SELECT col, sum(f) / 3 AS z FROM f12 GROUP BY 1)"


@query("sum02_log_likelihood", f"WITH {_UP}, {_ROOT} SELECT col, round(ln(z), 6) AS loglik FROM root")
def _(spark, d):
    a = b.alignment(spark, d)
    return counting.by_column(a, counting.log_likelihoods(a, b.JC3, b.TREE)).select("col", F.round("loglik", 6).alias("loglik"))


#: a posterior at the root needs only the upward pass when the root has a residue in the column
_RESIDUE = "spans AS (SELECT col FROM aln GROUP BY 1 HAVING bool_or(node IN (0, 1, 3)) AND bool_or(node > 3))"


@query("sum05_root_posterior", f"WITH {_UP}, {_ROOT}, {_RESIDUE} SELECT f12.col, s AS sym, round(f / 3 / z, 6) AS prob FROM f12 JOIN root ON root.col = f12.col JOIN spans ON spans.col = f12.col WHERE f / 3 / z >= 0.01")
def _(spark, d):
    a = b.alignment(spark, d)
    return counting.by_column(a, counting.posteriors(a, b.JC3, b.TREE)).where("node = 12").select("col", "sym", F.round("prob", 6).alias("prob"))


@query("sum15_root_map", f"WITH {_UP}, {_ROOT}, {_RESIDUE}, p AS (SELECT f12.col, s, round(f / 3 / z, 9) AS p FROM f12 JOIN root ON root.col = f12.col JOIN spans ON spans.col = f12.col) SELECT col, s AS sym FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY p DESC, s) AS k FROM p) WHERE k = 1")
def _(spark, d):
    a = b.alignment(spark, d)
    best = counting.most_probable(counting.posteriors(a, b.JC3, b.TREE, 0.0).where("node = 12"))
    return counting.by_column(a, best).select("col", "sym")


def _around() -> str:
    """Messages both ways along every branch, as CTEs: g{u}_{w} is what lies on u's side of the branch to w, for each state of u, and m{u}_{w} the same
    for each state of w; and pres, the nodes that have a residue in a column: leaves with one, and inner nodes with residues on two sides."""
    near: dict[int, dict[int, float]] = {n: {} for n, *_ in b.NODES}
    for n, p, _, t in b.NODES:
        if p >= 0:
            near[n][p] = near[p][n] = t
    leaves = set(b.LEAF.values())
    out, done = [f"{b.ALN_SQL}, {_STATES}, cols AS (SELECT DISTINCT col FROM aln)"], set()

    def beyond(u: int, w: int) -> list[int]:
        """Leaves on u's side."""
        return [u] if u in leaves else [x for k in near[u] if k != w for x in beyond(k, u)]

    def message(u: int, w: int) -> None:
        if (u, w) in done:
            return
        done.add((u, w))
        others = [k for k in near[u] if k != w]
        for k in others:
            message(k, u)
        if u in leaves:
            out.append(f"g{u}_{w} AS (SELECT c.col, st.s, CASE WHEN a.sym IS NULL OR a.sym = st.s THEN CAST(1 AS DOUBLE) ELSE 0 END AS f FROM cols c CROSS JOIN st LEFT JOIN aln a ON a.col = c.col AND a.node = {u})")
        else:
            joins = " ".join(f"JOIN m{k}_{u} ON m{k}_{u}.col = c.col AND m{k}_{u}.s = st.s" for k in others)
            out.append(f"g{u}_{w} AS (SELECT c.col, st.s, {' * '.join(f'm{k}_{u}.m' for k in others)} AS f FROM cols c CROSS JOIN st {joins})")
        out.append(f"m{u}_{w} AS (SELECT f.col, st.s, sum({_P.format(i='st.s', j='f.s', t=f'CAST({near[u][w]} AS DOUBLE)')} * f.f) AS m FROM g{u}_{w} f CROSS JOIN st GROUP BY 1, 2)")

    for u in near:
        for w in near[u]:
            message(u, w)
    sides = {n: [beyond(k, n) for k in near[n]] for n in near if n not in leaves}
    has = lambda some: f"bool_or(node IN ({', '.join(map(str, some))}))"
    inner = " UNION ALL ".join(f"SELECT col, {n} AS node FROM aln GROUP BY 1 HAVING {' + '.join(f'CAST({has(x)} AS INT)' for x in some)} > 1" for n, some in sides.items())
    out.append(f"pres AS (SELECT col, node FROM aln UNION ALL {inner})")
    parts = []
    for n in near:
        joins = " ".join(f"JOIN m{k}_{n} ON m{k}_{n}.col = c.col AND m{k}_{n}.s = st.s" for k in near[n])
        leaf = f"LEFT JOIN aln a ON a.col = c.col AND a.node = {n}" if n in leaves else ""
        own = "(CASE WHEN a.sym IS NULL OR a.sym = st.s THEN 1 ELSE 0 END) * " if n in leaves else ""
        parts.append(f"SELECT c.col, {n} AS node, st.s, {own}{' * '.join(f'm{k}_{n}.m' for k in near[n])} / 3 AS f FROM cols c CROSS JOIN st {joins} {leaf}")
    out.append(f"joint AS ({' UNION ALL '.join(parts)})")
    out.append("post AS (SELECT j.col, j.node, j.s, f / sum(f) OVER (PARTITION BY j.col, j.node) AS p, sum(f) OVER (PARTITION BY j.col, j.node) AS z FROM joint j JOIN pres USING (col, node))")
    return ", ".join(out)


_AROUND = _around()
_INNER = ", ".join(str(n) for n, *_ in b.NODES if n not in b.LEAF.values())


def _events() -> str:
    """Expected events of each branch: those of its ends' states, whose joint posterior comes from both sides' messages. The integral over the branch is a closed
    form under equal rates."""
    parts = []
    for n, p, _, t in b.NODES:
        if p >= 0:
            pr = _P.format(i="x.s", j="y.s", t=f"CAST({t} AS DOUBLE)")
            parts.append(f"SELECT x.col, {n} AS node, CAST({t} AS DOUBLE) AS t, x.s AS a, y.s AS b, x.f * y.f AS w, x.f * y.f * {pr} AS f FROM g{p}_{n} x JOIN g{n}_{p} y ON x.col = y.col JOIN pres v ON v.col = x.col AND v.node = {n} JOIN pres q ON q.col = x.col AND q.node = {p}")
    d = "(CASE WHEN {x} = {y} THEN 2 / CAST(3 AS DOUBLE) ELSE -1 / CAST(3 AS DOUBLE) END)"
    al, be = d.format(x="e.a", y="i.s"), d.format(x="j.s", y="e.b")
    inner = f"(t / 9 + ({al} + {be}) / 3 * (1 - exp(-1.5 * t)) / 1.5 + {al} * {be} * t * exp(-1.5 * t))"
    return f"""ends AS ({' UNION ALL '.join(parts)}), e AS (SELECT t, a, b, sum(w / z) AS share FROM (SELECT *, sum(f) OVER (PARTITION BY col, node) AS z FROM ends) GROUP BY 1, 2, 3),
ev AS (SELECT i.s AS i, j.s AS j, sum(share * {inner}) AS n FROM e CROSS JOIN st i CROSS JOIN st j GROUP BY 1, 2)"""


_TOPS = "tops AS (SELECT pres.col, pres.node FROM pres JOIN tree ON tree.node = pres.node LEFT JOIN pres q ON q.col = pres.col AND q.node = tree.parent WHERE q.node IS NULL)"
_COUNTS_SQL = f"""WITH {b.TREE_SQL}, {_AROUND}, {_events()}, {_TOPS}
SELECT 'root' AS kind, s AS i, '' AS j, round(sum(p), 4) AS value FROM post JOIN tops USING (col, node) GROUP BY s
UNION ALL SELECT CASE WHEN i = j THEN 'wait' ELSE 'sub' END, i, CASE WHEN i = j THEN '' ELSE j END, round(CASE WHEN i = j THEN n ELSE n / 2 END, 4) FROM ev
UNION ALL SELECT 'loglik', '', '', round(sum(ln(z)), 4) FROM (SELECT DISTINCT col, node, z FROM post JOIN tops USING (col, node))"""


@query("sum04_at_node", f"WITH {_UP}, {_ROOT} SELECT col, round(ln(z), 6) AS loglik FROM root")
def _(spark, d):
    """The column's likelihood as seen from node 4 is that seen from the root."""
    a = b.alignment(spark, d)
    return counting.by_column(a, counting.log_likelihoods_at(a, b.JC3, b.TREE, 4)).select("col", F.round("loglik", 6).alias("loglik"))


@query("sum06_excluded", f"WITH {_AROUND} SELECT g.col, g.s AS sym, round(g.f / sum(g.f) OVER (PARTITION BY g.col), 6) AS prob FROM g4_2 g JOIN pres ON pres.col = g.col AND pres.node = 4")
def _(spark, d):
    a = b.alignment(spark, d)
    return counting.by_column(a, counting.excluded(a, b.JC3, b.TREE, 2)).select("col", "sym", F.round("prob", 6).alias("prob"))


@query("sum07_branch_posterior", f"""WITH {_AROUND}, ab AS (SELECT x.col, x.s AS a, y.s AS c, x.f * y.f * {_P.format(i='x.s', j='y.s', t='CAST(0.15 AS DOUBLE)')} AS f FROM g4_2 x JOIN g2_4 y ON x.col = y.col JOIN pres v ON v.col = x.col AND v.node = 2 JOIN pres q ON q.col = x.col AND q.node = 4)
SELECT col, a AS parent_sym, c AS sym, round(f / sum(f) OVER (PARTITION BY col), 6) AS prob FROM ab""")
def _(spark, d):
    a = b.alignment(spark, d)
    return counting.by_column(a, counting.branch_posteriors(a, b.JC3, b.TREE, 2)).select("col", "parent_sym", "sym", F.round("prob", 6).alias("prob"))


@query("sum16_posteriors", f"WITH {_AROUND} SELECT CAST(node AS INT) AS node, s AS sym, round(sum(p), 4) AS expected, CAST(count(*) AS BIGINT) AS n FROM post WHERE node IN ({_INNER}) AND p >= 0.01 GROUP BY 1, 2")
def _(spark, d):
    a = b.alignment(spark, d)
    return counting.posteriors(a, b.JC3, b.TREE).groupBy("node", "sym").agg(F.round(F.sum(F.col("prob") * F.col("n")), 4).alias("expected"), F.sum("n").alias("n"))


@query("sum10_expected_counts", _COUNTS_SQL)
def _(spark, d):
    return counting.expected_counts(counting.patterns(b.alignment(spark, d)), b.JC3, b.TREE).select("kind", "i", "j", F.round("value", 4).alias("value"))


@query("sum09_direct_counts", _COUNTS_SQL)
def _(spark, d):
    return counting.expected_counts(counting.patterns(b.alignment(spark, d)), b.JC3, b.TREE, eigen=False).select("kind", "i", "j", F.round("value", 4).alias("value"))


#: branches between rows that are present: each line number as a child of line number 1
_BRANCH_SQL = f"""{b.ALN_SQL}, e AS (SELECT n AS node FROM (VALUES (1), (3), (5), (6), (8), (9)) v(n)), c AS (SELECT e.node, a.col, bool_or(a.node = 0) AS x, bool_or(a.node = e.node) AS y FROM e JOIN aln a ON a.node IN (0, e.node) GROUP BY 1, 2),
m AS (SELECT node, col, CASE WHEN x AND y THEN 'M' WHEN y THEN 'I' ELSE 'D' END AS move FROM c), g AS (SELECT *, sum(CAST(move = 'M' AS INT)) OVER (PARTITION BY node ORDER BY col) AS g FROM m),
w AS (SELECT *, coalesce(lag(move) OVER (PARTITION BY node ORDER BY g, CASE move WHEN 'M' THEN 0 WHEN 'I' THEN 1 ELSE 2 END, col), 'M') AS was FROM g)"""


@query("sum11_indel_counts", f"""WITH {_BRANCH_SQL} SELECT CAST(0 AS BIGINT) AS parent, CAST(node AS BIGINT) AS node, CAST(count(*) FILTER (move = 'I' AND was <> 'I') AS BIGINT) AS ins, CAST(count(*) FILTER (move = 'D' AND was <> 'D') AS BIGINT) AS del,
CAST(count(*) FILTER (move = 'I' AND was = 'I') AS BIGINT) AS ins_ext, CAST(count(*) FILTER (move = 'D' AND was = 'D') AS BIGINT) AS del_ext, CAST(count(*) FILTER (move = 'M' AND was = 'M') AS BIGINT) AS waits FROM w GROUP BY 2""")
def _(spark, d):
    edges = spark.createDataFrame([(0, n) for n in (1, 3, 5, 6, 8, 9)], "parent long, node long")
    return al.indel_counts(b.alignment(spark, d), edges).drop("ds")


_TRAJ = "t AS (SELECT user_id, event_type AS i, lead(event_type) OVER w AS j, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), sub AS (SELECT i, j, count(*) AS n FROM t WHERE j IS NOT NULL AND i <> j GROUP BY 1, 2), wait AS (SELECT i, sum(us) / 1e6 AS w FROM t WHERE j IS NOT NULL GROUP BY 1)"


def _trajectories(spark, d):
    """Fully observed jumps and waiting times of the events of each user, as long counts."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = b.table(spark, d, "events").select("user_id", F.col("event_type").alias("i"), F.lead("event_type").over(w).alias("j"), (F.unix_micros(F.lead(F.col("ts").cast("timestamp")).over(w)) - F.unix_micros(F.col("ts").cast("timestamp"))).alias("us")).where("j IS NOT NULL")
    sub = t.where("i <> j").groupBy(F.lit(0).alias("cpt"), F.lit("sub").alias("kind"), "i", "j").agg(F.count("*").cast("double").alias("value"))
    wait = t.groupBy(F.lit(0).alias("cpt"), F.lit("wait").alias("kind"), "i", F.lit("").alias("j")).agg((F.sum("us") / 1e6).alias("value"))
    return sub, wait


@query("sum13_sum_counts", f"WITH {_TRAJ} SELECT 'sub' AS kind, i, j, CAST(2 * n AS DOUBLE) AS value FROM sub UNION ALL SELECT 'wait', i, '', round(2 * w, 3) FROM wait")
def _(spark, d):
    sub, wait = _trajectories(spark, d)
    return counting.sum_counts(sub, wait, sub, wait).select("kind", "i", "j", F.round("value", 3).alias("value"))


@query("fit01_m_step", f"WITH {_TRAJ} SELECT sub.i, sub.j, round(n / w, 9) AS rate FROM sub JOIN wait USING (i)")
def _(spark, d):
    sub, wait = _trajectories(spark, d)
    return rates.maximised(sub.union(wait)).select("i", "j", F.round("rate", 9).alias("rate"))


@query("fit03_expected_log_likelihood", f"WITH {_TRAJ}, x AS (SELECT i, j, n, w, n / w AS r FROM sub JOIN wait USING (i)) SELECT round((SELECT sum(n * ln(r)) FROM x) - (SELECT sum(r * w) FROM x), 2) AS ell FROM range(1)")
def _(spark, d):
    sub, wait = _trajectories(spark, d)
    counts = sub.union(wait)
    return rates.expected_loglik(counts, rates.maximised(counts)).select(F.round("loglik", 2).alias("ell"))


@query("fit04_em")
def _(spark, d):
    """EM for the rates of the three return flags; rows are the fitted rates and the log likelihood of each iteration."""
    model, trace = counting.fit(b.alignment(spark, d), b.JC3, b.TREE, iterations=20)
    c = model.components[0]
    rows = [("rate", a, x, round(float(c.rate[i, j]), 5)) for i, a in enumerate("ANR") for j, x in enumerate("ANR") if i != j]
    rows += [("root", a, "", round(float(c.root[i]), 5)) for i, a in enumerate("ANR")] + [("loglik", str(i), "", round(x, 3)) for i, x in enumerate(trace)]
    return spark.createDataFrame(rows, "kind string, i string, j string, value double")


_FAMILY_MODEL = Model.jukes_cantor("acgt", insrate=0.05, delrate=0.05, insext=0.66, delext=0.66)


def _aligned(spark, d):
    seqs = b.family(spark, d)
    return pairs.aligned_pairs(seqs, pairs.all_pairs(seqs), _FAMILY_MODEL)


@query("pair07_align")
def _(spark, d):
    return _aligned(spark, d).select("row1", "row2", F.round("score", 6).alias("score"), "gapped1", "gapped2")


@query("pair13_spanning_tree")
def _(spark, d):
    return pairs.spanning_trees(_aligned(spark, d)).select("row1", "row2", F.round("score", 6).alias("score"))


@query("pair14_guide_alignment")
def _(spark, d):
    return pairs.guide_alignments(_aligned(spark, d), b.family(spark, d), _FAMILY_MODEL).select("row", "gapped")


@query("sim03_simulate")
def _(spark, d):
    m = Model.jukes_cantor("acgt", insrate=0.02, delrate=0.02, insext=0.5, delext=0.5)
    return simulation.families(spark, 64, m, b.TREE)


_RATIO_SQL = "x AS (SELECT p_brand AS method, s.n / CAST(p_retailprice AS DOUBLE) * 40 AS r FROM part p JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) s ON s.l_partkey = p.p_partkey)"


def _ratios(spark, d):
    n = b.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return b.table(spark, d, "part").join(n, "p_partkey").select(F.col("p_brand").alias("method"), (F.col("n") / F.col("p_retailprice") * 40).alias("r"))


@query("sim04_rmse", f"WITH {_RATIO_SQL} SELECT method, round(avg(r), 6) AS mean, round(sqrt(avg(r * r) - 2 * avg(r) + 1), 6) AS rmse FROM x GROUP BY 1")
def _(spark, d):
    return rates.summary(_ratios(spark, d)).select("method", F.round("mean", 6).alias("mean"), F.round("rmse", 6).alias("rmse"))


@query("sim05_quartiles", f"WITH {_RATIO_SQL}, k AS (SELECT method, r, row_number() OVER (PARTITION BY method ORDER BY r) - 1 AS k, count(*) OVER (PARTITION BY method) AS n FROM x) SELECT method, round(max(r) FILTER (k = n // 4), 6) AS q1, round(max(r) FILTER (k = n // 2), 6) AS median, round(max(r) FILTER (k = 3 * n // 4), 6) AS q3 FROM k GROUP BY 1")
def _(spark, d):
    return rates.quartiles(_ratios(spark, d)).select("method", *[F.round(x, 6).alias(x) for x in ("q1", "median", "q3")])


@query("sim05_histogram", f"WITH {_RATIO_SQL} SELECT method, CAST(round(r / 0.1) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY 1, 2")
def _(spark, d):
    return rates.histogram(_ratios(spark, d), 0.1)


@query("mod09_gamma_rates")
def _(spark, d):
    m = b.JC3.gamma(4, 0.5)
    return spark.createDataFrame([(i, float(c.weight), round(float(-c.rate[0, 0]), 6)) for i, c in enumerate(m.components)], "cpt int, weight double, rate double")


_FLAGS = Model.jukes_cantor("ANR", insrate=0.1, delrate=0.1, insext=0.5, delext=0.5)


@query("dp04_forward")
def _(spark, d):
    """Each order's return flags, in the order of lines, as a short sequence; each customer's consecutive orders as a pair."""
    lines = b.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: x["l_returnflag"]), "").alias("seq"))
    orders = b.table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    pair = orders.select(F.lit(0).alias("ds"), F.col("o_orderkey").alias("row1"), F.lead("o_orderkey").over(w).alias("row2"), F.col("seq").alias("seq1"), F.lead("seq").over(w).alias("seq2")).where("row2 IS NOT NULL")
    found = reconstruction.forward_scores(pair, _FLAGS, 0.3, 0.4)
    return found.select("row1", "row2", F.round("loglik", 6).alias("loglik"), F.round("best_loglik", 6).alias("best_loglik"), "matches")


@query("dp19_recon")
def _(spark, d):
    """The whole way from sequences to a history: pairs, guide, distances, tree, progressive reconstruction."""
    seqs = b.family(spark, d).select("ds", F.col("row").cast("string").alias("name"), "seq")
    got = workflow.reconstructed(seqs, _FAMILY_MODEL, recon.Options(samples=4), sparse=True)
    return got.select("node", "name", "gapped", F.round("loglik", 4).alias("loglik"))


def _simulated(spark, replicates: int, length: int):
    m = Model.jukes_cantor("acgt", insrate=0.02, delrate=0.02, insext=0.5, delext=0.5)
    rows = simulation.families(spark, replicates, m, b.TREE, length).join(b.tree(spark).drop("ds").withColumnRenamed("node", "n"), F.col("node") == F.col("n")).drop("n")
    return rows.select("ds", "node", "parent", "name", "blen", "gapped"), m


@query("sum17_history_loglik")
def _(spark, d):
    rows, m = _simulated(spark, 64, 100)
    return chains.likelihoods(rows, m, 1.0).select("ds", *[F.round(x, 5).alias(x) for x in ("root", "indel", "substitution", "prior")])


@query("dp21_refined")
def _(spark, d):
    rows, m = _simulated(spark, 8, 20)
    return chains.refined(rows, m).select("ds", "node", "gapped", F.round("loglik", 5).alias("loglik"))


@query("mc11_chains")
def _(spark, d):
    rows, m = _simulated(spark, 8, 12)
    return chains.sampled(rows, m, chains=2, per_node=2, population=1.0).select("ds", "chain", "node", "parent", "name", F.round("blen", 6).alias("blen"), "gapped", F.round("best_loglik", 5).alias("loglik"), "accepted")
