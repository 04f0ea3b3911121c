"""Candidate pairs from k-mers, pair alignment, and distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import sequences as sq
from ..kernels import pairdp
from ..kernels.model import Model

CELLS = 8_000_000


def kmer_index(seqs: DataFrame, k: int) -> DataFrame:
    """(ds, row, seq): a row for each k-mer and position."""
    return seqs.select("ds", "row", F.posexplode(sq.kmers(F.col("seq"), k)).alias("pos", "kmer"))


def diagonal_hits(index: DataFrame) -> DataFrame:
    """k-mer matches by pair of rows of a data set (row1 < row2) and diagonal, by an equi-join on the k-mer."""
    a = index.select("ds", "kmer", F.col("row").alias("row1"), F.col("pos").alias("p1"))
    b = index.select("ds", "kmer", F.col("row").alias("row2"), F.col("pos").alias("p2"))
    return a.join(b, ["ds", "kmer"]).where("row1 < row2").groupBy("ds", "row1", "row2", (F.col("p1") - F.col("p2")).alias("diag")).agg(F.count("*").alias("hits"))


def thresholds(hits: DataFrame, lengths: DataFrame, band: int, budget: int) -> DataFrame:
    """For each pair, the least number of hits a diagonal must have for the bands around all such diagonals to fit into a budget of cells,
    filling from the most hits on; and how many diagonals that are. Overlaps of bands count twice."""
    by = hits.groupBy("ds", "row1", "row2", "hits").agg(F.count("*").alias("n"))
    l1, l2 = lengths.select("ds", F.col("row").alias("row1"), F.col("len").alias("len1")), lengths.select("ds", F.col("row").alias("row2"), F.col("len").alias("len2"))
    run = F.sum("n").over(Window.partitionBy("ds", "row1", "row2").orderBy(F.desc("hits")))
    fits = by.withColumn("total", run).join(l1, ["ds", "row1"]).join(l2, ["ds", "row2"]).where(F.col("total") * (2 * band + 1) * F.least("len1", "len2") <= budget)
    return fits.groupBy("ds", "row1", "row2").agg(F.min("hits").alias("threshold"), F.max("total").alias("diagonals"))


def bands(hits: DataFrame, least: int, half: int) -> DataFrame:
    """The diagonals within half of one with at least `least` hits."""
    return hits.where(F.col("hits") >= least).select("ds", "row1", "row2", F.explode(F.sequence(F.col("diag") - half, F.col("diag") + half)).alias("diag")).distinct()


def all_pairs(rows: DataFrame) -> DataFrame:
    """(ds, row1, row2), row1 < row2, of every data set. Every pair is asked for; the join is by data set."""
    return rows.select("ds", F.col("row").alias("row1")).join(rows.select("ds", F.col("row").alias("row2")), "ds").where("row1 < row2")


def sparse_pairs(rows: DataFrame, seed: int) -> DataFrame:
    """(ds, row1, row2): a random connected graph of some n log2 n pairs of each data set's n rows. The draws depend on the seed and the rows alone."""

    def run(table: pa.Table) -> pa.Table:
        ds, own = table.column(0), sorted(table.column(1).to_pylist())
        edges = pairdp.sparse_graph(len(own), seed)
        return pa.table({"ds": pa.array([ds[0].as_py()] * len(edges), ds.type), "row1": pa.array([own[a] for a, _ in edges], pa.int64()), "row2": pa.array([own[b] for _, b in edges], pa.int64())})

    return rows.select("ds", F.col("row").cast("long").alias("row")).groupBy("ds").applyInArrow(run, f"ds {rows.schema['ds'].dataType.simpleString()}, row1 long, row2 long")


def aligned_pairs(seqs: DataFrame, pairs: DataFrame, model: Model, t: float = 1.0, diagonals: DataFrame | None = None) -> DataFrame:
    """Viterbi alignments (ds, row1, row2, score, gapped1, gapped2) of pairs of sequences, dealt out evenly by pair. With diagonals (ds, row1, row2, diag) a pair
    that has some is aligned between the least and the greatest of them, in memory of one row for each; others are aligned in full."""
    alphabet, sub, gaps = model.alphabet, pairdp.log_odds(model, t), pairdp.gap_scores(model, t)
    code = {s: i for i, ch in enumerate(alphabet) for s in (ch.lower(), ch.upper())} | {s: i for i, s in enumerate(alphabet)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = lambda s: np.array([code.get(x, -2) for x in s], np.int64)
        for b in batches:
            out = []
            every = list(zip(b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True))
            done: dict[int, tuple] = {}
            for i, (s1, s2, least, most) in enumerate(every):
                if least is not None:
                    score, path = pairdp.viterbi_banded(tokens(s1), tokens(s2), sub, gaps, least, most)
                    done[i] = (score, *pairdp.gapped(s1, s2, path))
            texts = [x[:2] for i, x in enumerate(every) if i not in done]
            lo = 0
            while lo < len(texts):  # as many pairs in step as CELLS of back pointers allow
                hi, n, m = lo, 0, 0
                while hi < len(texts) and (hi == lo or (hi - lo + 1) * (max(n, len(texts[hi][0])) + 1) * (n + m + len(texts[hi][0]) + len(texts[hi][1])) <= CELLS):
                    n, m, hi = max(n, len(texts[hi][0])), max(m, len(texts[hi][1])), hi + 1
                some = texts[lo:hi]
                for (s1, s2), (score, path) in zip(some, pairdp.viterbi_batch([tokens(s[0]) for s in some], [tokens(s[1]) for s in some], sub, gaps), strict=True):
                    out.append((score, *pairdp.gapped(s1, s2, path)))
                lo = hi
            rest = iter(out)
            out = [done[i] if i in done else next(rest) for i in range(len(every))]
            score, g1, g2 = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(score, pa.float64()), pa.array(g1, pa.string()), pa.array(g2, pa.string())], ["ds", "row1", "row2", "score", "gapped1", "gapped2"])

    one = lambda n: seqs.select("ds", F.col("row").alias(f"row{n}"), F.coalesce("seq", F.lit("")).alias(f"seq{n}"))
    rows = pairs.join(one(1), ["ds", "row1"]).join(one(2), ["ds", "row2"])
    if diagonals is None:
        rows = rows.withColumn("least", F.lit(None).cast("long")).withColumn("most", F.lit(None).cast("long"))
    else:
        ends = diagonals.groupBy("ds", "row1", "row2").agg(F.min("diag").cast("long").alias("least"), F.max("diag").cast("long").alias("most"))
        rows = rows.join(ends, ["ds", "row1", "row2"], "left")
    rows = rows.select("ds", "row1", "row2", "seq1", "seq2", "least", "most").repartition("ds", "row1", "row2")
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    return rows.mapInArrow(run, f"ds {kinds['ds']}, row1 {kinds['row1']}, row2 {kinds['row2']}, score double, gapped1 string, gapped2 string")


def spanning_trees(scored: DataFrame) -> DataFrame:
    """The maximum spanning tree of each data set's scored pairs: (ds, row1, row2, score, k), row1 < row2, k the order in which edges join."""

    def run(table: pa.Table) -> pa.Table:
        ds, a, b, w = (table.column(i).to_pylist() for i in range(4))
        rows = sorted({*a, *b})
        number = {r: i for i, r in enumerate(rows)}
        edges = [(*sorted(e[:2]), e[2]) for e in pairdp.spanning_tree(len(rows), [(number[x], number[y], z) for x, y, z in zip(a, b, w, strict=True)])]
        return pa.table({"ds": pa.array([ds[0]] * len(edges), table.schema.field(0).type), "row1": pa.array([rows[e[0]] for e in edges], pa.int64()), "row2": pa.array([rows[e[1]] for e in edges], pa.int64()), "score": pa.array([e[2] for e in edges], pa.float64()), "k": pa.array(range(len(edges)), pa.int64())})

    rows = scored.select("ds", F.col("row1").cast("long").alias("row1"), F.col("row2").cast("long").alias("row2"), "score")
    return rows.groupBy("ds").applyInArrow(run, f"ds {scored.schema['ds'].dataType.simpleString()}, row1 long, row2 long, score double, k long")


def guide_alignments(scored: DataFrame, seqs: DataFrame, model: Model, t: float = 1.0, diagonals: DataFrame | None = None) -> DataFrame:
    """The guide alignment (ds, row, gapped) of each data set: the pair alignments along the maximum spanning tree of its scored pairs, merged. Only the
    tree's n - 1 pairs are aligned once more and go to a data set's task."""
    edges = spanning_trees(scored)
    aligned = aligned_pairs(seqs, edges.select("ds", "row1", "row2"), model, t, diagonals)
    return merged(aligned.join(edges.select("ds", "row1", "row2", "k"), ["ds", "row1", "row2"]))


def merged(parts: DataFrame) -> DataFrame:
    """One alignment (ds, row, gapped) of each data set from pair alignments (ds, row1, row2, gapped1, gapped2, k) that connect its rows: columns with a
    residue in common are one, those of parts of smaller k first. Parts that contradict each other are an error."""

    def run(table: pa.Table) -> pa.Table:
        ds, a, b, g1, g2, k = (table.column(i).to_pylist() for i in range(6))
        rows = sorted({*a, *b})
        number = {r: i for i, r in enumerate(rows)}
        parts, text = [], {}
        for _, x, y, p, q in sorted(zip(k, a, b, g1, g2, strict=True)):
            pair = {number[x]: p, number[y]: q}
            text |= {r: v.replace("-", "") for r, v in pair.items()}
            parts.append({r: np.array([ch != "-" for ch in v], bool) for r, v in pair.items()})
        out = {}
        for r, bits in pairdp.merge(parts).items():
            residues = iter(text[r])
            out[r] = "".join(next(residues) if bit else "-" for bit in bits)
        return pa.table({"ds": pa.array([ds[0]] * len(out), table.schema.field(0).type), "row": pa.array([rows[r] for r in sorted(out)], pa.int64()), "gapped": [out[r] for r in sorted(out)]})

    rows = parts.select("ds", F.col("row1").cast("long").alias("row1"), F.col("row2").cast("long").alias("row2"), "gapped1", "gapped2", "k")
    return rows.groupBy("ds").applyInArrow(run, f"ds {parts.schema['ds'].dataType.simpleString()}, row long, gapped string")


def pair_counts(aln: DataFrame) -> DataFrame:
    """Pairs of symbols in the columns that two nodes (node1 < node2) share. Columns are compressed to patterns first: equal columns are
    joined once and weighted."""
    pattern = aln.groupBy("ds", "col").agg(F.array_sort(F.collect_list(F.struct("node", "sym"))).alias("cells")).groupBy("ds", "cells").agg(F.count("*").alias("n"))
    cell = pattern.select("ds", "n", "cells", F.explode("cells").alias("x")).select("ds", "n", "x", F.explode(F.filter("cells", lambda c: c["node"] > F.col("x.node"))).alias("y"))
    return cell.groupBy("ds", F.col("x.node").alias("node1"), F.col("y.node").alias("node2"), F.col("x.sym").alias("sym1"), F.col("y.sym").alias("sym2")).agg(F.sum("n").alias("n"))


def jukes_cantor(counts: DataFrame, size: int, most: float = 10.0, least: float = 1e-9) -> DataFrame:
    """Distances of the equal-rates model from pair_counts, within [least, most]; no shared column gives least, saturation most."""
    per = counts.groupBy("ds", "node1", "node2").agg(F.sum(F.when(F.col("sym1") == F.col("sym2"), F.col("n")).otherwise(0)).alias("same"), F.sum("n").alias("n"))
    limit = (size - 1) / size
    diff = (F.col("n") - F.col("same")) / F.col("n")
    t = F.when(diff >= limit, F.lit(most)).otherwise(-limit * F.log(1 - diff / limit))
    return per.select("ds", "node1", "node2", "same", (F.col("n") - F.col("same")).alias("diff"), F.least(F.lit(most), F.greatest(F.lit(least), F.coalesce(t, F.lit(least)))).alias("t"))


def ml_distances(counts: DataFrame, model: Model, most: float = 10.0, least: float = 1e-9, tolerance: float = 0.01) -> DataFrame:
    """Maximum likelihood distances under a model: a scan over a grid for a bracket, then golden section; all pairs of a batch in step. Where most of the
    grid is as good, as without shared columns, the least distance is taken."""
    m, code = model.with_eigen(), {s: i for i, s in enumerate(model.alphabet)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golden = (5**0.5 - 1) / 2
        grid = np.concatenate(([least], np.geomspace(1e-4, most, 40)))

        def log_joint(t: np.ndarray) -> np.ndarray:
            """log P(a, b) at each of some times (times, n, n)."""
            p = sum(c.weight * c.root[None, :, None] * np.clip(((e.right[None] * np.exp(e.values * t[:, None])[:, None, :]) @ e.left[None]).real, 0, 1) for c, e in zip(m.components, m.eigen, strict=True))
            return np.log(np.maximum(p, 1e-300))

        on_grid = log_joint(grid)
        for b in batches:
            n = np.zeros((b.num_rows, len(code), len(code)))
            cells = b.column(3)
            flat = cells.flatten()
            row = np.repeat(np.arange(b.num_rows), np.diff(cells.offsets.to_numpy()))
            s1, s2 = (np.array([code[x] for x in flat.field(f).to_pylist()], np.int64) for f in ("sym1", "sym2"))
            np.add.at(n, (row, s1, s2), flat.field("n").to_numpy(zero_copy_only=False))
            gain = np.einsum("bij,gij->bg", n, on_grid)
            i = gain.argmax(1)
            lo, hi = grid[np.maximum(0, i - 1)], grid[np.minimum(len(grid) - 1, i + 1)]
            of = lambda t: np.einsum("bij,bij->b", n, log_joint(t))  # noqa: E731, B023
            for _ in range(100):
                if (hi - lo <= tolerance * hi).all():
                    break
                a, z = hi - golden * (hi - lo), lo + golden * (hi - lo)
                left = of(a) >= of(z)
                lo, hi = np.where(left, lo, a), np.where(left, z, hi)
            out = np.where(n.sum((1, 2)) > 0, (lo + hi) / 2, least)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out)], ["ds", "node1", "node2", "t"])

    rows = counts.groupBy("ds", "node1", "node2").agg(F.collect_list(F.struct("sym1", "sym2", "n")).alias("cells"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"ds {kinds['ds']}, node1 {kinds['node1']}, node2 {kinds['node2']}, t double")
