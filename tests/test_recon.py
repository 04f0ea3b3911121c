"""Profiles, reconstruction and chains, by published values, path sums and enumeration."""

import itertools
import math

import numpy as np
import pytest

from cladeworks import sinks
from cladeworks.kernels import pairdp, profile as pf, recon, sampler, trees
from cladeworks.kernels.model import Model
from cladeworks.options import parse
from cladeworks.sources import families, models

JC = Model.jukes_cantor(rate=1.0, insrate=0.1, delrate=0.1, insext=0.9, delext=0.9)


def lattice(x, y, left=1.0, right=1.0, m=JC):
    return pf.Lattice(pf.Profile.leaf(m, x, 1), pf.Profile.leaf(m, y, 2), m, left, right, 0)


# Published scores of two pairs of sequences under this model.
@pytest.mark.parametrize(("x", "y", "total"), [("ag", "ct", -6.545192), ("ag", "actg", -12.745155)])
def test_forward_backward_and_profiles_agree(x, y, total):
    cells = lattice(x, y)
    every = [(i, j, s) for i in range(len(cells.x) - 1) for j in range(len(cells.y) - 1) for s in range(5) if cells.f[i, s, j] > -np.inf]
    assert cells.backward()[cells.start] == pytest.approx(cells.total)
    if y == "actg":
        assert cells.total == pytest.approx(total, abs=1e-5)
    for collapse in (True, False):
        whole = cells.profile(every, collapse=collapse)
        assert whole.path_sum(cells.insert) == pytest.approx(cells.total)
        null = {e.src for e in whole.edges if whole.emit[e.dst] is None}
        emits = {e.src for e in whole.edges if whole.emit[e.dst] is not None}
        assert not null & emits  # every state waits or is ready
    assert cells.best_profile().path_sum(cells.insert) <= cells.total
    post = cells.posterior()
    assert max(post.values()) <= 1 + 1e-9 and post[cells.start] == pytest.approx(1)


def test_best_paths():
    # Published scores of best paths.
    assert lattice("ag", "actg", 0.1, 0.01).best_profile().path_sum(np.log(np.full((1, 4), 0.25))) == pytest.approx(-13.233434, abs=1e-5)
    assert lattice("ag", "actg", 0.01, 1).best_profile().path_sum(np.log(np.full((1, 4), 0.25))) == pytest.approx(-13.379988, abs=1e-5)


def test_sampled_paths_follow_their_weights():
    cells = lattice("ag", "ac", 0.4, 0.4)
    rng = np.random.default_rng(1)
    met: dict[tuple, int] = {}
    for _ in range(3000):
        path = tuple(cells.sample(rng))
        met[path] = met.get(path, 0) + 1
    for path, n in met.items():
        weight = sum(next(w for c, w, _ in cells.into(b) if c == a) + cells.own(b) for a, b in itertools.pairwise(path))
        p = math.exp(weight - cells.total)
        assert abs(n / 3000 - p) < 5 * math.sqrt(p * (1 - p) / 3000) + 1e-3
    assert cells.sampled_profile(rng, 50).path_sum(cells.insert) <= cells.total + 1e-9


SLOW = Model.jukes_cantor(rate=0.0003333, insrate=0.01, delrate=0.01, insext=0.09, delext=0.09)
TREE = trees.parse_newick("(seq1:.001,(seq2:1,seq3:1)parent23:1)root;")
# A published alignment and its reconstruction.
ROWS = {"seq1": "-ACCGGTT", "seq2": "AC---GTA", "seq3": "AA---G--"}
HISTORY = ["-ACCGGTT", "-AC--GTA", "AA-----G", "-**--***", "-*******"]


@pytest.mark.parametrize("o", [recon.Options(least_posterior=0.001, band=40), recon.Options(samples=100, band=40), recon.Options(band=None, samples=60)])
def test_progressive_reconstruction(o):
    seqs = [r.replace("-", "") for r in ROWS.values()]
    guide = [np.array([c != "-" for c in r]) for r in ROWS.values()]
    h = recon.reconstruct(SLOW, TREE, seqs, list(ROWS), o, guide)
    assert h.rows == HISTORY and h.path_loglik <= h.loglik


def test_reconstruction_of_empty_sequences_and_bad_input():
    t = trees.parse_newick("(a:1,b:1)r;")
    assert recon.reconstruct(JC, t, ["", ""], ["a", "b"]).rows == ["", "", ""]
    assert recon.reconstruct(JC, t, ["AC", ""], ["a", "b"]).rows[0].replace("-", "") == "AC"
    for names in (["a", "a"], ["a", "c"]):
        with pytest.raises(ValueError):
            recon.reconstruct(JC, t, ["A", "C"], names)
    with pytest.raises(ValueError):
        recon.reconstruct(JC, trees.parse_newick("(a:1,b:1,c:1)r;"), ["A", "C", "G"], ["a", "b", "c"])


def test_chain_has_the_histories_distribution():
    m = Model.jukes_cantor("AC", insrate=0.3, delrate=0.3, insext=0.3, delext=0.3)
    t = trees.parse_newick("(a:.5,b:.7)r;")
    start = sampler.History.of(m, t, ["A", "C", "*"])

    def key(h):
        # what a history's likelihood depends on: the paths of both branches, with the root's residues numbered
        out = []
        for v in (0, 1):
            n, steps = 0, []
            for s in sampler.moves_between(h, v):
                steps.append((s, n))
                n += s != "I"
            out.append(tuple(steps))
        return tuple(out)

    value: dict[tuple, float] = {}
    kinds = [(1, 1, 1), (1, 0, 1), (0, 1, 1), (0, 1, 0), (1, 0, 0), (0, 0, 1)]  # the last one by moves of branches only, so that the root has two residues at most
    for n in range(1, 5):
        for cols in itertools.product(kinds, repeat=n):
            if sum(c[0] for c in cols) == sum(c[1] for c in cols) == 1 and sum(c[2] for c in cols) <= 2:
                rows = ["".join(x if c[i] else "-" for c in cols) for i, x in enumerate("AC*")]
                h = sampler.History.of(m, t, rows)
                value[key(h)] = sampler.loglik(m, h)
    top = max(value.values())
    want = {k: math.exp(v - top) for k, v in value.items()}
    whole = sum(want.values())
    met: dict[tuple, int] = {}
    sampler.run(m, start, 4000, 3, fix_tree=True, width=None, log=lambda _, c: met.__setitem__(key(c.now), met.get(key(c.now), 0) + 1))
    assert set(met) <= set(want)
    assert all(abs(met.get(k, 0) / 4000 - v / whole) < 0.05 for k, v in want.items())


def test_moves_keep_sequences_and_refinement_gains():
    m = Model.jukes_cantor(insrate=0.1, delrate=0.1, insext=0.4, delext=0.4)
    t = trees.parse_newick("((a:.3,b:.3)x:.3,(c:.4,d:.4)y:.2)r;")
    seqs = ["ACGGTT", "ACTT", "ACTTA", "CCTTA"]
    h = sampler.History.of(m, t, recon.reconstruct(m, t, seqs, list("abcd")).rows)
    chain = sampler.run(m, h, 60, 5, population=1.0)
    for x in (chain.now, chain.best):
        rows = dict(zip((n.name for n in x.tree), x.rows(m), strict=True))
        assert [rows[n].replace("-", "") for n in "abcd"] == seqs
        assert all(n.parent > i or n.parent < 0 for i, n in enumerate(x.tree))
    assert chain.best_value >= sampler.loglik(m, h, 1.0)
    assert sampler.refine(m, h)[1] >= sampler.loglik(m, h)


def test_banded_pairs_and_random_graphs():
    m = Model.jukes_cantor(insrate=0.1, delrate=0.1, insext=0.5, delext=0.5)
    sub, gaps = pairdp.log_odds(m, 0.5), pairdp.gap_scores(m, 0.5)
    rng = np.random.default_rng(5)
    for _ in range(60):
        x, y = (rng.integers(0, 4, rng.integers(0, 9)) for _ in range(2))
        score, path = pairdp.viterbi_banded(x, y, sub, gaps, -9, 9)
        assert score == pytest.approx(pairdp.viterbi(x, y, sub, gaps)[0])
        assert (path != 2).sum() == len(x) and (path != 1).sum() == len(y)
    edges = pairdp.sparse_graph(30, 1)
    assert len(edges) >= math.ceil(30 * math.log2(30)) and len(pairdp.spanning_tree(30, [(a, b, 1.0) for a, b in edges])) == 29
    assert pairdp.sparse_graph(1, 1) == []


def test_tree_edits():
    t = trees.parse_newick("((a:1,b:2)c:3,(d:1,e:2)f:3)r;")
    at = {n.name: i for i, n in enumerate(t)}
    assert trees.format_newick(trees.detached(t, at["a"])) == "(b:5,(d:1,e:2)f:3)r;"
    assert trees.format_newick(trees.attached(t, at["a"], "x", 0.5, above=0.25)) == "(((a:0.25,x:0.5):0.75,b:2)c:3,(d:1,e:2)f:3)r;"
    assert trees.format_newick(trees.moved(t, at["a"], at["f"], 4)) == "(b:5,(d:1,e:2,a:4)f:3)r;"
    assert trees.format_newick(trees.subtree(t, at["c"])) == "(a:1,b:2)c;"
    with pytest.raises(ValueError):
        trees.moved(t, at["c"], at["a"], 1)


def test_models_from_tables():
    s = "1\n2 3\n\n.2 .3 .5\nnotes"
    m = models.parse_paml(s, "XYZ")
    assert m.rate() == pytest.approx(1) and m.components[0].rate[0, 1] / m.components[0].rate[0, 2] == pytest.approx(1 * 0.3 / (2 * 0.5))
    x = models.parse_xrate("(chain (initial (state (a)) (prob 0.4)) (initial (state (b)) (prob 0.6)) (mutate (from (a)) (to (b)) (rate 3)) (mutate (from (b)) (to (a)) (rate 2)))")
    assert x.alphabet == "ab" and x.components[0].rate[0, 1] == 3
    y = models.adjusted(x, gaprate=0.2, inslen=4, gapext=0.5, scale=2)
    assert (y.insrate, y.insext, y.delext) == (0.4, 0.5, 0.5) and y.components[0].rate[0, 1] == 6
    with pytest.raises(ValueError):
        models.parse_paml("1 2", "XYZ")


def test_families_options_and_writers(tmp_path):
    (tmp_path / "a.fa").write_text("".join(f">{n}\n{r}\n" for n, r in ROWS.items()))
    (tmp_path / "t.nh").write_text(trees.format_newick(TREE))
    (f,) = families.routed([str(tmp_path / "a.fa"), str(tmp_path / "t.nh")])
    assert f.tree is not None and not f.reconstructed and f.seqs["seq3"] == "AAG"
    text = sinks.written("stockholm", TREE, HISTORY)
    (tmp_path / "h.stk").write_text(text)
    (g,) = families.load(str(tmp_path / "h.stk"))
    assert g.reconstructed and [g.gapped[n.name] for n in g.tree] == HISTORY
    (tmp_path / "h.nex").write_text(sinks.written("nexus", TREE, HISTORY))
    assert families.load(str(tmp_path / "h.nex"))[0].reconstructed
    assert ">seq1\n-ACCGGTT\n" in sinks.written("fasta", TREE, HISTORY, leaves_only=True)
    o = parse(["recon", "-careful", "-norefine", "-band", "10", "x.fa", "-tree", "t.nh"])
    assert (o.band, o.refine, o.norefine, o.auto, o.tree) == (10, False, True, ("x.fa",), ("t.nh",))
    with pytest.raises(SystemExit):
        parse(["recon", "-nj", "-upgma"])
    cells = lattice("ACG", "ATGG", 0.2, 0.2)
    dot = sinks.dot(*sinks.sequence_graph(cells.likely_profile(0.05), JC, 0.1))
    assert dot.startswith("digraph") and "START" in dot and '"state"' in sinks.profile_json(cells.best_profile(), JC.alphabet)
