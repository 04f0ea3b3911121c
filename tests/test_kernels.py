import itertools
import json

import numpy as np
import pytest

from cladeworks.kernels import model as km, pairdp, simulate, sumprod, trees
from cladeworks.kernels.model import Counts, Model

INDEL = {"insrate": 0.01, "delrate": 0.01, "insext": 0.09, "delext": 0.09}


def columns(model, newick, rows):
    tree = trees.parse_newick(newick)
    code = {"-": -1, "*": -2} | {s: i for i, s in enumerate(model.alphabet)}
    tokens = np.array([[code[x] for x in rows[n.name]] for n in tree]).T
    c = sumprod.Columns(model, np.array([n.parent for n in tree]), np.array([n.blen for n in tree]), tokens)
    c.fill_down()
    return c


HISTORY = {"root": "-*******", "seq1": "-ACCGGTT", "parent23": "**---***", "seq2": "AC---GTA", "seq3": "AA---G--"}
NEWICK = "(seq1:.001,(seq2:1,seq3:1)parent23:1)root;"


def test_counts_and_likelihood_of_a_history():
    m = Model.jukes_cantor(rate=0.0003333, **INDEL)
    c = columns(m, NEWICK, HISTORY)
    indels, branches = sumprod.indel_counts(m, c.parent, c.blen, c.tokens != -1, km.decay_wait)
    assert indels == pytest.approx([1, 2, 0, 3, 10.5062, 11.0053], rel=1e-5)
    assert branches + c.loglik.sum() == pytest.approx(-48.0077, rel=1e-5)


def test_counts_of_one_column():
    c = columns(Model.jukes_cantor(rate=0.3333), "(seq1:.99,seq2:.01)root;", {"seq1": "A", "seq2": "T", "root": "*"})
    for got in (c.counts(), c.counts(eigen=False)):
        assert got.root[0] == pytest.approx([0.00810002, 0.00329497, 0.00329497, 0.98531], rel=1e-5)
        assert got.sub[0, 0, 3] == pytest.approx(0.0260726, rel=1e-5)
        assert got.sub[0, 3, 0] == pytest.approx(0.748559, rel=1e-5)
        assert got.sub[0, 0, 0] == pytest.approx(0.446029, rel=1e-5)


def test_likelihood_against_enumeration():
    m = Model.make("AB", [(1, None, np.array([[0, 0.7], [0.2, 0]])), (2, None, np.array([[0, 0.1], [0.5, 0]]))])
    c = columns(m, "((x:.3,y:.5)p:.2,z:.7)r;", {"x": "AB", "y": "BB", "z": "AA", "p": "**", "r": "**"})
    for col, (x, y, z) in enumerate([(0, 1, 0), (1, 1, 0)]):
        want = 0.0
        for w, part in zip(m.components, range(2), strict=True):
            p = [m.probs(t)[part] for t in (0.3, 0.5, 0.2, 0.7)]
            want += w.weight * sum(w.root[r] * p[2][r, q] * p[0][q, x] * p[1][q, y] * p[3][r, z] for r, q in itertools.product(range(2), repeat=2))
        assert c.loglik[col] == pytest.approx(np.log(want))
    assert c.posterior()[3].sum(1) == pytest.approx([1, 1])


def test_model_algebra():
    m = Model.from_json(json.dumps({"alphabet": "ACGT", "insrate": 0.1, "mixture": [{"subrate": {"A": {"C": 1}, "C": {"G": 1}, "G": {"T": 1}, "T": {"A": 1}}}, {"subrate": {"A": {"T": 1}, "T": {"G": 1}, "G": {"C": 1}, "C": {"A": 1}}}]}))
    assert np.allclose(m.with_eigen().probs(0.7), m.probs(0.7))  # complex eigenvalues
    assert np.allclose(m.probs(0.3) @ m.probs(0.4), m.probs(0.7))
    assert Model.from_json(m.to_json()).to_json() == m.to_json()
    assert m.normalised().rate() == pytest.approx(1)
    assert np.mean([-c.rate[0, 0] for c in Model.jukes_cantor().gamma(4, 0.5).components]) == pytest.approx(1)
    for state in "MID":
        assert sum(p for (a, b), p in m.transitions(0.5).items() if a == state and b in "MID") == pytest.approx(1)


def test_em_step_raises_likelihood():
    m = Model.jukes_cantor(rate=0.2)
    rng = np.random.default_rng(3)
    rows = {n: "".join(rng.choice(list("ACGT"), 60)) for n in ("x", "y", "z")} | {"p": "*" * 60, "r": "*" * 60}
    last = -np.inf
    for _ in range(4):
        c = columns(m, "((x:.3,y:.5)p:.2,z:.7)r;", rows)
        assert c.loglik.sum() >= last - 1e-9
        last, m = c.loglik.sum(), c.counts().maximise(m, fix_indel=True)


def test_counts_json_round_trip_and_a_missing_comma():
    a = Counts(np.array([[1.0, 2.0]]), np.array([[[0.5, 3.0], [4.0, 0.25]]]), np.arange(6.0), -7.0)
    text = a.to_json("AB")
    b = Counts.from_json(text)
    assert np.allclose(a.sub, b.sub) and np.allclose(a.indel, b.indel) and b.loglik == -7
    broken = '{\n "alphabet": "AB",\n "indel": {\n "ins": 1,\n "del": 2,\n "insExt": 0,\n "delExt": 3,\n "insTime": 4.5\n "delTime": 5.5\n },\n "sub": {"root": {"A": 1, "B": 2}, "sub": {"A": {"B": 3}}, "wait": {"A": 1}}\n}'
    assert Counts.from_json(broken).indel.tolist() == [1, 2, 0, 3, 4.5, 5.5]


def test_trees_from_distances():
    s = {"seq2": "aaaagg", "seq3": "aacccc", "seq1": "aaaaaa", "seq4": "aattcc"}
    rate = 0.3333 * 4 / 4
    d = np.array([[-np.log(1 - 4 / 3 * sum(x != y for x, y in zip(s[a], s[b], strict=True)) / 6) / 4 / rate for b in s] for a in s])
    assert trees.format_newick(trees.neighbour_joining(d, list(s))) == "((seq2:0.220442,seq1:0.220442):0.6036,(seq3:0.220442,seq4:0.220442):0.6036);"
    assert trees.format_newick(trees.upgma(d, list(s))) == "((seq2:0.220442,seq1:0.220442):0.824042,(seq3:0.220442,seq4:0.220442):0.824042);"
    assert "0.6036" in trees.format_newick(trees.upgma(d, list(s), textbook=True))


def test_newick():
    t = trees.parse_newick("(((A:1,B:2)C:3,(D:0.1,E:0.2)F:.3)G:0.01,(H:4,I:5)J:6)X;")
    rerooted = trees.reroot_above(t, [n.name for n in t].index("C"))
    assert trees.format_newick(rerooted) == "((A:1,B:2)C:1.5,((D:0.1,E:0.2)F:0.3,(H:4,I:5)J:6.01)G:1.5)root;"
    assert trees.format_newick(trees.parse_newick("(a[note]:1,b:2[&&NHX:B=1])r;")) == "(a:1,b:2)r;"
    for bad in ("(a:1,a:2);", "((a,b);", "(a,b));"):
        with pytest.raises(ValueError):
            trees.parse_newick(bad)


def test_merge():
    bits = lambda r: np.array([x != "-" for x in r])
    got = pairdp.merge([{0: bits("abc---ghi"), 1: bits("a-cdefghi")}, {0: bits("abcghi"), 2: bits("-bcghi")}])
    assert ["".join("x" if x else "-" for x in got[r]) for r in range(3)] == ["xxx---xxx", "x-xxxxxxx", "-xx---xxx"]
    with pytest.raises(ValueError):
        pairdp.merge([{0: bits("ab-"), 1: bits("-ab")}, {0: bits("-ab"), 1: bits("ab-")}])
    with pytest.raises(ValueError):
        pairdp.merge([{0: bits("ab"), 1: bits("ab")}, {0: bits("abc"), 2: bits("abc")}])


def test_viterbi_against_all_alignments():
    m = Model.jukes_cantor(insrate=0.1, delrate=0.1, insext=0.5, delext=0.5)
    sub, (keep, opened, ext) = pairdp.log_odds(m, 0.5), pairdp.gap_scores(m, 0.5)

    def best(x, y, prev=0):
        if not len(x) and not len(y):
            return 0.0
        out = -np.inf
        if len(x) and len(y):
            out = max(out, keep + sub[x[0], y[0]] + best(x[1:], y[1:]))
        if len(x):
            out = max(out, (ext if prev == 1 else opened) + best(x[1:], y, 1))
        if len(y):
            out = max(out, (ext if prev == 2 else opened) + best(x, y[1:], 2))
        return out

    rng = np.random.default_rng(5)
    xs, ys = ([rng.integers(0, 4, rng.integers(0, 6)) for _ in range(20)] for _ in range(2))
    for (score, _), x, y in zip(pairdp.viterbi_batch(xs, ys, sub, (keep, opened, ext)), xs, ys, strict=True):
        assert score == pytest.approx(best(x, y))


def test_simulated_rows_agree():
    rows = simulate.history(Model.jukes_cantor(insrate=0.2, delrate=0.2, insext=0.5, delext=0.5), [2, 2, -1], [0.5, 0.8, 0.0], 40, 7)
    assert len({len(r) for r in rows}) == 1 and len(rows[2].replace("-", "")) == 40
