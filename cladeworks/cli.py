"""The command line: python -m cladeworks [recon | mcmc | count | sum | fit | generate] options files."""

from __future__ import annotations

import sys

import numpy as np

from . import sinks
from .kernels import model as km, recon, sampler, simulate, sumprod, trees
from .kernels.model import Counts, Model
from .options import Options, parse
from .sources import families as fam, models


def the_model(o: Options) -> Model:
    m = models.load(fam.text_of(o.model)) if o.model else models.named(o.preset or "lg", o.tables)
    m = models.adjusted(
        m, normalise=o.normalize, insrate=o.insrate, delrate=o.delrate, insext=o.insextprob, delext=o.delextprob, inslen=o.inslen, dellen=o.dellen, gaprate=o.gaprate, gapext=o.gapextprob, gaplen=o.gaplen,
        subscale=o.subscale, indelscale=o.indelscale, scale=o.scale, gamma=o.gamma, shape=o.shape,
    )
    if o.savemodel:
        with open(o.savemodel, "w") as f:
            f.write(m.to_json() + "\n")
    return m


def the_families(o: Options) -> list[fam.Family]:
    """Families of all input files. Sequences and guides are made anew where they aren't given as finished (-recon, -nexusrecon, -stockrecon)."""
    done = fam.routed([*o.recon, *o.nexusrecon, *o.stockrecon, *(o.tree if o.recon else ())], reroot=o.reroot) if o.recon or o.nexusrecon or o.stockrecon else []
    for f in done:
        if not f.reconstructed:
            raise ValueError(f"family {f.name!r} has nodes without a name or a row")
    rest = fam.routed([*o.auto, *o.seqs, *o.guide, *o.nexus, *o.stockholm, *(() if o.recon else o.tree)], reroot=o.reroot)
    return done + rest


def reconstructed(families: list[fam.Family], m: Model, o: Options) -> dict[str, tuple[list[trees.Node], list[str]]]:
    """Trees and rows of families by name. Those that aren't reconstructions go through Spark: guides and trees that are missing, and histories."""
    out = {f.name: (f.tree, [f.gapped[n.name] for n in f.tree]) for f in families if f.reconstructed and o.verb != "recon"}
    open_ = [f for f in families if f.name not in out]
    if open_:
        from pyspark.sql import SparkSession, functions as F

        from .operators import chains, reconstruction, workflow

        spark = SparkSession.builder.appName("cladeworks").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        seqs, given = fam.frames(spark, open_)
        bare = [f.name for f in open_ if not f.gapped]
        guide = seqs.where("gapped IS NOT NULL").select("ds", "name", "gapped")
        if bare:
            k = {} if o.kmatchoff else {"kmatch": o.kmatch, "kmatchn": o.kmatchn, "band": o.kmatchband}
            guide = guide.union(workflow.guides(seqs.where(F.col("ds").isin(bare)).select("ds", "name", "seq"), m, sparse=o.rndspan, seed=o.seed, **k))
        guide = guide.cache()
        leaves = seqs.join(given.groupBy("ds").agg(F.count("*").alias("n")), "ds", "left_anti").select("ds", "name")
        tree = given.union(workflow.trees_of(guide.join(leaves, ["ds", "name"], "left_semi"), m, method="nj" if o.nj else "upgma", jc=o.jc))
        tree = tree.cache()
        options = recon.Options(band=None if o.noband else o.band, samples=o.profsamples, least_posterior=o.profminpost, most_states=o.profmaxstates, best=not o.nobest, keep_gaps=o.keepgapsopen, seed=o.seed)
        rows = reconstruction.reconstruct(seqs.select("ds", "name", "seq").join(guide, ["ds", "name"], "left"), tree, m, options)
        whole = rows.select("ds", "node", "gapped").join(tree, ["ds", "node"])
        if o.refine and not o.norefine:
            whole = chains.refined(whole, m)
        got: dict[str, list] = {}
        for r in whole.collect():  # the histories that are written out
            got.setdefault(r.ds, []).append((r.node, r.parent, r["name"], r.blen, r.gapped))
        for name, nodes in got.items():
            nodes.sort()
            out[name] = [trees.Node(p, n, t) for _, p, n, t, _ in nodes], [g for *_, g in nodes]
    return out


def ancestral(m: Model, tree: list[trees.Node], rows: list[str], least: float) -> tuple[list[str], dict[str, list[list[tuple[str, float]]]]]:
    """Rows with the likeliest residues of ancestors, and their posteriors of at least `least` by node and column."""
    h = sampler.History.of(m, tree, rows)
    c = sumprod.Columns(m, h.parent, h.blen, h.tokens)
    c.fill_down()
    post = c.posterior()
    kids = trees.children(tree)
    best = [r if not kids[v] else "".join("-" if x in "-." else m.alphabet[int(p.argmax())] for x, p in zip(r, post[v], strict=True)) for v, r in enumerate(rows)]
    named = trees.name_inner(tree)
    return best, {named[v].name: [[(m.alphabet[i], float(p[i])) for i in np.flatnonzero(p >= least)] for p in post[v]] for v in range(len(tree)) if kids[v]}


def counted(m: Model, tree: list[trees.Node], rows: list[str]) -> Counts:
    h = sampler.History.of(m, tree, rows)
    c = sumprod.Columns(m, h.parent, h.blen, h.tokens)
    c.fill_down()
    out = c.counts()
    indels, branches = sumprod.indel_counts(m, h.parent, h.blen, h.tokens != sumprod.GAP, km.decay_wait)
    return Counts(out.root, out.sub, indels, out.loglik + branches)


def _written(o: Options, texts: list[str]) -> None:
    text = "".join(texts)
    if o.out:
        with open(o.out, "w") as f:
            f.write(text)
    else:
        sys.stdout.write(text)


def run(o: Options) -> None:
    if o.verb == "sum":
        total = None
        alphabet = ""
        for path in o.counts:
            text = fam.text_of(path)
            import json
            import re

            alphabet = re.search(r'"alphabet"\s*:\s*("[^"]*")', text)[1]
            alphabet = json.loads(alphabet)
            one = Counts.from_json(text)
            total = one if total is None else total + one
        _written(o, [] if total is None else [total.to_json(alphabet) + "\n"])
        return
    m = the_model(o)
    if o.verb == "generate":
        out = []
        for i, path in enumerate(o.tree):
            tree = trees.name_inner(trees.parse_newick(fam.text_of(path)))
            for r in range(o.replicates):
                rows = simulate.history(m, [n.parent for n in tree], [max(n.blen, 0.0) for n in tree], o.rootlen, o.seed + 1_000_003 * i + r)
                out.append(sinks.written(o.output, tree, rows, leaves_only=o.noancs))
        _written(o, out)
        return
    done = reconstructed(the_families(o), m, o)
    if o.verb in ("count", "fit"):
        prior = sum((Counts.from_json(fam.text_of(p)) for p in o.counts), Counts.zero(len(m.components), len(m.alphabet)))
        if o.verb == "fit" and not o.nolaplace:
            prior = prior + Counts(np.ones_like(prior.root), np.ones_like(prior.sub), np.ones(6))
        trace: list[float] = []
        for _ in range(o.maxiter if o.verb == "fit" and done else 1):
            total = sum((counted(m, t, r) for t, r in done.values()), Counts.zero(len(m.components), len(m.alphabet)))
            if o.verb == "count":
                _written(o, [total.to_json(m.alphabet) + "\n"])
                return
            trace.append(total.loglik + prior.log_prior(m))
            if len(trace) > 1 and trace[-1] - trace[-2] <= o.mininc * abs(trace[-2]):
                break
            m = (total + prior).maximise(m, fix_sub=o.fixsubrates, fix_indel=o.fixgaprates)
        _written(o, [m.to_json() + "\n"])
        return
    out = []
    for tree, rows in done.values():
        notes, post = {}, None
        if o.verb == "mcmc" or o.mcmc:
            lines: list[str] = []
            log = (lambda step, c, lines=lines: lines.append(sinks.trace_line(step, list(c.now.tree), c.now.rows(m), c.value))) if o.trace else None
            start = sampler.History.of(m, trees.name_inner(tree), rows)
            c = sampler.run(m.with_eigen(), start, o.samples * len(tree), o.seed, population=o.population, width=None if o.noband else o.band, fix_tree=o.fixtree, fix_alignment=o.fixalign, log=log)
            tree, rows, notes = list(c.best.tree), c.best.rows(m), {"LP": f"{c.best_value:.6f}"}
            if o.trace:
                with open(o.trace, "a") as f:
                    f.writelines(lines)
        if o.ancseq or o.ancprob:
            best, post = ancestral(m, tree, rows, o.minpost)
            rows, post = (best if o.ancseq else rows), (post if o.ancprob else None)
        out.append(sinks.written(o.output, tree, rows, leaves_only=o.noancs, wildcard=m.wildcard, notes=notes, posteriors=post))
    _written(o, out)


def main(args: list[str] | None = None) -> None:
    o = parse(sys.argv[1:] if args is None else args)
    if o.gaprate is not None and o.gaprate < 0:
        raise SystemExit("rates can't be negative")
    run(o)
