"""Options of the command line as one frozen record, and their parser."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Options:
    """Every switch of the command line. Files come first; numbers that are None keep what the model has."""

    verb: str = "recon"
    # input
    auto: tuple[str, ...] = ()
    seqs: tuple[str, ...] = ()
    guide: tuple[str, ...] = ()
    nexus: tuple[str, ...] = ()
    stockholm: tuple[str, ...] = ()
    tree: tuple[str, ...] = ()
    recon: tuple[str, ...] = ()
    nexusrecon: tuple[str, ...] = ()
    stockrecon: tuple[str, ...] = ()
    counts: tuple[str, ...] = ()
    reroot: str | None = None
    # model
    model: str | None = None
    preset: str | None = None
    tables: str | None = None
    normalize: bool = False
    insrate: float | None = None
    delrate: float | None = None
    insextprob: float | None = None
    delextprob: float | None = None
    inslen: float | None = None
    dellen: float | None = None
    gaprate: float | None = None
    gapextprob: float | None = None
    gaplen: float | None = None
    subscale: float = 1.0
    indelscale: float = 1.0
    scale: float = 1.0
    gamma: int | None = None
    shape: float = 1.0
    codon: bool = False
    savemodel: str | None = None
    # guide and tree
    allspan: bool = False
    rndspan: bool = False
    nj: bool = False
    upgma: bool = False
    jc: bool = False
    kmatch: int = 6
    kmatchn: int | None = None
    kmatchband: int = 64
    kmatchoff: bool = False
    saveguide: str | None = None
    # profiles
    band: int = 20
    noband: bool = False
    profsamples: int = 10
    profminpost: float | None = None
    profmaxstates: int = 0
    profmaxmem: float = 5.0
    nobest: bool = False
    keepgapsopen: bool = False
    # what comes after
    refine: bool = False
    norefine: bool = False
    mcmc: bool = False
    samples: int = 100
    trace: str | None = None
    fixtree: bool = False
    fixalign: bool = False
    population: float | None = None
    ancseq: bool = False
    ancprob: bool = False
    minpost: float = 0.01
    noancs: bool = False
    savedot: str | None = None
    # counting, fitting, simulating
    nolaplace: bool = False
    maxiter: int = 100
    mininc: float = 0.001
    fixsubrates: bool = False
    fixgaprates: bool = False
    rootlen: int = 100
    replicates: int = 1
    # everything
    fast: bool = False
    careful: bool = False
    output: str = "stockholm"
    out: str | None = None
    seed: int = 5489
    verbose: bool = False


VERBS = {"recon": "recon", "reconstruct": "recon", "r": "recon", "generate": "generate", "g": "generate", "mcmc": "mcmc", "m": "mcmc", "count": "count", "c": "count", "sum": "sum", "s": "sum", "fit": "fit", "f": "fit"}
BUNDLES = {
    "fast": {"rndspan": True, "kmatchn": 3, "band": 10, "profmaxstates": 1, "jc": True, "norefine": True},
    "careful": {"allspan": True, "kmatchoff": True, "band": 40, "profminpost": 0.001, "refine": True},
}
ONE_OF = [("model", "preset"), ("allspan", "rndspan"), ("nj", "upgma"), ("refine", "norefine"), ("noband", "band"), ("insextprob", "inslen"), ("delextprob", "dellen"), ("gapextprob", "gaplen"), ("fast", "careful")]
OUTPUTS = ("stockholm", "fasta", "nexus", "json")


def parse(args: list[str]) -> Options:
    """A verb (recon, if none is given), options with one dash or two, and files, which are taken for what they are. An option given overrides those that
    -fast and -careful stand for."""
    verb = VERBS.get(args[0]) if args else None
    args = list(args[1:] if verb else args)
    p = argparse.ArgumentParser(prog="cladeworks", allow_abbrev=False, argument_default=argparse.SUPPRESS, description="Evolutionary sequence analytics: " + ", ".join(sorted(set(VERBS.values()))))
    for f in fields(Options):
        if f.name in ("verb", "auto"):
            continue
        names = (f"-{f.name}", f"--{f.name}")
        if f.type == "bool":
            p.add_argument(*names, action="store_true")
        elif f.type.startswith("tuple"):
            p.add_argument(*names, action="append")
        else:
            kind = {"int": int, "float": float, "str": str}[f.type.split(" ")[0]]
            p.add_argument(*names, type=kind, **({"choices": OUTPUTS} if f.name == "output" else {}))
    p.add_argument("-auto", "--auto", action="append")
    p.add_argument("files", nargs="*", default=[])
    got = vars(p.parse_intermixed_args(args))
    files = got.pop("files")
    if isinstance(got.get("auto", []), str):
        got["auto"] = [got["auto"]]
    got = {k: tuple(v) if isinstance(v, list) else v for k, v in got.items()}
    if files:
        role = {"sum": "counts", "generate": "tree"}.get(verb or "recon", "auto")
        got[role] = (*got.get(role, ()), *files)
    for a, b in ONE_OF:
        if a in got and b in got:
            p.error(f"-{a} and -{b} exclude each other")
    for bundle, values in BUNDLES.items():
        if got.get(bundle):
            got = {k: v for k, v in values.items() if not any(k in pair and (set(pair) - {k}) & set(got) for pair in ONE_OF)} | got
    return Options(verb=verb or "recon", **got)
