"""Models from files: JSON, PAML exchangeabilities, XRATE grammars, and models by name."""

from __future__ import annotations

import os
import re
from dataclasses import replace

import numpy as np

from ..functions.sequences import CODONS, GENETIC_CODE
from ..kernels.model import Model

# The order of amino acids in PAML's tables, names of models, and the indel parameters that named models come with.
AMINO = "ARNDCQEGHILKMFPSTWYV"
PAML_FILES = {"lg": "lg", "wag": "wag", "jtt": "jones", "dayhoff": "dayhoff", "ecmrest": "ECMrest", "ecmunrest": "ECMunrest"}
INDELS = {"insrate": 0.01, "delrate": 0.01, "insext": 0.66, "delext": 0.66}
#: one character for each codon that isn't a stop, in the order of CODONS
CODON_SYMBOLS = "".join(chr(33 + i + (i > 8) + (i > 11) + (i > 12)) for i in range(64))


def parse_paml(text: str, alphabet: str = AMINO, **indels: float) -> Model:
    """The lower triangle of exchangeabilities s, then the frequencies pi: rates s_ij pi_j, at one substitution a unit of time. What follows
    them is ignored."""
    n = len(alphabet)
    need = n * (n - 1) // 2 + n
    values: list[float] = []
    for word in text.split():
        if len(values) == need:
            break
        try:
            values.append(float(word))
        except ValueError as e:
            raise ValueError(f"{len(values)} numbers before {word!r}; {need} are needed") from e
    if len(values) < need:
        raise ValueError(f"{len(values)} numbers; {need} are needed")
    s = np.zeros((n, n))
    s[np.tril_indices(n, -1)] = values[: need - n]
    pi = np.array(values[need - n :])
    return Model.make(alphabet, [(1.0, pi, (s + s.T) * pi)], **(INDELS | indels)).normalised()


def parse_xrate(text: str, **indels: float) -> Model:
    """The chains of an XRATE grammar: initial and mutate lines; several chains are a mixture of equal weights."""
    parts, alphabet = [], ""
    for chunk in re.split(r"\(chain", text)[1:] or [text]:
        root = {m[1]: float(m[2]) for m in re.finditer(r"\(initial\s+\(state\s+\((.)\)\)\s+\(prob\s+([-+.0-9eE]+)\)", chunk)}
        if not root:
            continue
        rates = {(m[1], m[2]): float(m[3]) for m in re.finditer(r"\(mutate\s+\(from\s+\((.)\)\)\s+\(to\s+\((.)\)\)\s+\(rate\s+([-+.0-9eE]+)\)", chunk)}
        alphabet = alphabet or "".join(root)
        parts.append((1.0, np.array([root[a] for a in alphabet]), np.array([[rates.get((a, b), 0.0) for b in alphabet] for a in alphabet])))
    if not parts:
        raise ValueError("no chain in the grammar")
    return Model.make(alphabet, parts, **(INDELS | indels))


def named(name: str, folder: str | None = None) -> Model:
    """A model by name, whatever its case: jc and jcrna by rule, others from `<file>.dat` (PAML) or `<name>.json` in a folder of the published tables,
    by default that of CLADEWORKS_MODELS. Codon tables have 61 rows, of the codons that aren't stops."""
    key = name.lower()
    if key in ("jc", "jcrna"):
        return Model.jukes_cantor("ACGU" if key == "jcrna" else "ACGT", **INDELS)
    folder = folder or os.environ.get("CLADEWORKS_MODELS")
    if folder is None:
        raise ValueError(f"model {name!r} is read from a folder of published tables; none is given")
    for path, read in ((f"{PAML_FILES.get(key, key)}.dat", None), (f"{key}.json", Model.from_json)):
        full = os.path.join(folder, path)
        if os.path.exists(full):
            with open(full) as f:
                text = f.read()
            if read:
                return read(text)
            codon = key.startswith("ecm")
            return parse_paml(text, "".join(c for c, a in zip(CODON_SYMBOLS, GENETIC_CODE, strict=True) if a != "*") if codon else AMINO)
    raise ValueError(f"no table of model {name!r} in {folder}")


def load(text: str) -> Model:
    """A model from the text of a file: JSON, an XRATE grammar, or a PAML table of amino acids."""
    start = text.lstrip()[:1]
    return Model.from_json(text) if start == "{" else parse_xrate(text) if start in "(;" else parse_paml(text)


def adjusted(
    m: Model, *, normalise: bool = False, insrate: float | None = None, delrate: float | None = None, insext: float | None = None, delext: float | None = None, inslen: float | None = None, dellen: float | None = None,
    gaprate: float | None = None, gapext: float | None = None, gaplen: float | None = None, subscale: float = 1.0, indelscale: float = 1.0, scale: float = 1.0, gamma: int | None = None, shape: float = 1.0,
) -> Model:
    """A model with parameters set one after the other: normalised; insertion and deletion rates, extensions, or mean lengths; the same for both as gap...;
    scales of substitutions, of indels, and of both; rates by a discretised gamma distribution."""
    if normalise:
        m = m.normalised()
    extension = lambda length: 1 - 1 / length
    values = {"insrate": (insrate, gaprate), "delrate": (delrate, gaprate)}
    values |= {k: (own, None if length is None else extension(length), gapext, None if gaplen is None else extension(gaplen)) for k, own, length in (("insext", insext, inslen), ("delext", delext, dellen))}
    chosen = {k: [v for v in vs if v is not None] for k, vs in values.items()}
    m = replace(m, **{k: v[-1] for k, v in chosen.items() if v})
    m = m.scaled(subscale * scale, indelscale * scale)
    return m if gamma is None else m.gamma(gamma, shape)


def finite_time_json(m: Model, t: float) -> str:
    """What a branch of length t does: substitution probabilities, and those of beginning and extending indels."""
    import json

    p = m.probs(t)
    moves = m.transitions(t)
    parts = [{"weight": c.weight, "rootprob": dict(zip(m.alphabet, c.root.tolist(), strict=True)), "subprob": {a: dict(zip(m.alphabet, row.tolist(), strict=True)) for a, row in zip(m.alphabet, q, strict=True)}} for c, q in zip(m.components, p, strict=True)]
    delete = moves["M", "D"] / (1 - moves["M", "I"]) if moves["M", "I"] < 1 else 0.0
    return json.dumps({"alphabet": m.alphabet, "time": t, "insprob": moves["M", "I"], "delprob": delete, "insextprob": m.insext, "delextprob": m.delext, **(parts[0] if len(parts) == 1 else {"mixture": parts})})


assert len(CODONS) == len(set(CODON_SYMBOLS)) == 64
