"""Continuous-time models of substitution, insertion and deletion.

A model is a mixture of components; each has a weight, a root distribution and a rate matrix whose rows sum to zero. Indels open at
rates `insrate` and `delrate` and extend with geometric probabilities.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace

import numpy as np


def equilibrium(rate: np.ndarray) -> np.ndarray:
    """The distribution p with p R = 0, by least squares, clipped at zero and scaled to one."""
    n = len(rate)
    p = np.linalg.lstsq(np.vstack([rate.T, np.ones(n)]), np.append(np.zeros(n), 1.0), rcond=None)[0]
    p = np.clip(p, 0, None)
    return p / p.sum()


def expm(a: np.ndarray) -> np.ndarray:
    """The matrix exponential by scaling, a Taylor series and squaring."""
    s = max(0, int(math.ceil(math.log2(max(1e-300, np.abs(a).sum(1).max())))) + 4)
    x, term, out = a / 2.0**s, np.eye(len(a)), np.eye(len(a))
    for k in range(1, 19):
        term = term @ x / k
        out = out + term
    for _ in range(s):
        out = out @ out
    return out


@dataclass(frozen=True)
class Component:
    weight: float
    root: np.ndarray
    rate: np.ndarray


@dataclass(frozen=True)
class Eigen:
    """The spectral form of a rate matrix: values, right vectors and their inverse; complex where it must be."""

    values: np.ndarray
    right: np.ndarray
    left: np.ndarray

    @classmethod
    def of(cls, rate: np.ndarray) -> Eigen:
        values, right = np.linalg.eig(rate)
        if np.abs(values.imag).max() < 1e-12:
            values, right = values.real, right.real
        return cls(values, right, np.linalg.inv(right))

    def probs(self, t: float) -> np.ndarray:
        return np.clip(((self.right * np.exp(self.values * t)) @ self.left).real, 0, 1)

    def occupancy(self, t: float) -> np.ndarray:
        """J_kl: the integral over s in [0, t] of exp(k s) exp(l (t - s)) for all pairs of eigenvalues."""
        v = self.values
        e = np.exp(v * t)
        d = v[:, None] - v[None]
        near = np.abs(d) <= 1e-6 * np.maximum(1e-300, np.maximum(np.abs(v)[:, None], np.abs(v)[None]))
        return np.where(near, t * e[:, None], (e[:, None] - e[None]) / np.where(near, 1, d))


@dataclass(frozen=True)
class Model:
    alphabet: str
    components: tuple[Component, ...]
    insrate: float = 0.0
    delrate: float = 0.0
    insext: float = 0.0
    delext: float = 0.0
    wildcard: str = "*"
    eigen: tuple[Eigen, ...] = field(default=(), compare=False, repr=False)

    @classmethod
    def make(cls, alphabet: str, parts: list[tuple[float, np.ndarray | None, np.ndarray]], **indels: float) -> Model:
        total = sum(p[0] for p in parts)
        out = []
        for w, root, rate in parts:
            rate = np.array(rate, float)
            np.fill_diagonal(rate, 0)
            np.fill_diagonal(rate, -rate.sum(1))
            out.append(Component(w / total, equilibrium(rate) if root is None else np.array(root, float) / np.sum(root), rate))
        return cls(alphabet, tuple(out), **indels)

    @classmethod
    def jukes_cantor(cls, alphabet: str = "ACGT", rate: float | None = None, **indels: float) -> Model:
        """All exchanges at one rate; by default one expected substitution a unit of time."""
        n = len(alphabet)
        return cls.make(alphabet, [(1.0, np.full(n, 1 / n), np.full((n, n), 1 / (n - 1) if rate is None else rate))], **indels)

    @classmethod
    def from_json(cls, text: str) -> Model:
        """Keys alphabet, wildcard, insrate, insextprob, delrate, delextprob, and rootprob and subrate, or a mixture of such with weights."""
        d = json.loads(text)
        alphabet = d["alphabet"]

        def component(x: dict) -> tuple[float, np.ndarray | None, np.ndarray]:
            rate = np.array([[x["subrate"].get(a, {}).get(b, 0.0) if a != b else 0.0 for b in alphabet] for a in alphabet])
            return x.get("weight", 1.0), np.array([x["rootprob"].get(a, 0.0) for a in alphabet]) if "rootprob" in x else None, rate

        names = {"insrate": "insrate", "delrate": "delrate", "insextprob": "insext", "delextprob": "delext"}
        return cls.make(alphabet, [component(x) for x in d.get("mixture", [d])], wildcard=d.get("wildcard", "*"), **{v: d.get(k, 0.0) for k, v in names.items()})

    def to_json(self) -> str:
        def component(x: Component) -> dict:
            return {"rootprob": dict(zip(self.alphabet, x.root.tolist(), strict=True)), "subrate": {a: {b: x.rate[i, j] for j, b in enumerate(self.alphabet) if i != j} for i, a in enumerate(self.alphabet)}}

        out = {"alphabet": self.alphabet, "wildcard": self.wildcard, "insrate": self.insrate, "insextprob": self.insext, "delrate": self.delrate, "delextprob": self.delext}
        parts = [component(x) for x in self.components]
        return json.dumps(out | (parts[0] if len(parts) == 1 else {"mixture": [{"weight": x.weight} | p for x, p in zip(self.components, parts, strict=True)]}))

    def with_eigen(self) -> Model:
        return replace(self, eigen=tuple(Eigen.of(x.rate) for x in self.components))

    def probs(self, t: float) -> np.ndarray:
        """P(t) of each component (components, n, n)."""
        return np.stack([e.probs(t) for e in self.eigen] if self.eigen else [np.clip(expm(x.rate * t), 0, 1) for x in self.components])

    def rate(self) -> float:
        """Expected substitutions a unit of time."""
        return float(sum(-x.weight * (x.root * np.diag(x.rate)).sum() for x in self.components))

    def scaled(self, substitution: float = 1.0, indel: float = 1.0) -> Model:
        return replace(self, components=tuple(replace(x, rate=x.rate * substitution) for x in self.components), insrate=self.insrate * indel, delrate=self.delrate * indel, eigen=())

    def normalised(self) -> Model:
        return self.scaled(1 / self.rate())

    def gamma(self, bins: int, shape: float) -> Model:
        """A mixture of the single component at `bins` rates: quantiles (c + 1) / (bins + 1) of a gamma distribution, divided by their mean."""
        if len(self.components) != 1:
            raise ValueError("only a model of one component takes gamma rates")
        q = np.array([gamma_quantile((i + 1) / (bins + 1), shape) for i in range(bins)])
        one = self.components[0]
        return replace(self, components=tuple(Component(1 / bins, one.root, one.rate * x) for x in q / q.mean()), eigen=())

    def transitions(self, t: float) -> dict[tuple[str, str], float]:
        """Probabilities of a branch's moves between match, insert, delete and end."""
        i, d, x, y = 1 - math.exp(-self.insrate * t), 1 - math.exp(-self.delrate * t), self.insext, self.delext
        return {
            ("M", "M"): (1 - i) * (1 - d), ("M", "I"): i, ("M", "D"): (1 - i) * d, ("M", "E"): 1 - i,
            ("I", "M"): (1 - x) * (1 - d), ("I", "I"): x, ("I", "D"): (1 - x) * d, ("I", "E"): 1 - x,
            ("D", "M"): 1 - y, ("D", "I"): 0.0, ("D", "D"): y, ("D", "E"): 1 - y,
        }


def gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 0.0
    lead = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return lead * total
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for k in range(1, 10_000):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - lead * h


def gamma_quantile(p: float, shape: float) -> float:
    """The inverse of the distribution function of Gamma(shape, scale=shape), by bisection."""
    lo, hi = 0.0, max(1.0, shape)
    while gamma_p(shape, hi) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gamma_p(shape, mid) < p else (lo, mid)
    return (lo + hi) / 2 * shape


def decay_wait(rate: float, t: float) -> float:
    """Expected time of a decay that is known to happen within t."""
    return 1 / rate - t / math.expm1(rate * t)


def xlogy(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.where(x == 0, 0.0, x * np.log(np.where(x == 0, 1.0, y)))


@dataclass
class Counts:
    """Sufficient statistics: a commutative monoid under +. Diagonals of sub are waiting times."""

    root: np.ndarray  # (components, n)
    sub: np.ndarray  # (components, n, n)
    indel: np.ndarray  # ins, del, insExt, delExt, insTime, delTime
    loglik: float = 0.0

    def __add__(self, o: Counts) -> Counts:
        return Counts(self.root + o.root, self.sub + o.sub, self.indel + o.indel, self.loglik + o.loglik)

    @classmethod
    def zero(cls, components: int, n: int) -> Counts:
        return cls(np.zeros((components, n)), np.zeros((components, n, n)), np.zeros(6))

    def maximise(self, m: Model, *, fix_sub: bool = False, fix_indel: bool = False) -> Model:
        """The M step: ratios of counts to waiting times."""
        if not fix_sub:
            parts = []
            for root, sub in zip(self.root, self.sub, strict=True):
                wait = np.diag(sub).copy()
                rate = np.where(wait[:, None] > 0, sub / np.where(wait > 0, wait, 1)[:, None], 0)
                parts.append((float(root.sum()) or 1e-300, root / root.sum() if root.sum() else None, rate))
            new = Model.make(m.alphabet, parts)
            m = replace(m, components=new.components, eigen=())
        if not fix_indel:
            ins, dele, insx, delx, ti, td = self.indel
            ratio = lambda a, b, old: float(a / b) if b > 0 else old
            m = replace(m, insrate=ratio(ins, ti, m.insrate), delrate=ratio(dele, td, m.delrate), insext=ratio(insx, insx + ins, m.insext), delext=ratio(delx, delx + dele, m.delext))
        return m

    def expected_loglik(self, m: Model) -> float:
        """The expected complete log likelihood under m, with 0 log 0 = 0."""
        ins, dele, insx, delx, ti, td = self.indel
        out = -m.insrate * ti - m.delrate * td
        for a, b in ((ins, m.insrate), (dele, m.delrate), (insx, m.insext), (ins, 1 - m.insext), (delx, m.delext), (dele, 1 - m.delext)):
            out += float(xlogy(np.array(a), np.array(b)))
        for c, root, sub in zip(m.components, self.root, self.sub, strict=True):
            off = ~np.eye(len(sub), dtype=bool)
            out += float(xlogy(root, c.root * c.weight).sum() + xlogy(sub[off], c.rate[off]).sum() + (np.diag(sub) * np.diag(c.rate)).sum())
        return out

    def log_prior(self, m: Model) -> float:
        """Gamma densities of rates, Beta of extensions, Dirichlet of root distributions, with these counts as pseudocounts."""
        ins, dele, insx, delx, ti, td = self.indel
        gamma = lambda x, n, t: (n + 1) * math.log(t) - math.lgamma(n + 1) + n * math.log(x) - t * x if t > 0 and x > 0 else 0.0
        beta = lambda p, a, b: math.lgamma(a + b + 2) - math.lgamma(a + 1) - math.lgamma(b + 1) + a * math.log(p) + b * math.log(1 - p) if 0 < p < 1 else 0.0
        out = gamma(m.insrate, ins, ti) + gamma(m.delrate, dele, td) + beta(m.insext, insx, ins) + beta(m.delext, delx, dele)
        for c, root, sub in zip(m.components, self.root, self.sub, strict=True):
            out += math.lgamma((root + 1).sum()) - sum(map(math.lgamma, root + 1)) + float(xlogy(root, c.root).sum())
            out += sum(gamma(c.rate[i, j], sub[i, j], sub[i, i]) for i in range(len(sub)) for j in range(len(sub)) if i != j)
        return out

    def to_json(self, alphabet: str) -> str:
        names = ("ins", "del", "insExt", "delExt", "insTime", "delTime")

        def component(k: int) -> dict:
            n = range(len(alphabet))
            return {
                "root": {a: float(self.root[k, i]) for i, a in enumerate(alphabet)},
                "sub": {alphabet[i]: {alphabet[j]: float(self.sub[k, i, j]) for j in n if i != j} for i in n},
                "wait": {alphabet[i]: float(self.sub[k, i, i]) for i in n},
            }

        parts = [component(k) for k in range(len(self.root))]
        return json.dumps({"alphabet": alphabet, "indel": dict(zip(names, map(float, self.indel), strict=True)), "sub": parts[0] if len(parts) == 1 else {"mixture": parts}, "logLikelihood": self.loglik})

    @classmethod
    def from_json(cls, text: str) -> Counts:
        """Also reads files that lack a comma between two members, and a mixture inside or beside `sub`."""
        import re

        d = json.loads(re.sub(r'([0-9\]}"])(\s*\n\s*")', r"\1,\2", re.sub(r",(\s*\n)", r",\1", text)).replace(",,", ","))
        alphabet = d["alphabet"]
        parts = d.get("mixture") or d["sub"].get("mixture") or [d["sub"]]
        root = np.array([[p["root"].get(a, 0.0) for a in alphabet] for p in parts])
        sub = np.array([[[p["wait"].get(a, 0.0) if a == b else p["sub"].get(a, {}).get(b, 0.0) for b in alphabet] for a in alphabet] for p in parts])
        return cls(root, sub, np.array([d["indel"][k] for k in ("ins", "del", "insExt", "delExt", "insTime", "delTime")]), d.get("logLikelihood", 0.0))
