"""Language ID by Bayesian fusion of text, declared markup language, address suffix and host priors.

P(l | page) is in proportion to P(text | l)^c * P(declared | l) * P(suffix | l) * P(l | host):

- Text: naive Bayes over byte trigrams, hashed to 2^14 numbers, counted over all documents of each language. As trigrams of one text
  aren't independent, its log likelihood is scaled by an exponent c: the one of EXPONENTS that gives the languages of held-out documents (a
  tenth, by doc_id hash, left out of the counts for this) the greatest likelihood, judged by FRAGMENT trigrams in a row of each.
- Declared language (the html tag's lang, its primary subtag) and address suffix (last label of the host): for each text language
  the shares of their values, smoothed; counted over all pages by grouped aggregation, with the language that the text alone gives.
- Host prior: shares of those languages on the host, smoothed with ALPHA pages' worth of the shares of its domain (the last two
  labels), those in turn with ALPHA of the shares over all pages, and those with one page for each language.

Every value has its own counts, however rare. The tables by host, declared language and suffix are joined with the pages; values that more than
a thousandth of the pages share meet them in a broadcast, so no task gets all pages of a hot host.

Null html is an empty page: its text says nothing and the priors decide. A null or odd address has an empty host and suffix. Rows that
repeat a page_id are judged one by one. Documents without text or language don't count; without any document there is no language
(null) to give. The model has 2^14 numbers a language, so languages may number MOST_LANGUAGES; more are an error. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as c

BITS = 14
FRAGMENT = 24
EXPONENTS = [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0]
ALPHA = 10.0
MOST_LANGUAGES = 200

_HIDDEN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{1,8})", re.I)


def visible(html: str) -> str:
    return unescape(_TAG.sub(" ", _HIDDEN.sub(" ", html)))


def declared(html: str) -> str:
    m = _DECLARED.search(html)
    return m[1].lower() if m else ""


def host_of(url: str | None) -> tuple[str, str, str]:
    """Host, domain and suffix of an address; empty where it has none."""
    try:
        host = (urlsplit(url or "").hostname or "").strip(".")
    except ValueError:
        host = ""
    labels = host.split(".") if host else []
    return host, ".".join(labels[-2:]), labels[-1] if labels else ""


def trigrams(chunk: c.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the byte trigrams of each text (lower-cased, runs of non-letters as one space), and their texts."""
    buf = c.LOWER[chunk.buf]
    letter = (buf >= 128) | ((buf >= 97) & (buf <= 122))
    buf = np.where(letter, buf, 32).astype(np.uint32)
    own = np.repeat(np.arange(chunk.n), np.diff(chunk.offsets))
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (own[1:] != own[:-1])
    keep[:1] = True
    buf, own = buf[keep], own[keep]
    if len(buf) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = (buf[:-2] << 16) | (buf[1:-1] << 8) | buf[2:]
    same = own[:-2] == own[2:]
    return ((x[same] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64), own[:-2][same]


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and the log probability of each trigram number in each, times the exponent c."""
    held = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0, F.lit(False))
    docs = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text", held.alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, bool], np.ndarray] = {}
        for b in batches:
            groups = list(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True))
            for chunk in c.chunks(b.column(1)):
                names = sorted(set(groups[chunk.first : chunk.first + chunk.n]))
                number = {x: i for i, x in enumerate(names)}
                code = np.array([number[x] for x in groups[chunk.first : chunk.first + chunk.n]])
                x, own = trigrams(chunk)
                counts = np.bincount((code[own] << BITS) | x, minlength=len(names) << BITS).reshape(len(names), -1)
                for name, n in zip(names, counts, strict=True):
                    total[name] = total.get(name, 0) + n
        for (name, out), n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array([out] * len(at), pa.bool_()), pa.array(at), pa.array(n[at])], ["lang", "held", "x", "n"])

    got = docs.mapInArrow(run, "lang string, held boolean, x long, n long").groupBy("lang", "x").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("held"), F.col("n")).otherwise(0)).alias("out")).toArrow()
    names = sorted(set(got["lang"].to_pylist()))
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"{len(names)} languages; {MOST_LANGUAGES} are allowed")
    if not names:
        return names, np.zeros((0, 1 << BITS))
    code = {x: i for i, x in enumerate(names)}
    at = [code[x] for x in got["lang"].to_pylist()], got["x"].to_numpy()

    def log_share(*columns: str) -> np.ndarray:
        counts = np.full((len(names), 1 << BITS), 0.5)
        counts[at] += got[columns[0]].to_numpy() - (got[columns[1]].to_numpy() if len(columns) > 1 else 0)
        return np.log(counts / counts.sum(1, keepdims=True))

    return names, log_share("n") * _exponent(docs, names, log_share("n", "out"))


def _exponent(docs: DataFrame, names: list[str], logp: np.ndarray) -> float:
    shared = docs.sparkSession.sparkContext.broadcast((names, np.ascontiguousarray(logp.T)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        total = np.zeros(len(EXPONENTS))
        for b in batches:
            lang = np.searchsorted(names, b.column(0).to_numpy(zero_copy_only=False).astype(str)) if b.num_rows else []
            for chunk in c.chunks(b.column(1)):
                x, own = trigrams(chunk)
                n = np.bincount(own, minlength=chunk.n)
                rank = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                first = c.mix(n.astype(np.uint64) + np.uint64(17)) % np.maximum(1, n - FRAGMENT + 1).astype(np.uint64)  # anywhere in the text
                some = (rank >= first[own].astype(np.int64)) & (rank < first[own].astype(np.int64) + FRAGMENT)
                score = np.stack([np.bincount(own[some], col[x[some]], chunk.n) for col in table.T], 1)
                true = score[np.arange(chunk.n), lang[chunk.first : chunk.first + chunk.n]]
                for k, s in enumerate(EXPONENTS):
                    total[k] += (s * (true - score.max(1)) - np.log(np.exp(s * (score - score.max(1, keepdims=True))).sum(1))).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(EXPONENTS))), pa.array(total)], ["k", "total"])

    rows = docs.where("held").select("lang", "text").mapInArrow(run, "k long, total double").groupBy("k").agg(F.round(F.sum("total"), 6).alias("total")).collect()
    return EXPONENTS[max(rows, key=lambda r: (r.total, r.k)).k] if rows and any(r.total for r in rows) else 0.2


SEEN = "page_id long, host string, domain string, suffix string, declared string, text_lang int, loglik array<double>"


def evidence(pages: DataFrame, names: list[str], logp: np.ndarray) -> DataFrame:
    """A row per page: parts of the address, declared language, scaled log likelihoods of its text, and the best one's number."""
    shared = pages.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logp.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            urls, pages_ = b.column(1).to_pylist(), b.column(2)
            for lo in range(0, b.num_rows, 256):
                html = [x or "" for x in pages_.slice(lo, 256).to_pylist()]
                for chunk in c.chunks(pa.array([visible(x) for x in html], pa.large_string())):
                    own_html = html[chunk.first : chunk.first + chunk.n]
                    x, own = trigrams(chunk)
                    score = np.stack([np.bincount(own, col[x], chunk.n) for col in table.T], 1).astype(float)
                    at = lo + chunk.first
                    host, domain, suffix = zip(*map(host_of, urls[at : at + chunk.n]), strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(at, chunk.n), pa.array(host), pa.array(domain), pa.array(suffix), pa.array(list(map(declared, own_html))), pa.array(score.argmax(1).astype(np.int32)), c.list_array(score.ravel(), np.full(chunk.n, len(names)))],
                        [x.split()[0] for x in SEEN.split(", ")],
                    )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, SEEN)


def _likelihoods(seen: DataFrame, column: str, n: int) -> DataFrame:
    """A row per value of the column: log P(value | language) for each language, and how many pages have it."""
    by = [F.sum(F.when(F.col("text_lang") == i, 1).otherwise(0)).cast("double").alias(f"n{i}") for i in range(n)]
    counts = seen.groupBy(column).agg(*by, F.count("*").alias(f"{column}_pages"))
    whole = counts.agg(F.count("*"), *[F.sum(f"n{i}") for i in range(n)]).first()
    logs = [F.log((F.col(f"n{i}") + 0.5) / F.lit((whole[i + 1] or 0.0) + 0.5 * (whole[0] or 1))) for i in range(n)]
    return counts.select(column, F.array(*logs).alias(f"by_{column}"), f"{column}_pages")


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, posterior, text_lang, declared, suffix, host, a row per page."""
    t = c.Tables(pages.sparkSession)
    names, logp = train(docs)
    if not names:
        none = F.lit(None).cast("string")
        return pages.select(F.col("page_id").cast("long").alias("page_id"), none.alias("lang"), F.lit(None).cast("double").alias("posterior"), *[none.alias(x) for x in ("text_lang", "declared", "suffix", "host")])
    n = len(names)
    seen = t.cut(evidence(pages, names, logp))
    total = seen.count()

    def shares() -> list:
        return [F.sum(F.when(F.col("text_lang") == i, F.col("n")).otherwise(0)).cast("double").alias(f"n{i}") for i in range(n)]

    by_host = t.cut(seen.groupBy("host", "domain", "text_lang").agg(F.count("*").alias("n")).groupBy("host", "domain").agg(*shares(), F.sum("n").alias("host_pages")))
    whole = by_host.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0.0)) for i in range(n)]).first()
    top = [(x + 1) / (sum(whole) + n) for x in whole]

    def smooth(own: str, prior: list) -> list:
        size = sum((F.col(f"{own}{i}") for i in range(1, n)), F.col(f"{own}0"))
        return [(F.col(f"{own}{i}") + ALPHA * prior[i]) / (size + ALPHA) for i in range(n)]

    by_domain = by_host.groupBy("domain").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(n)])
    by_domain = t.cut(by_domain.select("domain", *[x.alias(f"d{i}") for i, x in enumerate(smooth("n", [F.lit(x) for x in top]))]))
    hosts = by_host.agg(F.count("*")).first()[0]
    in_domain = by_host.groupBy("domain").agg(F.count("*").alias("hosts"))
    priors = c.split_join(by_host, by_domain.join(in_domain.hint("merge"), "domain"), ["domain"], "hosts", hosts)
    priors = t.cut(priors.select("host", F.array(*[F.log(x) for x in smooth("n", [F.col(f"d{i}") for i in range(n)])]).alias("by_host"), "host_pages"))

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            score = sum(b.column(i).flatten().to_numpy().reshape(-1, n) for i in range(5, 9))
            score -= score.max(1, keepdims=True)
            p = np.exp(score)
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            text = b.column(4).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([names[i] for i in best]), pa.array(p[np.arange(len(p)), best]), pa.array([names[i] for i in text]), b.column(3), b.column(2), b.column(1)],
                ["page_id", "lang", "posterior", "text_lang", "declared", "suffix", "host"],
            )

    rows = seen.drop("domain")
    for column, table in (("host", priors), ("declared", _likelihoods(seen, "declared", n)), ("suffix", _likelihoods(seen, "suffix", n))):
        rows = c.split_join(rows, table, [column], f"{column}_pages", total).drop(f"{column}_pages")
    rows = rows.select("page_id", "host", "suffix", "declared", "text_lang", "loglik", "by_host", "by_declared", "by_suffix")
    return rows.mapInArrow(fuse, "page_id long, lang string, posterior double, text_lang string, declared string, suffix string, host string")
