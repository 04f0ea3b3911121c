"""Quality classifier: a factorisation machine over hashed words, structure statistics and the length that the table states.

A text's features are its words, hashed to 2^12 numbers with counts scaled to length one, and DENSE numbers about its structure. The
model adds to a linear part the products of all pairs of features, weighted by inner products of RANK-dimensional factors; with
the identity sum_{i<j} <v_i, v_j> x_i x_j = (|sum x_i v_i|^2 - sum x_i^2 |v_i|^2) / 2 that takes time linear in the features.
Whole texts are scored in one pass without a shuffle; the model has a fixed size and is broadcast.

It is trained on the driver on TRAIN_ROWS labelled rows at most, those of the smallest hashes of doc_id, of which none has crc32(doc_id as
text) mod 5 = 0. Rows of labels that repeat a doc_id count once, with the smallest quality; null labels don't count. Without any
labelled row every score is 0.5. Null texts score as empty ones; null n_chars is taken from the text. A null doc_id counts as held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import common as c

BITS = 12
RANK = 8
DENSE = 16
TRAIN_ROWS = 4000
THRESHOLD = 0.3
TRAIN_WORDS = 4096
EPOCHS = 8

_CLASS = np.zeros(256, np.int64)  # 0 other symbols
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[32, *range(9, 14)]] = 4
_CLASS[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 5
_CLASS[128:] = 6


def features(chunk: c.Chunk, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Dense features (a row for each text), and of its words: text, number of the hash, and scaled count."""
    starts, ends, first = chunk.spans(c.space_words())
    h = c.span_hashes(chunk.buf, starts, ends, True)
    n, own, size = np.diff(first), c.owner(first), np.diff(chunk.offsets)
    text = np.repeat(np.arange(chunk.n), size)
    kinds = np.bincount(text * 7 + _CLASS[chunk.buf], minlength=7 * chunk.n).reshape(-1, 7)
    number = (h >> np.uint64(64 - BITS)).astype(np.int64)
    keys, counts = np.unique((own << BITS) | number, return_counts=True)
    t, word = keys >> BITS, keys & ((1 << BITS) - 1)
    norm = np.sqrt(np.bincount(t, counts.astype(float) ** 2, chunk.n))
    some, letters = np.maximum(n, 1), np.maximum(size, 1)
    same = np.bincount(own[1:][(h[1:] == h[:-1]) & (own[1:] == own[:-1])], minlength=chunk.n) if len(h) > 1 else np.zeros(chunk.n)
    last = _CLASS[chunk.buf[ends - 1]] if len(ends) else np.zeros(0, np.int64)
    head = _CLASS[chunk.buf[starts]] if len(ends) else np.zeros(0, np.int64)
    lines = np.bincount(text[chunk.buf == 10], minlength=chunk.n) + 1
    dense = np.stack(
        [
            np.log1p(n), np.log1p(n_chars), np.bincount(own, ends - starts, chunk.n) / some / 10, np.bincount(t, minlength=chunk.n) / some,
            same / some, np.bincount(own[last == 0], minlength=chunk.n) / some, np.bincount(own[last == 5], minlength=chunk.n) / some, np.bincount(own[head == 2], minlength=chunk.n) / some,
            *(kinds[:, k] / letters for k in (0, 1, 2, 3, 5, 6)), np.log1p(n / lines), counts_max(t, counts, chunk.n) / some,
        ],
        1,
    )
    return dense, t, word, counts / norm[t]


def counts_max(t: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    np.maximum.at(out, t, counts)
    return out


class Machine:
    """Weights, factors, and the scale of the dense features; those come after the words."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        self.mean, self.scale, self.w0 = mean, scale, 0.0
        self.w = np.zeros((1 << BITS) + DENSE)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (len(self.w), RANK))

    def scaled(self, dense: np.ndarray) -> np.ndarray:
        return np.clip((dense - self.mean) / self.scale, -6, 6) * 0.5

    def margin(self, dense: np.ndarray, t: np.ndarray, word: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The margins, and the sums of x_i v_i. dense is scaled; t is sorted."""
        n = len(dense)
        total, square, line = dense @ self.v[1 << BITS :], (dense**2) @ (self.v[1 << BITS :] ** 2).sum(1), self.w0 + dense @ self.w[1 << BITS :]
        if len(t):
            xv = x[:, None] * self.v[word]
            at = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
            total[t[at]] += np.add.reduceat(xv, at)
            square = square + np.bincount(t, (xv**2).sum(1), n)
            line = line + np.bincount(t, x * self.w[word], n)
        return line + ((total**2).sum(1) - square) / 2, total

    def score(self, *args: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(*args)[0], -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, seed: int = 7) -> Machine | None:
    """rows: dense features, word numbers, scaled counts and the label of each text. Logistic loss, Adam, a small penalty on squares."""
    if not rows:
        return None
    dense = np.stack([r[0] for r in rows])
    m = Machine(dense.mean(0), dense.std(0) + 1e-6, seed)
    dense, y = m.scaled(dense), np.array([r[3] for r in rows], float)
    rng, parts, step = np.random.default_rng(seed), [np.zeros(1), m.w, m.v], 0
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    rank = m.v.shape[1]
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), 128):
            pick = order[lo : lo + 128]
            t = np.repeat(np.arange(len(pick)), [len(rows[i][1]) for i in pick])
            word, x, d = np.concatenate([rows[i][1] for i in pick]), np.concatenate([rows[i][2] for i in pick]), dense[pick]
            margin, total = m.margin(d, t, word, x)
            g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[pick]) / len(pick)
            grad_w, grad_v = np.zeros_like(m.w), np.zeros_like(m.v)
            gx = g[t] * x
            grad_w[: 1 << BITS] = np.bincount(word, gx, 1 << BITS)
            grad_w[1 << BITS :] = d.T @ g
            pull = np.bincount(word, gx * x, 1 << BITS)
            for f in range(rank):
                grad_v[: 1 << BITS, f] = np.bincount(word, gx * total[t, f], 1 << BITS) - pull * m.v[: 1 << BITS, f]
            grad_v[1 << BITS :] = d.T @ (g[:, None] * total) - ((d**2).T @ g)[:, None] * m.v[1 << BITS :]
            step += 1
            for p, grad, a, b in zip(parts, (np.array([g.sum()]), grad_w + 1e-5 * m.w, grad_v + 1e-4 * m.v), first, second, strict=True):
                a += 0.1 * (grad - a)
                b += 0.01 * (grad**2 - b)
                p -= 0.02 * a / (1 - 0.9**step) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
            m.w0 = float(parts[0][0])
    return m


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine | None:
    """A machine for docs (doc_id, text, n_chars), with labels (doc_id, quality) outside the held-out fifth. Of rows that repeat a doc_id it
    learns from one, the least by text hash, and the driver gets `rows` rows at most, with TRAIN_WORDS distinct words of each at most."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold != 0)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    sample = F.broadcast(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    n_chars = F.coalesce(F.col("n_chars").cast("double"), F.length("text").cast("double"), F.lit(0.0))
    met = docs.select("doc_id", "text", n_chars.alias("n")).join(sample, "doc_id")
    texts = met.select("doc_id", "label", "text", "n", F.xxhash64("text", "n").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk in c.chunks(b.column(2)):
                at = slice(chunk.first, chunk.first + chunk.n)
                dense, t, word, x = features(chunk, b.column(3).to_numpy()[at])
                few = np.arange(len(t)) - np.searchsorted(t, t) < TRAIN_WORDS
                t, word, x = t[few], word[few], x[few]
                counts = np.bincount(t, minlength=chunk.n)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(chunk.first, chunk.n), b.column(1).slice(chunk.first, chunk.n), b.column(4).slice(chunk.first, chunk.n), c.list_array(dense.ravel(), np.full(chunk.n, DENSE)), c.list_array(word.astype(np.int32), counts), c.list_array(x.astype(np.float32), counts)],
                    ["doc_id", "label", "h", "dense", "word", "x"],
                )

    one = texts.mapInArrow(run, "doc_id long, label int, h long, dense array<double>, word array<int>, x array<float>")
    got = one.groupBy("doc_id").agg(F.min_by(F.struct("label", "dense", "word", "x"), "h").alias("r")).select("doc_id", "r.*").toArrow()
    ids, label, dense, word, x = (got[n].to_pylist() if n in ("doc_id", "label") else [v.values.to_numpy() for v in got[n]] for n in got.column_names)
    order = sorted(range(len(ids)), key=lambda i: (ids[i], dense[i].tobytes()))  # the same however rows arrive
    return train([(dense[i], word[i].astype(np.int64), x[i].astype(float), label[i]) for i in order])


def score(docs: DataFrame, machine: Machine | None, out: str = "_score") -> DataFrame:
    """All rows and columns of docs, with the probability of label 1. docs has text, and maybe n_chars."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    fields = list(plain.schema.fields)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    names = [n.lower() for n in docs.columns]
    text = names.index("text")
    chars = F.col(f"c{names.index('n_chars')}").cast("double") if "n_chars" in names else F.lit(None).cast("double")
    plain = plain.withColumn("n", F.coalesce(chars, F.length(f"c{text}").cast("double"), F.lit(0.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for chunk in c.chunks(b.column(text)):
                rows = b.slice(chunk.first, chunk.n)
                s = np.full(chunk.n, 0.5)
                if m is not None:
                    dense, *words = features(chunk, rows.column(len(fields)).to_numpy())
                    s = m.score(m.scaled(dense), *words)
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(fields)], pa.array(s)], [*(f.name for f in fields), "s"])

    return plain.mapInArrow(run, T.StructType([*fields, T.StructField("s", T.DoubleType())])).toDF(*docs.columns, out)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, a row per document."""
    found = score(docs.select("doc_id", "text", "n_chars"), fit(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    return found.select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't rejected."""
    out = c.free_name(docs, "_score")
    return score(docs, fit(docs, labels), out).where(F.col(out) >= THRESHOLD).select(*[f"`{n}`" for n in docs.columns])
