"""LM scoring by cross-entropy difference (target minus background; lower: more like the target).

Two word-bigram models over one vocabulary, with the same smoothing: the background is counted over all documents, the target over those
that labels mark with quality 1. Every word and every bigram has its own exact count, so the models grow with the corpus.

P(w | h) = (c(h, w) + K * P(w)) / (c(h) + K), P(w) = (c(w) + 1) / (N + V), over tokens and vocabulary, V counting one unknown
word too. h starts as a mark. For each h the probabilities add up to 1. Words stand as 64-bit hashes. The target documents are scored like
all others, by models that count them.

Scoring. Counts and scores take one shuffle: all tokens of a word, each with the word before it and its document, meet in one cell, which
so has the exact c(w), c(h, w) for each h, and c of the word as a history (all its tokens but those that end a text). The loss of a token is
log(c(h) + K) - log(c(h, w) + K * P(w)); the second part belongs to the cell of w, the first to that of h, so no table of bigrams is written
or joined. A cell sends sums back to blocks of documents. Tokens travel in ROUNDS parts, for each of which the texts are split into words
again, so that only one part is on disk at once. Cells have about CELL tokens and are dealt with one by one.

Words with one in 2 HEAD of all tokens, of which there can be 2 HEAD at most, are counted before and broadcast: their tokens go to cells by
bigram. The same holds for bigrams; tokens of those aren't sent. The result doesn't depend on HEAD, ROUNDS or CELL.

Models is the same two models as one written table, a row a bigram, for other uses; the scores are those of its losses (test).

Words are runs of anything but ASCII white space, lower-cased over A-Z. Null or empty texts have no tokens and score 0. Labels that are
null or have no document are ignored, repeated ones count once; rows that repeat a doc_id are counted and scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common as c

HEAD = 10_000
ROUNDS = 4
CELL = 1 << 18
CELLS = 1 << 13
SENT = 1 << 19
BLOCK_BITS = 10
K = 50.0
MERGE = 1 << 21
MARK = np.uint64(0x1B873593CC9E2D51)
TOKEN = np.dtype([("w", "<u8"), ("h", "<u8"), ("doc", "<u4")])  # doc: counted from the first row of its value, times four, and 1 for target, 2 for the end of a text
PART = np.dtype([("doc", "<u2"), ("t", "<f8"), ("b", "<f8")])


class Sums:
    """Sums of columns by a key, but for the first ones, which go with the key; merged by sorting whenever MERGE rows have gathered."""

    def __init__(self, fixed: int) -> None:
        self.fixed = fixed
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, keys: np.ndarray, *columns: np.ndarray) -> None:
        self.parts.append((keys, *columns))
        self.rows += len(keys)
        if self.rows > MERGE and len(self.parts) > 1:
            self.merge()

    def merge(self) -> tuple[np.ndarray, ...] | None:
        if not self.parts:
            return None
        keys, *columns = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        by = np.argsort(keys, kind="stable")
        keys = keys[by]
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        self.parts = [(keys[at], *(x[by][at] if i < self.fixed or not len(at) else np.add.reduceat(x[by], at) for i, x in enumerate(columns)))]
        self.rows = 0  # of those added since
        return self.parts[0]

    def full(self) -> bool:
        return bool(self.parts) and len(self.parts[0][0]) > 2 * MERGE


def _words(chunk: c.Chunk) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = chunk.spans(c.space_words())
    return c.span_hashes(chunk.buf, starts, ends, True), first


def _bigrams(chunk: c.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each token's word before it (MARK at the start of a text), the word, the key of both, and the first tokens of texts."""
    w, first = _words(chunk)
    h = np.empty_like(w)
    h[1:] = w[:-1]
    h[first[:-1][np.diff(first) > 0]] = MARK
    return h, w, c.mix(h * np.uint64(0x9E3779B97F4A7C15) + w), first


def counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """key, h, w, t, b: how often each bigram occurs in target and background."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    some = c.maybe(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), good, ["doc_id"]).where("may").drop("may")
    target = some.join(good.hint("merge"), "doc_id", "left_semi").select("text", F.lit(True).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(2)
        out = lambda p: pa.RecordBatch.from_arrays([pa.array(c.signed(x)) if x.dtype == np.uint64 else pa.array(x) for x in p], ["key", "h", "w", "t", "b"])
        for b in batches:
            target = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for chunk in c.chunks(b.column(0)):
                h, w, key, first = _bigrams(chunk)
                inside = np.repeat(target[chunk.first : chunk.first + chunk.n], np.diff(first))
                keys, at, of, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                t = np.bincount(of[inside], minlength=len(keys))
                sums.add(keys, h[at], w[at], t, n - t)
                if sums.full():
                    yield out(sums.merge())
                    sums = Sums(2)
        if (p := sums.merge()) is not None:
            yield out(p)

    texts = docs.select("text", F.lit(False).alias("t")).union(target)
    found = texts.mapInArrow(run, "key long, h long, w long, t long, b long").groupBy("key")
    return found.agg(F.first("h").alias("h"), F.first("w").alias("w"), F.sum("t").alias("t"), F.sum("b").alias("b"))


class Models:
    """The written table of counts (key, t, b, wt, wb, ht, hb), and the numbers that losses need besides: running words of both corpora, and of the
    vocabulary with the unknown word."""

    def __init__(self, found: DataFrame, tables: c.Tables):
        self.nt, self.nb = (x or 0 for x in found.agg(F.sum("t"), F.sum("b")).first())
        word = tables.cut(found.groupBy("w").agg(F.sum("t").alias("wt"), F.sum("b").alias("wb")))
        self.v = word.where("wb > 0").count() + 1
        before = tables.cut(found.groupBy("h").agg(F.sum("t").alias("ht"), F.sum("b").alias("hb")))
        half = tables.cut(found.join(word.hint("shuffle_hash"), "w").drop("w"), drop=(found, word))
        self.rows = tables.cut(half.join(before.hint("shuffle_hash"), "h").drop("h"), drop=(half, before))

    def losses(self) -> tuple[Column, Column]:
        """The loss of a row's bigram under target and background."""
        out = []
        for x, total in (("t", self.nt), ("b", self.nb)):
            p = K * (F.col(f"w{x}") + 1) / F.lit(float(total + self.v))
            out.append((F.log(F.col(f"h{x}") + K) - F.log(F.col(x) + p)).alias(f"l{x}"))
        return out[0], out[1]


class Head:
    """Numbers of some keys, a row of `values` each."""

    def __init__(self, key: np.ndarray, *values: np.ndarray):
        by = np.argsort(key)
        self.keys, self.values = key[by], np.stack([x[by] for x in values]) if len(key) else np.zeros((len(values), 0))
        self.bits = np.zeros(1 << 18, bool)
        self.bits[(self.keys & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    @staticmethod
    def of(rows: DataFrame) -> Head:
        key, *values = (x.to_numpy() for x in rows.toArrow().columns)
        return Head(key.view(np.uint64), *values)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        at = np.full(len(key), -1)
        some = np.flatnonzero(self.bits[(key & np.uint64((1 << 18) - 1)).astype(np.int64)])
        if len(some):
            place = np.searchsorted(self.keys, key[some])
            place[place == len(self.keys)] = 0
            at[some] = np.where(self.keys[place] == key[some], place, -1)
        return at


def _marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """rid, doc_id, text, and whether the document is one of the target. Only documents that labels may name are shuffled."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    some = c.maybe(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), good, ["doc_id"])
    far = some.where("may IS NULL OR doc_id IS NULL").select("doc_id", "text", F.lit(False).alias("t"))
    near = some.where("may AND doc_id IS NOT NULL").join(good.withColumn("t", F.lit(True)).hint("merge"), "doc_id", "left")
    return far.union(near.select("doc_id", "text", F.coalesce("t", F.lit(False)))).withColumn("rid", F.monotonically_increasing_id())


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """Over rows (text, t, rid): of each chunk's tokens the word before, the word, the key of both, the row in the batch, and 1 for those of the
    target, 2 for the last of a text."""
    target = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
    for chunk in c.chunks(batch.column(0)):
        h, w, key, first = _bigrams(chunk)
        row = chunk.first + c.owner(first)
        mark = target[row]
        mark[first[1:][np.diff(first) > 0] - 1] |= 2
        yield h, w, key, row, mark


def _by_flags(keys: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, each one's count in target and all documents, and its counts without ends of texts; the place of each key in them."""
    some, of = np.unique(keys, return_inverse=True)
    n = np.bincount(4 * of + mark, minlength=4 * len(some)).reshape(-1, 4)
    return some, n[:, 1] + n[:, 3], n.sum(1), n[:, 1], n[:, 0] + n[:, 1], of


def _word_counts(marked: DataFrame) -> DataFrame:
    """key, t, b, ht, hb of every word (kind 0), and of the bigrams that are frequent where many tokens are seen together (kind 1) a part of b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []

        def out() -> Iterator[pa.RecordBatch]:
            w, key, mark = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            bucket = (key & np.uint64(0xFFFF)).astype(np.int64)
            key = key[(np.bincount(bucket, minlength=1 << 16) * 2 * HEAD >= len(w))[bucket]]
            key, n = np.unique(key, return_counts=True)
            often = n * 2 * HEAD >= len(w)
            for kind, (k, *x) in ((0, _by_flags(w, mark)[:5]), (1, (key[often], *[n[often]] * 4))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(c.signed(k)), *map(pa.array, x)], ["kind", "key", "t", "b", "ht", "hb"])

        for batch in batches:
            for _, w, key, _, mark in _tokens(batch):
                parts.append((w, key, mark))
                if sum(len(x[0]) for x in parts) > MERGE // 2:
                    yield from out()
        if parts:
            yield from out()

    found = marked.select("text", "t", "rid").mapInArrow(run, "kind byte, key long, t long, b long, ht long, hb long").groupBy("kind", "key")
    return found.agg(*[F.sum(x).alias(x) for x in ("t", "b", "ht", "hb")])


def _bigram_counts(marked: DataFrame, head: Head) -> Head:
    """Exact counts of the bigrams of head in target and all documents."""
    known = marked.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(2 * len(known.value.keys), np.int64)
        for batch in batches:
            for _, _, key, _, mark in _tokens(batch):
                at = known.value.find(key)
                n += np.bincount(2 * at[at >= 0] + (mark[at >= 0] & 1), minlength=len(n))
        n = n.reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(c.signed(known.value.keys)), pa.array(n[:, 1]), pa.array(n.sum(1))], ["key", "t", "b"])

    rows = marked.select("text", "t", "rid").mapInArrow(run, "key long, t long, b long").where("b > 0").groupBy("key").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))
    return Head.of(rows.select("key", "t", "b"))


def _values(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Rows that are sorted by key as one binary value a key."""
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    offsets = (np.append(at, len(keys)) * rows.dtype.itemsize).astype(np.int32)
    return keys[at], pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def _rows(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The rows of all binary values, and how many each has."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind), np.diff(offsets) // kind.itemsize


class Scorer:
    """What tokens need besides the counts of their cell. words: t, b, ht, hb of the frequent ones; bigrams: t, b. sizes: N + V of target and of all."""

    def __init__(self, words: Head, bigrams: Head, sizes: tuple[float, float], texts: tuple[int, int]):
        self.words, self.bigrams, self.sizes, self.texts = words, bigrams, sizes, texts

    def word(self, i: int, both: np.ndarray, word: np.ndarray) -> np.ndarray:
        """-log(c(h, w) + K * P(w)) in target (i = 0) or background."""
        return -np.log(both + K * (word + 1) / self.sizes[i])

    def at_once(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over rows (text, t, rid, doc_id): tokens, and what frequent words, frequent bigrams and the mark add to the losses."""
        for batch in batches:
            n, sums = np.zeros(batch.num_rows, np.int64), np.zeros((2, batch.num_rows))
            for _, w, key, row, mark in _tokens(batch):
                n += np.bincount(row, minlength=len(n))
                at, pair = self.words.find(w), self.bigrams.find(key)
                history, inside = np.flatnonzero((at >= 0) & (mark < 2)), np.flatnonzero(pair >= 0)
                for i in range(2):
                    sums[i] += np.bincount(row[history], np.log(self.words.values[2 + i] + K)[at[history]], len(n))
                    sums[i] += np.bincount(row[inside], self.word(i, self.bigrams.values[i][pair[inside]], self.words.values[i][at[inside]]), len(n))
            sums += np.where(n > 0, np.log(np.array(self.texts) + K)[:, None], 0)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), *map(pa.array, (n, *sums))], ["rid", "doc_id", "n", "t", "b"])

    def send(self, r: int, cells: int):
        """Over rows (text, t, rid): the tokens of round r by cell."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: list[tuple[np.ndarray, ...]] = []
            base, held = 0, 0

            def out() -> pa.RecordBatch:
                cell, rows = (np.concatenate(x) for x in zip(*parts, strict=True))
                by = np.argsort(cell, kind="stable")
                keys, values = _values(cell[by], rows[by])
                parts.clear()
                return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), base)), values], ["cell", "base", "x"])

            for batch in batches:
                rid = batch.column(2).to_numpy()
                for h, w, key, row, mark in _tokens(batch):
                    at = self.words.find(w)
                    place = np.where(at >= 0, key, w)
                    mine = np.flatnonzero(place % np.uint64(ROUNDS) == r)
                    mine = mine[self.bigrams.find(key[mine]) < 0]
                    if not len(mine):
                        continue
                    own = rid[row[mine]]
                    for lo, hi in zip(*_runs(own), strict=True):
                        if parts and (own[lo:hi].min() < base or own[lo:hi].max() - base >= 1 << 30):
                            yield out()
                            held = 0
                        if not parts:
                            base = int(own[lo:hi].min())
                        rows = np.empty(hi - lo, TOKEN)
                        some = mine[lo:hi]
                        rows["w"], rows["h"], rows["doc"] = w[some], h[some], (own[lo:hi] - base) * 4 + mark[some]
                        parts.append(((place[some] // np.uint64(ROUNDS) % np.uint64(cells)).astype(np.int64), rows))
                        held += hi - lo
                    if held >= SENT:
                        yield out()
                        held = 0
            if parts:
                yield out()

        return run

    def cell(self, base: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        """The sums of a cell's tokens by document."""
        w, doc = rows["w"].astype(np.uint64), rows["doc"].astype(np.int64)
        mark, rid = doc & 3, base + (doc >> 2)
        key, *both, of_key = (x for i, x in enumerate(_by_flags(c.mix(rows["h"] * np.uint64(0x9E3779B97F4A7C15) + w), mark)) if i not in (3, 4))
        word, *counts, of_word = _by_flags(w, mark)
        at = self.words.find(word)
        rare, often = at < 0, np.flatnonzero(at >= 0)
        docs, own = np.unique(rid, return_inverse=True)
        out = np.empty(len(docs), PART)
        out["doc"] = docs & ((1 << BLOCK_BITS) - 1)
        for i, name in enumerate(("t", "b")):
            n = counts[i].astype(float)
            n[often] = self.words.values[i][at[often]]
            past = np.where(rare, np.log(counts[2 + i] + K), 0)  # that of a frequent word was added before
            out[name] = np.bincount(own, self.word(i, both[i][of_key], n[of_word]) + np.where(mark < 2, past[of_word], 0), len(docs))
        keys, values = _values(docs >> BLOCK_BITS, out)
        return pa.RecordBatch.from_arrays([pa.array(keys), values], ["block", "x"])

    def meet(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over rows (cell, base, x) sorted by cell: the sums of each cell, one at a time."""
        last, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, base = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows, n = _rows(batch.column(2), TOKEN)
            base, ends = np.repeat(base, n), np.concatenate(([0], np.cumsum(n)))
            for lo, hi in zip(*_bounds(cell), strict=True):
                if cell[lo] != last and held:
                    yield self.cell(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = []
                last = cell[lo]
                held.append((base[ends[lo] : ends[hi]], rows[ends[lo] : ends[hi]].copy()))
        if held:
            yield self.cell(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _bounds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return at, np.append(at[1:], len(keys))


def _runs(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the numbers of rows can't be counted from one base, as those of several files in a batch: parts that can."""
    return _bounds(own >> 29) if own.max() - own.min() >= 1 << 30 else (np.array([0]), np.array([len(own)]))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (block, x): the sums of each document."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        rows, n = _rows(batch.column(1), PART)
        blocks, of = np.unique(batch.column(0).to_numpy(), return_inverse=True)
        at = (np.repeat(of, n) << BLOCK_BITS) + rows["doc"]
        got = np.stack([np.bincount(at, x, len(blocks) << BLOCK_BITS).reshape(len(blocks), -1) for x in (np.ones(len(at)), rows["t"], rows["b"])], axis=1)
        for b, x in zip(blocks.tolist(), got, strict=True):
            sums[b] = sums[b] + x if b in sums else x.copy()
    for b, x in sums.items():
        some = np.flatnonzero(x[0])
        yield pa.RecordBatch.from_arrays([pa.array((b << BLOCK_BITS) + some), pa.array(x[1][some]), pa.array(x[2][some])], ["rid", "t", "b"])


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (nats a token) and score, their difference, a row per document."""
    spark = docs.sparkSession
    tables = c.Tables(spark)
    marked = tables.cut(_marked(docs, labels))
    counts = tables.cut(_word_counts(marked))
    v, nt, nb, ht, hb = (x or 0 for x in counts.where("kind = 0").agg(F.count("*"), *[F.sum(x) for x in ("t", "b", "ht", "hb")]).first())
    often = counts.where(F.col("b") * 2 * HEAD >= nb)
    words = Head.of(often.where("kind = 0").select("key", "t", "b", "ht", "hb"))
    bigrams = _bigram_counts(marked, Head.of(often.where("kind = 1").select("key", "b")))
    tables.drop(counts)
    known = spark.sparkContext.broadcast(Scorer(words, bigrams, (float(nt + v + 1), float(nb + v + 1)), (nt - ht, nb - hb)))
    sent = (nb - int(bigrams.values[1].sum())) // ROUNDS
    cells = max(64, min(sent // CELL, max(CELLS, sent // (8 * CELL))))
    texts, parts = marked.select("text", "t", "rid"), []
    for r in range(ROUNDS):
        met = texts.mapInArrow(lambda x, r=r: known.value.send(r, cells)(x), "cell long, base long, x binary").repartition("cell").sortWithinPartitions("cell")
        met = met.mapInArrow(lambda x: known.value.meet(x), "block long, x binary").repartition("block").mapInArrow(_gathered, "rid long, t double, b double")
        parts.append(tables.cut(met))
    once = marked.select("text", "t", "rid", "doc_id").mapInArrow(lambda x: known.value.at_once(x), "rid long, doc_id long, n long, t double, b double")
    every = reduce(DataFrame.union, [once, *[p.select("rid", F.lit(None).cast("long"), F.lit(0).cast("long"), "t", "b") for p in parts]])
    every = every.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), *[F.sum(x).alias(x) for x in ("n", "t", "b")])
    loss = lambda x: F.col(x) / F.greatest("n", F.lit(1))
    out = tables.cut(every.select("doc_id", F.col("n").alias("n_tokens"), loss("t").alias("target_loss"), loss("b").alias("background_loss")), drop=(marked, *parts))
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def brute(texts: list[tuple[int, str | None]], target: set[int]) -> list[tuple[int, float, float]]:
    """Tokens and losses of each text, with dictionaries."""
    from collections import Counter
    from math import log

    split = lambda t: ("".join(x.lower() if x.isascii() else x for x in t or "")).translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
    tokens = [(d, [w for w in split(t) if w]) for d, t in texts]
    count = Counter(w for _, ws in tokens for w in ws)
    models = []
    for some in ([x for x in tokens if x[0] in target], tokens):
        uni, pair, hist = Counter(), Counter(), Counter()
        for _, ws in some:
            for h, w in zip(["", *ws], ws, strict=False):
                uni[w] += 1
                pair[h, w] += 1
                hist[h] += 1
        models.append((uni, pair, hist))
    out = []
    for _, ws in tokens:
        losses = []
        for uni, pair, hist in models:
            p = lambda w: (uni[w] + 1) / (sum(uni.values()) + len(count) + 1)  # noqa: E731, B023
            losses.append(-sum(log((pair[h, w] + K * p(w)) / (hist[h] + K)) for h, w in zip(["", *ws], ws, strict=False)) / max(1, len(ws)))
        out.append((len(ws), *losses))
    return out
