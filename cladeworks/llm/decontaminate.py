"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of consecutive benchmark words. For each window length the search keeps a shift table, indexed by a hash of
the last two or three words of a window: how far the window may move on before its end can match. Where the shift is zero, the bucket of
that suffix hash names the patterns to test, and a direct comparison of all words, first by hash and then by bytes, confirms.
The table has some eight entries for each word of the patterns, so that most of it doesn't stop the search, and most positions are
never looked at. Segments of all texts in a chunk are searched in step, as one numpy vector of positions.

Memory. Patterns are compiled by blocks of whole items with at most BLOCK_BYTES of text (an item that is larger is a block by
itself), and held as the words' bytes, their offsets and hashes, a window being its first word's number: some 12 bytes a byte of text
with the tables. Each block is broadcast. A worker holds one block at a time: it gathers GATHER bytes of documents and searches them
for one block after the other. Nothing is shuffled and no join is made, so hot sources, long texts and groups of copies cost what their bytes cost.

Null or empty texts have no words. Null item ids mark words but are in no list of items; a repeated item counts once. Rows that
repeat a doc_id are judged one by one. Further columns are kept by `decontaminate`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import common as c

WINDOW = 10
BLOCK_BYTES = 16 << 20
GATHER = 64 << 20
SEGMENT = 128
TABLE_BITS = (16, 24)
LARGE = 4096

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words_of(text: str | None) -> list[bytes]:
    """The words of one text, lower-cased over A-Z."""
    raw = c.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = c.Chunk(0, raw, np.array([0, len(raw)])).spans(c.alnum_words())
    data = raw.tobytes()
    return [data[s:e] for s, e in zip(starts, ends, strict=True)]


class Patterns:
    """Shift and bucket tables of all windows of one length: word numbers `first` of windows in a text of words, and their items (numbers)."""

    def __init__(self, length: int, data: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, first: np.ndarray, item: np.ndarray):
        self.m, self.data, self.starts, self.ends, self.hashes = length, data, starts.astype(np.int32), ends.astype(np.int32), hashes
        self.block = min(length, 3 if len(first) > LARGE else 2)
        # equal windows are one pattern, with the items of all
        key = np.zeros(len(first), np.uint64)
        for j in range(length):
            key = c.mix(key * np.uint64(31) + hashes[first + j])
        by = np.lexsort((item, key))
        key, item = key[by], item[by]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        fresh = new | np.concatenate(([True], item[1:] != item[:-1]))
        self.first = first[by][new].astype(np.int32)
        self.item, self.items_at = item[fresh].astype(np.int32), np.append(np.flatnonzero(new[fresh]), fresh.sum()).astype(np.int32)
        self.bits = int(np.clip(int(8 * len(self.first)).bit_length(), *TABLE_BITS))
        shift = np.full(1 << self.bits, length - self.block + 1, np.uint8 if length < 256 else np.int32)
        for end in range(self.block, length + 1):
            np.minimum.at(shift, self.key(hashes, self.first + end - 1), length - end)
        last = self.key(hashes, self.first + length - 1)
        self.shift, self.by = shift, np.argsort(last, kind="stable").astype(np.int32)
        self.bucket = np.zeros((1 << self.bits) + 1, np.int32)
        np.cumsum(np.bincount(last, minlength=1 << self.bits), out=self.bucket[1:])

    def key(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The hash of the block of words that ends at each position."""
        x = h[at] * np.uint64(0x9E3779B97F4A7C15)
        for j, factor in enumerate((0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)[: self.block - 1]):
            x = x + h[at - 1 - j] * np.uint64(factor)
        x ^= x >> np.uint64(29)
        return (x * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def same(self, data: bytes, starts: np.ndarray, ends: np.ndarray, b: int, pattern: int) -> bool:
        w = int(self.first[pattern])
        return all(data[starts[b + j] : ends[b + j]] == self.data[self.starts[w + j] : self.ends[w + j]] for j in range(self.m))

    def search(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of windows and pattern numbers whose word hashes agree."""
        lo, hi = first[:-1] + self.m - 1, first[1:]
        n = np.maximum(0, -(-(hi - lo) // SEGMENT))
        doc = np.repeat(np.arange(len(n)), n)
        pos = lo[doc] + SEGMENT * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
        end = np.minimum(pos + SEGMENT, hi[doc])
        at, keys = [], []
        while len(pos):
            key = self.key(h, pos)
            step = self.shift[key].astype(np.int64)
            stop = step == 0
            at.append(pos[stop])
            keys.append(key[stop])
            pos = pos + np.maximum(step, 1)
            on = pos < end
            pos, end = pos[on], end[on]
        at, keys = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, keys))
        n = self.bucket[keys + 1] - self.bucket[keys]
        pattern = self.by[np.repeat(self.bucket[keys] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        at = np.repeat(at, n)
        for j in range(self.m):
            same = h[at - self.m + 1 + j] == self.hashes[self.first[pattern] + j]
            at, pattern = at[same], pattern[same]
        return at, pattern


class Block:
    """The patterns of some benchmark items, by window length, and the items' names."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.names = sorted({i for i, _ in items if i is not None})
        number = {x: k for k, x in enumerate(self.names)}
        column = pa.array([t for _, t in items], pa.large_string())
        data, starts, ends, first, size, of, hashes = [], [], [], [], 0, [], []
        for chunk in c.chunks(column):
            s, e, f = chunk.spans(c.alnum_words())
            data.append(c.LOWER[chunk.buf])
            hashes.append(c.span_hashes(chunk.buf, s, e, True))
            first.append(f[:-1] + sum(map(len, starts)))
            starts.append(s + size)
            ends.append(e + size)
            size += len(chunk.buf)
        of = np.array([number.get(i, -1) for i, _ in items], np.int64)
        self.by_length: list[Patterns] = []
        if not items:
            return
        buf = np.concatenate(data)
        starts, ends, first = np.concatenate(starts), np.concatenate(ends), np.append(np.concatenate(first), sum(map(len, starts)))
        hashes = np.concatenate(hashes)
        n = np.diff(first)
        for m in np.unique(np.minimum(n, window)).tolist():
            if m:
                some = np.flatnonzero(np.minimum(n, window) == m)
                count = n[some] - m + 1
                at = np.repeat(first[some] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                self.by_length.append(Patterns(m, buf.tobytes(), starts, ends, hashes, at, np.repeat(of[some], count)))


def search_chunk(chunk: c.Chunk, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set[str]]]:
    """Numbers of words, the index of each text's first word, which words are hit, and the items found in each text."""
    starts, ends, first = chunk.spans(c.alnum_words())
    h = c.span_hashes(chunk.buf, starts, ends, True)
    cover, found = np.zeros(len(h) + 1, np.int64), [set() for _ in range(chunk.n)]
    data = None
    for p in block.by_length:
        at, which = p.search(h, first)
        if len(at):
            data = data or c.LOWER[chunk.buf].tobytes()
            text = np.searchsorted(first, at, "right") - 1
            for e, k, d in zip(at.tolist(), which.tolist(), text.tolist(), strict=True):
                b = e - p.m + 1
                if p.same(data, starts, ends, b, k):
                    cover[b] += 1
                    cover[e + 1] -= 1
                    found[d].update(block.names[i] for i in p.item[p.items_at[k] : p.items_at[k + 1]].tolist() if i >= 0)
    return np.diff(first), first, np.cumsum(cover)[:-1] > 0, found


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """Whole items in blocks, read to the driver one partition at a time."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).toLocalIterator():
        length = len((r.t or "").encode())
        if block and size + length > block_bytes:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += length
    yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, text: str = "text", out: str | None = None) -> DataFrame:
    """All rows and columns of docs, with a struct column: n_words, hits (numbers of the words hit), items (ids, sorted). Unless given, its
    name is _leaks, with underscores before it while that is taken."""
    out = out or c.free_name(docs, "_leaks")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    col = [n.lower() for n in docs.columns].index(text)
    names = plain.columns
    blocks = [docs.sparkSession.sparkContext.broadcast(Block(items, window)) for items in _blocks(benchmark, block_bytes)]

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[pa.RecordBatch, c.Chunk]]]:
        held, size = [], 0
        for b in batches:
            for chunk in c.chunks(b.column(col)):
                held.append((b.slice(chunk.first, chunk.n), chunk))
                size += len(chunk.buf)
                if size >= GATHER or len(blocks) == 1:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in gathered(batches):
            results: list = [None] * len(group)
            for block in blocks:
                for i, (_, chunk) in enumerate(group):
                    n, first, hit, found = search_chunk(chunk, block.value)
                    old = results[i]
                    results[i] = (n, first, hit, found) if old is None else (n, first, hit | old[2], [x | y for x, y in zip(found, old[3], strict=True)])
                if len(blocks) > 1:
                    block.__dict__.pop("_value", None)  # a worker keeps what it has loaded; this one comes again with the next documents
            for (rows, chunk), (n, first, hit, found) in zip(group, results, strict=True):
                hits = [np.flatnonzero(hit[first[d] : first[d + 1]]) for d in range(chunk.n)]
                lists = [c.list_array(np.concatenate(hits).astype(np.int64), np.array([len(x) for x in hits])), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.StructArray.from_arrays([pa.array(n), *lists], ["n_words", "hits", "items"])], [*names, "x"])

    return plain.mapInArrow(search, T.StructType([*plain.schema.fields, T.StructField("x", FOUND)])).toDF(*docs.columns, out)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of the contract, a row per document."""
    found = decontaminate(docs.select("doc_id", "text"), benchmark, out="_leaks")
    n_hit = F.size("_leaks.hits").cast("long")
    return found.select(
        "doc_id",
        F.col("_leaks.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_leaks.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_leaks.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no window of the benchmark."""
    out = c.free_name(docs, "_leaks")
    found = decontaminate(docs, benchmark, out=out)
    return found.where(F.size(f"{out}.hits") == 0).select(*[f"`{n}`" for n in docs.columns])


def brute(text: str | None, items: list[tuple[str, str]], window: int = WINDOW) -> tuple[int, set[int], list[str]]:
    """What decontaminate finds in one text, by trying every pattern at every word."""
    words, hits, found = words_of(text), set(), set()
    for item, t in items:
        own = words_of(t)
        m = min(window, len(own))
        for i in range(len(own) - m + 1 if m else 0):
            for j in range(len(words) - m + 1):
                if words[j : j + m] == own[i : i + m]:
                    hits.update(range(j, j + m))
                    found.add(item)
    return len(words), hits, sorted(found)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
        FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT m FROM win),
dw AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS s FROM d, lens, unnest(range(1, len(w) - m + 2)) AS u(i)),
occ AS (SELECT dw.doc_id, dw.i, dw.m, win.item_id FROM dw JOIN win ON dw.m = win.m AND dw.s = win.s),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, m FROM occ) o, unnest(range(o.i, o.i + o.m)) AS u(p) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM occ) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
