"""Line dedup by a suffix array over line ids, built by distributed prefix doubling.

A run of consecutive lines with at least min_words words that also occurs earlier, in the order of doc_id and line, is deleted;
a line goes if it lies in any such run. Lines without words count for nothing and go with the line above them.

How it works. A line's id is a 64-bit hash of its bytes; lines are compared by it. Round r of prefix doubling sorts the distinct pairs (bucket
of the first 2^r lines, bucket of the next 2^r) over all executors and numbers them in order: the suffix array's buckets after 2^(r+1)
lines. Sorted by the last of them, over ranges of suffixes, neighbours' longest common prefixes (LCP) are counted along each range, and across
its ends. The suffixes between two LCPs below m are an LCP interval of depth m: the places of one run of m lines. Intervals are
numbered by the ends before them, in their range and in the ranges before it. In each interval the first suffix in document order is the
original and the others are later copies; a hot interval is summed up map-side, and its copies are dealt over all tasks.
Which depths m are needed: a repeated run is the union of those of its windows that have min_words words but would have fewer without
their last line, or without their first; every such window occurs earlier too. So the array is sorted only as deep as the longest
such window, and only over documents that hold a window of the first kind that is not unique.

Null or empty texts have no lines to delete. A null doc_id comes before all others. Rows that repeat doc_id and text are one document
and get the same result; of different texts with one doc_id, the order is that of a hash of the text. Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from . import common as c

MIN_WORDS = 50
_FIRST = -(2**63)


def _lines(chunk: c.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and word counts of the lines that have words, and for each text the index of its first line."""
    is_line = np.ones(256, bool)
    is_line[10] = False
    starts, ends, _ = chunk.spans(is_line)
    w, _, _ = chunk.spans(c.space_words())
    n = np.searchsorted(w, ends) - np.searchsorted(w, starts)
    some = n > 0
    starts, ends, n = starts[some], ends[some], n[some]
    return starts, ends, n, np.searchsorted(starts, chunk.offsets)


def windows(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths in lines of a document's windows that need each of their lines, the first or the last, to have least words."""
    total = np.concatenate(([0], np.cumsum(words)))
    b = np.arange(len(words))
    short = np.searchsorted(total, total[:-1] + least, "left") - b  # lines needed from b on
    ok = b + short <= len(words)
    b, short = b[ok], short[ok]
    longest = np.searchsorted(total, total[b + 1] + least, "left") - 1 - b  # lines until those after the first suffice
    n = np.maximum(longest - short, 0) + 1
    return np.repeat(b, n), np.repeat(short, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _run_hash(ids: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    up, down = c._powers(len(ids) + 1)
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(c.mix(ids.copy()) * up[: len(ids)])))
    return c.mix((run[b + m] - run[b]) * down[b] + m.astype(np.uint64))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("d"), F.xxhash64("text").alias("t"), "text")


def _documents(docs: DataFrame, least: int) -> DataFrame:
    """A row per document that has a window: ids and words of its lines, and hashes of its shortest windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk in c.chunks(b.column(2)):
                starts, ends, n, first = _lines(chunk)
                ids = c.span_hashes(chunk.buf, starts, ends, False)
                keep, hashes = [], []
                for d in range(chunk.n):
                    s, e = first[d], first[d + 1]
                    if e > s and n[s:e].sum() >= least:
                        at, m = windows(n[s:e], least)
                        lead = np.ones(len(at), bool)
                        lead[1:] = at[1:] != at[:-1]
                        keep.append(d)
                        hashes.append(_run_hash(ids[s:e], at[lead], m[lead]))
                if keep:
                    counts = np.array([first[d + 1] - first[d] for d in keep])
                    pick = np.concatenate([np.arange(first[d], first[d + 1]) for d in keep])
                    rows = pa.array(np.array(keep) + chunk.first)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(rows), b.column(1).take(rows), c.list_array(c.signed(ids[pick]), counts), c.list_array(n[pick].astype(np.int32), counts),
                         c.list_array(c.signed(np.concatenate(hashes)), np.array([len(x) for x in hashes]))],
                        ["d", "t", "ids", "words", "hashes"],
                    )

    return _keyed(docs).mapInArrow(run, "d long, t long, ids array<long>, words array<int>, hashes array<long>")


def _ranked(pairs: DataFrame, tables: c.Tables) -> DataFrame:
    """Distinct pairs (a, b) with ranks in their order; ranks are increasing, not dense."""
    return tables.cut(pairs.distinct().orderBy("a", "b").select("a", "b", F.monotonically_increasing_id().alias("r")))


def suffix_array(lines: DataFrame, depth: int, tables: c.Tables) -> DataFrame:
    """lines (d, t, line, words, id): adds r0, r1, ... : the buckets of each suffix in the array sorted by its first 1, 2, 4, ... lines,
    until they reach depth. Orders of lines are those of their ids; the end of a document comes first."""
    names, level = ["r0"], 0
    now = lines.withColumnRenamed("id", "r0")
    while (1 << level) < depth:
        after = F.lead(names[-1], 1 << level).over(Window.partitionBy("d", "t").orderBy("line"))
        rows = tables.cut(now.withColumn("a", F.col(names[-1])).withColumn("b", F.coalesce(after, F.lit(_FIRST))))
        ranks = _ranked(rows.select("a", "b"), tables)
        level += 1
        names.append(f"r{level}")
        now = tables.cut(rows.join(ranks.withColumnRenamed("r", names[-1]), ["a", "b"]).drop("a", "b"), drop=(rows, ranks, now))
    return now


def deletions(docs: DataFrame, least: int, tables: c.Tables) -> DataFrame:
    """(d, t, starts, lengths): for each document that loses lines, windows that are later copies, in lines that have words."""
    all_docs = tables.cut(_documents(docs, least))
    own = all_docs.select("d", "t", F.explode("hashes").alias("h"))
    again = own.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    taking = own.join(again, "h", "left_semi").select("d", "t").distinct()
    some = tables.cut(all_docs.dropDuplicates(["d", "t"]).join(taking, ["d", "t"], "left_semi").select("d", "t", "ids", "words"), drop=(all_docs,))

    def deepest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0
        for b in batches:
            for w in b.column(0):
                _, m = windows(np.array(w.as_py()), least)
                most = max(most, int(m.max(initial=0)))
        yield pa.RecordBatch.from_arrays([pa.array([most], pa.int64())], ["m"])

    depth = some.select("words").mapInArrow(deepest, "m long").agg(F.max("m")).first()[0] or 0
    lines = some.select("d", "t", F.posexplode(F.arrays_zip("ids", "words")).alias("line", "x")).select("d", "t", "line", F.col("x.words").alias("words"), F.col("x.ids").alias("id"))
    array = suffix_array(lines, depth, tables)
    last = array.columns[-1]

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The suffixes that begin a window: their bucket, place, shortest and longest window, and line ids as far as the latter."""
        for batch in batches:
            out: list[list[np.ndarray]] = []
            for i, (d, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                x = batch.column(2)[i].values
                by = np.argsort(x.field("line").to_numpy())
                b, m = windows(x.field("words").to_numpy()[by], least)
                lead = np.flatnonzero(np.concatenate((np.ones(min(1, len(b)), bool), b[1:] != b[:-1])))
                at, lo = b[lead], m[lead]
                hi = m[np.append(lead[1:], len(m)) - 1]
                pick = np.repeat(at - (np.cumsum(hi) - hi), hi) + np.arange(hi.sum())
                out.append([x.field("rank").to_numpy()[by][at], np.full(len(at), d), np.full(len(at), t), at, lo, hi, x.field("id").to_numpy()[by][pick]])
            if out:
                *cols, ids = (np.concatenate(z).astype(np.int64) for z in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), c.list_array(ids, cols[5])], ["rank", "d", "t", "b", "lo", "hi", "ids"])

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a sorted range to a row for each window: how many LCPs below m come before it in the range. As its last row, with no d, the
        range's first and last ids, and how many LCPs below each m up to depth it has in all."""
        part, ends, before = TaskContext.get().partitionId(), [None, None], np.zeros(depth + 1, np.int64)
        deep = np.arange(depth + 1)
        null = lambda n, kind: pa.nulls(n, kind)
        longs = pa.list_(pa.int64())
        for batch in batches:
            if not batch.num_rows:
                continue
            d, t, b, lo, hi = (batch.column(i).to_numpy() for i in range(1, 6))
            ids, size = batch.column(6).flatten().to_numpy(), hi
            start = np.cumsum(size) - size
            old = ends[1] if ends[1] is not None else np.zeros(0, np.int64)
            ids, start, size = np.concatenate((old, ids)), np.append(0, start + len(old)), np.append(len(old), size)
            lcp = _lcp(ids, start, size, depth)
            small = lcp[:, None] < deep  # of each row with the one before it
            if ends[1] is None:
                ends[0], small[0] = batch.column(6)[0].values.to_numpy(), False
            run = before + np.cumsum(small, axis=0)
            before, ends[1] = run[-1], batch.column(6)[batch.num_rows - 1].values.to_numpy()
            n = hi - lo + 1
            row = np.repeat(np.arange(len(n)), n)
            m = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), part)), *(pa.array(x[row]) for x in (d, t, b)), pa.array(m), pa.array(run[row, m]), null(len(row), longs), null(len(row), longs), null(len(row), longs)], FOUND_NAMES)
        if ends[0] is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), *(null(1, pa.int64()) for _ in range(5)), *(pa.array([list(map(int, x))], longs) for x in (*ends, before))], FOUND_NAMES)

    whole = array.groupBy("d", "t").agg(F.collect_list(F.struct("line", "words", F.col("r0").alias("id"), F.col(last).alias("rank"))).alias("rows"))
    order = ["rank", "d", "t", "b"]
    placed = whole.mapInArrow(suffixes, "rank long, d long, t long, b long, lo long, hi long, ids array<long>").repartitionByRange(*order).sortWithinPartitions(*order)
    found = tables.cut(placed.mapInArrow(intervals, FOUND), drop=(array, some))
    # one row a range: its ends and totals; what they add to the numbers of the ranges after it is broadcast, depth + 1 numbers a range
    shift, rows, end = np.zeros(depth + 1, np.int64), [], None
    for r in found.where("d IS NULL").select("part", "first", "last", "totals").orderBy("part").collect():
        if end is not None:
            ids = np.array(end + r["first"], np.int64)
            lcp = _lcp(ids, np.array([0, len(end)]), np.array([len(end), len(r["first"])]), depth)[0]
            shift = shift + (lcp < np.arange(depth + 1))
        rows.append((r.part, shift.tolist()))
        shift, end = shift + np.array(r.totals), r["last"]
    shifts = F.broadcast(docs.sparkSession.createDataFrame(rows, "part long, shift array<long>"))
    numbered = found.where("d IS NOT NULL").join(shifts, "part").select("d", "t", "b", "m", (F.col("n") + F.element_at("shift", F.col("m").cast("int") + 1)).alias("x"))
    firsts = numbered.groupBy("m", "x").agg(F.min(F.struct("d", "t", "b")).alias("f"), F.count("*").alias("copies")).where("copies > 1")
    firsts = tables.cut(firsts)
    met = c.split_join(numbered, firsts, ["m", "x"], "copies", numbered.count())
    later = met.where("f IS NOT NULL AND (d <> f.d OR t <> f.t OR b <> f.b)")
    runs = later.groupBy("d", "t").agg(F.collect_list(F.struct("b", "m")).alias("runs"))
    return tables.cut(runs, drop=(found, firsts))


FOUND = "part long, d long, t long, b long, m long, n long, first array<long>, last array<long>, totals array<long>"
FOUND_NAMES = [x.split()[0] for x in FOUND.split(", ")]


def _lcp(ids: np.ndarray, start: np.ndarray, size: np.ndarray, depth: int) -> np.ndarray:
    """The longest common prefix of each list but the first with the one before it. Lists are given by starts and sizes in ids."""
    out = np.zeros(len(start) - 1, np.int64)
    live = np.arange(len(out))
    for j in range(depth):
        live = live[(size[live] > j) & (size[live + 1] > j)]
        live = live[ids[start[live] + j] == ids[start[live + 1] + j]]
        if not len(live):
            break
        out[live] += 1
    return out


def dedup(docs: DataFrame, *, min_words: int = MIN_WORDS, out: str | None = None) -> DataFrame:
    """All rows and columns of docs, text without later copies of runs, and a struct column: n_lines, n_words, n_deleted (lines before
    it, their words, and those that went). Unless given, its name is _lines, with underscores before it while that is taken. Null texts stay null."""
    out = out or c.free_name(docs, "_lines")
    spark = docs.sparkSession
    t = c.Tables(spark)
    gone = deletions(docs.select("doc_id", "text"), min_words, t)
    names = [n.lower() for n in docs.columns]
    at, key = names.index("text"), names.index("doc_id")
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    fields = [T.StructField(f.name, f.dataType) for f in plain.schema]
    info = T.StructType([T.StructField(n, T.LongType()) for n in ("n_lines", "n_words", "n_deleted")])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk in c.chunks(b.column(at), 8 * c.CHUNK_BYTES):
                rows = b.slice(chunk.first, chunk.n)
                texts, counts = rows.column(at).to_pylist(), np.zeros((3, chunk.n), np.int64)
                starts, _, words, first = _lines(chunk)
                for d, runs in enumerate(rows.column(rows.num_columns - 1).to_pylist()):
                    lines = (texts[d] or "").split("\n") if texts[d] else []
                    own = words[first[d] : first[d + 1]]
                    counts[:2, d] = len(lines), own.sum()
                    if runs:
                        drop = np.zeros(len(own) + 1, bool)  # by number of the last line that has words
                        for r in runs:
                            drop[r["b"] + 1 : r["b"] + r["m"] + 1] = True
                        has = np.fromiter((bool(x.strip(" \t\x0b\x0c\r")) for x in lines), bool, len(lines))
                        stay = ~drop[np.cumsum(has)]
                        counts[2, d] = len(lines) - stay.sum()
                        texts[d] = "\n".join([x for x, k in zip(lines, stay.tolist(), strict=True) if k])
                cols = [pa.array(texts, pa.string()) if i == at else rows.column(i) for i in range(len(fields))]
                what = pa.StructArray.from_arrays([pa.array(x) for x in counts], ["n_lines", "n_words", "n_deleted"])
                yield pa.RecordBatch.from_arrays([*cols, what], [*(f.name for f in fields), "x"])

    # only rows that may lose lines are shuffled
    left = c.maybe(plain.withColumns({"d": F.coalesce(F.col(f"c{key}").cast("long"), F.lit(_FIRST)), "t": F.xxhash64(f"c{at}")}), gone, ["d", "t"])
    copies = left.where("may").groupBy("d", "t").agg(F.count("*").alias("copies"))
    ends = t.cut(gone.join(copies.hint("merge"), ["d", "t"]))
    met = c.split_join(left.where("may").drop("may"), ends, ["d", "t"], "copies", ends.agg(F.sum("copies")).first()[0] or 0).select(*plain.columns, "runs")
    stay = left.where("may IS NULL").select(*plain.columns, F.lit(None).cast(met.schema["runs"].dataType).alias("runs"))
    return stay.union(met).mapInArrow(apply, T.StructType([*fields, T.StructField("x", info)])).toDF(*docs.columns, out)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_deleted, text_sha256 of what is left, a row per document."""
    found = dedup(docs.select("doc_id", "text"))
    return found.select("doc_id", "_lines.n_lines", "_lines.n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def stage(docs: DataFrame) -> DataFrame:
    """The rows of docs with shortened texts, and n_chars of those; a document that had words and has none left goes."""
    out = c.free_name(docs, "_lines")
    found = dedup(docs, out=out)
    lost = F.col(f"{out}.n_deleted")
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(lost > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    gone = (lost > 0) & (F.trim(F.regexp_replace("text", r"[\t\n\x0B\f\r ]+", "")) == "")
    return found.where(~F.coalesce(gone, F.lit(False))).select(*[f"`{n}`" for n in docs.columns])


def brute(texts: list[tuple[int, str | None]], least: int) -> list[str | None]:
    """The texts that dedup leaves, by comparing every run with every earlier place; doc_ids differ."""
    has = lambda x: bool(x.strip(" \t\x0b\x0c\r"))
    count = lambda x: len([w for w in x.translate(str.maketrans("\t\x0b\x0c\r", "    ")).split(" ") if w])
    lines = [(d, [x for x in (t or "").split("\n") if has(x)]) for d, t in sorted(texts, key=lambda x: x[0])]
    flat = [(d, i, own) for d, own in lines for i in range(len(own))]
    drop: dict[int, set[int]] = {}
    for k, (d, i, own) in enumerate(flat):
        for _, j, other in flat[:k]:
            m = 0
            while i + m < len(own) and j + m < len(other) and own[i + m] == other[j + m]:
                m += 1
            if sum(map(count, own[i : i + m])) >= least:
                drop.setdefault(d, set()).update(range(i + 1, i + m + 1))
    out = []
    for d, t in texts:
        seen, kept = 0, []
        for x in (t or "").split("\n") if t else []:
            seen += has(x)
            if seen not in drop.get(d, ()):
                kept.append(x)
        out.append(None if t is None else "\n".join(kept))
    return out


SQL = r"""
WITH a AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w
           FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text <> '')),
p AS (SELECT *, count(*) FILTER (w > 0) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM a),
l AS (SELECT doc_id, p, line, w, sum(w) OVER (PARTITION BY doc_id ORDER BY p) AS cw FROM p WHERE w > 0),
ls AS (SELECT doc_id, list(line ORDER BY p) AS ls FROM l GROUP BY 1),
win AS (SELECT x.doc_id, x.p AS b, y.p AS e FROM l x JOIN l y ON x.doc_id = y.doc_id AND y.p >= x.p
        WHERE y.cw - (x.cw - x.w) >= 50 AND ((y.cw - y.w) - (x.cw - x.w) < 50 OR y.cw - x.cw < 50)),
s AS (SELECT win.doc_id, b, e, row_number() OVER (PARTITION BY array_to_string(ls[b:e], chr(10)) ORDER BY win.doc_id, b) AS k FROM win JOIN ls USING (doc_id)),
gone AS (SELECT DISTINCT s.doc_id, u.p FROM s, unnest(range(b, e + 1)) AS u(p) WHERE k > 1),
kept AS (SELECT p.doc_id, count(*) AS n_lines, count(gone.p) AS n_deleted, string_agg(line, chr(10) ORDER BY i) FILTER (gone.p IS NULL) AS t
         FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.p = gone.p GROUP BY 1)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_deleted, 0) AS BIGINT) AS n_deleted, sha256(coalesce(t, '')) AS text_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""
