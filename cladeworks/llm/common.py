"""Shared tools of the corpus operators: table access, the shared scratch folder, and vectorised text kernels.

The kernels work on the UTF-8 buffer of an Arrow string column, a few megabytes at a time, so their memory doesn't depend on
the number of rows in a batch. Classes of bytes decide what a word is; as every byte of a multi-byte character is 128 or more,
classes over ASCII give the same words as the character classes they stand for.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

CHUNK_BYTES = 1 << 20
COLLECT_S = 2.0

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: list[np.ndarray] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset, as in tests."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_cladeworks_scratch", None)
    if root is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = sc._cladeworks_scratch = "file://" + tempfile.mkdtemp(prefix="cladeworks-")
    path = f"{root}/cladeworks-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table in the scratch folder through Hadoop's file system, whatever store it's in."""
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session may have ended
        pass


def trim(spark: SparkSession) -> bool:
    """Gives memory that the driver has freed outside the heap back to the system. Spark runs each exchange and query on threads of large pools, and
    glibc keeps what they free in an arena for every few of them: hundreds of MB after an operator of a hundred queries. A JVM without that command
    goes without. Python's own process is trimmed likewise."""
    sc = spark.sparkContext
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)
    try:
        invoke = next(m for m in sc._jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = sc._gateway.new_array(sc._jvm.Object, 4)  # no parameters, no signature
        args[0], args[1] = sc._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(sc._jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
        return True
    except Exception:  # noqa: BLE001
        return False


class Tables:
    """Written intermediate tables of one operator. They cut lineage and outlive executors; drop() deletes those no longer read."""

    collected = 0.0

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def cut(self, df: DataFrame, *, drop: tuple[DataFrame, ...] = ()) -> DataFrame:
        path = scratch(self.spark)
        df.write.option("compression", "zstd").parquet(path)
        if time.monotonic() - Tables.collected > COLLECT_S:  # Spark deletes shuffle files once the driver has collected what refers to them
            Tables.collected = time.monotonic()
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            trim(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        self.drop(*drop)
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            if (at := self.paths.pop(id(df), None)) is not None:
                remove(self.spark, at[0])


def space_words() -> np.ndarray:
    """Words are runs of anything but ASCII white space."""
    t = np.ones(256, bool)
    t[[32, *range(9, 14)]] = False
    return t


def alnum_words() -> np.ndarray:
    """Words are runs of a-z (after lower-casing), 0-9 and non-ASCII characters."""
    t = np.zeros(256, bool)
    t[48:58] = t[97:123] = t[65:91] = t[128:] = True
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        _POWERS[:] = [np.full(size, b, _U) for b in (_BASE, pow(_BASE, -1, 2**64))]
        for p in _POWERS:
            p[0] = 1
            np.cumprod(p, out=p)
    return _POWERS[0], _POWERS[1]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each span of bytes: a rolling polynomial over random byte values, mixed with the length."""
    up, down = _powers(len(buf) + 1)
    run = np.empty(len(buf) + 1, _U)
    run[0] = 0
    np.cumsum((_TABLE[LOWER] if lower else _TABLE)[buf] * up[: len(buf)], out=run[1:])
    h = (run[ends] - run[starts]) * down[starts]
    h += (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93)
    return mix(h)


class Chunk:
    """Some consecutive texts: the bytes, and the offsets of each text in them (one more than texts)."""

    def __init__(self, first: int, buf: np.ndarray, offsets: np.ndarray):
        self.first, self.buf, self.offsets, self.n = first, buf, offsets, len(offsets) - 1

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes for which inside holds, and for each text the index of its first run."""
        if not len(self.buf):
            e = np.zeros(0, np.int64)
            return e, e, np.zeros(self.n + 1, np.int64)
        w = inside[self.buf]
        start, end = w.copy(), w.copy()
        start[1:] &= ~w[:-1]
        end[:-1] &= ~w[1:]
        cuts = self.offsets[(self.offsets > 0) & (self.offsets < len(self.buf))]
        start[cuts] = w[cuts]
        end[cuts - 1] = w[cuts - 1]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of a column (null: empty) in chunks of about size bytes, a longer text by itself."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield Chunk(lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def owner(first: np.ndarray) -> np.ndarray:
    """For each word, the index of its text; first is the third result of Chunk.spans."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


_STEPS = (np.random.default_rng(77).integers(0, 2**62, 64, dtype=np.uint64) * _U(2)) + _U(1)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, a text of fewer words, but not none, giving one of them all; and their texts."""
    n = np.diff(first)
    whole = np.flatnonzero((n > 0) & (n < k))
    total = len(words)
    if total >= k:
        h = words[: total - k + 1] * _STEPS[0]
        for j in range(1, k):
            h += words[j : total - k + 1 + j] * _STEPS[j]
        own = owner(first)
        same = own[: total - k + 1] == own[k - 1 :]
        h, own = mix(h[same]), own[: total - k + 1][same]
    else:
        h, own = np.zeros(0, _U), np.zeros(0, np.int64)
    if len(whole):
        extra = np.array([(words[first[d] : first[d + 1]] * _STEPS[: n[d]]).sum(dtype=_U) + _U(int(n[d]) * 0x51ED27) for d in whole], _U)
        h, own = np.concatenate((h, mix(extra))), np.concatenate((own, whole))
    return h, own


def set_digest(values: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Two order-free 64-bit sums of mixed values for each of n texts: equal sets of values, equal digests."""
    out = np.zeros((2, n), _U)
    for k, salt in enumerate((0x2545F4914F6CDD1D, 0x5851F42D4C957F2D)):
        run = np.zeros(len(values) + 1, _U)
        np.cumsum(mix(values ^ _U(salt)), out=run[1:])
        at = np.searchsorted(own, np.arange(n + 1))
        out[k] = run[at[1:]] - run[at[:-1]]
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind) if kind else pa.array(values))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it while df has a column of that name."""
    taken = {n.lower() for n in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def packed(df: DataFrame) -> DataFrame:
    """A column r: a struct of the columns of df, named c0, c1, ... so that no name can clash with another or hold a dot."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(F.struct("*").alias("r"))


def unpacked(rows: DataFrame, like: DataFrame, *others: str) -> DataFrame:
    """rows with r as the columns that df had when it was packed, and other columns."""
    flat = rows.select("r.*", *[F.col(x) for x in others])
    return flat.toDF(*like.columns, *others)


def maybe(rows: DataFrame, ends: DataFrame, keys: list[str], bits: int = 20) -> DataFrame:
    """rows with a column may: true where one of 2^bits buckets says that the keys may be among those of ends, else null. What is broadcast is
    one number a bucket at most. Where it's null a row needs no shuffle to learn that it meets nothing."""
    bucket = F.xxhash64(*keys).bitwiseAND((1 << bits) - 1)
    buckets = F.broadcast(ends.select(bucket.alias("_bucket")).distinct().withColumn("may", F.lit(True)))
    return rows.withColumn("_bucket", bucket).join(buckets, "_bucket", "left").drop("_bucket")


def split_join(rows: DataFrame, ends: DataFrame, keys: list[str], count: str, n_rows: int, share: int = 1000) -> DataFrame:
    """rows left joined with ends, one row a key, whose column count says how many rows have that key. Keys of more than one in `share` rows,
    of which there are fewer than `share`, are broadcast, so that no task gets all rows of a hot key; the others meet in a shuffle."""
    hot = F.broadcast(ends.where(F.col(count) * share > n_rows).withColumn("_hot", F.lit(True)))
    cold = ends.where(F.col(count) * share <= n_rows).hint("merge")
    tagged = rows.join(hot, keys, "left")
    near = tagged.where("_hot").drop("_hot")
    far = tagged.where("_hot IS NULL").select(*[f"`{n}`" for n in rows.columns]).join(cold, keys, "left")
    return near.unionByName(far)


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """Rows on the driver, for data with a stated bound; more of them are an error, never cut off."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows of {what}")
    return rows
