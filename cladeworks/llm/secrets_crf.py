"""Secret scans by a linear-chain conditional random field.

Tokens are runs of anything but white space, a chain is a line. Each token is tagged as secret begin, secret inside or outside. Scores come
from its shape (length; and of its longest run of letters and digits: length, how often the class of characters changes, shares of
digits and capitals, whether it's hexadecimal, repeats), its word, its key part, the words before and after it, what the word before
ends in, and of the file: the share of digits, the length, the place of the line, the source. Transitions join neighbours, and Viterbi finds
the best tags of every line, all lines of a chunk in step. The base patterns find spans of fixed kinds in every text; spans tagged
by the field are added where they overlap none of those, as kind `crf`.

The field is trained on the driver, by likelihood with forward-backward; its labels are the base spans. All documents are searched for
such spans, and it learns from TRAIN_DOCS of them at most, half with a span and half without, those of the smallest hashes; of a document
from DOC_LINES lines at most, those with a span first, and of a line from a window of LINE_TOKENS tokens at most, around its first span. Half of
the time the words of a token and its neighbours are hidden, so that it doesn't just learn the patterns' key words but what
secrets look like, and finds those behind other words. No span is no proof of no secret: a line with an unlabelled token of mixed letters and
digits (RUN_STEP, CHANGE_STEP) teaches nothing and is left out of training. The sample doesn't depend on how rows are dealt over partitions. Without any
span nothing is added. Every line of every text is tagged, however long.

Null texts are empty. Rows that repeat a doc_id are scanned one by one. Offsets count code points. A source column is read if there is
one; other columns are not.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import common as c

TRAIN_DOCS = 3000
DOC_LINES = 16
LINE_TOKENS = 64
WORD_BITS = 12
EPOCHS = 6
RUN_STEP, CHANGE_STEP = 4, 3  # of LENGTH and CHANGES: 12 letters and digits that change their class in a fifth of places
KINDS = ("assign", "access", "hex", "crf")


def _any_case(x: str) -> str:
    return "".join(f"[{ch.upper()}{ch}]" if ch.isalpha() else ch for ch in x)


PATTERNS = {
    "assign": (re.compile(rf"({'|'.join(map(_any_case, ('password', 'passwd', 'secret', 'token', 'api_?key')))})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]{16,}"), 0, 16),  # a run is matched whole or not at all
}
MAY_MATCH = r"(?i)password|passwd|secret|token|api_?key|AKIA|[0-9a-f]{16}"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    return [(kind, m.start(), m.end()) for kind, (p, group, least) in PATTERNS.items() for m in p.finditer(text) if len(m[group]) >= least]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


_KIND = np.zeros(256, np.int64)  # 0 other, 1 small, 2 capital, 3 digit, 4 symbols of keys
_KIND[[*range(97, 123), *range(128, 256)]] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[ord(x) for x in "+/_=-:"]] = 4
_RUN = np.zeros(256, bool)
_RUN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True
WORDS = 1 << WORD_BITS
TOKEN = [4, 8, 12, 16, 20, 32, 64]
LENGTH = [6, 8, 10, 12, 14, 16, 20, 24, 32, 40, 64]
CHANGES = [0.04, 0.12, 0.2, 0.3, 0.45]
SHARES = [0.01, 0.2, 0.45, 0.75]
# how many values each feature of a token has; the last four are of words, and can be hidden
SIZES = [8 * 3 * 2, 12 * 6, 12 * 2 * 2, 4 * 5 * 5, 8 * 4, 8 * 4, 3 * 4, 65 * 4, 4 * 4 * 2, WORDS, WORDS, WORDS, WORDS]
OFFSETS = np.concatenate(([0], np.cumsum(SIZES)))
N_FEATURES, N_WORDS = len(SIZES), 4
HIDDEN = int(OFFSETS[-1])  # stands for a word that isn't shown
SIZE = HIDDEN + N_WORDS + 1


def token_features(chunk: c.Chunk, sources: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of tokens, the index of each line's first token (and the number of tokens), the numbers of each token's features, a row
    for each, and the numbers of lines in their texts. sources has a number below 64 for each text."""
    starts, ends, _ = chunk.spans(c.space_words())
    n = len(starts)
    if not n:
        return starts, ends, np.zeros(1, np.int64), np.zeros((0, N_FEATURES), np.int64), np.zeros(0, np.int64)
    kind = _KIND[chunk.buf]
    total = lambda x: np.concatenate(([0], np.cumsum(x)))
    step = lambda x, edges: np.searchsorted(edges, x, "right")
    size = ends - starts
    digits = total(kind == 3)
    symbols = total(kind == 4)
    # the longest run of letters and digits of each token; tokens without one have the empty run at their start
    r0, r1, _ = chunk.spans(_RUN)
    lo, hi = starts.copy(), starts.copy()
    if len(r0):
        of = np.searchsorted(starts, r0, "right") - 1
        lead = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        best = np.maximum.reduceat(((r1 - r0) << 32) | (2**32 - 1 - np.arange(len(r0))), lead)
        best = 2**32 - 1 - (best & (2**32 - 1))
        lo[of[lead]], hi[of[lead]] = r0[best], r1[best]
    length = hi - lo
    one = np.maximum(length, 1)
    within = lambda run: run[hi] - run[lo]
    change = np.zeros(len(kind), np.int64)
    change[1:] = (kind[1:] != kind[:-1]) & _RUN[chunk.buf[1:]] & _RUN[chunk.buf[:-1]]
    same = np.zeros(len(kind), np.int64)
    same[1:] = chunk.buf[1:] == chunk.buf[:-1]
    first_in = np.minimum(lo, len(kind) - 1)
    changes = within(total(change)) - np.where(length > 0, change[first_in], 0)
    repeats = within(total(same)) / one > 0.2
    is_hex = within(total(_HEX[chunk.buf])) == length
    coarse = step(length, [8, 12, 16])
    share_d, share_u = step(within(digits) / one, SHARES), step(within(total(kind == 2)) / one, SHARES)

    hash_of = lambda a, z: (c.span_hashes(chunk.buf, a, z, True) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    word = hash_of(starts, ends)
    where = np.flatnonzero(np.isin(chunk.buf, [61, 58]))
    cut = np.searchsorted(where, starts)
    at = where[np.minimum(cut, len(where) - 1)] if len(where) else ends
    key = hash_of(starts, np.where((cut < len(where)) & (at < ends), at, starts))
    breaks = np.flatnonzero(chunk.buf == 10)
    text = np.searchsorted(chunk.offsets, starts, "right") - 1
    line = np.searchsorted(breaks, starts) + text
    new = np.concatenate(([True], line[1:] != line[:-1]))
    before, after = np.roll(word, 1), np.roll(word, -1)
    before[new], after[np.concatenate((new[1:], [True]))] = 0, 0
    last = chunk.buf[ends - 1]
    ends_in = np.roll(np.where(last == 58, 1, np.where(last == 61, 2, 0)), 1)
    ends_in[new] = 3
    has_key = (at < lo) & (at >= starts)
    bytes_of = np.maximum(1, np.diff(chunk.offsets))
    of_text = step((digits[chunk.offsets[1:]] - digits[chunk.offsets[:-1]]) / bytes_of, [0.001, 0.003, 0.01, 0.02, 0.05, 0.1, 0.3])[text]
    first_line = np.searchsorted(breaks, chunk.offsets[:-1]) + np.arange(chunk.n)
    number = line - first_line[text]
    last_line = np.searchsorted(breaks, chunk.offsets[1:]) + np.arange(chunk.n)
    place = np.where(number == 0, 0, np.where(line == last_line[text], 2, 1))
    source = (sources if sources is not None else np.full(chunk.n, 64))[text]
    ids = [
        (step(size, TOKEN) * 3 + np.minimum(symbols[ends] - symbols[starts], 2)) * 2 + (length == size),
        step(length, LENGTH) * 6 + step(changes / one, CHANGES),
        (step(length, LENGTH) * 2 + is_hex) * 2 + repeats,
        (coarse * 5 + share_d) * 5 + share_u,
        of_text * 4 + coarse,
        step(bytes_of, [200, 500, 1000, 2000, 5000, 20000, 100000])[text] * 4 + coarse,
        place * 4 + coarse,
        source * 4 + coarse,
        (ends_in * 4 + coarse) * 2 + has_key,
        word, before, after, key,
    ]
    return starts, ends, np.append(np.flatnonzero(new), n), np.stack(ids, 1) + OFFSETS[:-1], number[new]


class Field:
    """Weights (SIZE, 3), transitions (3, 3) and starts (3) of the tags outside, begin, inside; inside can't follow outside."""

    def __init__(self) -> None:
        self.w, self.t, self.s = np.zeros((SIZE, 3)), np.zeros((3, 3)), np.zeros(3)
        self.w[-1] = (2.0, 0.0, 0.0)

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        out = np.repeat(self.w[-1][None], len(ids), 0)
        for k in range(ids.shape[1]):
            out += self.w[ids[:, k]]
        return out

    def allowed(self) -> tuple[np.ndarray, np.ndarray]:
        t, s = self.t.copy(), self.s.copy()
        t[0, 2] = s[2] = -1e9
        return t, s

    def viterbi(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best tags of all lines; first has the index of each line's first token, and the number of tokens at its end."""
        t, s = self.allowed()
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        at, n = first[:-1][order], n[order]
        back = np.zeros((len(scores), 3), np.int8)
        best, ends = scores[at] + s, np.zeros((len(at), 3))
        live = len(at)
        for k in range(1, int(n[0]) if len(n) else 0):
            still = int(np.searchsorted(-n, -k, "left"))  # lines of more than k tokens
            ends[still:live] = best[still:live]
            live, best = still, best[:still]
            x = best[:, :, None] + t
            arg = x.argmax(1)
            rows = at[:live] + k
            back[rows] = arg
            best = np.take_along_axis(x, arg[:, None], 1)[:, 0] + scores[rows]
        ends[:live] = best
        tags = np.zeros(len(scores), np.int8)
        now = ends.argmax(1)
        for k in range(int(n[0]) - 1 if len(n) else -1, -1, -1):
            live = int(np.searchsorted(-n, -k, "left"))
            rows = at[:live] + k
            tags[rows] = now[:live]
            if k:
                now[:live] = back[rows, now[:live]]
        return tags


def _marginals(scores: np.ndarray, mask: np.ndarray, t: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tag and transition probabilities of padded lines (lines, tokens, 3)."""
    lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    b, n, _ = scores.shape
    f, g = np.zeros((b, n, 3)), np.zeros((b, n, 3))
    f[:, 0] = scores[:, 0] + s
    for k in range(1, n):
        f[:, k] = np.where(mask[:, k, None], lse(f[:, k - 1, :, None] + t, 1) + scores[:, k], f[:, k - 1])
    for k in range(n - 2, -1, -1):
        g[:, k] = np.where(mask[:, k + 1, None], lse(t + (scores[:, k + 1] + g[:, k + 1])[:, None, :], 2), 0)
    z = lse(f[:, -1], 1)
    p = np.exp(f + g - z[:, None, None]) * mask[:, :, None]
    pair = np.exp(f[:, :-1, :, None] + t + (scores[:, 1:] + g[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
    return p, pair.sum((0, 1))


HIDDEN_ROW = HIDDEN + np.maximum(0, np.arange(N_FEATURES) - (N_FEATURES - N_WORDS))


def train(lines: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> Field | None:
    """lines: feature numbers and tags of each token. Adam on the likelihood, with a small penalty on squares; words are hidden at random."""
    if not any((tags > 0).any() for _, tags in lines):
        return None
    field, rng, step = Field(), np.random.default_rng(11), 0
    parts = [field.w, field.t, field.s]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    lines = sorted(lines, key=lambda x: len(x[1]))
    groups = [lines[i : i + 64] for i in range(0, len(lines), 64)]
    for _ in range(epochs):
        for gi in rng.permutation(len(groups)):
            group = [(np.where(rng.random((len(ids), 1)) < np.array([0.0] * (N_FEATURES - N_WORDS) + [0.5] * N_WORDS), HIDDEN_ROW, ids), tags) for ids, tags in groups[gi]]
            b, n = len(group), max(len(x[1]) for x in group)
            mask, gold = np.zeros((b, n), bool), np.zeros((b, n, 3))
            scores = np.zeros((b, n, 3))
            for i, (ids, tags) in enumerate(group):
                mask[i, : len(tags)] = True
                gold[i, np.arange(len(tags)), tags] = 1
                scores[i, : len(tags)] = field.emissions(ids)
            t, s = field.allowed()
            p, pair = _marginals(scores, mask, t, s)
            pull = (p - gold) / b
            grads = [1e-4 * field.w, (pair - np.einsum("bka,bkc->ac", gold[:, :-1], gold[:, 1:])) / b, pull[:, 0].sum(0)]
            flat = np.concatenate([pull[i, : len(x[1])] for i, x in enumerate(group)])
            ids = np.concatenate([x[0] for x in group])
            for tag in range(3):
                grads[0][:, tag] += np.bincount(ids.ravel(), np.repeat(flat[:, tag], ids.shape[1]), SIZE)
            grads[0][-1] += flat.sum(0)
            step += 1
            for x, grad, a, v in zip(parts, grads, first, second, strict=True):
                a += 0.1 * (grad - a)
                v += 0.01 * (grad**2 - v)
                x -= 0.05 * a / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return field


def _points(buf: np.ndarray) -> np.ndarray:
    """For each byte offset, the number of code points before it."""
    return np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))


def _tags(chunk: c.Chunk, texts: list[str | None], starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The tags that base spans give to tokens: the first of a span, or of its part in a line, is a begin."""
    tags = np.zeros(len(starts), np.int8)
    for d in range(chunk.n):
        if spans := base_spans(texts[chunk.first + d] or ""):
            lo, hi = chunk.offsets[d : d + 2]
            point = _points(chunk.buf[lo:hi])
            i, j = np.searchsorted(starts, [lo, hi])
            a, z = point[starts[i:j] - lo], point[ends[i:j] - lo]
            for _, s, e in spans:
                inside = np.flatnonzero((a < e) & (z > s)) + i
                fresh = inside[tags[inside] == 0]
                tags[fresh] = 2
                tags[fresh[:1]] = 1
    lead = np.zeros(len(tags), bool)
    lead[first[:-1]] = True
    before = np.concatenate(([0], tags[:-1]))
    tags[(tags == 2) & (lead | (before == 0))] = 1
    return tags


def _source(docs: DataFrame):
    return F.pmod(F.xxhash64("source"), F.lit(64)).cast("int") if "source" in docs.columns else F.lit(64)


def fit(docs: DataFrame, rows: int = TRAIN_DOCS) -> Field | None:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            may = pc.fill_null(pc.match_substring_regex(b.column(1), MAY_MATCH), False).to_numpy(zero_copy_only=False)
            has = [bool(m) and bool(base_spans(b.column(1)[i].as_py())) for i, m in enumerate(may.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(has, pa.bool_())], ["h", "has"])

    one = docs.where("doc_id IS NOT NULL").select(F.xxhash64("doc_id", "text").alias("h"), "text", _source(docs).alias("source"))
    found = one.select("h", "text").mapInArrow(search, "h long, has boolean").groupBy("h").agg(F.first("has").alias("has"))
    half = rows // 2
    chosen = found.where("has").orderBy("h").limit(half).union(found.where("NOT has").orderBy("h").limit(half)).collect()  # rows at most
    schema = "h long, line long, ids array<int>, tags array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, h, sources = b.column(1).to_pylist(), b.column(0).to_numpy(), b.column(2).to_numpy()
            for chunk in c.chunks(b.column(1)):
                starts, ends, first, ids, number = token_features(chunk, sources[chunk.first : chunk.first + chunk.n])
                if not len(starts):
                    continue
                tags = _tags(chunk, texts, starts, ends, first)
                any_ = np.maximum.reduceat(tags, first[:-1]) > 0
                run, change = np.divmod(ids[:, 1] - OFFSETS[1], 6)
                doubtful = (tags == 0) & (run >= RUN_STEP) & (change >= CHANGE_STEP)
                usable = np.maximum.reduceat(doubtful, first[:-1]) == 0
                own = np.searchsorted(chunk.offsets, starts[first[:-1]], "right") - 1 + chunk.first
                order = c.mix(h[own].view(np.uint64) ^ (number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                by = np.lexsort((order, ~any_, own))
                rank = np.arange(len(by)) - np.searchsorted(own[by], own[by])
                out = []
                for k in by[(rank < DOC_LINES) & usable[by]]:
                    s, e = first[k], first[k + 1]
                    if e - s > LINE_TOKENS:
                        middle = s + int(np.argmax(tags[s:e] > 0)) - LINE_TOKENS // 2
                        s = min(max(s, middle), e - LINE_TOKENS)
                        e = s + LINE_TOKENS
                    mine = tags[s:e].copy()
                    mine[0] = 1 if mine[0] else 0
                    out.append((h[own[k]], number[k], ids[s:e].ravel().astype(np.int32), mine.astype(np.int32)))
                yield pa.RecordBatch.from_pylist([{"h": int(a), "line": int(x), "ids": i, "tags": y} for a, x, i, y in out], pa.schema([("h", pa.int64()), ("line", pa.int64()), ("ids", pa.list_(pa.int32())), ("tags", pa.list_(pa.int32()))]))

    if not chosen:
        return None
    few = F.broadcast(docs.sparkSession.createDataFrame([(r.h,) for r in chosen], "h long"))
    got = one.join(few, "h").mapInArrow(run, schema).dropDuplicates(["h", "line"]).toArrow().sort_by([("h", "ascending"), ("line", "ascending")])
    return train([(i.values.to_numpy().reshape(-1, N_FEATURES), t.values.to_numpy()) for i, t in zip(got["ids"], got["tags"], strict=True)])


SCAN = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, field: Field | None) -> DataFrame:
    """Counts of base spans by kind, the digest of all of them, and all spans, a row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for b in batches:
            for chunk in c.chunks(b.column(1), 4 * c.CHUNK_BYTES):
                texts = b.column(1).slice(chunk.first, chunk.n)
                spans: dict[int, list[tuple[str, int, int]]] = {}
                for d in np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, MAY_MATCH), False).to_numpy(zero_copy_only=False)).tolist():
                    spans[d] = base_spans(texts[d].as_py())
                counts = np.zeros((3, chunk.n), np.int64)
                base = [joined(spans.get(d, [])) for d in range(chunk.n)]
                for d, found in spans.items():
                    for k, kind in enumerate(KINDS[:3]):
                        counts[k, d] = sum(x[0] == kind for x in found)
                if field is not None:
                    starts, ends, first, ids, _ = token_features(chunk, b.column(2).slice(chunk.first, chunk.n).to_numpy())
                    tags = field.viterbi(field.emissions(ids), first) if len(starts) else np.zeros(0, np.int8)
                    begins = np.flatnonzero(tags == 1)
                    if len(begins):
                        stop = np.flatnonzero(np.concatenate((tags[1:] != 2, [True])))
                        last = stop[np.searchsorted(stop, begins)]
                        text = np.searchsorted(chunk.offsets, starts[begins], "right") - 1
                        for d in np.unique(text).tolist():
                            lo, hi = chunk.offsets[d : d + 2]
                            point, own = _points(chunk.buf[lo:hi]), text == d
                            fixed = list(spans.get(d, []))
                            for s, e in zip(point[starts[begins[own]] - lo].tolist(), point[ends[last[own]] - lo].tolist(), strict=True):
                                if not any(s < y and e > x for _, x, y in fixed):
                                    spans.setdefault(d, []).append(("crf", s, e))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(chunk.first, chunk.n), *map(pa.array, counts), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base]), pa.array([joined(spans.get(d, [])) for d in range(chunk.n)])],
                    [x.split()[0] for x in SCAN.split(", ")],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _source(docs).alias("source")).mapInArrow(run, SCAN)


def secrets(docs: DataFrame) -> DataFrame:
    return scan(docs, fit(docs))
