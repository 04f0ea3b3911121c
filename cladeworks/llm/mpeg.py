"""MPEG audio columns: bytes to an audio stream and back, and an index of any MPEG-1, 2 or 2.5 stream of layers I to III.

Reading resynchronises at frame headers (a header counts if its successor, where its length says, has the same version, layer and
rate, or the stream ends there), skips ID3v2.2 to 2.4 and ID3v1 tags, reads the variable-bitrate tables Xing, Info and VBRI with an encoder's delay and
padding, verifies the CRC-16 of protected frames of all layers, and gives exact durations (samples less delay and padding, and rate) and the
byte offset of each frame. Frames are found one after the other and their checksums then computed together, so time is linear in
frames however headers change. Streams of free format (no bit rate in the header) aren't read: their bytes count as skipped.

Storing. Each UNIT payload bytes become one mono MPEG-2 layer III frame of as many samples, at 16 kHz and 144 kbit/s, with CRC: silence
whose ancillary data are the payload, so any player can play it and nothing is lost. A Xing table and an ID3v2 tag with the length come
first. Bytes that look like a header inside a payload do no harm, as frames are found by following lengths.

Null texts are empty; an empty text has one frame. Rows that repeat a doc_id or a text are stored one by one, equal texts in equal bytes.
Texts of any length work; a stream is held in memory once. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as c

UNIT = 576
TAIL = 32
# Fixed values of the format: kbit/s by (MPEG-1?, layer), Hz by version bits.
RATES = {
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
HERTZ = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    kbps: int
    hertz: int
    mono: bool
    length: int
    samples: int
    side: int

    def fits(self, other: Header) -> bool:
        return (self.version, self.layer, self.hertz) == (other.version, other.layer, other.hertz)


@lru_cache(4096)
def header(four: bytes) -> Header | None:
    """The meaning of four bytes, if they are a frame header of a fixed bit rate."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    rate, hz, pad = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1
    if version == 1 or layer == 4 or rate in (0, 15) or hz == 3:
        return None
    kbps, hertz = RATES[version == 3, layer][rate], HERTZ[version][hz]
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    length = (12000 * kbps // hertz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hertz + pad
    mono = four[3] >> 6 == 3
    side = 0 if layer < 3 else (17 if mono else 32) if version == 3 else (9 if mono else 17)
    return Header(version, layer, not four[1] & 1, kbps, hertz, mono, length, samples, side)


def crc16(data: bytes, bits: int | None = None, x: int = 0xFFFF) -> int:
    """The checksum of the first bits (all, if not given) of data."""
    bits = 8 * len(data) if bits is None else bits
    for b in data[: bits // 8]:
        x = (x << 8 & 0xFF00) ^ _CRC[x >> 8 ^ b]
    for k in range(bits % 8):
        top = (x >> 15) ^ (data[bits // 8] >> 7 - k & 1)
        x = x << 1 & 0xFFFF ^ (0x8005 if top else 0)
    return x


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        x = b << 8
        for _ in range(8):
            x = (x << 1 ^ 0x8005 if x & 0x8000 else x << 1) & 0xFFFF
        out.append(x)
    return out


_CRC = _crc_table()
_CRC_ARRAY = np.array(_CRC, np.uint16)


def _crc_rows(rows: np.ndarray) -> np.ndarray:
    """The checksum of each row of bytes."""
    x = np.full(len(rows), 0xFFFF, np.uint16)
    for col in rows.T:
        x = (x << np.uint16(8)) ^ _CRC_ARRAY[(x >> np.uint16(8)) ^ col]
    return x


# Fixed values of the format: bits of allocation for runs of subbands (bits, subbands) of layer II, by table.
ALLOCATION = {"a": [(4, 11), (3, 12), (2, 4)], "b": [(4, 11), (3, 12), (2, 7)], "c": [(4, 2), (3, 6)], "d": [(4, 2), (3, 10)], "lsf": [(4, 4), (3, 7), (2, 19)]}


def _covered(data: bytes, at: int, h: Header) -> int:
    """How many bits after the checksum it covers: side information in layer III, allocation in layer I, and selection of scale factors too in II."""
    if h.layer == 3:
        return 8 * h.side
    channels = 1 if h.mono else 2
    joint = data[at + 3] >> 6 == 1
    bound = 4 * ((data[at + 3] >> 4 & 3) + 1) if joint else 32
    if h.layer == 1:
        return 4 * (channels * min(bound, 32) + (32 - min(bound, 32)))
    each = h.kbps // channels
    if h.version != 3:
        name = "lsf"
    elif each <= 48:
        name = "d" if h.hertz == 32000 else "c"
    else:
        name = "a" if each <= 80 or h.hertz == 48000 else "b"
    widths = [w for w, n in ALLOCATION[name] for _ in range(n)]
    body = data[at + 6 : at + 6 + 64]
    value, size = int.from_bytes(body, "big"), 8 * len(body)
    used = scale = 0
    for sb, w in enumerate(widths):
        for _ in range(channels if sb < bound else 1):
            some = value >> max(0, size - used - w) & (1 << w) - 1
            scale += (1 if sb < bound else channels) * bool(some)
            used += w
    return used + 2 * scale


@dataclass
class Stream:
    frames: int = 0
    samples: int = 0
    hertz: int = 0
    checked: int = 0
    bad: int = 0
    skipped: int = 0
    delay: int = 0
    padding: int = 0
    kbps: set[int] = field(default_factory=set)
    seek: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    bodies: list[np.ndarray] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    table: tuple[int, int, bytes] | None = None

    @property
    def exact(self) -> int:
        """Samples without what the encoder added in front and behind."""
        return max(0, self.samples - self.delay - self.padding)


def _id3(data: bytes, tags: dict[str, str]) -> int:
    """Reads an ID3v2 tag at the start, into tags (its own text frames, and the title); gives its length with its footer."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    safe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    version = data[3]
    end, at = min(10 + safe(data[6:10]), len(data)), 10
    if data[5] & 0x40 and version > 2 and at + 4 <= end:  # an extended header, whose size counts itself in version 4 only
        at += safe(data[at : at + 4]) if version > 3 else 4 + int.from_bytes(data[at : at + 4], "big")
    name, head = (3, 6) if version == 2 else (4, 10)
    while at + head <= end and data[at]:
        size = data[at + name : at + name + (3 if version == 2 else 4)]
        n = safe(size) if version > 3 else int.from_bytes(size, "big")
        kind, body = data[at : at + name], data[at + head : at + head + n]
        if kind in (b"TXXX", b"TXX") and n > 1:
            key, _, value = body[1:].partition(b"\0")
            tags[key.decode("latin-1")] = value.decode("latin-1")
        elif kind in (b"TIT2", b"TT2") and n > 1:
            tags["title"] = body[1:].rstrip(b"\0").decode("latin-1")
        at += head + n
    return min(len(data), end + 10) if version == 4 and data[5] & 0x10 else end


def _table(s: Stream, data: bytes, at: int, h: Header) -> bool:
    """Whether the frame holds a variable-bitrate table, which it reads."""
    x = at + 4 + 2 * h.protected + h.side
    plain = at + 4 + h.side  # many encoders leave no room for a checksum here
    for x in (plain, x):
        if data[x : x + 4] in (b"Xing", b"Info"):
            flags, x = int.from_bytes(data[x + 4 : x + 8], "big"), x + 8
            frames = size = 0
            toc = b""
            if flags & 1:
                frames, x = int.from_bytes(data[x : x + 4], "big"), x + 4
            if flags & 2:
                size, x = int.from_bytes(data[x : x + 4], "big"), x + 4
            if flags & 4:
                toc, x = data[x : x + 100], x + 100
            x += 4 if flags & 8 else 0
            if data[x : x + 4] in (b"LAME", b"Lavf", b"Lavc") and x + 24 <= at + h.length:
                both = int.from_bytes(data[x + 21 : x + 24], "big")
                s.delay, s.padding = both >> 12, both & 0xFFF
            s.table = frames, size, toc
            return True
    x = at + 36
    if data[x : x + 4] == b"VBRI" and x + 26 <= at + h.length:
        size, frames, n, _, width = struct.unpack(">IIHHH", data[x + 10 : x + 24])
        s.delay = int.from_bytes(data[x + 6 : x + 8], "big")
        s.table = frames, size, data[x + 26 : x + 26 + n * width]
        return True
    return False


def parse(data: bytes, bodies: bool = False) -> Stream:
    """The index of a stream, and with bodies the bytes of its frames behind the side information."""
    s, buf = Stream(), np.frombuffer(data, np.uint8)
    at, end = _id3(data, s.tags), len(data)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        s.tags["title"] = data[end - 125 : end - 95].rstrip(b"\0 ").decode("latin-1")
        end -= 128
    offsets: list[int] = []
    kinds: list[Header] = []
    synced, h = False, header(data[at : at + 4])
    while at + 4 <= end:
        good = h is not None and at + h.length <= end
        after = at + h.length if good else at
        n = header(data[after : after + 4]) if good and after + 4 <= end else None
        if not (good and (after >= end or n is not None and n.fits(h) or synced and h.protected and _sound(data, at, h))):
            nxt = data.find(b"\xff", at + 1, end)
            s.skipped += (end if nxt < 0 else nxt) - at
            at, synced = (end if nxt < 0 else nxt), False
            h = header(data[at : at + 4])
            continue
        if offsets or s.table is not None or not _table(s, data, at, h):
            offsets.append(at)
            kinds.append(h)
        at, synced, h = after, True, n
    s.skipped += max(0, end - at)
    s.frames, s.seek = len(offsets), np.array(offsets, np.int64)
    if not offsets:
        return s
    s.hertz = kinds[-1].hertz
    number = {k: i for i, k in enumerate(dict.fromkeys(kinds))}
    which = np.array([number[k] for k in kinds])
    for k, i in number.items():
        own = s.seek[which == i]
        s.samples += len(own) * k.samples
        s.kbps.add(k.kbps)
        if not k.protected:
            continue
        s.checked += len(own)
        if k.layer == 3:
            rows = np.concatenate((buf[own[:, None] + np.arange(2, 4)], buf[own[:, None] + np.arange(6, 6 + k.side)]), 1)
            s.bad += int((_crc_rows(rows) != (buf[own + 4].astype(np.uint16) << np.uint16(8) | buf[own + 5])).sum())
        else:
            s.bad += sum(not _sound(data, x, k) for x in own.tolist())
    if bodies:
        edges = np.flatnonzero(np.diff(which)) + 1
        for part, i in zip(np.split(s.seek, edges), which[np.append(0, edges)].tolist(), strict=True):
            k = list(number)[i]
            step = np.diff(part)
            if len(part) > 1 and (step == k.length).all():
                rows = buf[part[0] : part[0] + len(part) * k.length].reshape(-1, k.length)
            else:
                rows = buf[part[:, None] + np.arange(k.length)]
            s.bodies.append(rows[:, 4 + 2 * k.protected + k.side :])
    return s


def _sound(data: bytes, at: int, h: Header) -> bool:
    bits = _covered(data, at, h)
    return crc16(data[at + 6 : at + 7 + bits // 8], bits, crc16(data[at + 2 : at + 4])) == int.from_bytes(data[at + 4 : at + 6], "big")


_AUDIO, _TABLE = bytes([0xFF, 0xF2, 0xD8, 0xC0]), bytes([0xFF, 0xF3, 0xD8, 0xC0])  # MPEG-2 layer III, 144 kbit/s, 16 kHz, mono


def pad(raw: bytes) -> bytes:
    return raw + b"\xff" * (UNIT * max(1, -(-len(raw) // UNIT)) - len(raw))


def encode(raw: bytes) -> bytes:
    payload = np.frombuffer(pad(raw), np.uint8).reshape(-1, UNIT)
    h, n = header(_AUDIO), len(payload)
    frames = np.zeros((n, h.length), np.uint8)
    frames[:, :4] = np.frombuffer(_AUDIO, np.uint8)
    frames[:, 4:6] = list(crc16(_AUDIO[2:] + bytes(h.side)).to_bytes(2, "big"))
    frames[:, 6 + h.side : 6 + h.side + UNIT] = payload
    size = h.length * (n + 1)
    toc = bytes(min(255, 256 * (h.length * (1 + i * n // 100)) // size) for i in range(100))
    first = _TABLE + bytes(h.side) + b"Xing" + struct.pack(">III", 7, n, size) + toc
    text = b"\0payload-bytes\0" + str(len(raw)).encode()
    safe = lambda v: bytes([v >> 21 & 127, v >> 14 & 127, v >> 7 & 127, v & 127])
    tag = b"TXXX" + safe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + safe(len(tag)) + tag + first.ljust(h.length, b"\0") + frames.tobytes()


def decode(media: bytes) -> tuple[bytes, Stream]:
    """The padded payload of a stream made by encode, and its index. Damage is an error."""
    s = parse(media, bodies=True)
    if s.bad or s.skipped or s.table is None or s.table[0] != s.frames:
        raise ValueError(f"a stream of {s.frames} frames has {s.bad} bad checksums and {s.skipped} bytes outside of frames")
    return b"".join(b[:, :UNIT].tobytes() for b in s.bodies), s


def feature(s: Stream) -> str:
    """Rate, samples, exact duration in ms, bit rates, checksums, table and seek offsets of a stream."""
    seek = s.seek
    picks = seek[[0, len(seek) // 4, len(seek) // 2, 3 * len(seek) // 4, len(seek) - 1]] if len(seek) else []
    ms = f"{s.exact * 1000 // s.hertz}.{s.exact * 10**6 // s.hertz % 1000:03d}" if s.hertz else "0"
    table = f"{s.table[0]}/{s.table[1]}/{zlib.crc32(s.table[2])}" if s.table else "-"
    return f"hz={s.hertz};samples={s.samples};ms={ms};kbps={'+'.join(map(str, sorted(s.kbps)))};frames={s.frames};crc={s.checked - s.bad}/{s.checked};table={table};seek={','.join(map(str, picks))}"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, media: each text as an audio stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk in c.chunks(b.column(1)):
                data = chunk.buf.tobytes()
                media = [encode(data[s:e]) for s, e in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(chunk.first, chunk.n), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, media binary")


def index(media: DataFrame) -> DataFrame:
    """For (doc_id, media) of any streams: samples, exact duration in seconds, hertz, frames, checked and bad checksums, bytes outside of
    frames, frames by the variable-bitrate table (null without one), title, seek offsets of all frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, m in enumerate(b.column(1)):
                s = parse(m.as_py() or b"")
                row = {"samples": s.samples, "seconds": s.exact / s.hertz if s.hertz else 0.0, "hertz": s.hertz, "frames": s.frames, "checked": s.checked, "bad": s.bad, "skipped": s.skipped, "table_frames": s.table[0] if s.table else None, "title": s.tags.get("title"), "seek": s.seek.tolist()}
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), *(pa.array([v], INDEX[k]) for k, v in row.items())], ["doc_id", *row])

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(run, "doc_id long, samples long, seconds double, hertz long, frames long, checked long, bad long, skipped long, table_frames long, title string, seek array<long>")


INDEX = dict.fromkeys(("samples", "hertz", "frames", "checked", "bad", "skipped", "table_frames"), pa.int64()) | {"seconds": pa.float64(), "title": pa.string(), "seek": pa.list_(pa.int64())}
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(docs: DataFrame) -> DataFrame:
    """Stores every text, reads the stored bytes back, and gives the contract's columns, a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column(1):
                media = m.as_py()
                payload, s = decode(media)
                rows.append((int(s.tags["payload-bytes"]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), feature(s)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(cols, kinds, strict=True))], [x.split()[0] for x in DIGEST.split(", ")])

    return store(docs).mapInArrow(run, DIGEST)
