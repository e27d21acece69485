"""Matroska media columns: a writer for 8-bit PCM and a parser that yields packet tables.

The parser reads variable-length EBML elements (identifiers, sizes, unknown sizes), track entries, clusters with
simple blocks and block groups in any lacing (none, Xiph, fixed, EBML), and cues, into packets: track, timestamp,
byte range, key flag. Cues are checked against the clusters they point to.

The query stores each text's UTF-8 bytes, filled up with bytes 255 to a positive multiple of 576, as samples of a
PCM track, parses the stored form, joins the packets' byte ranges and computes its features from them.

Defined cases: a null text is empty, and has one frame; equal texts have equal stored forms; rows repeat as they
are. Only doc_id and text are read. A document is handled alone, so memory follows the longest one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, staged

FRAME, RATE = 576, 8000
LACE = 8  # frames in a block
BLOCKS = 48  # blocks in a cluster: under 32 s, which a block's 16-bit time can hold

#: Fixed values of the format: element identifiers.
EBML, DOCTYPE, SEGMENT, INFO, SCALE, DURATION = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, ENTRY, NUMBER, UID, TYPE, CODEC = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, FREQUENCY, CHANNELS, DEPTH, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, TIMECODE, SIMPLE, GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements whose content is elements.
MASTERS = {EBML, SEGMENT, INFO, TRACKS, ENTRY, AUDIO, CLUSTER, GROUP, CUES, POINT, POSITIONS}
NO_LACE, XIPH, FIXED, EBML_LACE = 0, 1, 2, 3


def vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer, in the fewest bytes that hold it (all ones is kept for unknown)."""
    w = width or next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * w).to_bytes(w, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], lacing: int) -> bytes:
    """The lace header and the frames."""
    if lacing == NO_LACE:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == XIPH:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif lacing == EBML_LACE:
        head += vint(sizes[0])
        for a, b in zip(sizes[:-1], sizes[1:-1]):
            w = next(k for k in range(1, 9) if abs(b - a) < (1 << 7 * k - 1) - 1)
            head += vint(b - a + (1 << 7 * w - 1) - 1, w)
    elif len(set(sizes)) > 1:
        raise ValueError("fixed lacing needs frames of one size")
    return head + b"".join(frames)


def write_pcm(payload: bytes, frame: int = FRAME, rate: int = RATE, lacing: int = FIXED, lace: int = LACE) -> bytes:
    """A file with one 8-bit PCM track; payload's length is a positive multiple of frame."""
    if not payload or len(payload) % frame:
        raise ValueError("the payload isn't whole frames")
    n = len(payload) // frame
    lace = 1 if lacing == NO_LACE else lace
    at_ms = lambda f: f * frame * 1000 // rate
    info = element(INFO, number(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", at_ms(n))))
    audio = element(AUDIO, element(FREQUENCY, struct.pack(">d", rate)) + number(CHANNELS, 1) + number(DEPTH, 8))
    entry = number(NUMBER, 1) + number(UID, 1) + number(TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, frame * 1_000_000_000 // rate) + audio
    parts = [info, element(TRACKS, element(ENTRY, entry))]
    pos, cues = sum(map(len, parts)), []
    per = max(1, min(BLOCKS, 32_000 // max(1, at_ms(lace))))
    for c in range(0, n, per * lace):
        start = at_ms(c)
        body = [number(TIMECODE, start)]
        for f in range(c, min(n, c + per * lace), lace):
            last = min(n, f + lace)
            if lacing == FIXED:
                data = bytes([last - f - 1]) + payload[f * frame : last * frame]
            else:
                data = laced([payload[i * frame : (i + 1) * frame] for i in range(f, last)], lacing)
            body.append(element(SIMPLE, b"\x81" + struct.pack(">hB", at_ms(f) - start, 0x80 | lacing << 1) + data))
        cues.append((start, pos))
        parts.append(element(CLUSTER, b"".join(body)))
        pos += len(parts[-1])
    parts.append(element(CUES, b"".join(element(POINT, number(CUE_TIME, t) + element(POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, p))) for t, p in cues)))
    head = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(DOCTYPE, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    return head + element(SEGMENT, b"".join(parts))


@dataclass
class Media:
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict = field(default_factory=dict)  # number -> {codec, rate, channels, depth, frame_ns}
    clusters: list = field(default_factory=list)  # (position in the segment, time)
    cues: list = field(default_factory=list)  # (time, track, position)
    packets: list = field(default_factory=list)  # (track, time in ns, offset, size, key)


def _head(data: bytes, at: int, end: int) -> tuple[int, int, int]:
    """Identifier, start and end of the content of the element at `at`; ValueError if it doesn't fit."""
    if at >= end or not data[at]:
        raise ValueError(f"no element at {at}")
    w = 9 - data[at].bit_length()
    ident, at = int.from_bytes(data[at : at + w], "big"), at + w
    size, start = _size(data, at, end)
    if size is None:
        return ident, start, -1
    if w > 4 or start + size > end:
        raise ValueError(f"element {ident:x} before {start} passes its parent")
    return ident, start, start + size


def _size(data: bytes, at: int, end: int) -> tuple[int | None, int]:
    if at >= end or not data[at]:
        raise ValueError(f"no size at {at}")
    w = 9 - data[at].bit_length()
    n = int.from_bytes(data[at : at + w], "big") & (1 << 7 * w) - 1
    return (None if n == (1 << 7 * w) - 1 else n), at + w


def _children(data: bytes, at: int, end: int, siblings: frozenset = frozenset()):
    """Elements of a master. One of unknown size ends before the next element that can stand beside it, or with its parent."""
    while at < end:
        ident, start, stop = _head(data, at, end)
        if stop < 0:
            stop = start
            while stop < end:
                k, s, e = _head(data, stop, end)
                if k in (siblings or {CLUSTER, CUES, TRACKS, INFO, SEGMENT, EBML}) and ident != SEGMENT:
                    break
                stop = end if e < 0 else e
        yield ident, at, start, stop
        at = stop


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b > a else 0.0


def _block(m: Media, data: bytes, at: int, end: int, time: int, key: bool | None) -> None:
    track, at = _size(data, at, end)
    rel, flags = struct.unpack(">hB", data[at : at + 3])
    at, lacing = at + 3, flags >> 1 & 3
    key = bool(flags & 0x80) if key is None else key
    if lacing == NO_LACE:
        sizes = [end - at]
    else:
        n, at = data[at] + 1, at + 1
        if lacing == FIXED:
            if (end - at) % n:
                raise ValueError(f"fixed lace at {at} isn't {n} equal frames")
            sizes = [(end - at) // n] * n
        else:
            sizes = []
            for i in range(n - 1):
                if lacing == XIPH:
                    s = 0
                    while data[at] == 255:
                        s, at = s + 255, at + 1
                    s, at = s + data[at], at + 1
                else:
                    first = at
                    s, at = _size(data, at, end)
                    if i:
                        s = sizes[-1] + s - ((1 << 7 * (at - first) - 1) - 1)
                sizes.append(s)
            sizes.append(end - at - sum(sizes))
            if min(sizes) < 0:
                raise ValueError(f"lace at {at} passes its block")
    ns = (time + rel) * m.scale
    step = m.tracks.get(track, {}).get("frame_ns", 0)
    for i, s in enumerate(sizes):
        m.packets.append((track, ns + i * step, at, s, key))
        at += s


def parse(data: bytes) -> Media:
    """ValueError for what is no Matroska file or is cut off."""
    m = Media()
    top = list(_children(data, 0, len(data)))
    if not top or top[0][0] != EBML or not any(k == SEGMENT for k, *_ in top):
        raise ValueError("no EBML header or segment")
    for ident, _, a, b in top:
        if ident != SEGMENT:
            continue
        base = a
        for k, at, a, b in _children(data, a, b):
            if k == INFO:
                for k, _, x, y in _children(data, a, b):
                    if k == SCALE:
                        m.scale = _uint(data, x, y)
                    elif k == DURATION:
                        m.duration = _float(data, x, y)
            elif k == TRACKS:
                for _, _, x, y in (e for e in _children(data, a, b) if e[0] == ENTRY):
                    t = {"codec": "", "rate": 0.0, "channels": 1, "depth": 0, "frame_ns": 0}
                    num = 0
                    for k, _, p, q in _children(data, x, y):
                        if k == NUMBER:
                            num = _uint(data, p, q)
                        elif k == CODEC:
                            t["codec"] = data[p:q].decode()
                        elif k == DEFAULT_DURATION:
                            t["frame_ns"] = _uint(data, p, q)
                        elif k == AUDIO:
                            for k, _, u, v in _children(data, p, q):
                                if k == FREQUENCY:
                                    t["rate"] = _float(data, u, v)
                                elif k in (CHANNELS, DEPTH):
                                    t["channels" if k == CHANNELS else "depth"] = _uint(data, u, v)
                    m.tracks[num] = t
            elif k == CLUSTER:
                time = 0
                m.clusters.append([at - base, 0])
                for k, _, x, y in _children(data, a, b):
                    if k == TIMECODE:
                        time = m.clusters[-1][1] = _uint(data, x, y)
                    elif k == SIMPLE:
                        _block(m, data, x, y, time, None)
                    elif k == GROUP:
                        inner = list(_children(data, x, y))
                        refers = any(e[0] == REFERENCE for e in inner)
                        for k, _, p, q in inner:
                            if k == BLOCK:
                                _block(m, data, p, q, time, not refers)
            elif k == CUES:
                for _, _, x, y in (e for e in _children(data, a, b) if e[0] == POINT):
                    time = 0
                    for k, _, p, q in _children(data, x, y):
                        if k == CUE_TIME:
                            time = _uint(data, p, q)
                        elif k == POSITIONS:
                            got = {k: _uint(data, u, v) for k, _, u, v in _children(data, p, q)}
                            m.cues.append((time, got.get(CUE_TRACK, 0), got.get(CUE_CLUSTER, 0)))
    known = {p for p, _ in m.clusters}
    if any(p not in known for _, _, p in m.cues):
        raise ValueError("a cue points to no cluster")
    return m


def padded(text: str | None, frame: int = FRAME) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b"\xff" * (max(frame, -(-len(raw) // frame) * frame) - len(raw)), len(raw)


def _read(media: bytes) -> tuple[int, str, int, str]:
    """Of a stored form, from its packet table, packet by packet: payload bytes, their SHA-256, CRC-32 of the last 32, feature."""
    m, view = parse(media), memoryview(media)
    sha, size, total, peak, tail = hashlib.sha256(), 0, 0, 0, b""
    for _, _, at, n, _ in m.packets:
        part = view[at : at + n]
        a = np.frombuffer(part, "uint8")
        sha.update(part)
        size, total, peak = size + n, total + int(a.sum(dtype="int64")), max(peak, int(a.max(initial=0)))
        tail = (tail + bytes(part[-32:]))[-32:]
    t = next(iter(m.tracks.values()))
    feature = f"{t['codec']};{t['rate']:.0f}Hz;{t['depth']}bit;packets={len(m.packets)};clusters={len(m.clusters)};cues={len(m.cues)};ms={m.duration:.0f};sum={total};peak={peak}"
    return size, sha.hexdigest(), zlib.crc32(tail), feature


def store(docs: DataFrame, lacing: int = FIXED) -> DataFrame:
    """doc_id, n_bytes, media: the stored form of every text."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):  # stored forms are as large as the texts: few at a time
                part = b.slice(i, 64)
                got = [padded(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in got], "int64"), pa.array([write_pcm(p, lacing=lacing) for p, _ in got], "binary")], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


def packets(stored: DataFrame) -> DataFrame:
    """The packet table of (doc_id, media): a row per packet, in file order."""
    def run(batches):
        for b in batches:
            for d, x in zip(b.column(0), b.column(1)):
                rows = parse(x.as_py()).packets
                cols = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array([d.as_py()] * len(rows), b.column(0).type), pa.array(range(len(rows)), "int32"), *[pa.array(c, t) for c, t in zip(cols, ("int64", "int64", "int64", "int64", "bool"))]], ["doc_id", "packet", "track", "time_ns", "offset", "size", "key"])

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, packet int, track bigint, time_ns bigint, offset bigint, size bigint, key boolean")


def digests(stored: DataFrame) -> DataFrame:
    """What the contract asks of (doc_id, n_bytes, media), from the parsed packets."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for b in batches:
            out = []
            for x in b.column(2):
                media = x.as_py()
                size, sha, crc, feature = _read(media)
                out.append((size, sha, crc, len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, ("int64", "string", "int64", "int64", "string", "string"))]], names)

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def query(docs: DataFrame) -> DataFrame:
    """Writes the stored forms as a table in the shared folder, and computes everything from what is read back."""
    return digests(staged(store(docs), "media"))
