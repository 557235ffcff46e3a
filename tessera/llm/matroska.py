"""Matroska audio: an EBML writer and a reader that builds a packet table.

The reader walks variable-length EBML elements (unknown sizes included),
clusters, SimpleBlocks and BlockGroups with no, Xiph, EBML and fixed lacing,
and cues, and returns each packet's track, timestamp and byte range in the
file. The writer stores 8-bit PCM: a file of one track whose frames hold
``FRAME`` samples, several frames to a laced block, and a cue for each cluster.

Nulls count as empty; an empty text stores one frame of padding. Equal texts
give equal files: nothing of the row but its text is written, so rows that repeat an id
or a text differ in nothing else. A text of any length is one file, whole; memory is
that of one file and its packet table. There are no ties. Extra columns are ignored,
whatever their names, and an empty table gives no rows. No shuffle.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .runtime import attach, ship
from .textkernels import utf8

# Element identifiers of the format.
EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION, AUDIO = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0xE1
SAMPLING, CHANNELS, BIT_DEPTH, TIMESTAMP_SCALE, DURATION, MUXER, WRITER = 0xB5, 0x9F, 0x6264, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_VERSION, DOC_READ = 0x4282, 0x4287, 0x4285
MASTERS = {SEGMENT, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS, INFO, EBML}
TOP = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES}

FRAME, RATE, LACED, BLOCKS_A_CLUSTER = 576, 8000, 8, 16
#: Ticks of 1 ms; a frame of 576 samples at 8 kHz lasts 72 ms.
FRAME_MS = FRAME * 1000 // RATE


class Malformed(ValueError):
    pass


def vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer."""
    w = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * w).to_bytes(w, "big")


def signed_vint(n: int) -> bytes:
    w = next(w for w in range(1, 9) if abs(n) < (1 << 7 * w - 1) - 1)
    return (n + (1 << 7 * w - 1) - 1 | 1 << 7 * w).to_bytes(w, "big")


def element(ident: int, body: bytes | int | float) -> bytes:
    if isinstance(body, float):
        body = struct.pack(">d", body)
    elif isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def lace(frames: list[bytes], lacing: str) -> tuple[int, bytes]:
    """Flag bits and bytes of a block's frames."""
    if len(frames) == 1:
        return 0, frames[0]
    head, sizes = bytes([len(frames) - 1]), [len(f) for f in frames]
    if lacing == "fixed":
        if len(set(sizes)) > 1:
            raise ValueError("fixed lacing needs frames of one size")
        return 0x04, head + b"".join(frames)
    if lacing == "xiph":
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
        return 0x02, head + b"".join(frames)
    head += vint(sizes[0]) + b"".join(signed_vint(b - a) for a, b in zip(sizes, sizes[1:-1], strict=False))
    return 0x06, head + b"".join(frames)


def write(payload: bytes, lacing: tuple[str, ...] = ("fixed", "xiph", "ebml")) -> bytes:
    """A file of one 8-bit PCM track; clusters take the lacings in turn."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    head = element(EBML, element(0x4286, 1) + element(0x42F7, 1) + element(0x42F2, 4) + element(0x42F3, 8) + element(DOC_TYPE, b"matroska") + element(DOC_VERSION, 4) + element(DOC_READ, 2))
    info = element(INFO, element(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, float(len(frames) * FRAME_MS)) + element(MUXER, b"tessera") + element(WRITER, b"tessera"))
    audio = element(AUDIO, element(SAMPLING, float(RATE)) + element(CHANNELS, 1) + element(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, element(TRACK_NUMBER, 1) + element(TRACK_UID, 1) + element(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(DEFAULT_DURATION, FRAME_MS * 1_000_000) + audio))
    body, at, cues = [info, tracks], len(info) + len(tracks), []
    step = LACED * BLOCKS_A_CLUSTER
    for c, first in enumerate(range(0, len(frames), step)):
        start, blocks = first * FRAME_MS, []
        for b in range(first, min(first + step, len(frames)), LACED):
            flags, data = lace(frames[b : b + LACED], lacing[c % len(lacing)])
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", b * FRAME_MS - start, 0x80 | flags) + data))
        cluster = element(CLUSTER, element(TIMESTAMP, start) + b"".join(blocks))
        cues.append(element(CUE_POINT, element(CUE_TIME, start) + element(CUE_POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    data = b"".join(body)
    return head + SEGMENT.to_bytes(4, "big") + vint(len(data), 8) + data


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """Value, next place, and whether all value bits are ones (unknown size)."""
    if at >= len(data) or not data[at]:
        raise Malformed(f"no variable-length integer at {at}")
    w = 9 - data[at].bit_length()
    if at + w > len(data):
        raise Malformed(f"truncated at {at}")
    raw = int.from_bytes(data[at : at + w], "big")
    value = raw if keep_marker else raw & (1 << 7 * w) - 1
    return value, at + w, raw & (1 << 7 * w) - 1 == (1 << 7 * w) - 1


@dataclass
class Media:
    tracks: dict[int, dict] = field(default_factory=dict)
    #: (track, timestamp in ns, first byte, end byte, key frame)
    packets: list[tuple[int, int, int, int, bool]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: dict[int, int] = field(default_factory=dict)
    scale: int = 1_000_000
    lacings: dict[str, int] = field(default_factory=dict)


def _children(data: bytes, at: int, end: int, inside: int = 0):
    """(identifier, first body byte, end) of each element; an unknown size ends at the next element of a higher level."""
    while at < end:
        ident, p, _ = read_vint(data, at, keep_marker=True)
        size, p, unknown = read_vint(data, p)
        stop = p + size
        if unknown:
            if ident not in (SEGMENT, CLUSTER):
                raise Malformed("an unknown size is for segments and clusters")
            stop = end
            if ident == CLUSTER:
                q = p
                while q < end:
                    kid, r, _ = read_vint(data, q, keep_marker=True)
                    if kid in TOP or kid == SEGMENT:
                        break
                    n, r, _ = read_vint(data, r)
                    q = r + n
                stop = min(q, end)
        if stop > end:
            raise Malformed(f"element {ident:x} ends after its parent")
        yield ident, p, stop, at
        at = stop


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _block(data: bytes, a: int, b: int, cluster_time: int, key: bool | None, media: Media) -> None:
    track, p, _ = read_vint(data, a)
    if p + 3 > b:
        raise Malformed("short block")
    rel, flags = struct.unpack_from(">hB", data, p)
    p += 3
    kind = flags >> 1 & 3
    key = bool(flags & 0x80) if key is None else key
    name = ("none", "xiph", "fixed", "ebml")[kind]
    media.lacings[name] = media.lacings.get(name, 0) + 1
    sizes: list[int] = []
    if kind:
        n, p = data[p] + 1, p + 1
        if kind == 1:
            for _ in range(n - 1):
                size = 0
                while data[p] == 255:
                    size, p = size + 255, p + 1
                size, p = size + data[p], p + 1
                sizes.append(size)
        elif kind == 3 and n > 1:
            size, p, _ = read_vint(data, p)
            sizes.append(size)
            for _ in range(n - 2):
                q = p
                diff, p, _ = read_vint(data, p)
                size += diff - ((1 << 7 * (p - q) - 1) - 1)
                sizes.append(size)
        elif kind == 2:
            if (b - p) % n:
                raise Malformed("fixed lacing of unequal frames")
            sizes = [(b - p) // n] * (n - 1)
    sizes.append(b - p - sum(sizes))
    if min(sizes) < 0:
        raise Malformed("laced sizes exceed the block")
    step = media.tracks.get(track, {}).get("default_duration", 0)
    for i, size in enumerate(sizes):
        media.packets.append((track, (cluster_time + rel) * media.scale + i * step, p, p + size, key))
        p += size


def _track(data: bytes, a: int, b: int) -> dict:
    t: dict = {}
    for u, v, w, _ in _children(data, a, b):
        if u in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION):
            t[{TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "default_duration"}[u]] = _uint(data, v, w)
        elif u == CODEC_ID:
            t["codec"] = data[v:w].rstrip(b"\0").decode()
        elif u == AUDIO:
            for k, p, q, _ in _children(data, v, w):
                if k == SAMPLING:
                    t["rate"] = struct.unpack(">d" if q - p == 8 else ">f", data[p:q])[0]
                elif k in (CHANNELS, BIT_DEPTH):
                    t["channels" if k == CHANNELS else "bits"] = _uint(data, p, q)
    return t


def _cluster(data: bytes, a: int, b: int, at: int, media: Media) -> None:
    """Packets of a cluster that begins at place ``at`` of its segment."""
    time = 0
    for x, y, z, _ in _children(data, a, b):
        if x == TIMESTAMP:
            time = _uint(data, y, z)
            media.clusters[at] = time
        elif x == SIMPLE_BLOCK:
            _block(data, y, z, time, None, media)
        elif x == BLOCK_GROUP:
            kids = list(_children(data, y, z))
            refs = any(u == 0xFB for u, *_ in kids)
            for u, v, w, _ in kids:
                if u == BLOCK:
                    _block(data, v, w, time, not refs, media)


def _head(data: bytes, kid: int, a: int, b: int, media: Media) -> None:
    """Anything of a segment but its clusters."""
    if kid == INFO:
        for x, y, z, _ in _children(data, a, b):
            if x == TIMESTAMP_SCALE:
                media.scale = _uint(data, y, z)
    elif kid == TRACKS:
        for x, y, z, _ in _children(data, a, b):
            if x == TRACK_ENTRY:
                t = _track(data, y, z)
                media.tracks[t.get("number", 0)] = t
    elif kid == CUES:
        for x, y, z, _ in _children(data, a, b):
            if x == CUE_POINT:
                time, where = 0, []
                for u, v, w, _ in _children(data, y, z):
                    if u == CUE_TIME:
                        time = _uint(data, v, w)
                    elif u == CUE_POSITIONS:
                        d = {k: _uint(data, l, m) for k, l, m, _ in _children(data, v, w)}
                        where.append((d.get(CUE_TRACK, 0), d.get(CUE_CLUSTER, -1)))
                media.cues += [(time, t, c) for t, c in where]


def _segments(data: bytes):
    """First and end byte of each segment; Malformed if the file has no head or none."""
    seen = []
    for ident, a, b, _ in _children(data, 0, len(data)):
        seen.append(ident)
        if ident == SEGMENT:
            yield a, b
    if EBML not in seen[:1] or SEGMENT not in seen:
        raise Malformed("no EBML head or no segment")


def read(data: bytes) -> Media:
    """The packet table of a file; Malformed if it breaks the format."""
    media = Media()
    for a, b in _segments(data):
        for kid, p, q, at in _children(data, a, b):
            if kid == CLUSTER:
                _cluster(data, p, q, at - a, media)
            else:
                _head(data, kid, p, q, media)
    return media


def seek(data: bytes, ns: int) -> list[tuple[int, int, int, int, bool]]:
    """Packets of the cluster that the cues name for a time: of the last cue not behind it. Other clusters are not parsed.

    Without cues, or before the first one, the whole file is read for them.
    """
    for a, b in _segments(data):
        media = Media()
        for kid, p, q, _ in _children(data, a, b):
            if kid != CLUSTER:
                _head(data, kid, p, q, media)
        before = [(time, c) for time, _, c in media.cues if time * media.scale <= ns]
        if before:
            at = a + max(before)[1]
            kid, p, q, _ = next(_children(data, at, b))
            if kid != CLUSTER:
                raise Malformed(f"a cue names {kid:x} at {at}")
            _cluster(data, p, q, at - a, media)
            return media.packets
    return [x for x in read(data).packets if x[1] <= ns]


def payload_of(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % FRAME or (0 if text else FRAME))


RESULT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
MEDIA = RESULT + ", media binary, packets array<struct<track:int,timestamp_ns:long,first:long,end:long,key:boolean>>"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, keep_media: bool = True) -> DataFrame:
    """Columns ``c`` (carried) and ``r`` (MEDIA, or RESULT without ``keep_media``).

    The features come from the packets read back: packets, clusters, cues that
    point at a cluster of their time, duration in ms, sum and sum of steps of the
    samples, and the sum of the frame at half the duration, which is sought by the cues.
    """
    import numpy as np

    ship(docs.sparkSession)
    names = [x.split()[0] for x in RESULT.split(", ")]

    def fn(cols):
        out = {n: [] for n in [*names, *(["media", "packets"] if keep_media else [])]}
        for text in utf8(cols[text_col]):
            data = write(payload_of(text))
            media = read(data)
            back = b"".join(data[a:b] for _, _, a, b, _ in media.packets)
            x = np.frombuffer(back, np.uint8).astype(np.int64)
            good = sum(media.clusters.get(c) == t for t, _, c in media.cues)
            end = media.packets[-1][1] // 1_000_000 + FRAME_MS
            half = len(media.packets) // 2 * FRAME_MS * 1_000_000
            mid = next(sum(data[a:b]) for _, t, a, b, _ in seek(data, half) if t == half)
            feature = f"packets={len(media.packets)};clusters={len(media.clusters)};cues={good};ms={end};sum={x.sum()};steps={np.abs(np.diff(x)).sum()};half={mid}"
            row = (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature)
            for n, v in zip(names, row, strict=True):
                out[n].append(v)
            if keep_media:
                out["media"].append(data)
                out["packets"].append([dict(track=t, timestamp_ns=s, first=a, end=b, key=k) for t, s, a, b, k in media.packets])
        return out

    return attach(docs, [text_col], list(carry or [id_col]), fn, MEDIA if keep_media else RESULT)


def op9(spark, sf_dir: str) -> DataFrame:
    out = media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_media=False)
    return out.select("c.doc_id", "r.*")
