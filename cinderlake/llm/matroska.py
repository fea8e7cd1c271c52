"""Media columns: Matroska files to packet tables.

``parse`` reads EBML elements (variable-length ids and sizes, unknown sizes of
segments and clusters), tracks, clusters, simple blocks and block groups, the
three kinds of lacing, and cues.  It yields packets with track, timestamp and the
byte range of each frame in the file, so that a consumer can read single frames.
``mux`` is the counterpart: 8-bit PCM samples in clusters of laced blocks.

Both work on one file at a time in a task; the input is dealt by row, and the
memory that a task needs is that of one Arrow batch and the largest file in it.

Defined results: null and empty texts are the empty payload, padded to 64 zero
bytes; equal texts give equal files; a file that ends within an element, or a block
that ends within its head, raises ``ValueError``; null media give no packets; an empty table gives an empty result;
repeated rows are done each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

EBML, SEGMENT, INFO, TRACKS, ENTRY, AUDIO = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1
CLUSTER, TIMESTAMP, SIMPLE, GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE, CUE_TIME, CUE_PLACES, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SCALE, DURATION, NUMBER, KIND, CODEC, RATE, CHANNELS, DEPTH = 0x2AD7B1, 0x4489, 0xD7, 0x83, 0x86, 0xB5, 0x9F, 0x6264
XIPH, FIXED, EBML_LACE = 1, 2, 3

FRAME = 512  # bytes
LACED = 8  # frames in a block
BLOCKS = 32  # blocks in a cluster
HERTZ = 8000


def vint(n: int, width: int = 0) -> bytes:
    """A size: its width is the number of leading zero bits plus one."""
    if not width:
        width = 1
        while n >= (1 << 7 * width) - 1:
            width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _lace(frames: list[bytes], kind: int) -> tuple[int, bytes]:
    """Flags of the lacing, and the lace's head before the frames."""
    if len(frames) == 1:
        return 0, b""
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if kind == FIXED and len(set(sizes)) == 1:
        return FIXED << 1, head
    if kind == XIPH:
        return XIPH << 1, head + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    head += vint(sizes[0])
    for a, b in zip(sizes, sizes[1:-1]):
        width = 1
        while not -(1 << 7 * width - 1) < b - a < 1 << 7 * width - 1:
            width += 1
        head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return EBML_LACE << 1, head


def mux(samples: bytes) -> bytes:
    """A Matroska file with one track of unsigned 8-bit samples."""
    head = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(0x4282, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
    ms = len(samples) * 1000 // HERTZ
    info = element(INFO, uint(SCALE, 1_000_000) + element(0x4D80, b"cinderlake") + element(0x5741, b"cinderlake") + element(DURATION, struct.pack(">d", ms)))
    audio = element(AUDIO, element(RATE, struct.pack(">d", HERTZ)) + uint(CHANNELS, 1) + uint(DEPTH, 8))
    tracks = element(TRACKS, element(ENTRY, uint(NUMBER, 1) + uint(0x73C5, 1) + uint(KIND, 2) + uint(0x9C, 1) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    body, cues = [info, tracks], []
    at = len(info) + len(tracks)
    step = FRAME * LACED * BLOCKS
    view = memoryview(samples)
    for lo in range(0, len(samples), step):
        start = lo * 1000 // HERTZ
        parts = [uint(TIMESTAMP, start)]
        for number, b in enumerate(range(lo, min(lo + step, len(samples)), FRAME * LACED)):
            chunk = view[b : min(b + FRAME * LACED, len(samples))]
            frames = [bytes(chunk[i : i + FRAME]) for i in range(0, len(chunk), FRAME)]
            flags, lace = _lace(frames, (XIPH, FIXED, EBML_LACE)[number % 3])
            data = b"\x81" + struct.pack(">h", b * 1000 // HERTZ - start) + bytes([flags | 0x80]) + lace + b"".join(frames)
            parts.append(element(SIMPLE, data))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE, uint(CUE_TIME, start) + element(CUE_PLACES, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


def _size_at(data: bytes, at: int) -> tuple[int, int, bool]:
    """Value, end and whether all its bits are set, of the variable-length integer at ``at``."""
    first = data[at] if at < len(data) else 0
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"no variable-length integer at byte {at}")
    value = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
    return value, at + width, value == (1 << 7 * width) - 1


def _head(data: bytes, at: int) -> tuple[int, int, int | None]:
    """Id, first byte of the body, and size (None: unknown) of the element at ``at``."""
    if not data[at]:
        raise ValueError(f"no element id at byte {at}")
    width = 9 - data[at].bit_length()
    ident = int.from_bytes(data[at : at + width], "big")
    size, body, unknown = _size_at(data, at + width)
    return ident, body, None if unknown else size


def _cluster_end(data: bytes, at: int, end: int) -> int:
    """Where a cluster of unknown size ends: at the next element that can't be within one."""
    while at < end:
        ident, body, size = _head(data, at)
        if ident in (CLUSTER, CUES, INFO, TRACKS):
            return at
        if size is None:
            raise ValueError(f"element {ident:x} at byte {at} has no size")
        at = body + size
    return at


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, first byte, first byte of the body, end) of each element in a range.

    An element of unknown size runs to the next element that can follow it: for a
    cluster the next cluster or cues, for a segment the end.
    """
    while at < end:
        ident, body, size = _head(data, at)
        if size is not None:
            stop = body + size
        else:
            stop = _cluster_end(data, body, end) if ident == CLUSTER else end
        if stop > end:
            raise ValueError(f"element {ident:x} at byte {at} ends after its parent")
        yield ident, at, body, stop
        at = stop


def _int(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    if b - a not in (0, 4, 8):
        raise ValueError(f"no number of {b - a} bytes at byte {a}")
    return struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b > a else 0.0


@dataclass
class Media:
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: list[dict] = field(default_factory=list)
    #: track, time in ns, cluster, block, place in the lace, first byte, bytes, key frame
    packets: list[tuple] = field(default_factory=list)
    #: time in ns, track, first byte of the cluster
    cues: list[tuple] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)


def _byte(data: bytes, a: int, b: int) -> int:
    if a >= b:
        raise ValueError(f"block ends within its lace's head at byte {a}")
    return data[a]


def _block(data: bytes, a: int, b: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative time, flags and byte ranges of the frames."""
    if b - a < 4:
        raise ValueError(f"block of {b - a} bytes at byte {a}")
    track, a, _ = _size_at(data, a)
    if b - a < 3:
        raise ValueError(f"block ends within its head at byte {a}")
    time = struct.unpack(">h", data[a : a + 2])[0]
    flags = data[a + 2]
    a += 3
    kind = flags >> 1 & 3
    if not kind:
        return track, time, flags, [(a, b - a)]
    number = _byte(data, a, b) + 1
    a += 1
    sizes = []
    if kind == XIPH:
        for _ in range(number - 1):
            n = 0
            while _byte(data, a, b) == 255:
                n += 255
                a += 1
            sizes.append(n + data[a])
            a += 1
    elif kind == EBML_LACE:
        n, a, _ = _size_at(data, a)
        sizes.append(n)
        for _ in range(number - 2):
            width = 9 - _byte(data, a, b).bit_length()
            d, a, _ = _size_at(data, a)
            n += d - ((1 << 7 * width - 1) - 1)
            sizes.append(n)
        sizes = sizes[: number - 1]
    else:
        if (b - a) % number:
            raise ValueError(f"fixed lacing of {b - a} bytes in {number} frames")
        sizes = [(b - a) // number] * (number - 1)
    sizes.append(b - a - sum(sizes))
    if sizes[-1] < 0:
        raise ValueError("laced frames pass the block's end")
    out = []
    for n in sizes:
        out.append((a, n))
        a += n
    return track, time, flags, out


def parse(data: bytes) -> Media:
    media, cues = Media(), []
    for ident, _, a, b in elements(data, 0, len(data)):
        if ident != SEGMENT:
            continue
        origin = a
        for kind, first, c, d in elements(data, a, b):
            if kind == INFO:
                for k, _, e, f in elements(data, c, d):
                    if k == SCALE:
                        media.scale = _int(data, e, f)
                    elif k == DURATION:
                        media.duration = _float(data, e, f)
            elif kind == TRACKS:
                for k, _, e, f in elements(data, c, d):
                    if k == ENTRY:
                        t = {}
                        for k2, _, g, h in elements(data, e, f):
                            if k2 in (NUMBER, KIND):
                                t["number" if k2 == NUMBER else "kind"] = _int(data, g, h)
                            elif k2 == CODEC:
                                t["codec"] = data[g:h].decode()
                            elif k2 == AUDIO:
                                for k3, _, i, j in elements(data, g, h):
                                    t[{RATE: "rate", CHANNELS: "channels", DEPTH: "depth"}.get(k3, k3)] = _float(data, i, j) if k3 == RATE else _int(data, i, j)
                        media.tracks.append(t)
            elif kind == CLUSTER:
                base, number, block = 0, len(media.clusters), 0
                media.clusters.append(first)
                for k, _, e, f in elements(data, c, d):
                    found = []
                    if k == TIMESTAMP:
                        base = _int(data, e, f)
                    elif k == SIMPLE:
                        found = [(e, f, None)]
                    elif k == GROUP:
                        inner = list(elements(data, e, f))
                        refers = any(x[0] == 0xFB for x in inner)
                        found = [(x[2], x[3], not refers) for x in inner if x[0] == BLOCK]
                    for g, h, key in found:
                        track, time, flags, frames = _block(data, g, h)
                        for lace, (start, size) in enumerate(frames):
                            media.packets.append((track, (base + time) * media.scale, number, block, lace, start, size, bool(flags & 0x80) if key is None else key))
                        block += 1
            elif kind == CUES:
                for k, _, e, f in elements(data, c, d):
                    if k == CUE:
                        time, places = 0, []
                        for k2, _, g, h in elements(data, e, f):
                            if k2 == CUE_TIME:
                                time = _int(data, g, h)
                            elif k2 == CUE_PLACES:
                                p = {k3: _int(data, i, j) for k3, _, i, j in elements(data, g, h)}
                                places.append((p.get(CUE_TRACK, 0), p.get(CUE_CLUSTER, 0) + origin))
                        cues += [(time, *p) for p in places]
    media.cues = [(t * media.scale, track, at) for t, track, at in cues]
    return media


PACKETS = "doc_id long, track int, time_ns long, cluster int, block int, lace int, first_byte long, bytes long, key boolean"


def packet_table(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet of each Matroska file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PACKETS.split(", ")]
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = parse(data.as_py()).packets if data.is_valid else []
                if found:
                    cols = list(zip(*found))
                    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(found), pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    return files.select(F.col(id_col).cast("long"), media_col).mapInArrow(run, PACKETS)


def stored(docs: DataFrame) -> DataFrame:
    """``doc_id, media``: each whole text as a Matroska file of 8-bit samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([mux(padded(text)[0])], pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, media binary")


def padded(text: pa.StringScalar) -> tuple[bytes, int]:
    data = text.as_buffer().to_pybytes() if text.is_valid else b""
    return data + bytes(-len(data) % 64 or (0 if data else 64)), len(data)


def read_back(data: bytes) -> tuple[bytes, str]:
    """The samples, gathered from the packets' byte ranges, and a description of the file."""
    media = parse(data)
    payload = b"".join([data[p[5] : p[5] + p[6]] for p in sorted(media.packets, key=lambda p: (p[1], p[2], p[3], p[4]))])
    x = np.frombuffer(payload, np.uint8)
    at = set(media.clusters)
    found = {
        "codec": media.tracks[0]["codec"],
        "tracks": len(media.tracks),
        "clusters": len(media.clusters),
        "blocks": len({p[2:4] for p in media.packets}),
        "packets": len(media.packets),
        "cues": sum(c[2] in at for c in media.cues),
        "ms": int(media.duration),
        "mean": f"{x.mean():.4f}",
        "rms": f"{np.sqrt(np.dot(x.astype(np.float64), x) / len(x)):.4f}",
        "peak": int(x.max()),
    }
    return payload, ";".join(f"{k}={v}" for k, v in found.items())


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            samples, n = padded(text)
            media = mux(samples)
            payload, feature = read_back(media)
            rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], names)


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(
        _digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
