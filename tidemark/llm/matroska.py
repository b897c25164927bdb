"""Matroska media columns: byte payloads muxed as 8-bit samples, and files parsed into packets.

``store_payloads`` writes each payload as one PCM track of a Matroska file: EBML header, segment
info, tracks, clusters of laced simple blocks (Xiph, fixed-size and EBML lacing in turn) and cues.
``read_media`` and ``packet_table`` parse such files, or any other Matroska bytes with known or
unknown element sizes, blocks and block groups, into packets with track, timestamp, byte range and whether they are
key frames (of a simple block by its flag, of a block in a group by the lack of a reference to another block). Parsing is one
pass, and elements nest no deeper than the format lets them.

Cases: a null payload or text counts as empty; a payload is padded with zero bytes up to a positive
multiple of 64; equal payloads give equal bytes (no clock or random id is stored); null media has no
packets and an empty payload; media that ends in the midst of an element yields the packets before
it; null ids stay null, repeated rows are handled each for itself, further columns are not read, and
an empty table gives an empty result. Files hold whole texts, however long.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# Fixed values of the Matroska format: element ids.
EBML, EBML_VERSION, EBML_READ, EBML_ID_LEN, EBML_SIZE_LEN, DOC_TYPE, DOC_VERSION, DOC_READ = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, LACING, DEFAULT_DURATION, CODEC = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x23E383, 0x86
AUDIO, FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that hold others which are read, by what they stand in.
_MASTERS = {SEGMENT: None, INFO: SEGMENT, TRACKS: SEGMENT, TRACK: TRACKS, CLUSTER: SEGMENT, BLOCK_GROUP: CLUSTER, CUES: SEGMENT, CUE_POINT: CUES, CUE_POSITIONS: CUE_POINT}
#: Ids that end an element of unknown size: those of the segment's children (seek head, attachments, chapters and tags too), and a new file's.
_TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367, SEGMENT, EBML}

#: 8 samples a millisecond, so that a payload's multiple of 64 bytes is whole milliseconds.
RATE, FRAME, FRAMES_PER_BLOCK, BLOCKS_PER_CLUSTER, PAD = 8000, 512, 8, 16, 64


def pad(payload: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return payload + bytes(-len(payload) % PAD if payload else PAD)


def vint(value: int) -> bytes:
    """A size as the shortest variable-length integer; all ones are kept for unknown sizes."""
    n = 1
    while value >= (1 << 7 * n) - 1:
        n += 1
    return (value | 1 << 7 * n).to_bytes(n)


def signed_vint(value: int) -> bytes:
    n = 1
    while not -(1 << 7 * n - 1) < value < 1 << 7 * n - 1:
        n += 1
    return (value + (1 << 7 * n - 1) - 1 | 1 << 7 * n).to_bytes(n)


def element(eid: int, body: bytes) -> bytes:
    return eid.to_bytes((eid.bit_length() + 7) // 8) + vint(len(body)) + body


def uint(eid: int, value: int) -> bytes:
    return element(eid, value.to_bytes(max(1, (value.bit_length() + 7) // 8)))


def laced(sizes: list[int], kind: int) -> bytes:
    """Head of a lace: the frame count less one, and all sizes but the last."""
    head = bytes([len(sizes) - 1])
    if kind == 1:
        return head + b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    if kind == 3:
        return head + vint(sizes[0]) + b"".join(signed_vint(b - a) for a, b in zip(sizes, sizes[1:-1]))
    return head


def mux(payload: bytes, frame: int = FRAME, per_block: int = FRAMES_PER_BLOCK, per_cluster: int = BLOCKS_PER_CLUSTER) -> bytes:
    """A Matroska file with the payload as 8-bit PCM samples of one audio track."""
    head = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ, 1) + uint(EBML_ID_LEN, 4) + uint(EBML_SIZE_LEN, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_VERSION, 4) + uint(DOC_READ, 2))
    info = element(INFO, uint(SCALE, 1_000_000) + element(MUXER, b"tidemark") + element(WRITER, b"tidemark"))
    audio = element(AUDIO, element(FREQUENCY, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    entry = uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(LACING, 1) + uint(DEFAULT_DURATION, frame * 10**9 // RATE) + element(CODEC, b"A_PCM/INT/LIT") + audio
    parts = [info, element(TRACKS, element(TRACK, entry))]
    at, cues, span = sum(map(len, parts)), [], frame * per_block
    for c in range(0, len(payload), span * per_cluster):
        start, blocks = c * 1000 // RATE, []
        for i, b in enumerate(range(c, min(c + span * per_cluster, len(payload)), span)):
            body = payload[b : b + span]
            sizes = [min(frame, len(body) - k) for k in range(0, len(body), frame)]
            kind = (1, 2, 3)[i % 3] if len(sizes) > 1 else 0
            kind = 3 if kind == 2 and len(set(sizes)) > 1 else kind  # fixed-size lacing needs equal frames
            ticks = struct.pack(">h", b * 1000 // RATE - start)
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + ticks + bytes([0x80 | kind << 1]) + (laced(sizes, kind) if kind else b"") + body))
        cluster = element(CLUSTER, uint(TIMESTAMP, start) + b"".join(blocks))
        cues.append(element(CUE_POINT, uint(CUE_TIME, start) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


@dataclass(frozen=True)
class Packet:
    """A frame: its track, time, place in the file and how it was laced."""

    track: int
    timestamp_ns: int
    offset: int
    size: int
    cluster_offset: int
    lacing: int
    key: bool


class Truncated(ValueError):
    """The file ends in the midst of an element."""


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """A value, its end, and whether all its bits are ones."""
    if at >= len(data) or not data[at]:
        raise Truncated(at)
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise Truncated(at)
    raw = int.from_bytes(data[at : at + n])
    value = raw & (1 << 7 * n) - 1
    return (raw if keep_marker else value), at + n, value == (1 << 7 * n) - 1


def number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b])


def frames(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block body."""
    if not kind:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == 3:
        for i in range(n - 1):  # a lace of one frame states no size
            before = at
            raw, at, _ = read_vint(data, at)
            sizes.append(sizes[-1] + raw - (1 << 7 * (at - before) - 1) + 1 if i else raw)
    else:
        sizes = [(end - at) // n] * (n - 1)
    out = []
    for size in [*sizes, end - at - sum(sizes)]:
        if size < 0 or at + size > end:
            raise Truncated(at)
        out.append((at, size))
        at += size
    return out


@dataclass
class Media:
    """What a file holds: packets, cues (time, track, cluster offset) and clusters; ``whole`` if it didn't end early."""

    packets: list[Packet]
    cues: list[tuple[int, int, int]]
    clusters: int = 0
    whole: bool = True


def demux(data: bytes) -> Media:
    """Parse a Matroska file."""
    out, durations, scale = Media([], []), {}, 1_000_000
    state = {"base": 0, "time": 0, "cluster": 0, "track": [0, 0], "cue": [0, 0, 0], "group": 0, "refers": False}

    def block(a: int, b: int, key: bool | None) -> None:
        track, p, _ = read_vint(data, a)
        ticks, flags = struct.unpack_from(">hB", data, p)
        kind, step = flags >> 1 & 3, durations.get(track, 0)
        t = (state["time"] + ticks) * scale
        out.packets.extend(Packet(track, t + i * step, o, n, state["cluster"], kind, bool(flags & 0x80) if key is None else key) for i, (o, n) in enumerate(frames(data, p + 3, b, kind)))

    def walk(at: int, end: int, parent: int | None, open_ended: bool) -> int:
        """Read the children of an element up to its end, or one of unknown size to where the next element begins."""
        nonlocal scale
        while at < end:
            start = at
            eid, at, _ = read_vint(data, at, keep_marker=True)
            if open_ended and parent is not None and parent != SEGMENT and eid in _TOP:
                return start
            size, at, unknown = read_vint(data, at)
            stop = end if unknown else at + size
            nests = _MASTERS.get(eid, eid) == parent
            if stop > end or (unknown and not nests):
                raise Truncated(start)
            if nests:
                if eid == SEGMENT:
                    state["base"] = at
                elif eid == CLUSTER:
                    state["cluster"] = start
                    out.clusters += 1
                elif eid == BLOCK_GROUP:
                    state["group"], state["refers"] = len(out.packets), False
                stop = walk(at, stop, eid, unknown)
                if eid == TRACK:
                    durations[state["track"][0]] = state["track"][1]
                    state["track"] = [0, 0]
                elif eid == CUE_POSITIONS:
                    out.cues.append((state["cue"][0] * scale, state["cue"][1], state["base"] + state["cue"][2]))
                elif eid == BLOCK_GROUP and state["refers"]:
                    out.packets[state["group"] :] = [replace(p, key=False) for p in out.packets[state["group"] :]]
            elif eid in (SIMPLE_BLOCK, BLOCK):
                block(at, stop, None if eid == SIMPLE_BLOCK else True)
            elif eid == REFERENCE_BLOCK:
                state["refers"] = True
            elif eid == SCALE:
                scale = number(data, at, stop)
            elif eid == TIMESTAMP:
                state["time"] = number(data, at, stop)
            elif eid in (TRACK_NUMBER, DEFAULT_DURATION):
                state["track"][eid == DEFAULT_DURATION] = number(data, at, stop)
            elif eid in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
                state["cue"][(CUE_TIME, CUE_TRACK, CUE_CLUSTER).index(eid)] = number(data, at, stop)
            at = stop
        return at

    try:
        walk(0, len(data), None, False)
    except (Truncated, IndexError, struct.error):
        out.whole = False
    return out


def payload_of(data: bytes, media: Media) -> bytes:
    """The stored samples: the packets' bytes in order."""
    return b"".join(data[p.offset : p.offset + p.size] for p in media.packets)


def features(payload: bytes, media: Media) -> str:
    """Packets, clusters, cues, laces, length, sums of the samples and a checksum of the packet table."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    laces = [sum(p.lacing == k for p in media.packets) for k in range(4)]
    tab = np.array([(p.track, p.timestamp_ns, p.offset, p.size) for p in media.packets], "<i8").tobytes()
    end = max((p.timestamp_ns for p in media.packets), default=0) // 1_000_000
    return f"packets={len(media.packets)};clusters={media.clusters};cues={len(media.cues)};laces={'/'.join(map(str, laces))};last_ms={end};sum={x.sum()};squares={(x * x).sum()};table={zlib.crc32(tab):08x}"


def store_payloads(docs: DataFrame, id_col: str = "doc_id", payload_col: str = "text") -> DataFrame:
    """id, n_bytes (unpadded) and media: each string or binary payload, padded, as a Matroska file. One map, no shuffle."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = [b.as_py() or b"" for b in batch.column(1)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([mux(pad(r)) for r in raw], pa.binary())], ["id", "n_bytes", "media"])

        return each

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(payload_col).cast("binary").alias("payload"))
    return map_batches(picked, make, "id long, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """id, n_bytes, media, payload and feature of stored files: one map, no shuffle."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            payloads, said = [], []
            for b in batch.column(2):
                data = b.as_py() or b""
                media = demux(data)
                payloads.append(payload_of(data, media))
                said.append(features(payloads[-1], media))
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(payloads, pa.binary()), pa.array(said, pa.string())], ["id", "n_bytes", "media", "payload", "feature"])

        return each

    return map_batches(stored.select("id", "n_bytes", "media"), make, "id long, n_bytes long, media binary, payload binary, feature string")


def packet_table(stored: DataFrame) -> DataFrame:
    """A row per packet of stored files: id, packet, track, timestamp_ns, offset, size, cluster_offset, lacing, keyframe."""
    fields = ("track", "timestamp_ns", "offset", "size", "cluster_offset", "lacing", "key")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(i, k, *(getattr(p, f) for f in fields)) for i, b in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for k, p in enumerate(demux(b.as_py() or b"").packets)]
            kinds = [pa.int64()] * 8 + [pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["id", "packet", *fields])

        return each

    return map_batches(stored.select("id", "media"), make, "id long, packet long, track long, timestamp_ns long, offset long, size long, cluster_offset long, lacing long, key boolean")
