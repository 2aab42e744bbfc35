"""Matroska: writing payloads as 8-bit audio in Matroska files, and parsing files to tables of packets.

The reader walks the variable-length EBML elements of a file: Segment, Info, Tracks, Clusters (of known and unknown size)
with SimpleBlocks and BlockGroups, all four lacings, and Cues. It gives a row for each frame with its track, timestamp,
flags and byte range in the file, so that payloads are read as slices of the stored bytes. Laced frames follow each other by
the BlockDuration over their number where a group has one, else by the track's DefaultDuration; a grouped block with a
ReferenceBlock is no keyframe.

Nulls and odd input: a null text is an empty payload, stored as 64 zero bytes; null or damaged files yield what was read
up to the damage and `error`; files without packets yield none. Equal texts give equal files: nothing depends on the row.
Only the key and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import table

# Fixed values of the format: element ids.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that hold elements and are walked into; of these, the last three may have an unknown size.
CONTAINERS = {INFO, TRACKS, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS, SEGMENT, CLUSTER}
#: Elements that end a cluster of unknown size.
TOP = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
NO_LACING, XIPH, FIXED, EBML_LACING = range(4)

#: How payloads are stored: samples a second (so that a frame of FRAME samples lasts whole milliseconds), samples in a frame, frames in a block, blocks in a cluster.
RATE, FRAME, LACED, BLOCKS = 8000, 1024, 8, 16
UNIT = 64


def number(n: int, size: int = 0) -> bytes:
    """A variable-length integer, of `size` bytes or as few as hold it."""
    size = size or next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * size).to_bytes(size, "big")


def element(id_: int, data: bytes) -> bytes:
    return id_.to_bytes((id_.bit_length() + 7) // 8, "big") + number(len(data)) + data


def uint(id_: int, n: int) -> bytes:
    return element(id_, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def block(track: int, offset: int, frames: list[bytes], lacing: int, flags: int = 0x80) -> bytes:
    """The data of a SimpleBlock."""
    head = number(track) + struct.pack(">hB", offset, flags | lacing << 1)
    if lacing == NO_LACING:
        return head + frames[0]
    sizes, head = [len(f) for f in frames], head + bytes([len(frames) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING:
        head += number(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            d = b - a
            k = next(k for k in range(1, 9) if abs(d) < (1 << 7 * k - 1))
            head += number(d + (1 << 7 * k - 1) - 1, k)
    return head + b"".join(frames)


def write(payload: bytes) -> bytes:
    """A Matroska file with one track of unsigned 8-bit samples, with a cue for each cluster."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    head = element(EBML, b"".join((uint(EBML_VERSION, 1), uint(EBML_READ_VERSION, 1), uint(EBML_MAX_ID, 4), uint(EBML_MAX_SIZE, 8), element(DOC_TYPE, b"matroska"), uint(DOC_VERSION, 4), uint(DOC_READ_VERSION, 2))))
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + element(MUXING_APP, b"leafmill") + element(WRITING_APP, b"leafmill"))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    body, cues, at = [info, tracks], [], len(info) + len(tracks)
    ms = FRAME * 1000 // RATE
    for c in range(0, len(frames), LACED * BLOCKS):
        start, blocks = c * ms, []
        for b in range(c, min(c + LACED * BLOCKS, len(frames)), LACED):
            part = frames[b : b + LACED]
            kind = NO_LACING if len(part) == 1 else FIXED if len(part[-1]) == FRAME else (XIPH, EBML_LACING)[b // LACED % 2]
            blocks.append(element(SIMPLE_BLOCK, block(1, b * ms - start, part, kind)))
        cluster = element(CLUSTER, uint(TIMESTAMP, start) + b"".join(blocks))
        cues.append(element(CUE_POINT, uint(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        body.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join((*body, element(CUES, b"".join(cues)))))


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    start: int
    length: int
    cluster: int
    block: int
    lace: int
    lacing: int
    keyframe: bool
    timed: bool = False  # by its group's duration


@dataclass
class Media:
    packets: list[Packet] = field(default_factory=list)
    tracks: dict[int, dict] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, cluster position in the segment
    clusters: list[tuple[int, int]] = field(default_factory=list)  # position in the segment, timestamp
    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    error: str | None = None


def _vint(data, at: int, keep: bool) -> tuple[int, int, bool]:
    """Value, bytes read, and whether all value bits are set (an unknown size). keep leaves the length marker in (ids)."""
    first = data[at]
    if not first:
        raise ValueError(f"no length marker at byte {at}")
    size = 9 - first.bit_length()
    if at + size > len(data):
        raise ValueError(f"cut short at byte {at}")
    whole = int.from_bytes(data[at : at + size], "big")
    low = whole & ((1 << 7 * size) - 1)
    return (whole if keep else low), size, low == (1 << 7 * size) - 1


def _laces(data, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block whose data after the header begins at `at`."""
    if lacing == NO_LACING:
        return [(at, end - at)]
    if at >= end:
        raise ValueError(f"a block that ends at byte {end} has no lace count")
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == FIXED:
        if (end - at) % count:
            raise ValueError("fixed lacing doesn't divide its block")
        sizes = [(end - at) // count] * count
    else:
        for i in range(count - 1):
            if lacing == XIPH:
                n = 0
                while True:
                    if at >= end:
                        raise ValueError(f"lace sizes go beyond byte {end}")
                    b, at = data[at], at + 1
                    n += b
                    if b < 255:
                        break
            else:
                if at >= end:
                    raise ValueError(f"lace sizes go beyond byte {end}")
                n, size, _ = _vint(data, at, False)
                at += size
                n = n if i == 0 else sizes[-1] + n - ((1 << 7 * size - 1) - 1)
            sizes.append(n)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a lace goes beyond its block")
    ranges = []
    for n in sizes:
        ranges.append((at, n))
        at += n
    return ranges


def parse(data: bytes | None) -> Media:
    """All of a file's tables; damage ends the walk and is told in `error`."""
    media = Media()
    if data is None:
        media.error = "no file"
        return media
    try:
        _walk(data, media)
    except (ValueError, struct.error) as e:
        media.error = str(e) or type(e).__name__
    for i, p in enumerate(media.packets):
        d = media.tracks.get(p.track, {}).get("frame_ns", 0)
        p.timestamp_ns += 0 if p.timed else p.lace * d
        if p.track >= 1 << 31 or not -(1 << 63) <= p.timestamp_ns < 1 << 63:
            media.error = media.error or f"packet {i} has a track or timestamp beyond its column"
            del media.packets[i:]
            break
    return media


#: Containers within containers, at most; the format itself has far fewer.
DEPTH = 32


@dataclass
class _State:
    """What the walk knows of the elements that are open."""

    segment: int = 0
    time: int = 0
    block: int = 0
    entry: dict = field(default_factory=dict)
    duration: int | None = None
    referring: bool = False
    first: int = 0


def _walk(data, media: Media) -> None:
    now = _State()
    open_: list[tuple[int, int, bool]] = [(0, len(data), False)]  # id, end, and whether the size is unknown
    at = 0
    while open_:
        inside, end, unending = open_[-1]
        if at >= end:
            _close(inside, media, now)
            open_.pop()
            continue
        began = at
        id_, size, _ = _vint(data, at, True)
        if inside == CLUSTER and unending and id_ in TOP:
            open_.pop()  # the end of a cluster of unknown size
            continue
        at += size
        if at >= len(data):
            raise ValueError(f"cut short at byte {at}")
        length, size, unknown = _vint(data, at, False)
        at += size
        stop = end if unknown else at + length
        if stop > end:
            raise ValueError(f"an element at byte {began} goes beyond its parent")
        if id_ in CONTAINERS or id_ == EBML:
            if len(open_) > DEPTH:
                raise ValueError(f"elements at byte {began} are nested too deep")
            if id_ == SEGMENT:
                now.segment = at
            elif id_ == CLUSTER:
                now.time = now.block = 0
                media.clusters.append((began - now.segment, 0))
            elif id_ in (TRACK_ENTRY, CUE_POINT):
                now.entry = {}
            elif id_ == BLOCK_GROUP:
                now.duration, now.referring, now.first = None, False, len(media.packets)
            open_.append((id_, stop, unknown))
            continue
        if id_ in (SIMPLE_BLOCK, BLOCK):
            _block(data, at, stop, id_ == SIMPLE_BLOCK, media, now)
        else:
            _leaf(id_, data[at:stop], media, now)
        at = stop


def _close(id_: int, media: Media, now: _State) -> None:
    e = now.entry
    if id_ == TRACK_ENTRY:
        media.tracks[e.get("number", 0)] = e
    elif id_ == CUE_POINT:
        media.cues.append((e.get("time", 0), e.get("track", 0), e.get("position", 0)))
    elif id_ == BLOCK_GROUP:
        group = media.packets[now.first :]
        for p in group:
            p.keyframe = not now.referring
            if now.duration is not None:
                p.timestamp_ns += now.duration * media.scale * p.lace // len(group)
                p.timed = True


def _block(data, at: int, stop: int, simple: bool, media: Media, now: _State) -> None:
    track, size, _ = _vint(data, at, False) if at < stop else (0, 0, False)
    if at + size + 3 > stop:
        raise ValueError(f"a block at byte {at} is shorter than its header")
    if not media.clusters:
        raise ValueError(f"a block at byte {at} stands outside a cluster")
    offset, flags = struct.unpack_from(">hB", data, at + size)
    lacing = flags >> 1 & 3
    for k, (start, n) in enumerate(_laces(data, at + size + 3, stop, lacing)):
        media.packets.append(Packet(track, (now.time + offset) * media.scale, start, n, len(media.clusters) - 1, now.block, k, lacing, bool(flags & 0x80) if simple else True))
    now.block += 1


def _leaf(id_: int, raw, media: Media, now: _State) -> None:
    n = int.from_bytes(raw, "big") if len(raw) <= 8 else 0
    real = struct.unpack(">f" if len(raw) == 4 else ">d", raw)[0] if len(raw) in (4, 8) else 0.0
    if id_ == TIMESTAMP:
        now.time = n
        if media.clusters:
            media.clusters[-1] = (media.clusters[-1][0], n)
    elif id_ == TIMESTAMP_SCALE:
        media.scale = n
    elif id_ == DURATION:
        media.duration = real
    elif id_ == BLOCK_DURATION:
        now.duration = n
    elif id_ == REFERENCE_BLOCK:
        now.referring = True
    elif id_ == DOC_TYPE:
        media.doc_type = bytes(raw).decode("ascii", "replace")
    elif id_ in _ENTRY:
        name, kind = _ENTRY[id_]
        now.entry[name] = {"u": n, "f": real, "s": bytes(raw).decode("ascii", "replace")}[kind]


_ENTRY = {
    TRACK_NUMBER: ("number", "u"), TRACK_UID: ("uid", "u"), TRACK_TYPE: ("type", "u"), CODEC_ID: ("codec", "s"), SAMPLING: ("rate", "f"), CHANNELS: ("channels", "u"), BIT_DEPTH: ("bits", "u"),
    DEFAULT_DURATION: ("frame_ns", "u"), CUE_TIME: ("time", "u"), CUE_TRACK: ("track", "u"), CUE_CLUSTER_POSITION: ("position", "u"),
}


def seek(media: Media, time: int, track: int = 1) -> tuple[int, int] | None:
    """The cluster (its position in the segment and timestamp) that a cue leads to for a time in timestamp units."""
    before = [c for c in media.cues if c[1] == track and c[0] <= time]
    return dict((p, (p, t)) for p, t in media.clusters).get(max(before)[2]) if before else None


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and these followed by zeros up to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % UNIT if raw else UNIT)


def feature(media: Media, payload: bytes) -> str:
    """Counts of the tables and moments of the samples, as text."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    laced = sum(p.lacing != NO_LACING for p in media.packets)
    return f"packets={len(media.packets)};laced={laced};clusters={len(media.clusters)};cues={len(media.cues)};ms={len(x) * 1000 // RATE};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings}"


def read_payload(data: bytes, media: Media, track: int = 1) -> bytes:
    """The frames of a track in order, sliced from the stored file."""
    return b"".join(data[p.start : p.start + p.length] for p in media.packets if p.track == track)


PACKETS = "track int, timestamp_ns long, start long, length long, cluster int, block int, lace int, lacing int, keyframe boolean"


def media_column(docs: DataFrame, text: str = "text", key: str = "doc_id", into: str = "media") -> DataFrame:
    """key, n_bytes and the file that stores each row's text."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                made = [payload_of(t.as_py()) for t in part.column(text)]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array([n for n, _ in made], pa.int64()), pa.array([write(p) for _, p in made], pa.binary())], names=[key, "n_bytes", into])

    return docs.select(key, text).mapInArrow(run, T.StructType([docs.schema[key], T.StructField("n_bytes", T.LongType()), T.StructField(into, T.BinaryType())]))


def packets(files: DataFrame, key: str, media: str = "media") -> DataFrame:
    """The packet table of a column of files: key and PACKETS, a row for each frame."""
    names = [x.split()[0] for x in PACKETS.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}

    def run(batches):
        for b in batches:
            keys, rows = b.column(key), []
            for i, data in enumerate(b.column(media)):
                rows += [(i, p) for p in parse(data.as_py()).packets]
                if len(rows) > 20_000 or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array([i for i, _ in rows], pa.int64())), *(pa.array([getattr(p, n) for _, p in rows], kinds[x.split()[1]]) for n, x in zip(names, PACKETS.split(", ")))], names=[key, *names])
                    rows = []

    schema = T.StructType([files.schema[key], *T.StructType.fromDDL(PACKETS).fields])
    return files.select(key, media).mapInArrow(run, schema)


DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, error string"


def digest(files: DataFrame, key: str = "doc_id", media: str = "media", carry: tuple[str, ...] = ("n_bytes",)) -> DataFrame:
    """What the payload read back from each stored file amounts to: key, the carried columns and DIGEST."""

    def run(batches):
        names = [key, *carry]
        for b in batches:
            rows = []
            for data in b.column(media):
                raw = data.as_py()
                m = parse(raw)
                back = read_payload(raw or b"", m)
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(raw or b""), hashlib.sha256(raw or b"").hexdigest(), feature(m, back), len(m.packets), m.error))
            cols = list(zip(*rows)) if rows else [()] * 8
            made = [pa.array(c, pa.string() if x.endswith("string") else pa.int64()) for c, x in zip(cols, DIGEST.split(", "))]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *made], names=[*names, *(x.split()[0] for x in DIGEST.split(", "))])

    schema = T.StructType([files.schema[key], *(files.schema[c] for c in carry), *T.StructType.fromDDL(DIGEST).fields])
    return files.select(key, *carry, media).mapInArrow(run, schema)


def op1(spark, sf_dir: str) -> DataFrame:
    return digest(media_column(table(spark, sf_dir, "documents"))).drop("error")
