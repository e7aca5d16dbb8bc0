"""Media columns as ISO media containers.

A payload is stored as raw 8-bit samples of one track: ``ftyp``, ``moov`` with its nested boxes and sample tables, and
``mdat`` with the samples in chunks. ``probe`` walks the nested boxes of any such file and decodes the sample tables
(sample description, times, sizes, chunks, chunk offsets, sync samples) into codec, duration and the byte ranges of
keyframes; it never touches the payload. The samples of movie fragments are added to their tracks. ``payload`` follows the
offsets and sizes to the stored bytes.

Defined results: a null text is an empty one; an empty text becomes 192 bytes of space; equal texts give equal files and
features, as nothing but the payload goes into a file. A file whose boxes are cut short or point outside it raises
``ValueError`` in ``probe``; ``described`` gives such a row, and a null one, null ``tracks``, and no tracks to a file without any.
Repeated rows repeat their result, other columns play no part, whatever their names, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needledrop.llm.common import map_rows

#: Bytes of a sample (a frame of the track), samples of a chunk, and how many samples lie between two keyframes.
FRAME, CHUNK_FRAMES, SYNC_EVERY = 192, 64, 16
#: Frames a second; the time scale counts samples of one byte.
RATE = 50
TIMESCALE = FRAME * RATE
#: Fixed value: boxes that hold other boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(data: bytes) -> bytes:
    """``data`` with spaces up to a positive multiple of ``FRAME`` bytes."""
    return data + b" " * (max(1, -(-len(data) // FRAME)) * FRAME - len(data))


def container(data: bytes) -> bytes:
    """An ISO media file with ``data``, a multiple of ``FRAME`` bytes, as the raw samples of one sound track."""
    n = len(data) // FRAME
    chunks = -(-n // CHUNK_FRAMES)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    wide = n * FRAME >= 1 << 32  # longer times and offsets need the second version of their boxes
    times = struct.pack(">QQIQ", 0, 0, TIMESCALE, n * FRAME) if wide else struct.pack(">4I", 0, 0, TIMESCALE, n * FRAME)
    track_times = struct.pack(">QQIIQ", 0, 0, 1, 0, n * FRAME) if wide else struct.pack(">5I", 0, 0, 1, 0, n * FRAME)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, min(TIMESCALE, 65535) << 16))
    to_chunk = [(1, CHUNK_FRAMES, 1)] if n % CHUNK_FRAMES == 0 else [(1, CHUNK_FRAMES, 1), (chunks, n % CHUNK_FRAMES, 1)]
    to_chunk = to_chunk[-1:] if chunks == 1 else to_chunk
    sync = np.arange(1, n + 1, SYNC_EVERY, dtype=">u4")

    def movie(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * CHUNK_FRAMES * FRAME
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">3I", 1, n, FRAME)),
            full(b"stss", struct.pack(">I", len(sync)), sync.tobytes()),
            full(b"stsc", struct.pack(">I", len(to_chunk)), *(struct.pack(">3I", *x) for x in to_chunk)),
            full(b"stsz", struct.pack(">2I", FRAME, n)),
            full(b"co64", struct.pack(">I", chunks), offsets.astype(">u8").tobytes()),
        )
        where = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        media = box(
            b"mdia",
            full(b"mdhd", times, struct.pack(">2H", 0x55C4, 0), version=wide),
            full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"),
            box(b"minf", full(b"smhd", bytes(4)), where, table),
        )
        head = full(b"tkhd", track_times, bytes(8), struct.pack(">4H", 0, 0, 0x100, 0), matrix, bytes(8), version=wide, flags=7)
        start = full(b"mvhd", times, struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=wide)
        return box(b"moov", start, box(b"trak", head, media))

    brand = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    lead = 16  # the size of mdat is always the long form
    first = len(brand) + len(movie(0)) + lead
    return b"".join((brand, movie(first), struct.pack(">I4sQ", 1, b"mdat", len(data) + lead), data))


def boxes(data, begin: int, end: int):
    """(type, body's begin, body's end) of the boxes in data[begin:end], one level deep."""
    while begin < end:
        if end - begin < 8:
            raise ValueError("a box is cut short")
        size, kind = struct.unpack_from(">I4s", data, begin)
        lead = 8
        if size == 1:
            if end - begin < 16:
                raise ValueError("a box is cut short")
            size, lead = struct.unpack_from(">Q", data, begin + 8)[0], 16
        elif size == 0:
            size = end - begin
        if size < lead or begin + size > end:
            raise ValueError("a box ends outside the one that holds it")
        yield kind, begin + lead, begin + size
        begin += size


@dataclass
class Track:
    codec: str
    timescale: int
    duration: int
    #: Of each sample: where it begins in the file, its bytes, and whether it is a keyframe.
    offsets: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0

    def key_ranges(self) -> list[tuple[int, int]]:
        return [(int(o), int(o + s)) for o, s in zip(self.offsets[self.keys], self.sizes[self.keys], strict=True)]


def probe(data) -> list[Track]:
    """The tracks of a file, from its boxes and sample tables alone."""
    tracks: dict[int, Track] = {}
    defaults: dict[int, tuple[int, ...]] = {}
    fragments: list[tuple[int, int, int]] = []

    def walk(begin: int, end: int, leaves: dict[bytes, tuple[int, int]], depth: int = 0) -> None:
        if depth > 16:
            raise ValueError("boxes are nested too deeply")
        at = begin
        for kind, b, e in boxes(data, begin, end):
            if kind == b"trak":
                own: dict[bytes, tuple[int, int]] = {}
                walk(b, e, own, depth + 1)
                tracks[track_number(data, own, len(tracks))] = track(data, own)
            elif kind == b"moof":
                fragments.append((at, b, e))
            elif kind == b"trex":
                number, *values = numbers_at(data, b + 4, ">5I")
                defaults[number] = tuple(values[1:])
            elif kind in CONTAINERS:
                walk(b, e, leaves, depth + 1)
            elif kind not in (b"mdat", b"free", b"skip"):
                leaves[kind] = (b, e)
            at = e

    walk(0, len(data), {})
    for place in fragments:  # only after all tracks and defaults are known
        fragment(data, *place, tracks, defaults)
    return list(tracks.values())


def numbers_at(data, at: int, layout: str) -> tuple[int, ...]:
    try:
        return struct.unpack_from(layout, data, at)
    except struct.error as e:
        raise ValueError("a box is cut short") from e


def track_number(data, leaves: dict[bytes, tuple[int, int]], n: int) -> int:
    """A track's number from its header; without one, a number that no header has."""
    if b"tkhd" not in leaves:
        return -1 - n
    begin, _ = leaves[b"tkhd"]
    return numbers_at(data, begin + (20 if data[begin] else 12), ">I")[0]


def fragment(data, start: int, begin: int, end: int, tracks: dict[int, Track], defaults: dict[int, tuple[int, ...]]) -> None:
    """Add a movie fragment's samples to their tracks; ``start`` is where its box begins, from which offsets count."""
    upto = start
    for kind, b, e in boxes(data, begin, end):
        if kind != b"traf":
            continue
        inner = list(boxes(data, b, e))
        head = next((x for k, x, _ in inner if k == b"tfhd"), None)
        if head is None:
            raise ValueError("a track fragment lacks its header")
        flags, number = numbers_at(data, head, ">II")
        if number not in tracks:
            raise ValueError("a fragment's track is unknown")
        own, at, base = tracks[number], head + 8, start if flags & 0x20000 else upto
        if flags & 1:
            (base,), at = numbers_at(data, at, ">Q"), at + 8
        at += 4 * bool(flags & 2)
        given = list(defaults.get(number, (0, 0, 0)))
        for i, flag in enumerate((0x8, 0x10, 0x20)):  # duration, size, flags of samples that don't say
            if flags & flag:
                (given[i],), at = numbers_at(data, at, ">I"), at + 4
        upto = base
        for k, x, y in inner:
            if k != b"trun":
                continue
            flags, n = numbers_at(data, x, ">II")
            at, first = x + 8, None
            if flags & 1:
                upto, at = base + numbers_at(data, at, ">i")[0], at + 4
            if flags & 4:
                (first,), at = numbers_at(data, at, ">I"), at + 4
            said = [c for c in (0x100, 0x200, 0x400, 0x800) if flags & c]
            if at + 4 * n * len(said) > y or len(own.sizes) + n > len(data):  # no file has more samples than bytes
                raise ValueError("a table is cut short")
            rows = np.frombuffer(data, ">u4", n * len(said), at).astype(np.int64).reshape(n, len(said))
            duration, sizes, marks = (rows[:, said.index(c)] if c in said else np.full(n, given[i], np.int64) for i, c in enumerate((0x100, 0x200, 0x400)))
            if first is not None and n:
                marks = np.append(first, marks[1:])
            offsets = upto + np.cumsum(sizes) - sizes
            upto += int(sizes.sum())
            if upto > len(data) or (n and offsets[0] < 0):
                raise ValueError("a sample lies outside the file")
            own.duration += int(duration.sum())
            own.offsets, own.sizes = np.append(own.offsets, offsets), np.append(own.sizes, sizes)
            own.keys = np.append(own.keys, marks & 0x10000 == 0)


def track(data, leaves: dict[bytes, tuple[int, int]]) -> Track:
    def numbers(kind: bytes, skip: int, width: int, columns: int = 1) -> np.ndarray:
        """A full box's table: the count after ``skip`` bytes, then rows of ``columns`` numbers."""
        begin, end = leaves[kind]
        n = struct.unpack_from(">I", data, begin + 4 + skip)[0]
        at = begin + 8 + skip
        if at + n * width * columns > end:
            raise ValueError("a table is cut short")
        return np.frombuffer(data, f">u{width}", n * columns, at).astype(np.int64).reshape(n, columns)

    try:
        begin, _ = leaves[b"mdhd"]
        timescale, duration = struct.unpack_from(*((">IQ", data, begin + 20) if data[begin] else (">II", data, begin + 12)))
        begin, end = leaves[b"stsd"]
        codec = bytes(data[begin + 12 : begin + 16]).decode("latin-1") if end - begin >= 16 else ""
        begin, _ = leaves[b"stsz"]
        same, n = struct.unpack_from(">II", data, begin + 4)
        if same * n > len(data):  # before anything of that size is made
            raise ValueError("the samples are larger than the file")
        sizes = np.full(n, same, np.int64) if same else numbers(b"stsz", 4, 4)[:, 0]
        starts = numbers(b"co64", 0, 8)[:, 0] if b"co64" in leaves else numbers(b"stco", 0, 4)[:, 0]
        runs = numbers(b"stsc", 0, 4, 3)
    except (KeyError, struct.error) as e:
        raise ValueError("a track lacks a table") from e
    # samples of each chunk: a run holds from its first chunk to the next run's; together they are the chunks, each once
    bounds = np.append(runs[:, 0], len(starts) + 1)
    if (bounds[0] != 1 if len(runs) else len(starts)) or (np.diff(bounds) < 0).any():
        raise ValueError("the runs of chunks are out of order")
    in_chunk = np.repeat(runs[:, 1], np.diff(bounds))
    if in_chunk.sum() != n:
        raise ValueError("the chunks don't hold the samples")
    before = np.append(0, np.cumsum(sizes))
    first = np.cumsum(in_chunk) - in_chunk  # a chunk without samples begins where the next one does, or at the end
    offsets = before[:-1] + np.repeat(starts - before[first], in_chunk)
    if n and (int((offsets + sizes).max()) > len(data) or int(offsets.min()) < 0):
        raise ValueError("a sample lies outside the file")
    keys = np.ones(n, bool)
    if b"stss" in leaves:
        at = numbers(b"stss", 0, 4)[:, 0] - 1
        if len(at) and (at.min() < 0 or at.max() >= n):
            raise ValueError("a keyframe is no sample")
        keys[:] = False
        keys[at] = True
    return Track(codec, timescale, duration, offsets, sizes, keys)


def payload(data, t: Track) -> bytes:
    """The stored bytes of a track's samples, read back by offset and size; neighbours in one piece."""
    if not len(t.sizes):
        return b""
    apart = np.flatnonzero(t.offsets[1:] != t.offsets[:-1] + t.sizes[:-1]) + 1
    begin, last = np.append(0, apart), np.append(apart, len(t.sizes)) - 1
    return b"".join(data[t.offsets[a] : t.offsets[b] + t.sizes[b]] for a, b in zip(begin, last, strict=True))


def feature(t: Track) -> str:
    """Codec, duration in ms, samples, keyframes, and the byte ranges of the first and last keyframe; ``spans`` has those of all."""
    ranges = t.key_ranges()
    shown = [f"{a}-{b}" for a, b in (ranges[:1] + ranges[-1:])]
    return f"{t.codec.strip()}:{round(1000 * t.seconds)}ms:{len(t.sizes)}:{len(ranges)}:{','.join(shown)}"


def spans(t: Track) -> str:
    """The byte ranges of all keyframes, in their order."""
    return ",".join(f"{a}-{b}" for a, b in t.key_ranges())


def stored(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, media binary) of every row: the text's UTF-8 bytes, padded, as a container."""
    make = lambda: lambda k, texts: [k, [container(padded((t or "").encode("utf-8", "replace"))) for t in texts]]
    from pyspark.sql.types import BinaryType, StructField, StructType

    return map_rows(df.select(F.col(key), F.col(text)), make, StructType([df.schema[key], StructField("media", BinaryType())]))


def described(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """(key, tracks array<struct<codec, duration_ms, n_samples, key_ranges array<struct<begin, end>>>>) of each file."""
    from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

    def one(data):
        try:
            tracks = probe(data) if data else None
        except ValueError:
            tracks = None
        if tracks is None:
            return None
        ranges = lambda t: [{"begin": a, "end": b} for a, b in t.key_ranges()]
        return [{"codec": t.codec, "duration_ms": round(1000 * t.seconds), "n_samples": len(t.sizes), "key_ranges": ranges(t)} for t in tracks]

    span = StructType([StructField("begin", LongType()), StructField("end", LongType())])
    each = [StructField("codec", StringType()), StructField("duration_ms", LongType()), StructField("n_samples", LongType()), StructField("key_ranges", ArrayType(span))]
    schema = StructType([df.schema[key], StructField("tracks", ArrayType(StructType(each)))])
    return map_rows(df.select(F.col(key), F.col(media)), lambda: lambda k, files: [k, list(map(one, files))], schema)


def round_trip(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The contract's columns and every keyframe's byte range: each text is stored, probed, read back and digested."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    def one(text):
        data = (text or "").encode("utf-8", "replace")
        media = container(padded(data))
        t = probe(media)[0]
        back = payload(media, t)
        sha = hashlib.sha256
        return (
            *(len(data), len(back), sha(back).hexdigest(), zlib.crc32(back[-16:])),
            *(len(media), sha(media).hexdigest(), feature(t), spans(t)),
        )

    names = {"n_bytes": LongType, "payload_bytes": LongType, "payload_sha256": StringType, "tail_crc32": LongType}
    names |= {"media_bytes": LongType, "media_sha256": StringType, "feature": StringType, "key_ranges": StringType}
    make = lambda: lambda k, texts: [k, *([list(x) for x in zip(*map(one, texts))] or [[]] * 8)]
    schema = StructType([df.schema[key], *(StructField(n, t()) for n, t in names.items())])
    return map_rows(df.select(F.col(key), F.col(text)), make, schema)
