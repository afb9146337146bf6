"""ISO base media files in a column: a writer for raw samples and a reader that never decodes payloads.

The reader walks nested boxes, decodes the sample tables of every track (stsd, stts, stsc, stsz or stz2, stco or co64,
stss) and the runs of fragments (trex, tfhd, trun), and gives codec, duration and the byte ranges of the key frames.
Counts are held against the sizes of their boxes and of the file before anything is allocated.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column_bytes, id_text, prepare

CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"moof", b"traf", b"mvex"}
SAMPLE_BYTES = 576
KEY_EVERY = 16
SAMPLES_PER_CHUNK = 32
TIMESCALE = 8000
CODEC = b"raw "


class Media(NamedTuple):
    """One track."""

    track_id: int
    handler: str  # vide, soun, ...
    codec: str
    timescale: int
    duration: int
    offsets: np.ndarray  # of each sample
    sizes: np.ndarray
    keys: np.ndarray  # indexes of the key frames


class Damaged(ValueError):
    pass


#: What reading bytes that are no sound file may raise.
DAMAGE = (Damaged, struct.error, ValueError, IndexError, OverflowError, MemoryError)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(data: bytes, unit: int = SAMPLE_BYTES) -> bytes:
    """`data` with bytes 255 up to a positive multiple of `unit`."""
    return data + b"\xff" * (max(1, -(-len(data) // unit)) * unit - len(data))


def write_media(payload: bytes, sample: int = SAMPLE_BYTES, key_every: int = KEY_EVERY, per_chunk: int = SAMPLES_PER_CHUNK) -> bytes:
    """A file with one track of 8-bit samples in frames of `sample` bytes; the payload must be a multiple of it."""
    n = len(payload) // sample
    chunks = -(-n // per_chunk)
    wide = len(payload) > 0xFFFF0000
    duration = n * sample
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")

    def moov(first: int) -> bytes:
        runs = [(1, per_chunk)] if n % per_chunk == 0 else [(1, per_chunk)] * (chunks > 1) + [(chunks, n % per_chunk)]
        offsets = [first + i * per_chunk * sample for i in range(chunks)]
        entry = box(CODEC, b"\0" * 6, struct.pack(">H", 1), b"\0" * 8, struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, sample)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, b, 1) for a, b in runs)),
            full(b"stsz", struct.pack(">II", sample, n)),
            full(b"stss", struct.pack(f">I{-(-n // key_every)}I", -(-n // key_every), *range(1, n + 1, key_every))),
            full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
        )
        minf = box(b"minf", full(b"smhd", b"\0" * 4), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, duration, 0x55C4, 0), version=1), full(b"hdlr", b"\0" * 4, b"soun", b"\0" * 13), minf)
        trak = box(b"trak", full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, duration), b"\0" * 16, matrix, b"\0" * 8, version=1, flags=7), mdia)
        return box(b"moov", full(b"mvhd", struct.pack(">QQIQ", 0, 0, TIMESCALE, duration), struct.pack(">IH", 0x10000, 0x100), b"\0" * 10, matrix, b"\0" * 24, struct.pack(">I", 2), version=1), trak)

    first = len(head) + len(moov(0)) + (16 if len(payload) + 8 >= 1 << 32 else 8)
    return head + moov(first) + box(b"mdat", payload)


class Box(NamedTuple):
    kind: bytes
    start: int
    body: int
    end: int
    path: tuple[tuple[bytes, int], ...]  # kinds and starts of the boxes around it

    def inside(self, kind: bytes) -> int | None:
        """The start of the box of that kind around this one."""
        return next((at for k, at in reversed(self.path) if k == kind), None)


def walk(data: bytes, start: int = 0, end: int | None = None) -> Iterator[Box]:
    """Every box, containers first, in the order of the file. Boxes that overrun their parent end with it."""
    stack: list[tuple[int, int, tuple]] = [(start, len(data) if end is None else end, ())]
    while stack:
        at, end_, path = stack.pop()
        if at + 8 > end_:
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1 and body + 8 <= end_:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = end_ - at
        if size < body - at:
            continue
        stop = min(at + size, end_)
        yield Box(kind, at, body, stop, path)
        stack.append((stop, end_, path))
        if kind in CONTAINERS and len(path) < len(CONTAINERS):
            stack.append((body, stop, (*path, (kind, at))))


def _numbers(data: bytes, b: Box, skip: int, count: int, dtype: str = ">u4") -> np.ndarray:
    if b.body + skip + count * np.dtype(dtype).itemsize > b.end:
        raise Damaged(f"{b.kind!r} is cut short")
    return np.frombuffer(data, dtype=dtype, count=count, offset=b.body + skip).astype(np.int64)


def _entries(data: bytes, b: Box, width: int, dtype: str = ">u4") -> np.ndarray:
    """The rows of a table of `width` numbers each, their count before them."""
    count = int(_numbers(data, b, 4, 1)[0])
    return _numbers(data, b, 8, width * count, dtype).reshape(count, width)


def _sample_sizes(data: bytes, t: dict[bytes, Box]) -> np.ndarray:
    if b"stz2" in t:
        bits, n = _numbers(data, t[b"stz2"], 4, 2).tolist()
        if bits in (8, 16):
            return _numbers(data, t[b"stz2"], 12, n, ">u1" if bits == 8 else ">u2")
        if bits != 4:
            raise Damaged("sizes of an unknown width")
        both = _numbers(data, t[b"stz2"], 12, -(-n // 2), ">u1")
        return np.stack([both >> 4, both & 15], axis=1).ravel()[:n]
    fixed, n = _numbers(data, t[b"stsz"], 4, 2).tolist()
    if not fixed:
        return _numbers(data, t[b"stsz"], 12, n)
    if fixed * n > len(data):
        raise Damaged("more samples than bytes")
    return np.full(n, fixed)


def _table_samples(data: bytes, t: dict[bytes, Box]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(offsets, sizes, key indexes, duration) by the sample tables."""
    sizes = _sample_sizes(data, t)
    n = len(sizes)
    times = _entries(data, t[b"stts"], 2)
    if int(times[:, 0].sum()) != n:
        raise Damaged("times for another number of samples")
    chunks = _entries(data, t[b"stco"], 1).ravel() if b"stco" in t else _entries(data, t[b"co64"], 1, ">u8").ravel()
    runs = _entries(data, t[b"stsc"], 3)
    firsts = np.append(runs[:, 0], len(chunks) + 1)
    if n and (not len(runs) or firsts[0] != 1 or (np.diff(firsts) < 0).any()):
        raise Damaged("runs of chunks out of order")
    of_chunk = np.minimum(np.repeat(runs[:, 1], np.diff(firsts)) if n else runs[:0, 1], n)
    if int(of_chunk.sum()) < n:
        raise Damaged("fewer chunks than samples")
    ends = np.minimum(np.cumsum(of_chunk), n)
    of_chunk = np.diff(ends, prepend=0)  # so that no more than n are ever repeated
    before = np.append(0, np.cumsum(sizes))
    offsets = np.repeat(chunks[: len(ends)] - before[ends - of_chunk], of_chunk) + before[:-1]
    keys = _entries(data, t[b"stss"], 1).ravel() - 1 if b"stss" in t else np.arange(n)
    return offsets, sizes, keys, int((times[:, 0] * times[:, 1]).sum())


def _checked(data: bytes, offsets: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> None:
    n = len(sizes)
    if n and (offsets.min() < 0 or sizes.min() < 0 or int((offsets + sizes).max()) > len(data)):
        raise Damaged("samples beyond the file")
    if len(keys) and (keys[0] < 0 or keys[-1] >= n or (np.diff(keys) <= 0).any()):
        raise Damaged("key frames that are no samples")


NOT_SYNC = 0x10000


def _run_samples(data: bytes, b: Box, defaults: tuple[int, int, int], start: int) -> tuple[np.ndarray, ...]:
    """(offsets, sizes, durations, flags) of a trun; `defaults` are duration, size and flags."""
    flags = int(_numbers(data, b, 0, 1)[0]) & 0xFFFFFF
    count, at = int(_numbers(data, b, 4, 1)[0]), 8 + 4 * bool(flags & 1) + 4 * bool(flags & 4)
    width = sum(bool(flags & x) for x in (0x100, 0x200, 0x400, 0x800))
    if not width and count * max(defaults[1], 1) > len(data):
        raise Damaged("more samples than bytes")
    rows = _numbers(data, b, at, width * count).reshape(count, width)
    column = iter(range(width))
    duration, size, own = (rows[:, next(column)] if flags & x else np.full(count, y) for x, y in zip((0x100, 0x200, 0x400), defaults, strict=True))
    if flags & 4 and count and not flags & 0x400:
        own = np.append(_numbers(data, b, 8 + 4 * bool(flags & 1), 1), own[1:])
    return start + np.cumsum(size) - size, size, duration, own


def _fragment_samples(data: bytes, boxes: list[Box]) -> dict[int, list[tuple[np.ndarray, ...]]]:
    """The runs of each track's fragments."""
    out: dict[int, list[tuple[np.ndarray, ...]]] = {}
    extends = {int(x[0]): tuple(x[2:].tolist()) for x in (_numbers(data, b, 4, 5) for b in boxes if b.kind == b"trex")}
    moof, track, base, at, defaults = None, None, 0, 0, (0, 0, 0)
    for b in boxes:
        if b.kind == b"tfhd" and b.inside(b"traf") is not None:
            flags, track = (int(x) for x in _numbers(data, b, 0, 2))
            skip, given = 8 + 8 * bool(flags & 1) + 4 * bool(flags & 2), []
            for x, y in zip((8, 0x10, 0x20), extends.get(track, (0, 0, 0)), strict=True):
                given.append(int(_numbers(data, b, skip, 1)[0]) if flags & x else y)
                skip += 4 * bool(flags & x)
            defaults = tuple(given)
            new = b.inside(b"moof") != moof
            moof = b.inside(b"moof")
            if flags & 1:
                base = int(_numbers(data, b, 8, 1, ">u8")[0])
            elif flags & 0x20000 or new:
                base = moof or 0
            else:
                base = at
            at = base
        elif b.kind == b"trun" and b.inside(b"traf") is not None and track is not None:
            if int(_numbers(data, b, 0, 1)[0]) & 1:
                at = base + int(_numbers(data, b, 8, 1, ">i4")[0])
            run = _run_samples(data, b, defaults, at)
            out.setdefault(track, []).append(run)
            at += int(run[1].sum())
    return out


def read_tracks(data: bytes) -> list[Media]:
    """Every track of a file, in its order. Raises one of DAMAGE where a table doesn't fit its box, the others or the file."""
    boxes = list(walk(data))
    tracks: dict[int, dict[bytes, Box]] = {}
    for b in boxes:
        if b.kind == b"trak":
            tracks[b.start] = {}
        elif (at := b.inside(b"trak")) is not None:
            tracks[at].setdefault(b.kind, b)
    fragments = _fragment_samples(data, boxes)
    out = []
    for t in tracks.values():
        if not {b"mdhd", b"stsd"} <= t.keys():
            raise Damaged("a track without a header or description")
        head = t[b"mdhd"]
        wide = _numbers(data, head, 0, 1)[0] >> 24 == 1
        timescale = int(_numbers(data, head, 20 if wide else 12, 1)[0])
        declared = int(_numbers(data, head, 24 if wide else 16, 1, ">u8" if wide else ">u4")[0])
        codec = _numbers(data, t[b"stsd"], 12, 4, ">u1").astype(np.uint8).tobytes().decode("latin-1").strip()
        handler = _numbers(data, t[b"hdlr"], 8, 4, ">u1").astype(np.uint8).tobytes().decode("latin-1") if b"hdlr" in t else ""
        track_id = int(_numbers(data, t[b"tkhd"], 20 if _numbers(data, t[b"tkhd"], 0, 1)[0] >> 24 == 1 else 12, 1)[0]) if b"tkhd" in t else 0
        needed = {b"stts", b"stsc"} <= t.keys() and (b"stsz" in t or b"stz2" in t) and (b"stco" in t or b"co64" in t)
        runs = fragments.get(track_id, [])
        if not needed and not runs:
            raise Damaged("a track without a sample table")
        none = np.zeros(0, dtype=np.int64)
        offsets, sizes, keys, duration = _table_samples(data, t) if needed else (none, none, none, 0)
        for more, size, durations, flags in runs:
            keys = np.append(keys, len(sizes) + np.flatnonzero(flags & NOT_SYNC == 0))
            offsets, sizes, duration = np.append(offsets, more), np.append(sizes, size), duration + int(durations.sum())
        _checked(data, offsets, sizes, keys)
        if max(duration, declared) >= 1 << 63:
            raise Damaged("a duration beyond 63 bits")
        out.append(Media(track_id, handler, codec, timescale, duration or declared, offsets, sizes, keys))
    return out


def read_media(data: bytes) -> Media | None:
    """The first picture track, else the first track; None if the bytes are damaged or hold none."""
    try:
        tracks = read_tracks(data)
    except DAMAGE:
        return None
    return next((t for t in tracks if t.handler == "vide"), tracks[0] if tracks else None)


def sample_bytes(data: bytes, media: Media) -> bytes:
    """The samples, joined. Neighbouring samples are read as one range."""
    if not len(media.offsets):
        return b""
    ends = media.offsets + media.sizes
    new = np.flatnonzero(np.append(True, media.offsets[1:] != ends[:-1]))
    last = np.append(new[1:], len(ends)) - 1
    return b"".join(data[a:b] for a, b in zip(media.offsets[new].tolist(), ends[last].tolist(), strict=True))


def key_ranges(media: Media) -> list[tuple[int, int]]:
    return list(zip(media.offsets[media.keys].tolist(), media.sizes[media.keys].tolist(), strict=True))


_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
_TRACKS = pa.list_(pa.struct([("track_id", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("keyframes", _RANGES)]))


def described(data: bytes | None) -> tuple:
    """(codec, timescale, duration, key-frame ranges, tracks) of a file; nulls for one that is empty or damaged."""
    try:
        tracks = read_tracks(data or b"")
        rows = [(t, [{"start": a, "length": b} for a, b in key_ranges(t)]) for t in tracks]
    except DAMAGE:
        rows = []
    if not rows:
        return (None,) * 5
    main, keys = next((x for x in rows if x[0].handler == "vide"), rows[0])
    names = ("track_id", "handler", "codec", "timescale", "duration")
    every = [{**{n: getattr(t, n) for n in names}, "samples": len(t.sizes), "keyframes": k} for t, k in rows]
    return main.codec, main.timescale, main.duration, keys, every


def media_columns(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """id, codec, timescale, duration, keyframes (byte ranges) and tracks of a binary column of ISO media files.

    The first four describe the first picture track, else the first track; tracks describes all: track_id, handler,
    codec, timescale, duration, samples, keyframes. Fragments count with their tracks. One row per input row; a null
    or empty file, and one of which any table is damaged or points beyond the file, has null columns; other columns
    are ignored; an empty table gives no rows.
    """
    prepare(df.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), _RANGES, _TRACKS]
        names = ["id", "codec", "timescale", "duration", "keyframes", "tracks"]
        for batch in batches:
            rows = [described(x.as_py()) for x in batch.column(1)]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    ranges = "array<struct<start: long, length: long>>"
    tracks = f"array<struct<track_id: long, handler: string, codec: string, timescale: long, duration: long, samples: long, keyframes: {ranges}>>"
    rows = df.select(df[id_col].cast("long").alias("id"), df[media_col].cast("binary").alias("media"))
    return rows.mapInArrow(read, f"id long, codec string, timescale long, duration long, keyframes {ranges}, tracks {tracks}")


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Store every whole text as an ISO media file, read it back from its own sample tables and describe it.

    One row per input row: doc_id, n_bytes, payload_bytes, payload_sha256 and tail_crc32 (of the bytes read back),
    media_bytes, media_sha256, feature, keyframes (byte ranges), and media if `keep_media`. A null text is empty:
    one frame of bytes 255. Equal texts have equal values; null ids stay null; an empty table gives no rows.
    """
    prepare(df.sparkSession)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), ranges] + [pa.binary()] * keep_media
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "keyframes"] + ["media"] * keep_media
        for batch in batches:
            rows = []
            for raw in column_bytes(batch, "text"):
                stored = write_media(pad(raw or b""))
                media = read_media(stored)
                back, keys = sample_bytes(stored, media), key_ranges(media)
                crc = zlib.crc32(np.asarray(keys, dtype="<i8").tobytes())
                feature = f"codec={media.codec};timescale={media.timescale};duration={media.duration};samples={len(media.sizes)};keyframes={len(keys)};first={keys[0][0]}+{keys[0][1]};last={keys[-1][0]}+{keys[-1][1]};ranges={crc:08x}"
                row = (len(raw or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, [{"start": a, "length": b} for a, b in keys])
                rows.append((*row, stored) if keep_media else row)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], kinds[i]) for i in range(len(kinds)))], ["doc_id", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, keyframes array<struct<start: long, length: long>>" + ", media binary" * keep_media
    return id_text(df, id_col, text_col).mapInArrow(store, schema)
