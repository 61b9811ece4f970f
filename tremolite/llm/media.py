"""Media columns for ISO media files: boxes are walked and sample tables decoded; payloads are never decoded."""

from __future__ import annotations

import contextlib
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl"}
#: Levels of boxes that are entered; the tables of samples stand on the fifth.
DEEPEST = 16
#: Samples of one size that a track may have whose bytes aren't in the file.
ELSEWHERE = 1 << 20
#: Bytes of a sample, samples a second, samples of a chunk, and every how many samples a keyframe stands.
UNIT, RATE, CHUNK, KEY_EVERY = 64, 125, 16, 8

MEDIA = """track int, codec string, timescale long, duration long, n_samples long, keyframes array<struct<start:long,end:long>>"""


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes) -> bytes:
    return _box(kind, b"\0\0\0\0", *parts)


def _table(values: np.ndarray) -> bytes:
    return struct.pack(">I", len(values)) + np.asarray(values, ">u4").tobytes()


def pack(payload: bytes) -> bytes:
    """An ISO media file whose only track has ``payload``, as raw 8-bit samples in units of ``UNIT`` bytes."""
    n = len(payload) // UNIT
    chunks = -(-n // CHUNK)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE * UNIT << 16 & 0xFFFFFFFF))
    head = _box(b"ftyp", b"isom\0\0\0\1isom")
    runs = [(1, CHUNK, 1)] * (n >= CHUNK) + [(chunks, n % CHUNK, 1)] * (n % CHUNK > 0)

    def moov(at: int) -> bytes:
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, 1)),
            _full(b"stss", _table(np.arange(1, n + 1, KEY_EVERY))),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", UNIT, n)),
            _full(b"co64", struct.pack(">I", chunks), (at + np.arange(chunks, dtype=np.int64) * CHUNK * UNIT).astype(">u8").tobytes()),
        )
        mdhd = _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0))
        hdlr = _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0")
        trak = _box(b"trak", _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(60)), _box(b"mdia", mdhd, hdlr, _box(b"minf", _full(b"smhd", bytes(4)), table)))
        return _box(b"moov", _full(b"mvhd", struct.pack(">IIII", 0, 0, RATE, n), bytes(80)), trak)

    before = len(head) + len(moov(0)) + 16  # the media box has a 64-bit size
    return head + moov(before) + struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) + payload


def walk(data: bytes, at: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start, end) of each box's content; broken sizes end the walk of what holds them. Boxes below ``DEEPEST`` aren't
    entered, so that a file made of nested ones takes no more than that."""
    levels = [(at, len(data) if end is None else end, path)]
    while levels:
        at, end, path = levels.pop()
        if at + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            continue
        yield (*path, kind), at + head, at + size
        levels.append((at + size, end, path))
        if kind in CONTAINERS and len(path) < DEEPEST:
            levels.append((at + head, at + size, (*path, kind)))


class Track:
    """A track's codec, times and the byte range of each sample, from the boxes of one ``trak``."""

    def __init__(self, data: bytes, at: int, end: int) -> None:
        boxes = {}
        for path, a, b in walk(data, at, end, (b"moov", b"trak")):
            boxes.setdefault(path[-1], data[a:b])
        u4 = lambda kind, skip: np.frombuffer(boxes[kind], ">u4", offset=skip).astype(np.int64)
        self.codec = boxes[b"stsd"][12:16].decode("latin-1")
        wide = boxes[b"mdhd"][0] == 1
        self.timescale = struct.unpack_from(">I", boxes[b"mdhd"], 20 if wide else 12)[0]
        stts = u4(b"stts", 8).reshape(-1, 2)
        self.duration = int((stts[:, 0] * stts[:, 1]).sum())
        same, n = struct.unpack_from(">II", boxes[b"stsz"], 4)
        sizes = np.empty(0, np.int64) if same else u4(b"stsz", 12)[:n]
        # a count is the file's word: no more samples than its table or its bytes can hold, or so many if they lie elsewhere
        if n > (max(len(data) // same, ELSEWHERE) if same else len(sizes)):
            raise ValueError("more samples than the file holds")
        sizes = np.full(n, same, np.int64) if same else sizes
        starts = np.frombuffer(boxes[b"co64"], ">u8", offset=8).astype(np.int64) if b"co64" in boxes else u4(b"stco", 8)
        runs = u4(b"stsc", 8).reshape(-1, 3)
        counts = np.minimum(np.repeat(runs[:, 1], np.diff(np.minimum(np.append(runs[:, 0], len(starts) + 1), len(starts) + 1))), n)
        counts = counts[: int(np.searchsorted(np.cumsum(counts), n)) + 1]
        chunk = np.repeat(np.arange(len(counts)), counts)[:n]
        if len(chunk) < n:
            raise ValueError("fewer chunks than samples")
        ahead = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.start = starts[chunk] + ahead - ahead[np.searchsorted(chunk, chunk)]
        self.end = self.start + sizes
        keys = u4(b"stss", 8) - 1 if b"stss" in boxes else np.arange(n)  # without that table every sample is a keyframe
        self.keyframes = [(int(self.start[k]), int(self.end[k])) for k in keys if 0 <= k < n]

    def payload(self, data: bytes) -> bytes:
        """All samples, read by their byte ranges; ranges that touch are read at once."""
        if not len(self.start):
            return b""
        cut = np.flatnonzero(np.concatenate([[True], self.start[1:] != self.end[:-1]]))
        last = np.append(cut[1:], len(self.start)) - 1
        return b"".join(data[self.start[a] : self.end[b]] for a, b in zip(cut, last, strict=True))


def tracks(data: bytes | None) -> list[Track]:
    """The tracks of a file in order; one whose tables are cut short or missing is left out."""
    out = []
    for path, at, end in walk(data or b""):
        if path == (b"moov", b"trak"):
            with contextlib.suppress(KeyError, struct.error, ValueError, IndexError):
                out.append(Track(data, at, end))
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    names = ["media_id", "track", "codec", "timescale", "duration", "n_samples", "keyframes"]
    for batch in batches:
        rows: list[tuple] = []
        for media_id, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = [(media_id, n, t.codec, t.timescale, t.duration, len(t.start), [{"start": a, "end": b} for a, b in t.keyframes]) for n, t in enumerate(tracks(media.as_py()))]
            rows += found or [(media_id, *[None] * 6)]
        yield pa.record_batch([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=names)


def media_columns(df: DataFrame, media_id: str, media: str) -> DataFrame:
    """media_id and the columns of ``MEDIA``, one row for each track of a file; each track has its own tables.

    A row of nulls where the bytes are null, cut short or hold no whole track. Repeated rows: equal results. An empty
    table gives an empty table. Other columns aren't read, whatever their names.
    """
    return df.select(F.col(media_id).cast("long").alias("media_id"), F.col(media).alias("media")).mapInArrow(_describe, f"media_id long, {MEDIA}")


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = text_bytes(batch.column(1))
        cols: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for k in range(batch.num_rows):
            raw = data[offs[k] : offs[k + 1]].tobytes()
            stored = pack(raw + bytes(-len(raw) % UNIT if raw else UNIT))
            (track,) = tracks(stored)
            back = track.payload(stored)
            first, last = track.keyframes[0], track.keyframes[-1]
            feature = f"{track.codec}:{track.timescale}:{track.duration}:{len(track.keyframes)}:{first[0]}-{first[1]}:{last[0]}-{last[1]}"
            row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature)
            for c, v in zip(cols.values(), row, strict=True):
                c.append(v)
        yield pa.record_batch([batch.column(0), *(pa.array(v, pa.string() if isinstance(v[0], str) else pa.int64()) if v else pa.array(v, pa.int64()) for v in cols.values())], names=["doc_id", *cols])


def media_report(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores each text as an ISO media file, reads the stored bytes back, and returns their digests and features.

    The payload is the text's UTF-8 bytes and bytes 0 up to a positive multiple of 64. Null or empty text: 64 bytes 0.
    feature: codec, timescale, duration in its units, keyframes, and the byte ranges of the first and last of them.
    One text at a time, no shuffle; equal texts give equal values, a null doc_id stays null. An empty table gives an
    empty table. Columns other than doc_id and text aren't read, whatever their names.
    """
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _store, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
