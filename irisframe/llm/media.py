"""Columns of ISO media containers: codec, duration and keyframe byte ranges.

``describe`` walks the nested boxes of a container and decodes its sample tables
(sizes, chunk map, chunk offsets, durations, sync samples); payloads are never
decoded. ``wrap`` writes a container that holds bytes as 8-bit samples, so a
column of texts can make the round trip.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 64
TIMESCALE = 8000
SYNC_EVERY = 16
SAMPLES_PER_CHUNK = 256
NESTED = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta"))


def _box(kind: bytes, *body: bytes) -> bytes:
    raw = b"".join(body)
    if len(raw) + 8 < 1 << 32:
        return struct.pack(">I4s", len(raw) + 8, kind) + raw
    return struct.pack(">I4sQ", 1, kind, len(raw) + 16) + raw


def _full(kind: bytes, *body: bytes, version: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24), *body)


def wrap(payload: bytes) -> bytes:
    """An ISO media file with one track of raw 8-bit samples, ``UNIT`` bytes each.

    ``payload`` must be a positive multiple of ``UNIT``.
    """
    count = len(payload) // UNIT
    if not count or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of the unit")
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    length = count * UNIT
    chunks = -(-count // SAMPLES_PER_CHUNK)
    rest = count - (chunks - 1) * SAMPLES_PER_CHUNK
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    runs = [(1, SAMPLES_PER_CHUNK, 1)] if chunks > 1 else []
    if not runs or rest != SAMPLES_PER_CHUNK:
        runs.append((chunks, rest, 1))
    sync = np.arange(1, count + 1, SYNC_EVERY, dtype=">u4")
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")

    def movie(first: int) -> bytes:
        step = SAMPLES_PER_CHUNK * UNIT
        large = first + length >= 1 << 32
        offsets = (np.arange(chunks, dtype=np.uint64) * step + first).astype(">u8" if large else ">u4")
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, count, UNIT)),
            _full(b"stss", struct.pack(">I", len(sync)), sync.tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
            _full(b"stsz", struct.pack(">II", UNIT, count)),
            _full(b"co64" if large else b"stco", struct.pack(">I", chunks), offsets.tobytes()),
        )
        reference = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), struct.pack(">I4sI", 12, b"url ", 1)))
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, length, 0x55C4, 0), version=1),
            _full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0"),
            _box(b"minf", _full(b"smhd", bytes(4)), reference, table),
        )
        track = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, length), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), version=1)
        return _box(
            b"moov",
            _full(b"mvhd", struct.pack(">QQIQ", 0, 0, TIMESCALE, length), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=1),
            _box(b"trak", track, media),
        )

    data = _box(b"mdat", payload)
    size = len(head) + len(movie(0))
    first = size + len(data) - length
    made = movie(first)
    if len(head) + len(made) != size:  # wider chunk offsets than assumed
        first += len(head) + len(made) - size
        made = movie(first)
    return head + made + data


@dataclass
class Track:
    codec: str
    timescale: int
    duration: int
    offsets: np.ndarray
    sizes: np.ndarray
    keyframes: np.ndarray

    @property
    def keyframe_ranges(self) -> list[tuple[int, int]]:
        return list(zip(self.offsets[self.keyframes].tolist(), self.sizes[self.keyframes].tolist()))

    def payload(self, raw: bytes) -> bytes:
        """The samples in order, read at the places the tables give."""
        ends = self.offsets + self.sizes
        if not len(ends):
            return b""
        cuts = np.flatnonzero(self.offsets[1:] != ends[:-1]) + 1
        return b"".join(raw[self.offsets[a] : ends[b - 1]] for a, b in zip([0, *cuts], [*cuts, len(ends)]))


def walk(raw: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body start, body end) of every box, containers before their content."""
    end = len(raw) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", raw, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("a box is cut off")
            size, body = struct.unpack_from(">Q", raw, body)[0], start + 16
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            raise ValueError("a box is cut off")
        yield (*path, kind), body, stop
        if kind in NESTED:
            yield from walk(raw, body, stop, (*path, kind))
        start = stop


def _numbers(raw: bytes, at: int, count: int, kind: str = ">u4") -> np.ndarray:
    return np.frombuffer(raw, dtype=kind, count=count, offset=at).astype(np.int64)


def describe(raw: bytes) -> list[Track]:
    """Tracks of a container; raises ValueError on broken boxes or tables."""
    tracks: list[dict] = []
    try:
        for path, at, end in walk(raw):
            kind = path[-1]
            if kind == b"trak":
                tracks.append({})
            if b"trak" not in path[:-1]:
                continue
            t = tracks[-1]
            if kind == b"mdhd":
                long = raw[at]
                t["scale"], t["duration"] = struct.unpack_from(">IQ" if long else ">II", raw, at + (20 if long else 12))
            elif kind == b"stsd":
                t["codec"] = struct.unpack_from(">4s", raw, at + 12)[0].decode("latin-1").strip()
            elif kind == b"stts":
                t["times"] = _numbers(raw, at + 8, 2 * _numbers(raw, at + 4, 1)[0])
            elif kind == b"stss":
                t["sync"] = _numbers(raw, at + 8, _numbers(raw, at + 4, 1)[0]) - 1
            elif kind == b"stsc":
                t["runs"] = _numbers(raw, at + 8, 3 * _numbers(raw, at + 4, 1)[0]).reshape(-1, 3)
            elif kind == b"stsz":
                size, count = _numbers(raw, at + 4, 2)
                t["sizes"] = np.full(count, size) if size else _numbers(raw, at + 12, count)
            elif kind in (b"stco", b"co64"):
                t["chunks"] = _numbers(raw, at + 8, _numbers(raw, at + 4, 1)[0], ">u4" if kind == b"stco" else ">u8")
        return [_track(t) for t in tracks]
    except (struct.error, KeyError, IndexError) as error:
        raise ValueError(f"broken container: {error}") from error


def _track(t: dict) -> Track:
    sizes, chunks, runs = t["sizes"], t["chunks"], t["runs"]
    last = np.append(runs[1:, 0], len(chunks) + 1)
    per_chunk = np.repeat(runs[:, 1], last - runs[:, 0])
    if len(per_chunk) != len(chunks) or per_chunk.sum() != len(sizes):
        raise ValueError("broken container: chunk map and sizes differ")
    begins = np.cumsum(per_chunk) - per_chunk
    before = np.cumsum(sizes) - sizes
    offsets = np.repeat(chunks - before[begins], per_chunk) + before if len(sizes) else sizes
    sync = t.get("sync", np.arange(len(sizes)))
    duration = t["duration"] or int((t["times"][::2] * t["times"][1::2]).sum())
    return Track(t["codec"], t["scale"], duration, offsets, sizes, sync)


def media_columns(files: DataFrame, content: str = "content", key: str = "key") -> DataFrame:
    """(key, codec, seconds, keyframes, error): one row per container.

    ``keyframes`` are (offset, size) byte ranges over all tracks; null and broken
    containers give null columns and a reason in ``error``. Rows stand alone.
    """
    ranges = pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column("content"):
                try:
                    tracks = describe(raw.as_py() or b"")
                    if not tracks:
                        raise ValueError("no track")
                    frames = [{"offset": o, "size": s} for t in tracks for o, s in t.keyframe_ranges]
                    out.append((",".join(t.codec for t in tracks), max(t.duration / t.timescale for t in tracks), frames, None))
                except (ValueError, ZeroDivisionError) as error:
                    out.append((None, None, None, str(error)))
            kinds = (pa.string(), pa.float64(), ranges, pa.string())
            arrays = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
            yield pa.record_batch([batch.column("key"), *arrays], ["key", "codec", "seconds", "keyframes", "error"])

    given = files.select(F.col(key).cast("long").alias("key"), F.col(content).alias("content"))
    schema = "key long, codec string, seconds double, keyframes array<struct<offset:long,size:long>>, error string"
    return given.mapInArrow(run, schema)


def padded(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\0")


def stored_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, content): each text as a container of 8-bit samples.

    A null text counts as empty; zero bytes fill the last unit. Equal texts give
    equal containers; rows stand alone and only doc_id and text are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.record_batch(
                {"doc_id": batch.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "content": pa.array([wrap(padded(t)) for t in texts], pa.binary())}
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, content binary")


def media_digests(files: DataFrame) -> DataFrame:
    """Digests and features of stored texts, all from the containers' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column("content").to_pylist():
                (track,) = describe(raw)
                payload = track.payload(raw)
                frames = track.keyframe_ranges
                places = hashlib.sha256(repr(frames).encode()).hexdigest()[:16]
                feature = f"codec={track.codec};seconds={track.duration / track.timescale:.6f};keyframes={len(frames)};first={frames[0]};last={frames[-1]};ranges={places}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(raw), hashlib.sha256(raw).hexdigest(), feature))
            names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            arrays = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), *arrays], ["doc_id", "n_bytes", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return files.mapInArrow(run, schema)
