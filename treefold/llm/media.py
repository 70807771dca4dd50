"""Media columns for ISO base media files: a box walker, sample tables, key-frame byte ranges; no payload is decoded.

``probe`` walks the nested boxes of one file and reads, per track, the codec (sample entry), time scale, duration and the
sample tables stts, stsz/stz2, stsc, stco/co64 and stss; from these it places every sample in the file and gives the byte
range of each key frame. ``write_raw_track`` is the writer for payloads that are stored as 8-bit samples: an
uncompressed grey video track of 8 x 8 frames, one frame a sample, a key frame at the start of every group of frames.

Results for odd input: null or empty text is a payload of 64 zero bytes, a very long one has as many frames as it takes;
null media, bytes that are not ISO media or are cut short, boxes nested deeper than MOST_DEPTH, tables that count more
samples than the file has bytes, and samples outside the file give a null probe with the reason in ``error``, and so do
files with movie fragments (moof), whose sample runs are not read. Every count is checked against the file's size before
memory is taken for it. Equal texts give equal media; an empty table gives an empty table; other columns are kept unless
they clash with the computed names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn

FRAME = 64  # 8 x 8 samples of 8 bits
FRAME_RATE = 25
GROUP = 25  # frames from one key frame to the next
#: Boxes that hold boxes (fixed values of ISO/IEC 14496-12).
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
#: Boxes inside boxes; the standard's own nest seven deep.
MOST_DEPTH = 32
IDENTITY = (0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


class MediaError(ValueError):
    """The bytes are not a whole ISO media file."""


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(payload: bytes) -> bytes:
    """payload with zero bytes up to a positive multiple of FRAME."""
    return payload + bytes(-len(payload) % FRAME or (0 if payload else FRAME))


def write_raw_track(payload: bytes) -> bytes:
    """An ISO media file whose one video track is payload, a positive multiple of FRAME bytes, as raw 8-bit grey frames."""
    n = len(payload) // FRAME
    frames_at = struct.pack(">I", n)
    brand = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
    keys = range(1, n + 1, GROUP)
    entry = box(
        b"raw ",
        bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1),
    )

    def movie(offset: int) -> bytes:
        stbl = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">III", 1, n, 1)),
            full_box(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full_box(b"stsc", struct.pack(">IIII", 1, 1, n, 1)),
            full_box(b"stsz", struct.pack(">I", FRAME), frames_at),
            full_box(b"co64", struct.pack(">IQ", 1, offset)),
        )
        url = full_box(b"url ", flags=1)
        minf = box(b"minf", full_box(b"vmhd", bytes(8), flags=1), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), url)), stbl)
        mdia = box(
            b"mdia",
            full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, FRAME_RATE, n, 0x55C4, 0)),
            full_box(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"),
            minf,
        )
        tkhd = full_box(b"tkhd", struct.pack(">IIIIIQhhhH9III", 0, 0, 1, 0, n, 0, 0, 0, 0, 0, *IDENTITY, 8 << 16, 8 << 16), flags=7)
        mvhd = full_box(b"mvhd", struct.pack(">IIIIIH10x9I24xI", 0, 0, FRAME_RATE, n, 0x10000, 0x100, *IDENTITY, 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    large = len(payload) + 8 >= 1 << 32
    head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if large else struct.pack(">I4s", len(payload) + 8, b"mdat")
    moov = movie(len(brand) + len(movie(0)) + len(head))
    return brand + moov + head + payload


def walk(data: memoryview) -> Iterator[tuple[tuple, int, int]]:
    """(path, body start, body end) of every box, nested ones after the box that holds them."""
    frames = [[0, len(data), ()]]
    while frames:
        start, end, path = frames[-1]
        if start >= end:
            frames.pop()
            continue
        if end - start < 8:
            raise MediaError("a box header is cut short")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise MediaError("a box header is cut short")
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise MediaError(f"box {kind!r} runs beyond its frame")
        frames[-1][0] = start + size
        yield (*path, kind), start + head, start + size
        if kind in CONTAINERS:
            if len(frames) > MOST_DEPTH:
                raise MediaError("boxes are nested too deep")
            frames.append([start + head, start + size, (*path, kind)])


def _table(data: memoryview, a: int, b: int, fields: int, kind: str = ">u4") -> np.ndarray:
    """The rows of a counted table box."""
    if b - a < 8:
        raise MediaError("a table is cut short")
    (n,) = struct.unpack_from(">I", data, a + 4)
    if n * fields * np.dtype(kind).itemsize > b - a - 8:
        raise MediaError("a table is cut short")
    return np.frombuffer(data, kind, n * fields, a + 8).astype(np.int64).reshape(n, fields)


def _sizes(data: memoryview, kind: bytes, a: int, b: int) -> np.ndarray:
    if b - a < 12:
        raise MediaError("a table is cut short")
    one, n = struct.unpack_from(">II", data, a + 4)
    if kind == b"stsz" and one:
        if n * one > len(data):
            raise MediaError("the samples are larger than the file")
        return np.full(n, one, np.int64)
    bits = 32 if kind == b"stsz" else one & 0xFF
    if bits not in (4, 8, 16, 32) or (n * bits + 7) // 8 > b - a - 12:
        raise MediaError("a table is cut short")
    if bits == 4:
        pairs = np.frombuffer(data, np.uint8, (n + 1) // 2, a + 12)
        return np.stack([pairs >> 4, pairs & 15], 1).reshape(-1)[:n].astype(np.int64)
    return np.frombuffer(data, f">u{bits // 8}", n, a + 12).astype(np.int64)


class Track:
    """What the boxes say of one track of a file of n_bytes; samples are placed on demand."""

    def __init__(self, n_bytes: int):
        self.n_bytes = n_bytes
        self.codec = self.handler = ""
        self.timescale = self.duration = 0
        self.tables: dict[bytes, np.ndarray] = {}

    def samples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offset, length and decode time of every sample. Memory goes with the number of sizes, whatever the other tables count."""
        sizes, chunks = self.tables.get(b"stsz", np.zeros(0, np.int64)), self.tables.get(b"stco", np.zeros((0, 1), np.int64))[:, 0]
        runs = self.tables.get(b"stsc", np.zeros((0, 3), np.int64))
        stts = self.tables.get(b"stts", np.zeros((0, 2), np.int64))
        n = len(sizes)
        if not n:
            return sizes, sizes, sizes
        if not len(chunks) or not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any():
            raise MediaError("samples without chunks")
        at, number = np.arange(n), np.arange(1, len(chunks) + 1)
        per_chunk = runs[np.searchsorted(runs[:, 0], number, "right") - 1, 1]
        chunk_ends, run_ends = np.cumsum(np.minimum(per_chunk, n)), np.cumsum(np.minimum(stts[:, 0], n))
        if chunk_ends[-1] < n or not len(stts) or run_ends[-1] < n:
            raise MediaError("the sample tables disagree")
        chunk = np.searchsorted(chunk_ends, at, "right")
        before = np.cumsum(sizes) - sizes
        offset = chunks[chunk] + before - before[(chunk_ends - np.minimum(per_chunk, n))[chunk]]
        if offset.min() < 0 or chunks.min() < 0 or (offset + sizes).max() > self.n_bytes:
            raise MediaError("a sample lies outside the file")
        run = np.searchsorted(run_ends, at, "right")
        spans = np.minimum(stts[:, 0], n) * stts[:, 1]
        time = (np.cumsum(spans) - spans)[run] + (at - (run_ends - np.minimum(stts[:, 0], n))[run]) * stts[run, 1]
        return offset, sizes, time

    def key_frames(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offset, length and decode time of every sync sample; without a table every sample is one."""
        offset, size, time = self.samples()
        if (sync := self.tables.get(b"stss")) is not None:
            at = sync[:, 0] - 1
            if len(at) and (at.min() < 0 or at.max() >= len(offset)):
                raise MediaError("a key frame is not a sample")
            offset, size, time = offset[at], size[at], time[at]
        return offset, size, time


def probe(data: bytes) -> list[Track]:
    """The tracks of an ISO media file, from its boxes alone."""
    view, tracks, known = memoryview(data), [], False
    for path, a, b in walk(view):
        kind = path[-1]
        known |= path in ((b"ftyp",), (b"moov",))
        if kind == b"moof":
            raise MediaError("sample runs of movie fragments are not read")
        if kind == b"trak":
            tracks.append(Track(len(data)))
        elif b"trak" not in path:
            continue
        elif kind == b"mdhd":
            wide = b > a and view[a] == 1
            if b - a < (32 if wide else 20):
                raise MediaError("a header is cut short")
            tracks[-1].timescale, tracks[-1].duration = struct.unpack_from(">IQ" if wide else ">II", view, a + (20 if wide else 12))
        elif kind == b"hdlr":
            if b - a < 12:
                raise MediaError("a header is cut short")
            tracks[-1].handler = bytes(view[a + 8 : a + 12]).decode("latin-1")
        elif kind == b"stsd":
            if b - a < 16:
                raise MediaError("a sample entry is cut short")
            tracks[-1].codec = bytes(view[a + 12 : a + 16]).decode("latin-1")
        elif kind in (b"stsz", b"stz2"):
            tracks[-1].tables[b"stsz"] = _sizes(view, kind, a, b)
        elif kind in (b"stco", b"co64"):
            tracks[-1].tables[b"stco"] = _table(view, a, b, 1, ">u4" if kind == b"stco" else ">u8")
        elif kind in (b"stts", b"stss", b"stsc"):
            tracks[-1].tables[kind] = _table(view, a, b, {b"stts": 2, b"stss": 1, b"stsc": 3}[kind])
    if not known:
        raise MediaError("no ISO media file")
    return tracks


RANGE = "offset long, length long, time double"
PROBE = f"tracks array<struct<handler:string, codec:string, timescale:long, duration:long, n_samples:long, key_frames:array<struct<{RANGE.replace(' ', ':').replace(',:', ', ')}>>>>"


def media_columns(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df with tracks (codec, duration, key-frame byte ranges) and error for a binary column of ISO media files."""
    rest = [c for c in df.columns if c not in ("tracks", "error")]
    spark_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema), PROBE, "error string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("time", pa.float64())])
        kind = pa.list_(pa.struct([("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("key_frames", pa.list_(key))]))
        for batch in batches:
            found, errors = [], []
            for x in batch.column(rest.index(media_col)):
                try:
                    data = x.as_py()
                    if data is None:
                        raise MediaError("no media")
                    found.append([
                        {
                            "handler": t.handler, "codec": t.codec, "timescale": t.timescale, "duration": t.duration, "n_samples": len(t.tables.get(b"stsz", ())),
                            "key_frames": [{"offset": o, "length": n, "time": at / (t.timescale or 1)} for o, n, at in zip(*(v.tolist() for v in t.key_frames()))],
                        }
                        for t in probe(data)
                    ])
                    errors.append(None)
                except MediaError as e:
                    found.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind), pa.array(errors, pa.string())], [*rest, "tracks", "error"])

    return df.select(*rest).mapInArrow(run, spark_schema)


def texts_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as UTF-8, padded with zero bytes to whole frames, in a media file of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in tn.pieces(batch.num_rows, tn.raw(batch.column(1))[1], 4 << 20):
                part = batch.slice(low, high - low)
                raw = [(t.as_py() or "").encode() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, raw), pa.int64()), pa.array([write_raw_track(pad(r)) for r in raw], pa.binary())], ["doc_id", "n_bytes", "media"]
                )
        tn.give_back()

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


DIGESTS = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}


def payload_digests(media: DataFrame, media_col: str = "media") -> DataFrame:
    """media without its file column, but with digests of the payload that the sample tables locate, of the file, and its features."""
    rest = [c for c in media.columns if c != media_col and c not in DIGESTS]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in media.select(*rest).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {c: [] for c in DIGESTS}
            for x in batch.column(0):
                data = x.as_py()
                (track,) = probe(data)
                view = memoryview(data)
                offset, size, _ = track.samples()
                # Samples that follow each other in the file are read as one stretch.
                cut = np.flatnonzero(offset[1:] != offset[:-1] + size[:-1]) + 1
                edges = [0, *cut.tolist(), len(offset)]
                whole = b"".join(view[int(offset[a]) : int(offset[b - 1] + size[b - 1])] for a, b in zip(edges[:-1], edges[1:]))
                key_at, key_len, _ = track.key_frames()
                ranges = np.stack([key_at, key_len], 1).astype("<i8").tobytes()
                rows["payload_bytes"].append(len(whole))
                rows["payload_sha256"].append(hashlib.sha256(whole).hexdigest())
                rows["tail_crc32"].append(zlib.crc32(whole[-FRAME:]))
                rows["media_bytes"].append(len(data))
                rows["media_sha256"].append(hashlib.sha256(data).hexdigest())
                rows["feature"].append(f"{track.handler}/{track.codec.strip()} {track.duration}/{track.timescale}s keys={len(key_at)} ranges={zlib.crc32(ranges):08x}")
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(rows[c], kind) for c, kind in DIGESTS.items())], [*rest, *DIGESTS])
        tn.give_back()

    kinds = ", ".join(f"{c} {'long' if pa.types.is_integer(k) else 'string'}" for c, k in DIGESTS.items())
    return media.select(media_col, *rest).mapInArrow(run, ", ".join([*fields, kinds]))
