"""Media columns: AVI motion-JPEG stored from bytes, its RIFF index parsed, intra frames decoded, shots detected, timed clip rows."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import by_bytes, column, text

WIDTH, ROWS, FPS = 64, 64, 25
CLIP = "struct<clip:int,first_frame:int,frames:int,start_ms:long,end_ms:long,mean_level:double>"

# Lossless JPEG (process 14: prediction, then Huffman codes). A difference of
# category s is coded by a prefix of 9 - s bits and s further bits, so that
# each sample takes 9 bits and whole frames decode as arrays. The codes are the
# canonical ones of a table with one symbol for each length from 1 to 9.
_SYMBOLS = bytes(range(8, -1, -1))
_CODE, _DIFF = np.zeros(511, np.uint16), np.zeros(512, np.int16)
for _d in range(-255, 256):
    _s = abs(_d).bit_length()
    _prefix = ((1 << (8 - _s)) - 1) << 1
    _CODE[_d + 255] = (_prefix << _s) | (_d if _d >= 0 else _d + (1 << _s) - 1)
    _DIFF[_CODE[_d + 255]] = _d
_SHIFTS = np.arange(8, -1, -1, dtype=np.uint16)
_TABLE = b"\xff\xc4" + struct.pack(">HB", 19 + len(_SYMBOLS), 0) + bytes([1] * 9 + [0] * 7) + _SYMBOLS


def encode_frame(x: np.ndarray) -> bytes:
    """A grey frame of 8-bit samples as lossless JPEG."""
    h, w = x.shape
    x = x.astype(np.int16)
    d = np.empty_like(x)
    d[:, 1:] = x[:, 1:] - x[:, :-1]
    d[1:, 0] = x[1:, 0] - x[:-1, 0]
    d[0, 0] = x[0, 0] - 128
    code = _CODE[d.ravel() + 255]
    bits = np.packbits(((code[:, None] >> _SHIFTS) & 1).astype(np.uint8))
    if (spare := (h * w * 9) % 8) != 0:
        bits[-1] |= (1 << (8 - spare)) - 1
    scan = bits.tobytes().replace(b"\xff", b"\xff\x00")
    head = struct.pack(">2sHBHHB3B", b"\xff\xc3", 11, 8, h, w, 1, 1, 0x11, 0)
    return b"\xff\xd8" + head + _TABLE + b"\xff\xda" + struct.pack(">HB2B3B", 8, 1, 1, 0, 1, 0, 0) + scan + b"\xff\xd9"


def _walk_bits(scan: bytes, n: int, table: dict[tuple[int, int], int]) -> np.ndarray:
    """Differences under any Huffman table, symbol by symbol."""
    value, at, out = int.from_bytes(scan, "big"), len(scan) * 8, np.empty(n, np.int32)
    for i in range(n):
        code = length = 0
        while (length, code) not in table or not length:
            at -= 1
            code, length = (code << 1) | ((value >> at) & 1), length + 1
            if length > 16 or at < 0:
                raise ValueError("bad Huffman code")
        s = table[(length, code)]
        at -= s if s < 16 else 0
        extra = (value >> at) & ((1 << s) - 1)
        out[i] = 32768 if s == 16 else extra if s and extra >> (s - 1) else extra - (1 << s) + 1
    return out


def decode_frame(data: bytes) -> np.ndarray:
    """The samples of a one-component lossless JPEG with left prediction; ValueError for any other kind of frame."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, h, w, tables, raw = 2, 0, 0, {}, {}
    while True:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if marker == 0xC3:
            depth, h, w, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or n != 1:
                raise ValueError("one component of 8 bits is read")
        elif marker in (0xC0, 0xC1, 0xC2, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB):
            raise ValueError("only lossless intra frames are read")
        elif marker == 0xC4:
            while body:
                counts, code, k, table = body[1:17], 0, 17, {}
                for length in range(1, 17):
                    for _ in range(counts[length - 1]):
                        table[(length, code)] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                tables[body[0]], raw[body[0]], body = table, body[1:k], body[k:]
        elif marker == 0xDA:
            place, predictor = body[2] >> 4, body[3]
            break
        at += 2 + size
    if predictor != 1:
        raise ValueError("left prediction is read")
    scan = data[at + 2 + size : data.rindex(b"\xff\xd9")].replace(b"\xff\x00", b"\xff")
    if raw[place] == _TABLE[5:]:
        bits = np.unpackbits(np.frombuffer(scan, np.uint8), count=h * w * 9).reshape(-1, 3, 3)
        parts = (bits * np.array([4, 2, 1], np.uint8)).sum(2, dtype=np.uint16)
        d = _DIFF[(parts[:, 0] << 6) | (parts[:, 1] << 3) | parts[:, 2]].astype(np.int32)
    else:
        d = _walk_bits(scan, h * w, tables[place])
    d = d.reshape(h, w)
    d[:, 0] = 128 + np.cumsum(d[:, 0])
    return (np.cumsum(d, axis=1) & 0xFF).astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    """An AVI 1.0 file with an index; the rows of the last frame beyond the payload are 0, its length is in the INFO list."""
    lines = len(payload) // WIDTH
    rows = -(-lines // -(-lines // ROWS))
    padded = payload + b"\0" * (-lines % rows * WIDTH)
    frames = [encode_frame(x) for x in np.frombuffer(padded, np.uint8).reshape(-1, rows, WIDTH)]
    movi, index = [b"movi"], []
    at = 4
    for f in frames:
        c = _chunk(b"00dc", f)
        movi.append(c)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(c)
    most = max(map(len, frames))
    avih = struct.pack("<10I16x", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, WIDTH, rows)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, WIDTH, rows)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, rows, 1, 8, b"MJPG", WIDTH * rows, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload %d\0" % len(payload)))
    body = b"AVI " + hdrl + info + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, size
        at += 8 + size + size % 2


def read_avi(data: bytes) -> tuple[list[np.ndarray], float, int]:
    """(intra frames by the index, seconds a frame, payload bytes or -1)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, seconds, length = 0, [], 1 / FPS, -1
    for name, at, size in _chunks(data, 12, 8 + struct.unpack_from("<I", data, 4)[0]):
        kind = data[at : at + 4]
        if name == b"LIST" and kind == b"movi":
            movi = at
        elif name == b"LIST":
            for inner, start, n in _chunks(data, at + 4, at + size):
                if inner == b"avih":
                    seconds = struct.unpack_from("<I", data, start)[0] / 1e6
                elif inner == b"ICMT" and data[start : start + 8] == b"payload ":
                    length = int(data[start + 8 : start + n].rstrip(b"\0"))
        elif name == b"idx1":
            index = [struct.unpack_from("<4sIII", data, k) for k in range(at, at + size, 16)]
    frames = []
    for name, flags, offset, size in index:
        if name[2:] in (b"dc", b"db") and flags & 0x10:
            if data[movi + offset : movi + offset + 4] != name:  # some writers count from the file's start
                offset -= movi
            frames.append(decode_frame(data[movi + offset + 8 : movi + offset + 8 + size]))
    return frames, seconds, length


def shots(frames: list[np.ndarray], bins: int = 16, window: int = 8, times: float = 3.0, least: float = 0.08) -> tuple[list[int], np.ndarray]:
    """First frames of shots, and the frames' histograms (shares).

    A frame starts a shot when half the L1 distance of its histogram from the
    one before is above ``least`` plus the mean and ``times`` standard
    deviations of the distances of the ``window`` frames before it.
    """
    hist = np.stack([np.bincount(f.ravel() // (256 // bins), minlength=bins) / f.size for f in frames])
    step = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    starts = [0]
    for i, d in enumerate(step.tolist()):
        near = step[max(0, i - window) : i]
        if d > least + (float(near.mean() + times * near.std()) if len(near) else 0.0):
            starts.append(i + 1)
    return starts, hist


def store_avi(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 4 << 20) -> DataFrame:
    """(id, n_bytes, media): the UTF-8 text and zeros up to a positive multiple of 64 bytes, as grey frames 64 samples wide.

    Null and empty texts give one frame of 64 zeros. Repeated rows give
    repeated results; an empty table gives an empty result; other columns are
    not read.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "_text", batch_bytes):
            media, size = [], []
            for t in batch.column(1).to_pylist():
                raw = t.encode()
                size.append(len(raw))
                media.append(write_avi(raw + b"\0" * (-len(raw) % 64 if raw else 64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(media, pa.binary())], ["_id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(column(id_col).alias("_id"), text(text_col).alias("_text"))
    return rows.mapInArrow(store, f"_id {kind}, n_bytes long, media binary").withColumnRenamed("_id", id_col)


def media_features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", batch_bytes: int = 4 << 20) -> DataFrame:
    """One row for each media value: digests of the file and of its decoded payload, a feature text, and its clips as an array.

    A null, or bytes that aren't an AVI file of lossless intra frames, gives a row of nulls with ``error`` set.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "_media", batch_bytes):
            rows = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    frames, seconds, length = read_avi(data or b"")
                    payload = b"".join(f.tobytes() for f in frames)[: length if length >= 0 else None]
                    starts, hist = shots(frames)
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    rows.append({"_id": key, "error": str(e)[:80]})
                    continue
                ms = [round(1000 * seconds * i) for i in [*starts, len(frames)]]
                levels = (np.arange(hist.shape[1]) + 0.5) * (256 / hist.shape[1])
                clips = [
                    {"clip": k, "first_frame": a, "frames": b - a, "start_ms": ms[k], "end_ms": ms[k + 1], "mean_level": float(round((hist[a:b].mean(0) * levels).sum(), 4))}
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(frames)], strict=True))
                ]
                rows.append({
                    "_id": key, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]),
                    "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "n_frames": len(frames), "clips": clips,
                    "feature": f"frames={len(frames)};shots={','.join(map(str, starts))};hist={','.join(f'{x:.4f}' for x in hist.mean(0))}",
                })
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    kind = media.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    out = pa.schema([
        ("_id", to_arrow_type(kind)), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("n_frames", pa.int32()), ("feature", pa.string()),
        ("clips", pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("frames", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("mean_level", pa.float64())]))), ("error", pa.string()),
    ])
    rows = media.select(column(id_col).alias("_id"), column(media_col).alias("_media"))
    schema = f"_id {kind.simpleString()}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames int, feature string, clips array<{CLIP}>, error string"
    return rows.mapInArrow(features, schema).withColumnRenamed("_id", id_col)


def clip_rows(features: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each clip with its times."""
    return features.select(id_col, F.explode("clips").alias("c")).select(id_col, "c.*")
