"""Messages of gridded binary forecasts (edition 2) as rows: read from binary files, and written for archives and tests."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.sources import rice

SCHEMA = (
    "message int, reference timestamp_ntz, step int, category int, number int, member int, ni int, nj int, lat1 double, lon1 double, lat2 double, lon2 double, values array<float>"
)
UNSTRUCTURED = (100, 101)


def signed(x: int, bits: int) -> int:
    """Sign and magnitude."""
    return -(x & ((1 << (bits - 1)) - 1)) if x >> (bits - 1) else x


class Bits:
    """Big-endian fields of any width, read as arrays."""

    def __init__(self, data: bytes) -> None:
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def take(self, n: int, width: int) -> np.ndarray:
        if not width or not n:
            return np.zeros(n, np.int64)
        part = self.bits[self.at : self.at + n * width]
        self.at += n * width
        part = np.pad(part, (0, n * width - len(part))).reshape(n, width).astype(np.int64)
        return part @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))

    def align(self) -> None:
        self.at = -(-self.at // 8) * 8


def _scaled(x: np.ndarray, ref: float, binary: int, decimal: int) -> np.ndarray:
    return (ref + x * 2.0**binary) / 10.0**decimal


def _complex(data: bytes, s5: bytes, n: int, order: int) -> np.ndarray:
    """Group references, widths and lengths, then the groups; with ``order``, sums of differences."""
    groups, width0, width_bits = struct.unpack_from(">IBB", s5, 31)
    length0, step, last, length_bits = struct.unpack_from(">IBIB", s5, 37)
    extra, start, low = (s5[48] if order else 0), [], 0
    if order:
        read = lambda k: signed(int.from_bytes(data[k * extra : (k + 1) * extra], "big"), 8 * extra)
        start, low = [read(k) for k in range(order)], read(order)
        data = data[(order + 1) * extra :]
    b = Bits(data)
    refs = b.take(groups, s5[19])
    b.align()
    widths = b.take(groups, width_bits) + width0
    b.align()
    lengths = b.take(groups, length_bits) * step + length0
    b.align()
    if groups:
        lengths[-1] = last
    x = np.concatenate([r + b.take(int(k), int(w)) for r, w, k in zip(refs, widths, lengths, strict=True)] or [np.zeros(0, np.int64)])[:n]
    if order:
        x = x + low
        x[:order] = start[: len(x)]
        if order == 2 and len(x) > 2:
            first = np.concatenate([[x[1] - x[0]], x[2:]]).cumsum()
            x = np.concatenate([[x[0]], x[0] + first.cumsum()])
        elif order == 1:
            x = x.cumsum()
    return x


def field(s5: bytes, s6: bytes, s7: bytes, points: int) -> np.ndarray:
    """Values of all grid points, NaN where the bitmap has none."""
    n, template = struct.unpack_from(">IH", s5, 5)
    ref, binary, decimal, bits = struct.unpack_from(">fhhB", s5, 11)
    if template == 4:
        got = np.frombuffer(s7[: len(s7) // 4 * 4], ">f4").astype(np.float64)
    elif template == 0:
        got = _scaled(Bits(s7).take(n, bits), ref, binary, decimal) if bits else np.full(n, ref / 10.0**decimal)
    elif template in (2, 3):
        got = _scaled(_complex(s7, s5, n, s5[47] if template == 3 else 0), ref, binary, decimal)
    elif template == 42:
        interval = struct.unpack_from(">H", s5, 23)[0]
        coding = rice.Coding(bits, s5[22] or 16, interval or 128, s5[21])
        got = _scaled(rice.decode(s7, n, coding), ref, binary, decimal) if bits else np.full(n, ref)  # without bits, the reference value as it stands
    else:
        raise ValueError(f"packing {template} is not read")
    got = np.concatenate([got, np.zeros(max(0, n - len(got)))])[:n]
    if s6[5] == 255:
        return got.astype(np.float32)
    out = np.full(points, np.nan, np.float32)
    there = np.unpackbits(np.frombuffer(s6[6:], np.uint8))[:points].astype(bool)
    out[there] = got[: there.sum()]
    return out


def message(data: bytes, at: int) -> tuple[dict, int]:
    """(one message's fields, its end); ValueError where it isn't one that is read."""
    if data[at + 7] != 2:
        raise ValueError("edition 2 is read")
    end = at + int.from_bytes(data[at + 8 : at + 16], "big")
    if data[end - 4 : end] != b"7777":
        raise ValueError("no end mark")
    parts, k = {}, at + 16
    while k < end - 4:
        size = int.from_bytes(data[k : k + 4], "big")
        if size < 5 or k + size > end:
            raise ValueError("bad section")
        parts[data[k + 4]] = data[k : k + size]
        k += size
    s3, s4 = parts[3], parts[4]
    template = struct.unpack_from(">H", s3, 12)[0]
    points = struct.unpack_from(">I", s3, 6)[0]
    ni, nj, lat1, lon1, lat2, lon2 = points, 1, 0.0, 0.0, 0.0, 0.0
    if template in (0, 40):
        ni, nj = struct.unpack_from(">II", s3, 30)
        lat1, lon1, lat2, lon2 = (signed(struct.unpack_from(">I", s3, o)[0], 32) / 1e6 for o in (46, 50, 55, 59))
    elif template not in UNSTRUCTURED:
        raise ValueError(f"grid {template} is not read")
    product = struct.unpack_from(">H", s4, 7)[0]
    return {
        "reference": datetime(*struct.unpack_from(">HBBBBB", parts[1], 12)), "step": struct.unpack_from(">I", s4, 18)[0], "category": s4[9], "number": s4[10], "member": s4[35] if product in (1, 11) else 0,
        "ni": ni, "nj": nj, "lat1": lat1, "lon1": lon1, "lat2": lat2, "lon2": lon2, "values": field(parts[5], parts[6], parts[7][5:], points),
    }, end


def messages(data: bytes) -> Iterator[dict]:
    """All messages that can be read, one after another; junk and bad messages are skipped."""
    at, n = data.find(b"GRIB"), 0
    while at >= 0:
        try:
            got, end = message(data, at)
            yield got | {"message": n}
            n += 1
        except (ValueError, KeyError, IndexError, struct.error):
            end = at + 4
        at = data.find(b"GRIB", end)


def decode(files: DataFrame, key: str, content: str) -> DataFrame:
    """A row for each message of each file. A file is a slice of an archive (megabytes), which a task holds one at a time."""
    names = [f.split(" ", 1) for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(1).to_pylist()):
                found = list(messages(data or b""))
                if found:
                    own = batch.column(0).take(pa.array([i] * len(found)))
                    kinds = {"reference": pa.timestamp("us"), "values": pa.list_(pa.float32()), "lat1": pa.float64(), "lon1": pa.float64(), "lat2": pa.float64(), "lon2": pa.float64()}
                    cols = [pa.array([m[c] for m in found], kinds.get(c, pa.int32())) for c, _ in names]
                    yield pa.RecordBatch.from_arrays([own, *cols], ["_key", *[c for c, _ in names]])

    kind = files.schema[key].dataType.simpleString()
    schema = f"_key {kind}, " + ", ".join(f"`{c}` {t}" for c, t in names)
    return files.select(F.col(key).alias("_key"), F.col(content).alias("_content")).mapInArrow(run, schema).withColumnRenamed("_key", key)


def read_files(spark, path: str) -> DataFrame:
    """Messages of the files below a path, by path."""
    return decode(spark.read.format("binaryFile").load(path).select("path", "content"), "path", "content")


def cells(decoded: DataFrame) -> DataFrame:
    """Long form: a row for each grid point, (i, j) from the row-major place; latitudes and longitudes evenly between the corners."""
    d = decoded.select(*[c for c in decoded.columns if c != "values"], F.posexplode("values").alias("pos", "value"))
    d = d.withColumns({"i": F.floor(F.col("pos") / F.col("ni")).cast("int"), "j": (F.col("pos") % F.col("ni")).cast("int")})
    at = lambda a, b, k, n: F.col(a) + (F.col(b) - F.col(a)) * F.col(k) / F.greatest(F.col(n) - 1, F.lit(1))
    return d.withColumns({"lat": at("lat1", "lat2", "i", "nj"), "lon": at("lon1", "lon2", "j", "ni")}).drop("pos")


def _pack(x: np.ndarray, width: int) -> bytes:
    return np.packbits(((x.astype(np.int64)[:, None] >> np.arange(width - 1, -1, -1)) & 1).astype(np.uint8)).tobytes() if width else b""


def _section(number: int, body: bytes) -> bytes:
    return struct.pack(">IB", len(body) + 5, number) + body


def encode(values: np.ndarray, ni: int, packing: int = 0, decimal: int = 1, step: int = 0, member: int = 0, reference: datetime = datetime(2026, 6, 1), corners=(10.0, 0.0, 0.0, 10.0), group: int = 16) -> bytes:
    """One message on a regular grid; packing 0 simple, 2 by groups, 3 by groups of first differences, 4 as floats, 42 by adaptive Rice codes. NaN goes into a bitmap."""
    there = ~np.isnan(values)
    v = values[there]
    x = np.round(v * 10.0**decimal).astype(np.int64)
    low = int(x.min()) if len(x) else 0
    x = x - low
    ref, extra, body = float(low), b"", v.astype(">f4").tobytes()
    if packing == 0:
        bits = int(x.max()).bit_length() if len(x) else 0
        body = _pack(x, bits)
    elif packing in (2, 3):
        head = b""
        if packing == 3:
            d = np.diff(x, prepend=x[:1])
            least = int(d[1:].min()) if len(d) > 1 else 0
            head = b"".join(struct.pack(">I", abs(k) | (1 << 31 if k < 0 else 0)) for k in (int(x[0]) if len(x) else 0, least))
            x = np.concatenate([d[:1] * 0, d[1:] - least])
        parts = [x[k : k + group] for k in range(0, len(x), group)]
        refs = np.array([p.min() for p in parts], np.int64)
        widths = np.array([int((p - p.min()).max()).bit_length() for p in parts], np.int64)
        bits = int(refs.max()).bit_length() if len(refs) else 0
        wide = int(widths.max()).bit_length() if len(widths) else 0
        body = head + _pack(refs, bits) + _pack(widths, wide)
        bitstring = "".join(format(int(e), f"0{w}b") for p, r, w in zip(parts, refs, widths, strict=True) if w for e in p - r)
        body += int(bitstring.ljust(-(-len(bitstring) // 8) * 8, "0") or "0", 2).to_bytes(-(-len(bitstring) // 8), "big")
        extra = struct.pack(">BBIIIBBIBIB", 1, 0, 0, 0, len(parts), 0, wide, group, 0, len(parts[-1]) if parts else 0, 0) + (bytes([1, 4]) if packing == 3 else b"")
    elif packing == 42:
        bits = max(1, int(x.max()).bit_length()) if len(x) else 0
        body = rice.encode(x, rice.Coding(bits)) if bits else b""
        extra = struct.pack(">BBH", rice.PREDICTED, 16, 128)
    else:
        bits = 32
    s1 = struct.pack(">HHBBBHBBBBBBB", 7, 0, 2, 1, 1, *reference.timetuple()[:6], 0, 1)
    micro = lambda a: (abs(round(a * 1e6))) | (1 << 31 if a < 0 else 0)
    nj = len(values) // ni
    s3 = struct.pack(">BIBBH", 0, len(values), 0, 0, 0) + bytes([6]) + bytes(15) + struct.pack(">IIII", ni, nj, 0, 0) + struct.pack(">II", micro(corners[0]), micro(corners[1])) + b"\0" + struct.pack(">IIII", micro(corners[2]), micro(corners[3]), 0, 0) + b"\0"
    s4 = struct.pack(">HHBB", 0, 1, 2, 2) + bytes(6) + b"\1" + struct.pack(">I", step) + bytes(12) + bytes([0, member, 31])
    s5 = struct.pack(">IHfhhBB", len(v), packing, ref, 0, decimal, bits, 0) + extra
    s6 = b"\xff" if there.all() else b"\0" + np.packbits(there).tobytes()
    whole = _section(1, s1) + _section(3, s3) + _section(4, s4) + _section(5, s5) + _section(6, s6) + _section(7, body) + b"7777"
    return b"GRIB" + bytes([0, 0, 0, 2]) + struct.pack(">Q", len(whole) + 16) + whole


def encode_rows(grids: DataFrame, key: str, values: str, ni: int, packing: str) -> DataFrame:
    """(key, content): a message for each row of values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [encode(np.array(v, float), ni, p) for v, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["_key", "content"])

    kind = grids.schema[key].dataType.simpleString()
    return grids.select(F.col(key).alias("_key"), F.col(values), F.col(packing)).mapInArrow(run, f"_key {kind}, content binary").withColumnRenamed("_key", key)


def canonical(decoded: DataFrame, variable: Column) -> DataFrame:
    """Messages as slices of a named variable: their time, member, lattice and the degrees between its neighbours."""
    step = lambda a, b, n: F.when(F.col(n) > 1, F.abs(F.col(b) - F.col(a)) / (F.col(n) - 1)).otherwise(0.0)
    return decoded.select(
        "id", variable.alias("variable"), (F.col("reference") + F.make_dt_interval(F.lit(0), F.col("step"))).alias("valid_time"), F.col("step").alias("step_hours"), F.col("member").cast("int").alias("member"), F.col("nj").alias("nlats"), F.col("ni").alias("nlons"),
        F.col("lat1").alias("lat_start"), F.col("lat2").alias("lat_end"), step("lat1", "lat2", "nj").alias("lat_step"), F.col("lon1").alias("lon_start"), F.col("lon2").alias("lon_end"), step("lon1", "lon2", "ni").alias("lon_step"), F.col("values").alias("data"),
    )
