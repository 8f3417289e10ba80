"""Adaptive Rice codes: vectors written bit by bit, round trips, and messages that hold them."""

import struct

import numpy as np
import pytest

from galeframe.sources import grib2, rice


def packed(*bits):
    return int("".join(bits).replace(" ", "").ljust(-(-sum(len(b.replace(" ", "")) for b in bits) // 8) * 8, "0"), 2).to_bytes(-(-sum(len(b.replace(" ", "")) for b in bits) // 8), "big")


EIGHT = rice.Coding(8, 8, 1)
#: id of three bits, the reference, then seven differences, of which even ones go up; in the last, 255 at 249 is 6 of room and 249 down.
VECTORS = {
    "unary": (packed("001", "00001010", "001 01 1 00001 0001 1 1"), [10, 11, 10, 10, 12, 10, 10, 10]),
    "split after one bit": (packed("010", "00001010", "01 1 1 001 1 1 1", "0 1 0 1 0 0 1"), [10, 11, 10, 10, 7, 7, 7, 6]),
    "pairs": (packed("000 1", "00000101", "001 01 1 0001"), [5, 4, 3, 3, 3, 3, 4, 4]),
    "zeros": (packed("000 0", "00001010", "1"), [10] * 8),
    "as they are": (packed("111", "11111111", *["00000001"] * 6, "11111111"), [255, 254, 253, 252, 251, 250, 249, 0]),
}


@pytest.mark.parametrize("name", VECTORS)
def test_vectors(name):
    data, want = VECTORS[name]
    assert rice.decode(data, 8, EIGHT).tolist() == want


def test_runs_of_zero_blocks():
    coding = rice.Coding(8, 8, 128)
    head, rest = "000 0 00000111", "001 01 1 1 1 1 1 1 1"
    assert rice.decode(packed(head, "0001", rest), 40, coding).tolist() == [7] * 32 + [6] * 8  # four blocks, then one that falls once
    assert rice.decode(packed(head, "00001", rest), 65 * 8, coding).tolist() == [7] * 64 * 8 + [6] * 8  # the rest of a segment of 64
    assert rice.decode(packed(head, "000001", rest), 48, coding).tolist() == [7] * 40 + [6] * 8  # five blocks
    short = rice.Coding(8, 8, 3)
    assert rice.decode(packed(head, "00001", "000 0 00001001 1"), 32, short).tolist() == [7] * 24 + [9] * 8  # the rest of an interval


def test_without_prediction_and_with_signs():
    assert rice.decode(packed("111", *["00000011"] * 7, "11111110"), 8, rice.Coding(8, 8, 1, 0)).tolist() == [3] * 7 + [254]
    assert rice.decode(packed("111", *["00000011"] * 7, "11111110"), 8, rice.Coding(8, 8, 1, rice.SIGNED)).tolist() == [3] * 7 + [-2]
    assert rice.decode(packed("001", "11111110", "01 01 1 1 1 1 1"), 8, rice.Coding(8, 8, 1, rice.SIGNED | rice.PREDICTED)).tolist() == [-2, -3, *[-4] * 6]


@pytest.mark.parametrize("flags", [0, 1, 8, 9, 24, 40])
def test_round_trips(flags):
    rng = np.random.default_rng(flags)
    for bits in (1, 2, 4, 8, 9, 16, 17, 24):
        for block, interval in ((8, 1), (16, 128), (64, 2)):
            coding = rice.Coding(bits, block, interval, flags)
            low, high = coding.range
            n = int(rng.integers(0, 4000))
            for x in (rng.integers(low, high + 1, n), np.clip(np.cumsum(rng.integers(-2, 3, n)) + (low + high) // 2, low, high), np.full(n, high), np.where(rng.random(n) < 0.003, low, high)):
                assert (rice.decode(rice.encode(x, coding), n, coding) == x).all()


def test_cut_off_samples_are_an_error():
    data = rice.encode(np.arange(200), EIGHT)
    with pytest.raises(ValueError):
        rice.decode(data[:20], 200, EIGHT)
    assert rice.decode(b"", 0, EIGHT).tolist() == []


def hand_message(s5, s7, values_shape=(2, 4), s6=b"\xff"):
    """A message built section by section: a grid of two rows, step 12, template 42."""
    section = lambda k, body: struct.pack(">IB", len(body) + 5, k) + body
    nj, ni = values_shape
    s1 = struct.pack(">HHBBBHBBBBBBB", 98, 0, 2, 1, 1, 2026, 6, 1, 12, 0, 0, 0, 1)
    s3 = struct.pack(">BIBBH", 0, ni * nj, 0, 0, 0) + bytes(16) + struct.pack(">IIII", ni, nj, 0, 0) + struct.pack(">II", 10_000_000, 0) + b"\0" + struct.pack(">IIII", 9_000_000, 3_000_000, 0, 0) + b"\0"
    s4 = struct.pack(">HHBB", 0, 0, 2, 2) + bytes(6) + b"\1" + struct.pack(">I", 12) + bytes(12)
    body = section(1, s1) + section(3, s3) + section(4, s4) + section(5, s5) + section(6, s6) + section(7, s7) + b"7777"
    return b"GRIB" + bytes([0, 0, 0, 2]) + struct.pack(">Q", len(body) + 16) + body


def test_a_message_built_by_hand(spark):
    s5 = struct.pack(">IHfhhBB", 8, 42, 5.0, 1, 1, 8, 0) + struct.pack(">BBH", 8, 8, 1)
    good = hand_message(s5, VECTORS["unary"][0])
    cut = hand_message(s5, VECTORS["unary"][0][:2])
    flat = hand_message(struct.pack(">IHfhhBB", 8, 42, 273.5, 0, 1, 0, 0) + struct.pack(">BBH", 8, 8, 1), b"")
    holes = hand_message(struct.pack(">IHfhhBB", 8, 42, 5.0, 1, 1, 8, 0) + struct.pack(">BBH", 8, 8, 1), VECTORS["unary"][0], (3, 3), b"\0" + bytes([0b11110111, 0b10000000]))
    files = spark.createDataFrame([(1, bytearray(good + b"junk" + cut + flat)), (2, bytearray(holes)), (3, None)], "id int, content binary")
    got = {(r["id"], r["message"]): r for r in grib2.decode(files, "id", "content").collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0)}  # the one that is cut off is skipped
    want = [(5.0 + 2 * x) / 10 for x in VECTORS["unary"][1]]
    assert np.allclose(got[1, 0]["values"], want) and (got[1, 0]["ni"], got[1, 0]["nj"], got[1, 0]["step"]) == (4, 2, 12)
    assert got[1, 1]["values"] == [273.5] * 8
    assert np.isnan(got[2, 0]["values"][4]) and np.allclose([x for k, x in enumerate(got[2, 0]["values"]) if k != 4], want)
