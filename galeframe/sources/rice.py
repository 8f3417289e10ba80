"""Adaptive Rice coding of integer samples, by the open standard CCSDS 121.0-B, as array kernels.

Samples come in blocks; ``interval`` blocks share one reference sample, from
which each sample is predicted by the one before. A block names its option:
zero blocks (a run of them), second extension (pairs), samples split after k
bits, or samples as they are. Ones that end unary codes are found for the
whole message at once, so that a block is a few slices and not a loop by bit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Bits of the flags; the run that stands for the rest of a segment, and blocks in a segment.
SIGNED, PREDICTED, RESTRICTED, PADDED = 1, 8, 16, 32
REST, SEGMENT = 5, 64


@dataclass(frozen=True)
class Coding:
    bits: int
    block: int = 16
    interval: int = 128
    flags: int = PREDICTED

    @property
    def id_bits(self) -> int:
        if self.flags & RESTRICTED and self.bits <= 4:
            return 1 if self.bits <= 2 else 2
        return 3 if self.bits <= 8 else 4 if self.bits <= 16 else 5

    @property
    def range(self) -> tuple[int, int]:
        half = 1 << (self.bits - 1)
        return (-half, half - 1) if self.flags & SIGNED else (0, (1 << self.bits) - 1)


def _wide(bits: np.ndarray, n: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.int64)
    return bits.reshape(n, width).astype(np.int64) @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.ones, self.at = np.flatnonzero(self.bits), 0

    def fixed(self, n: int, width: int) -> np.ndarray:
        part = self.bits[self.at : self.at + n * width]
        if len(part) < n * width:
            raise ValueError("samples are cut off")
        self.at += n * width
        return _wide(part, n, width)

    def unary(self, n: int) -> np.ndarray:
        """Numbers of zeros before each of the next n ones."""
        if not n:
            return np.zeros(0, np.int64)
        first = np.searchsorted(self.ones, self.at)
        ends = self.ones[first : first + n]
        if len(ends) < n:
            raise ValueError("samples are cut off")
        out = np.diff(ends, prepend=self.at - 1) - 1
        self.at = int(ends[-1]) + 1
        return out

    def align(self) -> None:
        self.at = -(-self.at // 8) * 8


def _pairs(codes: np.ndarray) -> np.ndarray:
    """Second extension: a code is the place of (a, b) in the order of a + b, then b."""
    total = ((np.sqrt(8.0 * codes + 1.0) - 1.0) / 2.0).astype(np.int64)
    total += (total + 1) * (total + 2) // 2 <= codes
    b = codes - total * (total + 1) // 2
    return np.stack([total - b, b], 1).ravel()


def _predicted(first: int, steps: np.ndarray, low: int, high: int) -> np.ndarray:
    """Samples after ``first`` from mapped differences: even ones go up and odd ones down, while the range allows it; beyond, all go away from the nearer end."""
    up = np.where(steps % 2 == 0, steps // 2, -(steps + 1) // 2)
    out, at, last = np.empty(len(steps), np.int64), 0, int(first)
    while at < len(steps):
        x = last + np.cumsum(up[at:])
        before = np.concatenate([[last], x[:-1]])
        room = np.minimum(before - low, high - before)
        odd = (steps[at:] + 1) // 2 > room
        n = int(np.argmax(odd)) if odd.any() else len(x)
        out[at : at + n] = x[:n]
        at += n
        if at < len(steps):
            last = int(before[n])
            away = int(steps[at]) - int(room[n])
            last += away if last - low <= high - last else -away
            out[at] = last
            at += 1
            if room[n] < 0:
                raise ValueError("samples leave their range")
        # else: all are placed
    return out


def decode(data: bytes, count: int, coding: Coding) -> np.ndarray:
    """The first ``count`` samples of ``data``; ValueError where it ends before them."""
    r, size, predicted = _Reader(data), coding.block, bool(coding.flags & PREDICTED)
    low, high = coding.range
    plain = (1 << coding.id_bits) - 1
    out, done = [], 0
    while done < count:
        parts, b = [], 0
        reference = None
        while b < coding.interval and done + b * size < count:
            head = predicted and b == 0
            n = size - head
            option = int(r.fixed(1, coding.id_bits)[0])
            kind = int(r.fixed(1, 1)[0]) if option == 0 else None
            if head and option != plain:
                reference = int(r.fixed(1, coding.bits)[0])
            blocks = 1
            if option == plain:
                part = r.fixed(size, coding.bits)
                if head:
                    reference, part = int(part[0]), part[1:]
            elif kind is None:
                part = r.unary(n) << (option - 1)
                part = part + r.fixed(n, option - 1)
            elif kind:
                part = _pairs(r.unary(size // 2))[head:]
            else:
                run = int(r.unary(1)[0]) + 1
                blocks = min(coding.interval - b, SEGMENT - b % SEGMENT) if run == REST else run - (run > REST)
                part = np.zeros(blocks * size - head, np.int64)
            parts.append(part)
            b += blocks
        steps = np.concatenate(parts)
        if predicted:
            reference -= (reference > high) << coding.bits
            steps = np.concatenate([[reference], _predicted(reference, steps, low, high)])
        elif coding.flags & SIGNED:
            steps = steps - ((steps > high).astype(np.int64) << coding.bits)
        out.append(steps)
        done += b * size
        if coding.flags & PADDED:
            r.align()
    return np.concatenate(out)[:count] if out else np.zeros(0, np.int64)


def _bits(x, width: int) -> np.ndarray:
    return ((np.atleast_1d(np.asarray(x, np.int64))[:, None] >> np.arange(width - 1, -1, -1)) & 1).astype(np.uint8).ravel()


def _unary(x: np.ndarray) -> np.ndarray:
    out = np.zeros(int(x.sum()) + len(x), np.uint8)
    out[np.cumsum(x + 1) - 1] = 1
    return out


def mapped(x: np.ndarray, low: int, high: int) -> np.ndarray:
    """Differences to the sample before as numbers from 0."""
    step, before = np.diff(x), x[:-1]
    room = np.minimum(before - low, high - before)
    return np.where(np.abs(step) <= room, np.where(step >= 0, 2 * step, -2 * step - 1), room + np.abs(step))


def _block(v: np.ndarray, raw: np.ndarray, head: np.ndarray, coding: Coding) -> np.ndarray:
    """One block that isn't all zero, by its shortest option."""
    plain = (1 << coding.id_bits) - 1
    sizes = {k: int((v >> k).sum()) + len(v) * (1 + k) + len(head) for k in range(min(plain - 1, coding.bits))}
    whole = np.concatenate([[0], v]) if len(head) else v
    total = whole[::2] + whole[1::2]
    pairs = total * (total + 1) // 2 + whole[1::2]
    extended = 1 + int(pairs.sum()) + len(pairs) + len(head)
    k = min(sizes, key=sizes.get, default=None)
    best = min([x for x in (sizes.get(k), extended, len(raw) * coding.bits) if x is not None])
    if best == len(raw) * coding.bits:
        return np.concatenate([_bits(plain, coding.id_bits), _bits(raw, coding.bits)])
    if k is not None and best == sizes[k]:
        return np.concatenate([_bits(k + 1, coding.id_bits), head, _unary(v >> k), _bits(v, k) if k else head[:0]])
    return np.concatenate([_bits(0, coding.id_bits), _bits(1, 1), head, _unary(pairs)])


def encode(samples: np.ndarray, coding: Coding) -> bytes:
    """Bytes that ``decode`` reads; the last block is filled with its last sample."""
    x, size = np.asarray(samples, np.int64), coding.block
    if not len(x):
        return b""
    x = np.concatenate([x, np.full(-len(x) % size, x[-1])])
    low, high = coding.range
    out = []
    for at in range(0, len(x), size * coding.interval):
        own = x[at : at + size * coding.interval]
        v = np.concatenate([[0], mapped(own, low, high)]) if coding.flags & PREDICTED else own & ((1 << coding.bits) - 1)
        rows, raw = v.reshape(-1, size), (own if coding.flags & PREDICTED else v).reshape(-1, size)
        raw = np.concatenate([raw.ravel()[:1], v[1:]]).reshape(-1, size) if coding.flags & PREDICTED else raw
        empty, b = ~rows.any(1), 0
        while b < len(rows):
            head = _bits(own[0], coding.bits) if coding.flags & PREDICTED and b == 0 else np.zeros(0, np.uint8)
            if empty[b]:
                end = min(coding.interval, b - b % SEGMENT + SEGMENT)
                run = int(np.argmin(np.append(empty[b:end], False)))
                code = REST - 1 if run >= REST and b + run == end else run - (run < REST)
                out.append(np.concatenate([_bits(0, coding.id_bits + 1), head, _unary(np.array([code]))]))
                b += run
            else:
                out.append(_block(rows[b][len(head) > 0 :], raw[b], head, coding))
                b += 1
        if coding.flags & PADDED:
            out.append(np.zeros(-sum(map(len, out)) % 8, np.uint8))
    return np.packbits(np.concatenate(out)).tobytes()
