"""Counting quotient filters of packed n-grams, in numpy.

An n-gram of word numbers is a pair of whole numbers: ``left`` holds its first
words, ``right`` the others, ``width`` bits each. ``permute`` mixes the pair by
a Feistel network, which can be undone, so equal n-grams and no others have
equal mixed pairs. A filter is a sorted set of mixed pairs with counts. The top
bits of ``left``, its *quotient*, are not stored: a bitmap says which quotients
occur and a second one where the run of each ends. Of every entry the filter
keeps the full remainder, so it is lossless, and a counter of one byte, with
larger counts in a list behind.
"""

import struct
from dataclasses import dataclass

import numpy as np

_HEADER = struct.Struct("<QQB")
_ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
_LARGE = 255


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _mixed(values: np.ndarray, key: int) -> np.ndarray:
    """A fixed function of 64 bits; it need not be invertible itself."""
    x = (values + np.uint64(key)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class Layout:
    """How n-grams of ``words`` numbers of ``width`` bits (at most 32) are packed."""

    words: int
    width: int

    @property
    def left_bits(self) -> int:
        return self.width * ((self.words + 1) // 2)

    @property
    def right_bits(self) -> int:
        return self.width * (self.words // 2)

    def pack(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        half = (self.words + 1) // 2
        sides = []
        for some in (columns[:half], columns[half:]):
            side = some[0].astype(np.uint64)
            for column in some[1:]:
                side = (side << np.uint64(self.width)) | column.astype(np.uint64)
            sides.append(side)
        return sides[0], sides[1]

    def unpack(self, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
        columns = []
        for side, count in ((left, (self.words + 1) // 2), (right, self.words // 2)):
            for i in reversed(range(count)):
                columns.append((side >> np.uint64(i * self.width)) & _mask(self.width))
        return columns

    def permute(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for i, key in enumerate(_ROUNDS):
            if i % 2:
                right = right ^ (_mixed(left, key) & _mask(self.right_bits))
            else:
                left = left ^ (_mixed(right, key) & _mask(self.left_bits))
        return left, right

    def restore(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that ``permute`` made these of."""
        for i, key in reversed(list(enumerate(_ROUNDS))):
            if i % 2:
                right = right ^ (_mixed(left, key) & _mask(self.right_bits))
            else:
                left = left ^ (_mixed(right, key) & _mask(self.left_bits))
        return left, right


@dataclass
class Counts:
    """Mixed pairs in ascending order, each once, with how often they occur."""

    left: np.ndarray
    right: np.ndarray
    n: np.ndarray


def counted(layout: Layout, left: np.ndarray, right: np.ndarray, n: np.ndarray | None = None) -> Counts:
    """Equal pairs summed. Input made of sorted stretches is merged, not sorted anew."""
    if not len(left):
        return Counts(left, right, np.zeros(0, np.uint64))
    if layout.left_bits + layout.right_bits <= 64:
        keys = (left << np.uint64(layout.right_bits)) | right
        if n is None:
            keys = np.sort(keys)
        else:
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        first = keys[starts]
        left, right = first >> np.uint64(layout.right_bits), first & _mask(layout.right_bits)
        total = len(keys)
    else:
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        n = n if n is None else n[order]
        new = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        starts = np.flatnonzero(np.concatenate(([True], new)))
        total = len(left)
        left, right = left[starts], right[starts]
    if n is None:
        return Counts(left, right, np.diff(starts, append=total).astype(np.uint64))
    return Counts(left, right, np.add.reduceat(n, starts))


def encode(layout: Layout, some: Counts, top: int = 0) -> bytes:
    """The filter of counts whose ``left`` agree in their ``top`` highest bits."""
    entries = len(some.left)
    low = layout.left_bits - top
    quotient_bits = min(low, max(1, entries.bit_length()))
    rest = low - quotient_bits
    within = some.left & _mask(low)
    quotients = within >> np.uint64(rest)
    occupied = np.zeros(1 << quotient_bits, bool)
    occupied[quotients.astype(np.int64)] = True
    run_ends = np.append(quotients[1:] != quotients[:-1], True)
    counters = np.minimum(some.n, np.uint64(_LARGE)).astype(np.uint8)
    large = some.n[some.n >= _LARGE]
    return b"".join(
        [
            _HEADER.pack(entries, len(large), quotient_bits),
            np.packbits(occupied).tobytes(),
            np.packbits(run_ends).tobytes(),
            _planes(within & _mask(rest), rest),
            _planes(some.right, layout.right_bits),
            counters.tobytes(),
            large.astype("<u8").tobytes(),
        ]
    )


def decode(layout: Layout, data: bytes, top: int = 0, prefix: int = 0) -> Counts:
    """What ``encode`` was given; ``prefix`` are the ``top`` highest bits."""
    entries, large, quotient_bits = _HEADER.unpack_from(data)
    low = layout.left_bits - top
    rest = low - quotient_bits
    at = _HEADER.size

    def take(size: int) -> np.ndarray:
        nonlocal at
        part = np.frombuffer(data, np.uint8, size, at)
        at += size
        return part

    occupied = np.unpackbits(take(-(-(1 << quotient_bits) // 8)), count=1 << quotient_bits)
    ends = np.flatnonzero(np.unpackbits(take(-(-entries // 8)), count=entries))
    lengths = np.diff(ends, prepend=-1)
    quotients = np.repeat(np.flatnonzero(occupied).astype(np.uint64), lengths)
    remainders = _joined(take(_plane_size(entries, rest)), entries, rest)
    right = _joined(take(_plane_size(entries, layout.right_bits)), entries, layout.right_bits)
    n = take(entries).astype(np.uint64)
    n[n == _LARGE] = np.frombuffer(data, "<u8", large, at)
    left = (quotients << np.uint64(rest)) | remainders
    if top:
        left |= np.uint64(prefix << low)
    return Counts(left, right, n)


def merge(layout: Layout, filters: list[Counts]) -> Counts:
    """One filter's counts from those of several, all in the same order."""
    joined = [np.concatenate(column) for column in zip(*[(f.left, f.right, f.n) for f in filters])]
    return counted(layout, *joined)


def cut(layout: Layout, some: Counts, top: int) -> list[tuple[int, Counts]]:
    """The stretches of equal ``top`` highest bits, with these bits."""
    if not len(some.left):
        return []
    prefixes = some.left >> np.uint64(layout.left_bits - top) if top else np.zeros_like(some.left)
    starts = np.flatnonzero(np.concatenate(([True], prefixes[1:] != prefixes[:-1])))
    ends = np.append(starts[1:], len(prefixes))
    return [
        (int(prefixes[a]), Counts(some.left[a:b], some.right[a:b], some.n[a:b]))
        for a, b in zip(starts.tolist(), ends.tolist())
    ]


def _plane_size(entries: int, bits: int) -> int:
    return entries * (bits // 8) + bits % 8 * -(-entries // 8)


def _planes(values: np.ndarray, bits: int) -> bytes:
    """The lowest byte of all values, then the next; single bits where no byte is full."""
    spread = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    parts = [spread[:, : bits // 8].T.tobytes()]
    if bits % 8:
        over = spread[:, bits // 8]
        parts += [np.packbits((over >> bit) & 1).tobytes() for bit in range(bits % 8)]
    return b"".join(parts)


def _joined(data: np.ndarray, entries: int, bits: int) -> np.ndarray:
    spread = np.zeros((entries, 8), np.uint8)
    whole = bits // 8
    spread[:, :whole] = data[: whole * entries].reshape(whole, entries).T
    size = -(-entries // 8)
    for bit in range(bits % 8):
        at = whole * entries + bit * size
        spread[:, whole] |= np.unpackbits(data[at : at + size], count=entries) << bit
    return spread.reshape(-1).view("<u8").astype(np.uint64)
