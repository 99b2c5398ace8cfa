"""Two-word shingle sets of whole texts as hashes, and HyperMinHash registers of them."""

from __future__ import annotations

import numpy as np
import xxhash

BANDS, ROWS = 42, 6
REGISTERS = BANDS * ROWS
MANTISSA_BITS = 10
#: Words whose hash a worker remembers; the memory is emptied when it is full.
REMEMBERED = 300_000

_BUCKET_BITS, _VALUE_BITS = 8, 56
_STARTS = np.arange(1 << _BUCKET_BITS, dtype=np.uint64) << np.uint64(_VALUE_BITS)
_VALUE = np.uint64((1 << _VALUE_BITS) - 1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _WordHashes()


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _turns() -> np.ndarray:
    """By bucket and register, ``turn << 8 | bucket``: a register asks its own bucket first, then all in random order."""
    order = _mix(np.arange(REGISTERS << _BUCKET_BITS, dtype=np.uint64) + np.uint64(1)).reshape(REGISTERS, -1)
    order[np.arange(REGISTERS), np.arange(REGISTERS)] = 0
    turns = order.argsort(1).argsort(1).astype(np.uint16).T
    return np.ascontiguousarray(turns << np.uint16(_BUCKET_BITS) | np.arange(len(turns), dtype=np.uint16)[:, None])


_TURNS = _turns()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's two-word shingles.

    Words are runs of characters other than ASCII white space, A-Z lower-cased, which is how ``bytes`` sees them. A
    single word counts as one shingle; without words the set is empty.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    if len(h) == 1:
        return _mix(h + np.uint64(1))
    return np.unique(_mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + (h[1:] ^ (h[1:] >> np.uint64(29)))))


def registers(shingles: np.ndarray) -> bytes:
    """HyperMinHash registers of a non-empty sorted set, in the order of bands.

    The leading byte of a hash names its bucket. A register holds, of its bucket's least value, the number of leading
    zeros and the mantissa bits after the first one. An empty bucket takes the register of that filled one which comes
    first in an order of its own, so that registers of short texts are drawn independently of each other.
    """
    first = np.searchsorted(shingles, _STARTS)
    filled = np.flatnonzero(np.diff(np.append(first, len(shingles))) > 0)
    value = (shingles[first[filled]] & _VALUE).astype(np.float64)
    mantissa, exponent = np.frexp(value)
    zeros = (_VALUE_BITS - exponent).astype(np.uint16)
    kept = np.maximum((mantissa * 2 - 1) * (1 << MANTISSA_BITS), 0).astype(np.uint16)
    packed = (zeros << np.uint16(MANTISSA_BITS)) | kept
    of_bucket = np.zeros(1 << _BUCKET_BITS, np.uint16)
    of_bucket[filled] = packed
    asked = _TURNS[filled].min(0) & np.uint16((1 << _BUCKET_BITS) - 1)
    return of_bucket[asked].reshape(ROWS, BANDS).T.tobytes()


def parity(shingles: np.ndarray) -> np.ndarray:
    """Bits, in signed 64-bit numbers, that every shingle flips one of: two bits a shingle at least, and 1,024.

    Two sets' bits differ in no more places than the sets do. The width is a power of two; folded in half by exclusive
    or, bits are those of half the width.
    """
    width = max(1_024, 1 << (2 * len(shingles) - 1).bit_length()) if len(shingles) else 1_024
    place = (shingles & np.uint64(width - 1)).astype(np.int64)
    odd = (np.bincount(place, minlength=width) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def folded(bits: np.ndarray, size: int = 16) -> np.ndarray:
    """Bits folded to ``size`` numbers."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def estimate(a: bytes, b: bytes) -> float:
    """Jaccard estimate of two register strings, less the matches that short registers give by chance."""
    equal = np.count_nonzero(np.frombuffer(a, np.uint16) == np.frombuffer(b, np.uint16)) / REGISTERS
    chance = 1 / 3 / (1 << MANTISSA_BITS)
    return (equal - chance) / (1 - chance)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int(np.count_nonzero(large[at] == small)) if len(large) else 0
