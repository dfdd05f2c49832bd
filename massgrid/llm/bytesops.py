"""Vectorised byte-level building blocks shared by the text operators.

Everything here works on one Arrow batch: the UTF-8 bytes of many texts laid end to
end in a single uint8 array plus the offsets of the texts. Nulls are empty texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15
#: Inverse of _ODD modulo 2**64, so powers with negative exponents exist.
_ODD_INV = pow(_ODD, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche (a bijection on 64-bit integers)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def byte_table(seed: int) -> np.ndarray:
    """One pseudo-random 64-bit value per byte value."""
    return mix(np.arange(1, 257, dtype=U64) * U64(_ODD) + U64(seed))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept per worker, rounded up to a power of two."""
    size = 1 << max(12, int(n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        both = []
        for base in (_ODD, _ODD_INV):
            p = np.full(size, base, dtype=U64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


def forget_powers() -> None:
    """Free what powers() keeps; workers live on after a task."""
    _POWERS.clear()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; offsets start at 0, a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if large else np.int32, count=n + 1, offset=column.offset * (8 if large else 4)).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def binary_array(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow binary array over existing bytes without copying them."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow list array; offsets must fit 32 bits, which a batch of bounded size guarantees."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))


def gather_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start..start+length of every range, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, e = starts[keep], ends[keep]
    first = e - lengths[keep]
    out[0] = s[0]
    out[first[1:]] = s[1:] - (s[:-1] + lengths[keep][:-1] - 1)
    return np.cumsum(out)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Separators for words without punctuation: every ASCII character that is no letter or digit.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def words(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words before each text) of the maximal runs of bytes that are no space in every text.

    Space is 0x20 and 0x09..0x0D unless told otherwise; a run ends at its text's end.
    """
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = ~space[raw]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


#: Words of more bytes than this are hashed one by one.
LONG_WORD = 64


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int, lower: bool = True) -> np.ndarray:
    """64-bit hash of every word: its bytes, eight at a time, each time mixed; different words of up to 8 bytes and one length differ.

    No polynomial, whose value two unlike words of two letters can share whatever the base.
    """
    size = end - start
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = _LOWER[raw] if lower else raw
    eight = np.ndarray((len(raw) + 1,), np.dtype("<u8"), buffer=padded, strides=(1,))  # the eight bytes from any place
    out = mix(size.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(seed))
    at, left = np.flatnonzero(size <= LONG_WORD), size
    places = start
    k = 0
    while True:
        at = at[left[at] > 8 * k]
        if not len(at):
            break
        rest = np.minimum(left[at] - 8 * k, 8).astype(U64)
        chunk = eight[places[at] + 8 * k] & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - U64(8) * rest))
        out[at] = mix(out[at] ^ chunk)
        k += 1
    key = seed.to_bytes(8, "little")
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(padded[start[i] : end[i]], digest_size=8, key=key).digest(), "little")
    return out


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-word shingle hashes of every text, end to end, and their offsets.

    A text of 1..n-1 words has its whole word sequence as the only shingle; one without words has none.
    """
    start, end, first = words(raw, offsets)
    h = word_hashes(raw, start, end, 11)
    count = np.diff(first)
    place = np.arange(len(h)) - np.repeat(first[:-1], count)
    left = np.repeat(count, count) - place
    acc = np.zeros(len(h), U64)
    for k in range(n):
        shifted = np.zeros(len(h), U64)
        if k < len(h):
            shifted[: len(h) - k] = h[k:]
        shifted[left <= k] = 0
        acc = (acc ^ shifted) * U64(0xC2B2AE3D27D4EB4F)
        acc ^= acc >> U64(29)
    acc = mix(acc)
    keep = (left >= n) | ((place == 0) & (np.repeat(count, count) < n))
    sizes = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    kept = acc[keep]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    for i in range(len(sizes)):
        if sizes[i] > 1:
            kept[bounds[i] : bounds[i + 1]].sort()
    fresh = np.ones(len(kept), bool)
    fresh[1:] = kept[1:] != kept[:-1]
    fresh[bounds[:-1][sizes > 0]] = True
    total = np.concatenate([[0], np.cumsum(fresh)])
    return kept[fresh], total[bounds]
