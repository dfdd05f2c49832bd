"""Ids of short pieces of text that a Python worker has met before.

Words come again and again, in later blocks and tasks of the same worker, too. A piece is found by its hash and then
compared byte by byte, so what a worker has met never changes a result. Pieces of up to SHORT bytes are kept, up to
a limit; others are encoded each time they come.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from massgrid.llm.bytesops import U64, gather_ranges, text_bytes, word_hashes

Encoded = tuple[np.ndarray, np.ndarray]  # ids end to end, offsets


SHORT = 256


class ChunkIds:
    def __init__(self, encode: Callable[[pa.Array], Encoded], limit: int = 1 << 19):
        self.encode, self.limit = encode, limit
        self.keys, self.starts, self.sizes = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.places, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of a piece's bytes
        self.ids, self.bytes = np.zeros(0, np.int32), np.zeros(0, np.uint8)

    def _found(self, key: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces that are known, their places in the table)."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, size = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1), np.diff(offsets)
        piece = np.flatnonzero((self.keys[at] == key) & (self.lengths[at] == size))
        at, size = at[piece], size[piece]
        differ = raw[gather_ranges(offsets[:-1][piece], size)] != self.bytes[gather_ranges(self.places[at], size)]
        same = np.diff(np.concatenate([[0], np.cumsum(differ)])[np.concatenate([[0], np.cumsum(size)])]) == 0
        return piece[same], at[same]

    def lookup(self, pieces: pa.Array) -> Encoded:
        """Ids of each of the distinct pieces."""
        raw, offsets = text_bytes(pieces)
        key = word_hashes(raw, offsets[:-1], offsets[1:], 29, lower=False)
        known, at = self._found(key, raw, offsets)
        start, size = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        start[known], size[known] = self.starts[at], self.sizes[at]
        unknown = np.ones(len(key), bool)
        unknown[known] = False
        missing = np.flatnonzero(unknown)
        ids = self.ids
        if len(missing):
            fresh, bounds = self.encode(pieces.take(pa.array(missing)))
            start[missing], size[missing] = len(ids) + bounds[:-1], np.diff(bounds)
            ids = np.concatenate([ids, fresh.astype(np.int32)])
            self._keep(missing, key, raw, offsets, start, size, ids)
        return ids[gather_ranges(start, size)], np.concatenate([[0], np.cumsum(size)])

    def _keep(self, missing: np.ndarray, key: np.ndarray, raw: np.ndarray, offsets: np.ndarray, start: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        length = np.diff(offsets)
        short = missing[length[missing] <= SHORT]
        if not len(short) or len(self.keys) + len(short) > self.limit:
            return
        keys = np.concatenate([self.keys, key[short]])
        order = np.argsort(keys, kind="stable")
        place = len(self.bytes) + np.cumsum(length[short]) - length[short]
        self.bytes = np.concatenate([self.bytes, raw[gather_ranges(offsets[:-1][short], length[short])]])
        begin = len(self.ids) + np.cumsum(size[short]) - size[short]
        self.ids = np.concatenate([self.ids, ids[gather_ranges(start[short], size[short])]])
        self.keys = keys[order]
        self.starts, self.sizes = np.concatenate([self.starts, begin])[order], np.concatenate([self.sizes, size[short]])[order]
        self.places, self.lengths = np.concatenate([self.places, place])[order], np.concatenate([self.lengths, length[short]])[order]
