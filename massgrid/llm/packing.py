"""Sum-of-squares online packing of tokenised documents into windows of a fixed length.

Each document gets an end id. Its full windows are cut off at once; what is left goes to the fill level h
for which the sum of squared counts of partially filled windows, kept in one array by level, gets
smallest: moving a window from h to h + s changes the sum by 2 * (count[h + s] - count[h]) + 2, filling one
up by 1 - 2 * count[h], opening a new one by 2 * count[s] + 1.

Every task packs its own rows, so nothing is shuffled and the same input split gives the same windows
when a lost task runs again. Beyond `max_open` open windows, which bound the memory, each new one completes another:
the fullest window takes pieces, cut where need be, from the emptiest. When a task ends all are completed so, and what
is left over is split at powers of two. So a sequence is either full or a power of two long, and there is no padding.

Cases: a null or empty text is the end id alone; a text longer than a window takes several; repeated rows
are packed each; of levels with equal sums the lowest is taken; a null doc_id is packed under null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massgrid.llm.bpe import blocks
from massgrid.llm.bytesops import binary_array, list_array, text_bytes
from massgrid.llm.chunks import ChunkIds
from massgrid.llm.common import lean, text_rows

BLOCK_BYTES = 4 << 20
Piece = tuple[int, int, int, np.ndarray]  # document, start in it, tokens of the document, ids


class Levels:
    """Open windows by how far they are filled."""

    def __init__(self, window: int = 4096, max_open: int = 1024):
        self.window, self.max_open = window, max_open
        self.count = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Place a document; yields the windows that are complete."""
        doc, start, total, ids = piece
        while len(ids) >= self.window:
            yield [(doc, start, total, ids[: self.window])]
            ids, start = ids[self.window :], start + self.window
        size = len(ids)
        if not size:
            return
        rest = (doc, start, total, ids)
        last = self.window - size
        cost = 2 * (self.count[size : self.window + 1] - self.count[: last + 1]) + 2
        cost[last] = 1 - 2 * self.count[last]
        cost[self.count[: last + 1] == 0] = np.iinfo(np.int64).max
        level = int(cost.argmin())
        if cost[level] > 2 * self.count[size] + 1:
            level, pieces = 0, [rest]
        else:
            pieces = [*self._taken(level), rest]
        if level + size == self.window:
            yield pieces
            return
        self._put(pieces, level + size)
        while self.count.sum() > self.max_open:
            yield from self._completed()

    def _put(self, pieces: list[Piece], level: int) -> None:
        self.count[level] += 1
        self.open.setdefault(level, []).append(pieces)

    def _taken(self, level: int) -> list[Piece]:
        self.count[level] -= 1
        return self.open[level].pop()

    def _completed(self) -> Iterator[list[Piece]]:
        """Fill up the fullest open window from the emptiest ones, whose pieces are cut."""
        level = int(np.flatnonzero(self.count)[-1])
        window, need = self._taken(level), self.window - level
        while need and self.count.any():
            level = int(np.flatnonzero(self.count)[0])
            other = self._taken(level)
            while need and other:
                doc, start, total, ids = other.pop()
                take = min(need, len(ids))
                window.append((doc, start + len(ids) - take, total, ids[len(ids) - take :]))
                if take < len(ids):
                    other.append((doc, start, total, ids[: len(ids) - take]))
                need, level = need - take, level - take
            if other:
                self._put(other, level)
        if need:
            yield from self._powers(window)
        else:
            yield window

    def close(self) -> Iterator[list[Piece]]:
        """Complete all open windows; what no full window holds is split at powers of two."""
        while self.count.any():
            yield from self._completed()

    def _powers(self, pieces: list[Piece]) -> Iterator[list[Piece]]:
        left = sum(len(p[3]) for p in pieces)
        pieces = pieces[::-1]
        while left:
            room = 1 << (left.bit_length() - 1)
            left, out = left - room, []
            while room:
                doc, start, total, ids = pieces.pop()
                out.append((doc, start, total, ids[:room]))
                if len(ids) > room:
                    pieces.append((doc, start + room, total, ids[room:]))
                room -= len(out[-1][3])
            yield out


class WordTokenizer:
    """The ids of texts by the `tokenizers` library, which is asked once for every distinct run of non-space characters.

    This holds for tokenizers that drop white space and split at it first; special tokens' strings are found as the library finds them.
    """

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.known = ChunkIds(self._pieces)

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for i in range(0, len(pieces), 8192):  # the library's objects are large
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(pieces.slice(i, 8192).to_pylist(), add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            ids.append(np.fromiter((i for x in lists for i in x), np.int32, int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, offsets), each text closed by end_id."""
        runs = pc.ascii_split_whitespace(texts)
        coded = runs.flatten().dictionary_encode()
        flat = list_array(*self.known.lookup(coded.dictionary), pa.int32()).take(coded.indices)
        ids, ends = flat.flatten().to_numpy(), flat.offsets.to_numpy().astype(np.int64) if len(flat) else np.zeros(1, np.int64)
        ends = ends[np.asarray(runs.offsets, np.int64) - runs.offsets[0].as_py()]
        out = np.full(len(ids) + len(texts), end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), np.diff(ends))] = ids
        return out, ends + np.arange(len(texts) + 1)


_LOADED: dict[int, WordTokenizer] = {}


def loaded(source: str) -> WordTokenizer:
    """One tokenizer a Python worker."""
    if hash(source) not in _LOADED:
        _LOADED.clear()
        _LOADED[hash(source)] = WordTokenizer(source)
    return _LOADED[hash(source)]


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, max_open: int = 1024) -> DataFrame:
    """Pieces of all texts: where each lies in its document and in its sequence, and its ids as little-endian 32-bit integers.

    `tokenizer` is the path of a tokenizer file, read on the driver.
    """
    with open(tokenizer, encoding="utf-8") as file:
        source = docs.sparkSession.sparkContext.broadcast(file.read())  # a fixed file, under 2 MB

    def rows(windows: list[tuple[int, list[Piece]]]) -> pa.RecordBatch:
        cols: tuple[list, ...] = ([], [], [], [], [], [], [])
        for sequence, pieces in windows:
            at = 0
            for doc, start, total, ids in pieces:
                for c, v in zip(cols, (doc, start, len(ids), ids.astype("<u4").tobytes(), total, sequence, at), strict=True):
                    c.append(v)
                at += len(ids)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, done = Levels(window, max_open), []
        sequence = TaskContext.get().partitionId() << 40
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            keys = batch.column(0).to_pylist()
            for i, j in blocks(offsets, BLOCK_BYTES):
                texts = binary_array(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).cast(pa.large_string())
                ids, ends = loaded(source.value).encode(texts, end_id)
                for k in range(j - i):
                    for pieces in levels.add((keys[i + k], 0, int(ends[k + 1] - ends[k]), ids[ends[k] : ends[k + 1]].copy())):
                        done.append((sequence, pieces))
                        sequence += 1
                    if len(done) >= 512:
                        yield rows(done)
                        done = []
        for pieces in levels.close():
            done.append((sequence, pieces))
            sequence += 1
        yield rows(done)

    return text_rows(docs).mapInArrow(lean(run), SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: all documents packed into sequences of at most 4096 tokens."""
    import public_tokenizers

    out = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
