"""Byte-level BPE encoding and decoding by merge replay.

A block of the corpus is cut into pretokens, and every distinct pretoken that the worker has not met before is encoded once. The distinct
pretokens stand end to end in one symbol array with links to the neighbours; an inverted index maps the
rank of a token pair to the positions where the pair stands. Ranks are applied in ascending order, each
at all its positions at once, and only the pairs next to a merged position are looked up anew. Texts are
then put together from the encoded pretokens by Arrow gathers.

A block is at most `BLOCK_BYTES` of text (a longer text is a block of its own), so memory is bounded and
nothing is shuffled; a lost executor costs only its own blocks.

Cases: a null or empty text has no tokens; the ids decode to exactly the bytes of the text; an empty table
gives an empty result; equal texts give equal ids; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massgrid.llm.bytesops import binary_array, gather_ranges, list_array, text_bytes
from massgrid.llm.chunks import ChunkIds
from massgrid.llm.common import lean, text_rows

BLOCK_BYTES = 6 << 20
NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from a file of base64 token and rank on each line."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def unicode_spaces(pattern: str) -> str:
    r"""The pattern with \s as the Unicode property, which leaves out the four separator controls that Python counts as space."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")


class Vocabulary:
    """Ranked tokens, and for every pair of tokens that forms a third one the rank of that one."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.rank = tokens, {t: i for i, t in enumerate(tokens)}
        self.pattern = regex.compile(unicode_spaces(pattern))
        self.bytes = pa.array(tokens, pa.large_binary())
        self.first = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.rank[t[:k]] * len(tokens) + self.rank[t[k:]], i) for i, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in self.rank and t[k:] in self.rank]
        pairs.sort()
        self.known = ChunkIds(self._pieces)
        self.keys, self.values = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int32)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * len(self.tokens) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def by_word(self, word: bytes) -> list[int]:
        """The plain procedure for one word: always the lowest rank, leftmost first."""
        parts = [bytes([b]) for b in word]
        while True:
            ranks = [self.rank.get(parts[i] + parts[i + 1], NONE) for i in range(len(parts) - 1)]
            best = min(ranks, default=NONE)
            if best == NONE:
                return [self.rank[p] for p in parts]
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, offsets) of the words; every merge is applied in rank order over all of them."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        n = len(raw)
        if not n:
            return np.zeros(0, np.int32), bounds
        token = np.append(self.first[raw], np.int32(-1))  # one more place: the end of every word's links
        after = np.arange(1, n + 2)
        after[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = n
        after[n] = n
        before = np.arange(-1, n)
        before[bounds[:-1][bounds[1:] > bounds[:-1]]] = n
        before = np.append(before, n)
        rank = np.full(n + 1, NONE, np.int32)
        inner = np.flatnonzero(after[:n] < n)
        rank[inner] = self.pair_ranks(token[inner], token[after[inner]])
        inner = inner[rank[inner] != NONE]
        order = inner[np.argsort(rank[inner], kind="stable")]
        present, start = np.unique(rank[order], return_index=True)
        index: dict[int, list[np.ndarray]] = {int(r): [p] for r, p in zip(present, np.split(order, start[1:]), strict=True)} if len(order) else {}
        queue = sorted(index)
        odd: list[np.ndarray] = []
        while queue:
            r = heapq.heappop(queue)
            found = index.pop(r, None)
            if found is None:
                continue
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                tied = np.concatenate([[False], at[1:] == after[at[:-1]]])
                if tied.any():  # pairs that share a symbol: every second one, from the left
                    place = np.arange(len(at))
                    at = at[(place - np.maximum.accumulate(np.where(tied, 0, place))) % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            token[at], token[gone], rank[gone] = r, -1, NONE
            after[at] = beyond
            before[beyond] = at
            before[n] = n
            touched = np.concatenate([at, before[at]])
            touched = touched[touched < n]
            right = after[touched]
            new = np.where(right < n, self.pair_ranks(token[touched], token[right]), NONE)
            rank[touched] = new
            touched, new = touched[new != NONE], new[new != NONE]
            if not len(new):
                continue
            if new.min() < r:
                odd.append(touched[new < r])
            if len(new) > 1:
                sort = np.argsort(new, kind="stable")
                touched, new = touched[sort], new[sort]
                cuts = np.flatnonzero(new[1:] != new[:-1]) + 1
                groups = zip(new[np.concatenate([[0], cuts])].tolist(), np.split(touched, cuts), strict=True)
            else:
                groups = [(int(new[0]), touched)]
            for key, places in groups:
                if key in index:
                    index[key].append(places)
                else:
                    index[key] = [places]
                    heapq.heappush(queue, key)
        alive = token[:n] >= 0
        ids, ends = token[:n][alive], np.concatenate([[0], np.cumsum(alive)])[bounds]
        if odd:  # a merge made a pair of lower rank: the order inside the word decides, so such words are encoded one by one
            lists = np.split(ids, ends[1:-1])
            for w in np.unique(np.searchsorted(bounds, np.concatenate(odd), side="right") - 1):
                lists[w] = np.array(self.by_word(words[w]), np.int32)
            ids, ends = np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        return ids, ends

    def _pieces(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, offsets) of chunks, whose distinct pretokens are encoded together."""
        codes: dict[str, int] = {}
        parts, sizes = [], np.empty(len(chunks), np.int64)
        findall = self.pattern.findall
        for i, chunk in enumerate(chunks.to_pylist()):
            pieces = findall(chunk.decode())
            sizes[i] = len(pieces)
            for piece in pieces:
                parts.append(codes.setdefault(piece, len(codes)))
        words = [w.encode() for w in codes]
        whole = np.array([self.rank.get(w, -1) for w in words], np.int32)
        ids, ends = self.replay([w if k < 0 else b"" for w, k in zip(words, whole, strict=True)])
        length = np.diff(ends)
        length[whole >= 0] = 1
        bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
        table = np.empty(int(bounds[-1]), np.int32)
        single = np.zeros(len(table), bool)
        single[bounds[:-1][whole >= 0]] = True
        table[single], table[~single] = whole[whole >= 0], ids
        parts = np.array(parts, np.int64)
        flat = table[gather_ranges(bounds[parts], length[parts])]
        return flat, np.concatenate([[0], np.cumsum(length[parts])])[np.concatenate([[0], np.cumsum(sizes)])]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, offsets) of a block of texts."""
        cuts = split_places(raw, offsets)
        coded = binary_array(raw, cuts).dictionary_encode()
        out = list_array(*self.known.lookup(coded.dictionary), pa.int32()).take(coded.indices)
        return out.flatten().to_numpy(), out.offsets.to_numpy()[np.searchsorted(cuts, offsets)].astype(np.int64) if len(out) else np.zeros(len(offsets), np.int64)


_LOADED: dict[tuple[str, str], Vocabulary] = {}


def loaded(path: str, pattern: str, tokens: list[bytes]) -> Vocabulary:
    """One vocabulary a Python worker; building its pair table takes most of a second."""
    if (path, pattern) not in _LOADED:
        _LOADED.clear()
        _LOADED[path, pattern] = Vocabulary(tokens, pattern)
    return _LOADED[path, pattern]


def split_places(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where no pretoken runs across: text bounds, and single spaces between two characters that are surely no space.

    Next to the space only ASCII and two-byte characters from U+00C0 are taken as such; elsewhere the chunk just gets longer.
    """
    n = len(raw)
    if n < 3:
        return np.unique(np.concatenate([offsets, [0, n]]))
    plain = (raw > 0x20) & (raw < 0x7F)
    lead = (raw >= 0xC3) & (raw <= 0xDF)
    before = plain[:-2].copy()
    before[1:] |= (raw[1:-2] >= 0x80) & (raw[1:-2] < 0xC0) & lead[:-3]
    at = np.flatnonzero((raw[1:-1] == 0x20) & before & (plain | lead)[2:]) + 1
    return np.union1d(at, offsets)


def blocks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `limit` bytes together, or one text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of every text; `vocabulary` is the path of a rank file, read on the driver."""
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))  # a fixed file, about 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vocab = loaded(vocabulary, pattern, tokens.value)
            raw, offsets = text_bytes(batch.column(1))
            for i, j in blocks(offsets, BLOCK_BYTES):
                ids, ends = vocab.encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), list_array(ids, ends, pa.int32())], names=["doc_id", "ids"])
                pa.default_memory_pool().release_unused()

    return text_rows(docs).mapInArrow(lean(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """Adds `decoded` (binary): the bytes of the ids of every row."""
    tokens = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            table = table if table is not None else pa.array(tokens.value, pa.large_binary())
            column = batch.column(batch.schema.names.index(ids))
            ends = np.asarray(column.offsets, dtype=np.int64) - column.offsets[0].as_py()
            parts = table.take(column.flatten())
            places = np.frombuffer(parts.buffers()[1], np.int64, len(parts) + 1) if len(parts) else np.zeros(1, np.int64)
            raw = np.frombuffer(parts.buffers()[2] or b"", np.uint8)
            decoded = binary_array(raw, places[ends]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*batch.schema.names, "decoded"])
            pa.default_memory_pool().release_unused()

    return encoded.mapInArrow(lean(run), f"{schema}, decoded binary")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: ids of every document and the bytes they decode to, as digests."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.PATTERN), path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
