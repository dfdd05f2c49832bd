"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of order 4 over lower-case letters, with runs of other characters as one space. The
models of all languages share sorted hash arrays: by order, the mixed n-gram keys and, for each key, the log
probability in every language; for contexts the weights of the lower order. Four 16-bit characters are one 64-bit
key, so keys never collide. A radix index narrows a search down to a few neighbours. The language with the lowest
cross-entropy by character wins; a text whose lowest cross-entropy is above the quantile that was calibrated on
labelled documents outside the counts is marked as rejected.

The models are fitted on a bounded sample of labelled rows: `max_rows` or `max_bytes` a language in expectation, of
`max_langs` languages at most, chosen by a hash of the doc_id among those whose crc32(doc_id as text) mod 5 is not 0. They are broadcast; the sample bounds them.

Cases: a null text, or one without a letter, is `und` with score 0; long texts are scored whole, in blocks; without
any labelled row all are `und`; ties go to the first language by name; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massgrid.llm.bpe import blocks
from massgrid.llm.bytesops import U64, mix, text_bytes
from massgrid.llm.common import lean, text_rows
from massgrid.llm.toxicity import held_out

ORDER = 4
SPACE = 0x20
BLOCK_BYTES = 1 << 20
#: How far a difference of one nat a character moves the score.
SHARPNESS = 12.0


@cache
def _symbols() -> np.ndarray:
    """By code point: the lower-case letter, or space; letters beyond the basic plane are one symbol."""
    table = np.full(0x110000, SPACE, np.uint16)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = ord(c.lower()[0])
            table[i] = low if low < 0xFFFF else 0xFFFF
    return table


def symbols(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts end to end, without spaces at a text's start or after another, and their offsets."""
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
    s = _symbols()[points]
    space = s == SPACE
    keep = ~space
    keep[1:] |= ~space[:-1]
    starts = at[:-1][at[:-1] < at[1:]]
    keep[starts] = ~space[starts]
    return s[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def grams(s: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The key of each symbol with the ORDER - 1 before it; before a text stand spaces."""
    wide = s.astype(U64)
    key = wide.copy()
    for k in range(1, ORDER):
        key[k:] |= wide[:-k] << U64(16 * k)
    for j in range(ORDER - 1):
        at = offsets[:-1] + j
        at = at[at < offsets[1:]]
        blank = sum(SPACE << (16 * k) for k in range(j + 1, ORDER))
        key[at] = (key[at] & U64((1 << (16 * (j + 1))) - 1)) | U64(blank)
    return key


def _suffix(key: np.ndarray, n: int) -> np.ndarray:
    return key & U64((1 << (16 * n)) - 1)


class Counts:
    """One language: by order, sorted keys and their (continuation) counts, and by context the totals and kinds."""

    def __init__(self, keys: np.ndarray):
        grams_, counts = np.unique(keys, return_counts=True)
        self.grams, self.counts, self.discount = {ORDER: grams_}, {ORDER: counts}, {}
        for n in range(ORDER - 1, 0, -1):  # below the top order a count is the number of different symbols before it
            self.grams[n], self.counts[n] = np.unique(_suffix(self.grams[n + 1], n), return_counts=True)
        self.context, self.total, self.kinds = {}, {}, {}
        for n in range(1, ORDER + 1):
            ones, twos = (self.counts[n] == 1).sum(), (self.counts[n] == 2).sum()
            self.discount[n] = ones / (ones + 2 * twos) if ones and twos else 0.5
            context, place = np.unique(self.grams[n] >> U64(16), return_inverse=True)
            self.context[n] = context
            self.total[n], self.kinds[n] = np.bincount(place, self.counts[n]), np.bincount(place)

    def rest(self, context: np.ndarray, n: int) -> np.ndarray:
        """Weight of order n - 1 after a context; 1 where the context was never seen."""
        at = np.minimum(np.searchsorted(self.context[n], context), len(self.context[n]) - 1)
        return np.where(self.context[n][at] == context, self.discount[n] * self.kinds[n][at] / self.total[n][at], 1.0)

    def chance(self, key: np.ndarray, n: int, size: int) -> np.ndarray:
        """Interpolated probability of the last symbol of keys of order n; size: of the alphabet."""
        if n == 0:
            return np.full(len(key), 1.0 / size)
        at = np.minimum(np.searchsorted(self.grams[n], key), len(self.grams[n]) - 1)
        count = np.where(self.grams[n][at] == key, np.maximum(self.counts[n][at] - self.discount[n], 0), 0.0)
        context = key >> U64(16)
        c = np.minimum(np.searchsorted(self.context[n], context), len(self.context[n]) - 1)
        total = np.where(self.context[n][c] == context, self.total[n][c], 1.0)
        return count / total + self.rest(context, n) * self.chance(_suffix(key, n - 1), n - 1, size)


class HashArray:
    """Rows of values by key: sorted mixed keys, and where each prefix of their bits starts."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        mixed = mix(keys)
        order = np.argsort(mixed)
        self.keys, self.values = np.append(mixed[order], U64(2**64 - 1)), np.concatenate([values[order], values[:1] * 0]).astype(np.float32)
        self.bits = max(1, int(2 * len(keys)).bit_length())
        self.start = np.searchsorted(mixed[order], np.arange(1 << self.bits, dtype=U64) << U64(64 - self.bits)).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, whether it is there) of each key."""
        mixed = mix(keys)
        at = self.start[(mixed >> U64(64 - self.bits)).astype(np.int64)]
        behind = np.flatnonzero(self.keys[at] < mixed)
        while len(behind):
            at[behind] += 1
            behind = behind[self.keys[at[behind]] < mixed[behind]]
        return at, self.keys[at] == mixed


class Models:
    """All languages' models, and the calibrated bound of rejection."""

    def __init__(self, names: list[str], counts: list[Counts]):
        self.names, self.bound = names, np.inf
        size = 2 + len(np.unique(np.concatenate([c.grams[1] for c in counts])))
        self.unseen = np.float32(-np.log(size))
        self.chances, self.rests = {}, {}
        for n in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([c.grams[n] for c in counts]))
            self.chances[n] = HashArray(keys, np.stack([np.log(c.chance(keys, n, size)) for c in counts], 1))
            context = np.unique(np.concatenate([c.context[n] for c in counts]))
            self.rests[n] = HashArray(context, np.stack([np.log(c.rest(context, n)) for c in counts], 1))

    def cross_entropy(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nats a symbol by language, symbols) of each text."""
        s, at = symbols(raw, offsets)
        keys = grams(s, at)
        row, there = self.chances[ORDER].find(keys)
        found = self.chances[ORDER].values[row]
        todo = np.flatnonzero(~there)
        if len(todo):
            key, low = keys[todo], np.zeros((len(todo), len(self.names)), np.float32)
            open_ = np.arange(len(todo))
            for n in range(ORDER, 0, -1):
                part = _suffix(key[open_], n)
                if n < ORDER:
                    row, there = self.chances[n].find(part)
                    low[open_[there]] += self.chances[n].values[row[there]]
                    open_, part = open_[~there], part[~there]
                if not len(open_):
                    break
                row, there = self.rests[n].find(part >> U64(16))
                low[open_[there]] += self.rests[n].values[row[there]]
            low[open_] += self.unseen
            found[todo] = low
        total = np.concatenate([np.zeros((1, len(self.names))), np.cumsum(found, 0, dtype=np.float64)])
        n = np.diff(at)
        return -(total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1)[:, None], n


def fit(texts: pa.Array, langs: list[str], quantile: float = 0.999) -> Models | None:
    """Models of all languages; every fifth text is left out of the counts and calibrates the rejection."""
    names = sorted(set(langs))
    if not names:
        return None
    raw, offsets = text_bytes(texts)
    lang, fifth = np.array(langs), np.arange(len(langs)) % 5 == 4
    s, at = symbols(raw, offsets)
    keys, row = grams(s, at), np.repeat(np.arange(len(langs)), np.diff(at))
    counts = []
    for name in names:
        mine = keys[(lang == name)[row] & ~fifth[row]]
        counts.append(Counts(mine if len(mine) else keys[(lang == name)[row]]) if (lang == name)[row].any() else Counts(np.array([SPACE], U64)))
    models = Models(names, counts)
    entropy, n = models.cross_entropy(raw, offsets)
    if (usable := fifth & (n > 20)).any():
        models.bound = float(np.quantile(entropy[usable].min(1), quantile))
    return models


def train(docs: DataFrame, max_rows: int = 300, max_bytes: int = 1 << 24, max_langs: int = 256) -> Models | None:
    """Learned from about max_rows documents, or max_bytes of text, of each language that are not held out.

    Where there are more than max_langs different values in lang, those of most documents are learned.
    """
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("double")).alias("bytes"))
    most = sizes.orderBy(F.desc("n"), "lang").limit(max_langs).collect()
    if not most:
        return None
    share = F.create_map(*[F.lit(x) for r in most for x in (r.lang, int(min(1.0, max_rows / r.n, max_bytes / max(1.0, r.bytes)) * (1 << 20)))])
    sample = known.where(F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")))
    table = sample.select("doc_id", "text", "lang").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])  # bounded by the parameters
    return fit(table["text"], table["lang"].to_pylist())


def identify(docs: DataFrame, models: Models | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sent.value
        names = np.array(["und", *(models.names if models else [])], object)
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for i, j in blocks(offsets, BLOCK_BYTES):
                best, sure, far = np.zeros(j - i, np.int64), np.zeros(j - i), np.zeros(j - i, bool)
                if models:
                    entropy, n = models.cross_entropy(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    least = entropy.min(1)
                    best = np.where(n > 0, entropy.argmin(1) + 1, 0)
                    sure = np.where(n > 0, 1 / np.exp(-SHARPNESS * (entropy - least[:, None])).sum(1), 0.0)
                    far = (n > 0) & (least > models.bound)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names[best], pa.string()), pa.array(np.round(sure, 6)), pa.array(far)], names=["doc_id", "lang_pred", "score", "rejected"])

    return text_rows(docs).mapInArrow(lean(run), "doc_id long, lang_pred string, score double, rejected boolean")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
