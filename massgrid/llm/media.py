"""Media columns: content-addressed payloads in tar shards.

Each row's payload is zero-padded to a positive multiple of 64 bytes and stored losslessly as the
samples of an 8-bit grey PNG that is 64 pixels wide. Members are named by the SHA-256 of the stored
form, and a task stores equal payloads once; two tasks may both store one, as no payload is sent between them. A row then only carries (digest, shard, offset, length);
header-only range reads fill the metadata columns, and whole reads the payload's features.

Everything is narrow: no payload is ever shuffled. Each task writes its own shards, whose names hold
the partition and the attempt, so a task that is run again never touches what another attempt wrote,
and only the index of the attempt that commits is used. Shards are written and read through
pyarrow.fs by URI, so the store may be local, HDFS or an object store.

Cases: a null text is an empty payload, stored as 64 zero bytes; an empty table gives an empty
result; equal texts give equal values, whatever task stores them; rows that share a doc_id are stored each; a null doc_id
stays null; a very long text is one object, held whole by its task; other columns of the input are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massgrid.llm.common import lean, saved, shared_folder, text_rows

WIDTH = 64
PNG_MARK = b"\x89PNG\r\n\x1a\n"
#: Signature, then the IHDR chunk: all that a header-only read fetches.
HEADER_BYTES = len(PNG_MARK) + 25
BLOCK = 512


def padded(payload: bytes) -> bytes:
    """Zero-padded to a positive multiple of WIDTH bytes."""
    short = -len(payload) % WIDTH if payload else WIDTH
    return payload + b"\0" * short


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def to_png(payload: bytes, level: int = 4) -> bytes:
    """The padded payload as one 8-bit grey image, a row of 64 samples after another."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # a leading 0: the row isn't filtered
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG_MARK + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(start: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first HEADER_BYTES bytes."""
    if start[:8] != PNG_MARK or start[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    width, height, bits = struct.unpack(">IIB", start[16:25])
    return width, height, bits


def from_png(image: bytes) -> bytes:
    """The samples of an image that to_png made."""
    width, height, _ = png_header(image)
    at, packed = len(PNG_MARK), []
    while at < len(image):
        (n,), kind = struct.unpack(">I", image[at : at + 4]), image[at + 4 : at + 8]
        if kind == b"IDAT":
            packed.append(image[at + 8 : at + 8 + n])
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows are not written by this module")
    return lines[:, 1:].tobytes()


class ShardWriter:
    """Tar shards of one task; starts another one beyond max_bytes."""

    def __init__(self, base: str, stem: str, max_bytes: int):
        self.base, self.stem, self.max_bytes = base, stem, max_bytes
        self.fs, self.root = pafs.FileSystem.from_uri(base)
        self.count, self.out, self.at, self.seen = 0, None, 0, {}

    def add(self, media: bytes, digest: str) -> tuple[str, int, int]:
        if digest in self.seen:
            return self.seen[digest]
        if self.out is None:
            self.fs.create_dir(self.root, recursive=True)
            self.name = f"{self.stem}-{self.count:04d}.tar"
            self.out, self.at = self.fs.open_output_stream(f"{self.root}/{self.name}"), 0
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(media)
        head = info.tobuf(tarfile.GNU_FORMAT)
        self.out.write(head)
        self.out.write(media)
        self.out.write(b"\0" * (-len(media) % BLOCK))
        place = (f"{self.base}/{self.name}", self.at + len(head), len(media))
        self.at += len(head) + len(media) + -len(media) % BLOCK
        self.seen[digest] = place
        if self.at >= self.max_bytes:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * (2 * BLOCK))
            self.out.close()
            self.out, self.count = None, self.count + 1


INDEX = "doc_id long, n_bytes long, media_sha256 string, shard string, offset long, media_bytes long"


def store(docs: DataFrame, folder: str, max_shard_bytes: int = 1 << 29) -> DataFrame:
    """Write the payload of every text to tar shards in `folder`; return the index of rows."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shards = ShardWriter(folder, f"part-{context.partitionId():06d}-{context.taskAttemptId()}", max_shard_bytes)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode()
                media = to_png(padded(raw))
                digest = hashlib.sha256(media).hexdigest()
                rows.append((len(raw), digest, *shards.add(media, digest)))
            n, digest, shard, at, size = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(shard, pa.string()), pa.array(at, pa.int64()), pa.array(size, pa.int64())], names=["doc_id", "n_bytes", "media_sha256", "shard", "offset", "media_bytes"])
        shards.close()

    return saved(text_rows(docs).mapInArrow(lean(write), INDEX), "media-index")


class ShardReader:
    """Keeps the shard that was read last open."""

    def __init__(self):
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            if self.file is not None:
                self.file.close()
            fs, path = pafs.FileSystem.from_uri(shard)
            self.name, self.file = shard, fs.open_input_file(path)
        return self.file.read_at(length, offset)


def with_headers(index: DataFrame) -> DataFrame:
    """Adds width, height and bits by reading the first HEADER_BYTES bytes of each stored object."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = ShardReader()
        for batch in batches:
            heads = [png_header(shards.read(s.as_py(), o.as_py(), HEADER_BYTES)) for s, o in zip(batch.column("shard"), batch.column("offset"), strict=True)]
            cols = list(zip(*heads, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in cols)], names=[*batch.schema.names, "width", "height", "bits"])

    return index.mapInArrow(lean(read), f"{INDEX}, width long, height long, bits long")


def with_payload(index: DataFrame, payload: bool = False) -> DataFrame:
    """Reads every stored object whole: checks its digest, decodes it and adds the payload's features.

    The feature is the share of samples in each sixteenth of the range (in ten-thousandths), with the
    sum of samples. payload=True also returns the payload itself.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema.fields)

    def features(image: bytes, digest: str) -> tuple:
        if hashlib.sha256(image).hexdigest() != digest:
            raise ValueError(f"stored object differs from its address {digest}")
        data = from_png(image)
        samples = np.frombuffer(data, np.uint8)
        shares = np.bincount(samples >> 4, minlength=16) * 10000 // len(samples)
        text = f"sum={int(samples.sum(dtype=np.int64))};hist16=" + ",".join(map(str, shares.tolist()))
        return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), text, data

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = ShardReader()
        for batch in batches:
            rows, last, known = [], None, None
            for s, o, n, d in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "media_bytes", "media_sha256")), strict=True):
                if d != last:
                    last, known = d, features(shards.read(s, o, n), d)
                rows.append(known)
            size, sha, crc, text, data = zip(*rows, strict=True) if rows else ((),) * 5
            more = [pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(crc, pa.int64()), pa.array(text, pa.string())]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "feature"]
            if payload:
                more.append(pa.array(data, pa.binary()))
                names.append("payload")
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    return index.mapInArrow(lean(read), f"{schema}, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string" + ", payload binary" * payload)


def media_table(docs: DataFrame) -> DataFrame:
    """Store every text, then read headers and payloads back."""
    index = store(docs, shared_folder(docs.sparkSession, "media-shards"))
    return with_payload(with_headers(index))


def members(shard: bytes) -> list[tuple[str, bytes]]:
    """The members of a shard as an ordinary tar reader sees them."""
    with tarfile.open(fileobj=io.BytesIO(shard)) as tar:
        return [(m.name, tar.extractfile(m).read()) for m in tar.getmembers()]


def query(spark, sf_dir: str) -> DataFrame:
    """op1: media columns of every document."""
    out = media_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat_ws(";", F.format_string("%dx%dx%d", "width", "height", "bits"), "feature").alias("feature"))
