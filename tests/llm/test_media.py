import hashlib
import zlib
from urllib.parse import urlparse

from massgrid.llm import media


def test_png_round_trip():
    for raw in (b"", b"a", b"x" * 64, bytes(range(256)) * 9):
        data = media.padded(raw)
        assert len(data) % 64 == 0 and data and data.startswith(raw)
        image = media.to_png(data)
        assert media.png_header(image[: media.HEADER_BYTES]) == (64, len(data) // 64, 8)
        assert media.from_png(image) == data


def test_rows_and_shards(table, odd_texts):
    rows = media.media_table(table(odd_texts)).collect()
    assert len(rows) == len(odd_texts)
    for r in rows:
        raw = (odd_texts[r.doc_id] or "").encode()
        data = media.padded(raw)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(data))
        assert r.payload_sha256 == hashlib.sha256(data).hexdigest()
        assert r.tail_crc32 == zlib.crc32(data[-64:])
        assert r.media_bytes == len(media.to_png(data))
        assert (r.width, r.height) == (64, len(data) // 64)
    assert len({r.feature for r in rows if r.doc_id in (4, 5)}) == 1
    for shard in {r.shard for r in rows}:
        with open(urlparse(shard).path, "rb") as f:
            found = dict(media.members(f.read()))
        assert all(hashlib.sha256(d).hexdigest() + ".png" == n for n, d in found.items())


def test_empty_table(empty):
    assert media.media_table(empty).count() == 0
