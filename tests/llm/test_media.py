import hashlib
import zlib

import numpy as np
import pytest

from chunkloom.llm import tiff


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_pages_come_back(compression, predictor, tile):
    r = np.random.default_rng(1)
    pages = [r.integers(0, 256, (37, 50), np.uint8), np.zeros((5, 3), np.uint8), np.repeat(r.integers(0, 9, (40, 4, 3), np.uint16), 9, axis=1), np.tile(np.arange(256, dtype=np.uint8), (40, 8))]
    back = list(tiff.read_pages(tiff.write_tiff(pages, compression, predictor, 7, tile)))
    assert [p.number for p in back] == [0, 1, 2, 3]
    for want, got in zip(pages, back, strict=True):
        assert (got.pixels == (want if want.ndim == 3 else want[:, :, None])).all()


def test_lzw_of_long_inputs():
    r = np.random.default_rng(2)
    for data in (bytes(100_000), r.integers(0, 4, 60_000, np.uint8).tobytes(), r.integers(0, 256, 30_000, np.uint8).tobytes(), b"", b"a"):
        assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
        assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data


def test_big_endian_float_predictor():
    import struct

    x = np.array([[1.5, -2.25, 3.0], [0.0, 1e10, -7.5]], ">f4")
    planes = x.view(np.uint8).reshape(2, 3, 4).transpose(0, 2, 1).reshape(2, 12)
    coded = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).astype(np.uint8).tobytes()
    tags = [(256, 3), (257, 2), (258, 32), (259, 1), (273, 8), (277, 1), (278, 2), (279, len(coded)), (317, 3), (339, 3)]
    data = b"MM" + struct.pack(">HI", 42, 8 + len(coded)) + coded + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", t, 4, 1, v) for t, v in tags) + b"\0\0\0\0"
    (page,) = tiff.read_pages(data)
    assert (page.pixels[:, :, 0] == x.astype(np.float32)).all()


def test_faults_are_rows(spark):
    good = tiff.write_tiff([np.ones((4, 4), np.uint8)])
    loop = bytearray(good)
    loop[-4:] = good[4:8]
    rows = [(1, good), (2, None), (3, b"II*\0"), (4, b"junk junk junk"), (5, bytes(loop)), (6, good[:-20]), (1, good)]
    out = tiff.tiff_pages(spark.createDataFrame(rows, "id long, error binary"), "id", "error").collect()
    by = {}
    for r in out:
        by.setdefault(r["id"], []).append(r)
    assert len(by[1]) == 2 and by[1][0]["error"] is None and bytes(by[1][0]["pixels"]) == b"\1" * 16
    assert all(by[k][-1]["error"] for k in (2, 3, 4, 5, 6))
    assert len(by[5]) == 2 and by[5][0]["error"] is None
    with pytest.raises(tiff.TiffError):
        list(tiff.read_pages(good, max_page_bytes=8))


def test_digests(spark, edge):
    got = sorted((tuple(r)[:5] for r in tiff.text_media_digests(edge).collect()), key=repr)
    want = []
    for r in edge.collect():
        raw = (r.text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert got == sorted(want, key=repr)
    assert tiff.text_media_digests(edge.limit(0)).count() == 0
    n, media = tiff.store_text("x" * (64 * tiff.PAGE_ROWS + 5))
    assert len(list(tiff.read_pages(media))) == 2


def packed_page(values, bits, compression=1, form=1, fill=1):
    """The strip and the tags of one page of small samples."""
    h, w = values.shape
    single = np.unpackbits((values.astype(np.uint8) << (8 - bits))[:, :, None], axis=2)[:, :, :bits].reshape(h, -1)
    raw = np.packbits(single, axis=1).tobytes()
    raw = tiff.packbits_encode(raw) if compression == tiff.PACKBITS else raw
    raw = bytes(int(f"{b:08b}"[::-1], 2) for b in raw) if fill == 2 else raw
    return raw, [(256, w), (257, h), (258, bits), (259, compression), (266, fill), (273, None), (277, 1), (278, h), (279, len(raw)), (339, form)]


def chained(pages):
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for raw, tags in pages:
        at = len(out)
        out += raw + bytes(len(raw) % 2)
        out[link : link + 4] = len(out).to_bytes(4, "little")
        out += len(tags).to_bytes(2, "little") + b"".join(t.to_bytes(2, "little") + b"\4\0\1\0\0\0" + (at if v is None else v).to_bytes(4, "little") for t, v in tags)
        link = len(out)
        out += bytes(4)
    return bytes(out)


def test_small_and_signed_samples_and_pages_after_a_fault(spark):
    r = np.random.default_rng(5)
    want = [r.integers(0, 1 << b, (7, 13), np.uint8) for b in (1, 2, 4, 1)]
    pages = [packed_page(v, b, c, fill=f) for v, b, c, f in zip(want, (1, 2, 4, 1), (tiff.PACKBITS, 1, tiff.PACKBITS, 1), (1, 1, 1, 2), strict=True)]
    signed = np.array([[-3, 100, -128]], np.int8)
    pages.append((signed.tobytes(), [(256, 3), (257, 1), (258, 8), (259, 1), (273, None), (277, 1), (278, 1), (279, 3), (339, 2)]))
    bad = packed_page(want[0], 1, 7)  # a compression that is not supported
    media = chained([bad, *pages[:2], bad, *pages[2:]])
    rows = sorted(tiff.tiff_pages(spark.createDataFrame([(1, media)], "id long, media binary"), "id", "media").collect(), key=lambda x: x["page"])
    assert [x["page"] for x in rows] == list(range(7)) and [x["page"] for x in rows if x["error"]] == [0, 3]
    assert [bytes(x["pixels"]) for x in rows if not x["error"]] == [v.tobytes() for v in [*want, signed]]
