"""Media columns, TIFF: walk image directories, decode strips and tiles, undo predictors, one row per page.

Defined results
* null or undecodable media: one row, page 0, ``error`` set, ``pixels`` null.
* a page that cannot be decoded is such a row with its number, and the other pages are kept; where the directory chain
  itself breaks, the row ends the file.
* samples of 1, 2 or 4 bits are stored as a byte each, as they are (the photometric tag is not applied).
* a directory chain that loops ends at the first repeat with an error row.
* repeated rows give repeated results; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chunkloom.llm.common import lean, sliced

# TIFF 6.0 tags and compression codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER = 256, 257, 258, 259, 262, 266
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD_TYPES = {1: "B", 3: "H", 4: "I", 16: "Q"}

#: A page that declares more decoded bytes than this is reported as an error instead of being unpacked.
MAX_PAGE_BYTES = 1 << 30


class TiffError(ValueError):
    pass


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    pixels: np.ndarray  # height x width x samples


@dataclass
class Fault:
    number: int
    error: TiffError


# ---- codecs


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 1 + (n > 128)
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, i, literal = bytearray(), 0, bytearray()

    def flush() -> None:
        for k in range(0, len(literal), 128):
            part = literal[k : k + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    while i < len(data):
        run = 1
        while run < 128 and i + run < len(data) and data[i + run] == data[i]:
            run += 1
        if run >= 3:
            flush()
            out += bytes((257 - run, data[i]))
        else:
            literal += data[i : i + run]
        i += run
    flush()
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """MSB-first codes of 9 to 12 bits; the width grows one code early, as TIFF writers do."""
    roots = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, table, width, prev = bytearray(), list(roots), 9, b""
    acc = have = 0
    for byte in data:
        acc, have = (acc << 8) | byte, have + 8
        if have < width:
            continue
        have -= width
        code = acc >> have
        acc &= (1 << have) - 1
        if code == 256:
            table, width, prev = list(roots), 9, b""
            continue
        if code == 257:
            break
        if code < len(table):
            entry = table[code]
        elif code == len(table) and prev:
            entry = prev + prev[:1]
        else:
            raise TiffError("LZW code out of range")
        out += entry
        if prev:
            table.append(prev + entry[:1])
        prev = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
        if len(out) >= size:
            break
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    table = {bytes((i,)): i for i in range(256)}
    nxt, width, acc, have, out, word = 258, 9, 0, 0, bytearray(), b""

    def put(code: int) -> None:
        nonlocal acc, have
        acc, have = (acc << width) | code, have + width
        while have >= 8:
            have -= 8
            out.append(acc >> have)
            acc &= (1 << have) - 1

    put(256)
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = nxt
        nxt += 1
        if nxt == (1 << width) and width < 12:
            width += 1
        if nxt >= 4094:
            put(256)
            table = {bytes((k,)): k for k in range(256)}
            nxt, width = 258, 9
        word = data[i : i + 1]
    if word:
        put(table[word])
        nxt += 1
        if nxt == (1 << width) and width < 12:
            width += 1
    put(257)
    if have:
        out.append((acc << (8 - have)) & 255)
    return bytes(out)


def _unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        raw = data
    elif compression in (DEFLATE, OLD_DEFLATE):
        try:
            raw = zlib.decompressobj().decompress(data, size or 1)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from None
    elif compression == LZW:
        raw = lzw_decode(data, size)
    elif compression == PACKBITS:
        raw = packbits_decode(data, size)
    else:
        raise TiffError(f"compression {compression} is not supported")
    if len(raw) < size:
        raise TiffError("a strip or tile is too short")
    return raw[:size]


def _unpredict(block: np.ndarray, predictor: int) -> np.ndarray:
    """block: rows x columns x samples in native order; a wrap-around sum undoes horizontal differencing."""
    if predictor == 1:
        return block
    if predictor == 2 and block.dtype.kind in "iu":
        return np.cumsum(block, axis=1, dtype=block.dtype)
    raise TiffError(f"predictor {predictor} is not supported for {block.dtype}")


def _unpack_bits(raw: bytes, rows: int, bits: int) -> np.ndarray:
    """Rows of samples of 1, 2 or 4 bits, the high bits first; each row begins with a byte."""
    single = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1)
    return np.packbits(single.reshape(rows, -1, bits), axis=2)[:, :, 0] >> (8 - bits)


def _float_unpredict(raw: bytes, rows: int, cols: int, samples: int, itemsize: int) -> np.ndarray:
    """Predictor 3: bytes are grouped by significance over the row and differenced."""
    b = np.frombuffer(raw, np.uint8).reshape(rows, cols * samples * itemsize)
    if samples > 1:
        b = np.cumsum(b.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, -1)
    else:
        b = np.cumsum(b, axis=1, dtype=np.uint8)
    planes = b.reshape(rows, itemsize, cols * samples).transpose(0, 2, 1)
    return np.ascontiguousarray(planes).view(f">f{itemsize}").reshape(rows, cols, samples).astype(f"=f{itemsize}")


# ---- reading


def read_pages(data: bytes, max_page_bytes: int = MAX_PAGE_BYTES) -> Iterator[Page]:
    """Every page of a classic or big TIFF, in the order of the directory chain. Raises TiffError on a fault."""
    for p in read_each(data, max_page_bytes):
        if isinstance(p, Fault):
            raise p.error
        yield p


def read_each(data: bytes, max_page_bytes: int = MAX_PAGE_BYTES) -> Iterator[Page | Fault]:
    """As read_pages, with a Fault in place of each page that cannot be decoded. Raises TiffError where the chain breaks."""
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        raise TiffError("no TIFF header")
    e = "<" if data[:2] == b"II" else ">"

    def at(fmt: str, where: int) -> tuple:
        try:
            return struct.unpack_from(e + fmt, data, where)
        except struct.error:
            raise TiffError("an offset lies outside the file") from None

    (magic,) = at("H", 2)
    if magic not in (42, 43):
        raise TiffError("no TIFF header")
    big = magic == 43
    count_fmt, offset_fmt, entry = ("Q", "Q", 20) if big else ("H", "I", 12)
    (where,) = at(offset_fmt, 8 if big else 4)
    seen, number = set(), 0
    while where:
        if where in seen:
            raise TiffError("the directory chain loops")
        seen.add(where)
        (n,) = at(count_fmt, where)
        base = where + struct.calcsize(e + count_fmt)
        tags: dict[int, tuple] = {}
        if n * entry > len(data):
            raise TiffError("a directory is longer than the file")
        try:
            for i in range(n):
                p = base + i * entry
                tag, kind = at("HH", p)
                (count,) = at(offset_fmt, p + 4)
                if kind not in FIELD_TYPES:
                    continue
                size = struct.calcsize(FIELD_TYPES[kind]) * count
                if size > len(data):
                    raise TiffError("a field is longer than the file")
                inline = p + 4 + struct.calcsize(offset_fmt)
                tags[tag] = at(f"{count}{FIELD_TYPES[kind]}", inline if size <= struct.calcsize(offset_fmt) else at(offset_fmt, inline)[0])
            page: Page | Fault = _page(data, e, tags, number, max_page_bytes)
        except TiffError as error:
            page = Fault(number, error)
        yield page
        number += 1
        (where,) = at(offset_fmt, base + n * entry)


def _page(data: bytes, e: str, tags: dict[int, tuple], number: int, max_page_bytes: int) -> Page:
    def one(tag: int, default: int | None = None) -> int:
        if tag in tags and tags[tag]:
            return tags[tag][0]
        if default is None:
            raise TiffError(f"tag {tag} is missing")
        return default

    width, height, samples, bits = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1)
    compression, predictor, planar, form = one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1), one(SAMPLE_FORMAT, 1)
    small = bits in (1, 2, 4) and form == 1 and predictor == 1
    if not small and (bits not in (8, 16, 32, 64) or form not in (1, 2, 3) or (form == 3 and bits < 32)):
        raise TiffError(f"{bits} bits of sample format {form} are not supported")
    if not width or not height or not samples:
        raise TiffError("an empty page")
    item = max(1, bits // 8)
    if width * height * samples * item > max_page_bytes:
        raise TiffError("the page is larger than the limit")
    kind = " uif"[form] + str(item)
    planes = samples if planar == 2 else 1
    depth = samples // planes
    tiled = TILE_OFFSETS in tags
    bw, bh = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    offsets, counts = (tags[TILE_OFFSETS], tags.get(TILE_COUNTS, ())) if tiled else (tags.get(STRIP_OFFSETS, ()), tags.get(STRIP_COUNTS, ()))
    if not bw or not bh or bw * bh * depth * item > max_page_bytes:
        raise TiffError("a bad strip or tile size")
    across, down = -(-width // bw), -(-height // bh)
    if len(offsets) != across * down * planes or len(counts) != len(offsets):
        raise TiffError("a wrong number of strips or tiles")
    out = np.empty((height, width, samples), kind)
    for i, (where, size) in enumerate(zip(offsets, counts, strict=True)):
        plane, j = divmod(i, across * down)
        y, x = (j // across) * bh, (j % across) * bw
        rows = bh if tiled else min(bh, height - y)
        if where + size > len(data):
            raise TiffError("a strip or tile lies outside the file")
        coded = data[where : where + size]
        if small and one(FILL_ORDER, 1) == 2:
            coded = np.packbits(np.unpackbits(np.frombuffer(coded, np.uint8)), bitorder="little").tobytes()
        raw = _unpack(coded, compression, rows * -(-bw * depth * bits // 8))
        if small:
            block = _unpack_bits(raw, rows, bits)[:, : bw * depth].reshape(rows, bw, depth)
        elif predictor == 3:
            block = _float_unpredict(raw, rows, bw, depth, item)
        else:
            block = _unpredict(np.frombuffer(raw, e + kind).reshape(rows, bw, depth).astype(f"={kind}"), predictor)
        h, w = min(rows, height - y), min(bw, width - x)
        out[y : y + h, x : x + w, plane * depth : plane * depth + depth] = block[:h, :w]
    return Page(number, width, height, samples, bits, compression, predictor, out)


# ---- writing


def write_tiff(
    pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 512, tile: tuple[int, int] | None = None, level: int = 1
) -> bytes:
    """Little-endian classic TIFF of unsigned pages (height x width or height x width x samples)."""
    out = bytearray(b"II*\x00\x00\x00\x00\x00")
    link = 4
    for page in pages:
        a = page if page.ndim == 3 else page[:, :, None]
        h, w, s = a.shape
        bh, bw = tile or (max(1, min(rows_per_strip, h)), w)
        offsets, counts = [], []
        for y in range(0, h, bh):
            for x in range(0, w, bw):
                block = a[y : y + bh, x : x + bw]
                if tile and block.shape[:2] != (bh, bw):
                    block = np.pad(block, ((0, bh - block.shape[0]), (0, bw - block.shape[1]), (0, 0)))
                if predictor == 2:
                    d = block.copy()
                    d[:, 1:] -= block[:, :-1]
                    block = d
                raw = block.astype("<" + a.dtype.str[1:]).tobytes()
                if compression == DEFLATE:
                    raw = zlib.compress(raw, level)
                elif compression == LZW:
                    raw = lzw_encode(raw)
                elif compression == PACKBITS:
                    raw = packbits_encode(raw)
                offsets.append(len(out))
                counts.append(len(raw))
                out += raw
        if len(out) % 2:
            out.append(0)
        lists = {}
        for key, values in (("o", offsets), ("c", counts)):
            if len(values) == 1:
                lists[key] = values[0]
            else:
                lists[key] = len(out)
                out += struct.pack(f"<{len(values)}I", *values)
        n = len(offsets)
        where_tags = [(TILE_WIDTH, 4, 1, bw), (TILE_HEIGHT, 4, 1, bh), (TILE_OFFSETS, 4, n, lists["o"]), (TILE_COUNTS, 4, n, lists["c"])] if tile else [(STRIP_OFFSETS, 4, n, lists["o"]), (ROWS_PER_STRIP, 4, 1, bh), (STRIP_COUNTS, 4, n, lists["c"])]
        tags = sorted([(WIDTH, 4, 1, w), (HEIGHT, 4, 1, h), (BITS, 3, 1, a.dtype.itemsize * 8), (COMPRESSION, 3, 1, compression), (PHOTOMETRIC, 3, 1, 1), (SAMPLES, 3, 1, s), (PREDICTOR, 3, 1, predictor), *where_tags])
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# ---- DataFrame operators

PAGE_SCHEMA = "id long, page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, error string"


def tiff_pages(df: DataFrame, id_col: str, media_col: str, max_page_bytes: int = MAX_PAGE_BYTES) -> DataFrame:
    """One row per page of every file in media_col; see the module's defined results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "media"):
                rows = []
                for key, media in zip(batch.column("id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                    number = 0
                    try:
                        for p in read_each(media or b"", max_page_bytes):
                            number = p.number + 1
                            if isinstance(p, Fault):
                                rows.append((key, p.number, *[None] * 7, str(p.error)))
                            else:
                                rows.append((key, p.number, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.pixels.tobytes(), None))
                    except TiffError as fault:
                        rows.append((key, number, *[None] * 7, str(fault)))
                names = [x.split()[0] for x in PAGE_SCHEMA.split(", ")]
                kinds = [pa.int64(), *[pa.int32()] * 7, pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 10, kinds, strict=True)], names)

    return df.select(df[id_col].cast("long").alias("id"), df[media_col].cast("binary").alias("media")).mapInArrow(lean(run), PAGE_SCHEMA)


#: Width of the stored pages, and rows after which a payload continues on a new page.
PAGE_WIDTH, PAGE_ROWS = 64, 16384


def store_text(text: str | None) -> tuple[int, bytes]:
    """Length of the UTF-8 text, and a TIFF that holds it padded with zeros to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
    grid = np.frombuffer(payload, np.uint8).reshape(-1, PAGE_WIDTH)
    return len(raw), write_tiff([grid[y : y + PAGE_ROWS] for y in range(0, len(grid), PAGE_ROWS)])


def page_feature(pages: list[Page]) -> str:
    """Pages, rows, mean sample (thousandths) and shares of eight brightness bands (thousandths)."""
    counts = sum(np.bincount(p.pixels.ravel(), minlength=256) for p in pages)
    n = int(counts.sum())
    bands = counts.reshape(8, 32).sum(axis=1)
    return f"{len(pages)}p{sum(p.height for p in pages)}r{int(counts @ np.arange(256)) * 1000 // n}m" + "-".join(str(int(b) * 1000 // n) for b in bands)


DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media_digests(docs: DataFrame) -> DataFrame:
    """Stores every text as TIFF, reads the stored pages back through read_pages and digests what was read."""
    import hashlib

    def digest(text: str | None) -> tuple:
        n, media = store_text(text)
        pages = list(read_pages(media))
        payload = b"".join(p.pixels.tobytes() for p in pages)
        return (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), page_feature(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for whole in batches:
            for batch in sliced(whole, "text"):
                cols = zip(*map(digest, batch.column("text").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(lean(run), DIGEST_SCHEMA)
