"""TIFF columns (operator 2): pages of images of 8-bit samples from bytes, and bytes from payloads.

``read_pages`` walks the chain of image directories, decodes PackBits, LZW or deflate strips and tiles, undoes
predictors and gives one row for each page. ``write_payload`` stores bytes losslessly as grey 8-bit pages.

``payload_features`` goes through both: texts are stored, the stored bytes are read as pages, and consecutive pages of a
row, which narrow steps keep together and in order, are described as one payload.

Defined results: a null or broken image gives one row with its error and no samples; a null text is an empty payload;
an empty payload is one row of 64 zero samples; payloads longer than a page go on in further pages; repeated rows are rows
of their own with equal values; an empty table gives no rows; extra columns of any name are left out.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import texts

ROW = 64
#: Rows of a strip and of a page that ``write_payload`` makes.
STRIP_ROWS, PAGE_ROWS = 1024, 16384
#: Fixed values of the format: bytes of a field's type; tags; compressions.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
NONE, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
#: How many bytes one byte can stand for at most, by compression: deflate's 258 for two bits, a whole LZW table of 12-bit codes.
GROWTH = {NONE: 1, LZW: 2600, DEFLATE: 1040, DEFLATE_OLD: 1040, PACKBITS: 64}


def unpack_bits(data: bytes) -> bytes:
    """PackBits: a count byte below 128 copies count+1 bytes, one above 128 repeats the next byte 257-count times."""
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 - (n == 128)
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, most significant bit first, and the width raised one code early."""
    out = bytearray()
    table: list[bytes] = []
    bits, held, width, before = 0, 0, 9, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code > len(table) or (code == len(table) and not before):
            raise ValueError(f"LZW code {code} is beyond the table")
        word = table[code] if code < len(table) else before + before[:1]
        out += word
        if before:
            table.append(before + word[:1])
        before = word
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def decode_segment(data: bytes, compression: int) -> bytes:
    """One strip or tile."""
    if compression == NONE:
        return data
    if compression in (DEFLATE, DEFLATE_OLD):
        return zlib.decompress(data)
    if compression == PACKBITS:
        return unpack_bits(data)
    if compression == LZW:
        return unpack_lzw(data)
    raise ValueError(f"compression {compression} is not supported")


def directories(media: bytes) -> Iterator[dict[int, list[int]]]:
    """The fields of each image directory along the chain."""
    order = {b"II": "<", b"MM": ">"}.get(media[:2])
    if order is None or struct.unpack_from(order + "H", media, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", media, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise ValueError("the chain of directories is a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", media, at)
        fields = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", media, at + 2 + 12 * i)
            size = TYPE_BYTES.get(kind, 1) * count
            where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", media, at + 10 + 12 * i)[0]
            if kind in (1, 3, 4):
                fields[tag] = list(struct.unpack_from(f"{order}{count}{'BHI'[kind // 2 if kind > 1 else 0]}", media, where))
        yield fields
        (at,) = struct.unpack_from(order + "I", media, at + 2 + 12 * n)


def decode_page(media: bytes, fields: dict[int, list[int]]) -> np.ndarray:
    """The samples of one page: rows x columns x samples, unsigned 8 bits."""

    def one(tag: int, default: int) -> int:
        return fields.get(tag, [default])[0]

    width, length, samples = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1)
    if any(b != 8 for b in fields.get(BITS, [8])) or width <= 0 or length <= 0:
        raise ValueError("only pages of 8-bit samples are supported")
    tiled = TILE_OFFSETS in fields
    offsets, sizes = (fields[TILE_OFFSETS], fields[TILE_BYTES]) if tiled else (fields[STRIP_OFFSETS], fields[STRIP_BYTES])
    wide, high = (one(TILE_WIDTH, width), one(TILE_LENGTH, length)) if tiled else (width, min(one(ROWS_PER_STRIP, length), length))
    apart = one(PLANAR, 1) == 2
    if min(wide, high, samples) <= 0:
        raise ValueError("tiles, strips or samples without size")
    across, down = -(-width // wide), -(-length // high)
    if len(offsets) != across * down * (samples if apart else 1):
        raise ValueError(f"{len(offsets)} strips or tiles do not make up the page")
    held = GROWTH.get(one(COMPRESSION, NONE), 1) * sum(len(media[a : a + n]) for a, n in zip(offsets, sizes, strict=True))
    if width * length * samples > held:
        raise ValueError(f"{width} x {length} x {samples} samples are more than {held} bytes, which the strips can hold at most")
    out = np.zeros((down * high, across * wide, samples), np.uint8)
    for i, (a, n) in enumerate(zip(offsets, sizes, strict=True)):
        plane, k = divmod(i, across * down)
        y, x = k // across * high, k % across * wide
        deep = 1 if apart else samples
        raw = np.frombuffer(decode_segment(media[a : a + n], one(COMPRESSION, NONE)), np.uint8)
        rows = high if tiled else min(high, length - y)
        grid = raw[: rows * wide * deep].reshape(rows, wide, deep)
        if one(PREDICTOR, 1) == 2:
            grid = np.cumsum(grid, axis=1, dtype=np.uint8)
        out[y : y + rows, x : x + wide, slice(plane, plane + 1) if apart else slice(None)] = grid
    return out[:length, :width]


def encode_payload(payload: bytes, level: int = 1) -> bytes:
    """A little-endian TIFF of grey pages, 64 samples wide, deflate strips; the payload's length divides by 64."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 8))
    rows = len(payload) // ROW
    link = 4
    for top in range(0, rows, PAGE_ROWS):
        high = min(PAGE_ROWS, rows - top)
        strips = [zlib.compress(payload[(top + y) * ROW : (top + min(y + STRIP_ROWS, high)) * ROW], level) for y in range(0, high, STRIP_ROWS)]
        at = len(out)
        struct.pack_into("<I", out, link, at)
        n, count = 9, len(strips)
        after = at + 2 + 12 * n + 4
        lists = after, after + 4 * count
        data = after + 8 * count * (count > 1)
        begins = np.cumsum([data, *map(len, strips)]).tolist()
        fields = [
            (WIDTH, 4, 1, ROW), (LENGTH, 4, 1, high), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, DEFLATE), (PHOTOMETRIC, 3, 1, 1),
            (STRIP_OFFSETS, 4, count, lists[0] if count > 1 else begins[0]), (SAMPLES, 3, 1, 1), (ROWS_PER_STRIP, 4, 1, STRIP_ROWS), (STRIP_BYTES, 4, count, lists[1] if count > 1 else len(strips[0])),
        ]
        out += struct.pack("<H", n) + b"".join(struct.pack("<HHII", *f) for f in fields) + bytes(4)
        link = after - 4
        if count > 1:
            out += struct.pack(f"<{2 * count}I", *begins[:-1], *(b - a for a, b in itertools.pairwise(begins)))
        out += b"".join(strips) + bytes(sum(map(len, strips)) % 2)
    return bytes(out)


def read_pages(images: DataFrame, key: str, media: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each page of each image: the key, page, width, height, samples, pixels; or the error. The columns to
    ``keep`` stand on every row of their image."""
    kinds = dict(images.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, of = [], []
            for i, (k, data) in enumerate(zip(batch["key"], batch["media"], strict=True)):
                try:
                    for n, fields in enumerate(directories(data if data is not None else b"")):
                        page = decode_page(data, fields)
                        rows.append((k, n, page.shape[1], page.shape[0], page.shape[2], page.tobytes(), None))
                        of.append(i)
                except (ValueError, KeyError, IndexError, TypeError, OverflowError, MemoryError, struct.error, zlib.error) as e:
                    rows.append((k, -1, 0, 0, 0, b"", str(e)[:200]))
                    of.append(i)
            out = pd.DataFrame(rows, columns=["key", "page", "width", "height", "samples", "pixels", "error"])
            yield out.assign(**{c: batch[c].to_numpy()[of] for c in keep})

    some = images.selectExpr(f"`{key}` AS key", f"`{media}` AS media", *(f"`{c}`" for c in keep))
    schema = f"key {kinds[key]}, page int, width int, height int, samples int, pixels binary, error string" + "".join(f", `{c}` {kinds[c]}" for c in keep)
    return some.mapInPandas(run, schema).withColumnRenamed("key", key)


def store_payloads(docs: DataFrame) -> DataFrame:
    """Every text as a TIFF: a number of its row, doc_id, n_bytes, media, media_bytes and media_sha256."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = [x.encode("utf-8", "surrogatepass") for x in batch["text"]]
            media = [encode_payload(x + bytes(-len(x) % ROW if x else ROW)) for x in data]
            sums = [hashlib.sha256(x).hexdigest() for x in media]
            yield pd.DataFrame({"row": batch["row"], "doc_id": batch["doc_id"], "n_bytes": list(map(len, data)), "media": media, "media_bytes": list(map(len, media)), "media_sha256": sums})

    rows = texts(docs).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInPandas(run, "row long, doc_id long, n_bytes long, media binary, media_bytes long, media_sha256 string")


def payload_features(docs: DataFrame) -> DataFrame:
    """Store every text as a TIFF, read its pages back, and describe what was read.

    doc_id, n_bytes, payload_bytes, payload_sha256 and tail_crc32 of the samples read back, media_bytes and
    media_sha256 of the file, and a feature string: pages, mean and deviation of the samples, how many of 256 values
    occur, mean step between neighbours, and the deciles of the rows' means."""

    def describe(pages: list[bytes]) -> tuple:
        back = b"".join(pages)
        grid = np.frombuffer(back, np.uint8).reshape(-1, ROW)
        count = np.bincount(grid.ravel(), minlength=256)
        n, value = grid.size, np.arange(256)
        mean = float(count @ value) / n
        spread = float(count @ (value - mean) ** 2 / n) ** 0.5
        step = float(np.abs(np.diff(grid.astype(np.int16), axis=1)).mean())
        rows = np.quantile(grid.mean(1), np.linspace(0, 1, 11))
        feature = f"pages={len(pages)};mean={mean:.4f};sd={spread:.4f};values={np.count_nonzero(count)};step={step:.4f};rows=" + ",".join(f"{x:.2f}" for x in rows)
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), feature

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, pages = None, []  # of the row whose pages may go on
        for batch in itertools.chain(batches, [None]):
            out = []
            for row in [None] if batch is None else batch.itertuples(index=False):
                if last is not None and (row is None or row.row != last.row):
                    out.append((last.doc_id, last.n_bytes, *describe(pages), last.media_bytes, last.media_sha256))
                    pages = []
                if row is not None:
                    if row.error is not None:
                        raise ValueError(f"a stored payload cannot be read: {row.error}")
                    pages.append(row.pixels)
                last = row
            out = pd.DataFrame(out, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "feature", "media_bytes", "media_sha256"])
            yield out.astype({"doc_id": "Int64"})

    pages = read_pages(store_payloads(docs), "row", "media", ("doc_id", "n_bytes", "media_bytes", "media_sha256"))
    pages = pages.select("row", "page", "pixels", "error", "doc_id", "n_bytes", "media_bytes", "media_sha256")
    out = pages.mapInPandas(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, media_bytes long, media_sha256 string")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
