"""TIFF as a column: image directories walked, strips and tiles decoded, predictors undone, one row a page.

``pages`` reads a TIFF from bytes: either byte order, a chain of image directories, strips or tiles, no
compression, PackBits, LZW or deflate, the horizontal predictor, 8 or 16 bits a sample, samples of a pixel together.
``encode`` writes such files, so that a payload can be stored losslessly and read back.

Defined cases: a null file has no pages; a file cut short, or with a loop in its directories or a feature not named
here, raises ValueError in ``pages`` and gives one row with ``error`` in ``tiff_pages``. Repeated rows are read
alike; a very long payload takes more pages; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags, and the compressions known here.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPES = {1: "B", 3: "H", 4: "I"}
CLEAR, END = 256, 257


def unpack_bits(data: bytes) -> bytes:
    """Undo PackBits."""
    out, i, n = [], 0, len(data)
    while i < n:
        k = data[i]
        if k < 128:
            out.append(data[i + 1 : i + 2 + k])
            i += k + 2
        else:
            if k > 128:
                out.append(data[i + 1 : i + 2] * (257 - k))
            i += 2 if k > 128 else 1
    return b"".join(out)


def pack_bits(data: bytes) -> bytes:
    """PackBits, with runs of three or more equal bytes as repeats."""
    a = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero(np.diff(a.astype(np.int16), prepend=-1))
    lengths = np.diff(starts, append=len(a))
    out, at = [], 0

    def literal(end: int) -> None:
        for i in range(at, end, 128):
            part = data[i : min(end, i + 128)]
            out.append(bytes([len(part) - 1]) + part)

    long = lengths >= 3
    for start, n in zip(starts[long].tolist(), lengths[long].tolist(), strict=True):
        literal(start)
        byte = data[start : start + 1]
        while n:
            k = min(n, 128) if n != 129 else 127
            out.append(bytes([257 - k]) + byte)
            n -= k
            start += k
        at = start
    literal(len(data))
    return b"".join(out)


def unpack_lzw(data: bytes) -> bytes:
    """Undo LZW: codes of 9 to 12 bits, high bits first, which widen one code early."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    out: list[bytes] = []
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    # the k-th code after a clear has a width that depends on k alone
    widths = np.repeat([9, 10, 11, 12], [254, 512, 1024, 4096])
    at = 0
    while at + 9 <= len(bits):
        ends = at + np.cumsum(widths)
        n = int(np.searchsorted(ends, len(bits), side="right"))
        codes = np.zeros(n, np.int64)
        for w in (9, 10, 11, 12):
            (own,) = np.nonzero(widths[:n] == w)
            if len(own):
                lo = ends[own[0]] - w
                codes[own] = bits[lo : lo + w * len(own)].reshape(-1, w) @ (1 << np.arange(w - 1, -1, -1))
        stop = np.flatnonzero((codes == CLEAR) | (codes == END))
        n = int(stop[0]) if len(stop) else n
        table, last = base.copy(), b""
        for code in codes[:n].tolist():
            if code < len(table):
                text = table[code]
            elif code == len(table) and last:
                text = last + last[:1]
            else:
                raise ValueError("LZW code out of range")
            if last:
                table.append(last + text[:1])
            out.append(text)
            last = text
        if not len(stop) or codes[n] == END:
            break
        at = int(ends[n])
    return b"".join(out)


def _width(size: int) -> int:
    """Bits of the next code when the writer's table has ``size`` entries."""
    return 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12


def pack_lzw(data: bytes) -> bytes:
    """LZW with a clear code at the start and whenever the table is full."""
    codes, widths = [CLEAR], [9]
    table, size, last = {bytes([i]): i for i in range(256)}, 258, b""
    fresh = table.copy()
    for i in range(len(data)):
        text = last + data[i : i + 1]
        if text in table:
            last = text
            continue
        codes.append(table[last])
        widths.append(_width(size))
        table[text] = size
        size += 1
        if size == 4094:
            codes.append(CLEAR)
            widths.append(12)
            table, size = fresh.copy(), 258
        last = data[i : i + 1]
    if last:
        codes.append(table[last])
        widths.append(_width(size))
        size += 1
    codes.append(END)
    widths.append(_width(size))
    c, w = np.array(codes), np.array(widths)
    ends = np.cumsum(w)
    bits = np.zeros(ends[-1], np.uint8)
    for k in range(12):  # the bit of value 2**k of every code that has one
        has = w > k
        bits[ends[has] - 1 - k] = c[has] >> k & 1
    return np.packbits(bits).tobytes()


UNPACK = {NONE: bytes, PACKBITS: unpack_bits, LZW: unpack_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress}
PACK = {NONE: bytes, PACKBITS: pack_bits, LZW: pack_lzw, DEFLATE: lambda b: zlib.compress(b, 1)}


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple[int, ...]], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind in TYPES:
            form = order + str(count) + TYPES[kind]
            where = at + 10 + 12 * i
            if struct.calcsize(form) > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            tags[tag] = struct.unpack_from(form, data, where)
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, tags: dict[int, tuple[int, ...]], order: str) -> np.ndarray:
    width, height, samples = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
    bits, compression, predictor = tags.get(BITS, (1,))[0], tags.get(COMPRESSION, (NONE,))[0], tags.get(PREDICTOR, (1,))[0]
    if bits not in (8, 16) or len({*tags.get(BITS, ())}) != 1 or compression not in UNPACK or predictor not in (1, 2) or samples > 1 and tags.get(PLANAR, (1,))[0] != 1:
        raise ValueError("a kind of TIFF that is not read here")
    kind = np.dtype(order + "u" + str(bits // 8))
    tiled = TILE_OFFSETS in tags
    if tiled:
        bw, bh, offsets, counts = tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0], tags[TILE_OFFSETS], tags[TILE_COUNTS]
    else:
        bw, bh, offsets, counts = width, min(height, tags.get(ROWS_PER_STRIP, (height,))[0]), tags[STRIP_OFFSETS], tags[STRIP_COUNTS]
    across = -(-width // bw)
    if len(offsets) < across * -(-height // bh):
        raise ValueError("blocks are missing")
    out = np.empty((height, width, samples), kind.newbyteorder("="))
    for i in range(across * -(-height // bh)):
        y, x = i // across * bh, i % across * bw
        rows = bh if tiled else min(bh, height - y)
        raw = UNPACK[compression](data[offsets[i] : offsets[i] + counts[i]])
        block = np.frombuffer(raw, kind, rows * bw * samples).reshape(rows, bw, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        out[y : y + bh, x : x + bw] = block[: height - y, : width - x]
    return out


def pages(data: bytes) -> Iterator[tuple[dict[int, tuple[int, ...]], np.ndarray]]:
    """Tags and samples (height, width, samples of a pixel) of each page."""
    try:
        order = {b"II": "<", b"MM": ">"}[data[:2]]
        magic, at = struct.unpack_from(order + "HI", data, 2)
        if magic != 42:
            raise ValueError("not a TIFF")
        seen = set()
        while at:
            if at in seen:
                raise ValueError("directories form a loop")
            seen.add(at)
            tags, at = _directory(data, at, order)
            yield tags, _page(data, tags, order)
    except (KeyError, struct.error, zlib.error, IndexError) as e:
        raise ValueError(f"damaged TIFF: {e!r}") from e


def encode(images: list[np.ndarray], compression: list[int], *, predictor: list[int], tile: list[int], order: str = "<") -> bytes:
    """A TIFF of grey images (2-D, 8 bits); ``tile`` 0 stands for strips of 64 rows."""
    parts, at, heads = [struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8)], 8, []
    for image, kind, differ, side in zip(images, compression, predictor, tile, strict=True):
        height, width = image.shape
        bh, bw = (side, side) if side else (64, width)
        blocks = []
        for y in range(0, height, bh):
            for x in range(0, width, bw):
                block = image[y : y + bh, x : x + bw]
                if side:
                    block = np.pad(block, ((0, bh - block.shape[0]), (0, bw - block.shape[1])))
                if differ == 2:
                    block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
                blocks.append(PACK[kind](np.ascontiguousarray(block).tobytes()))
        entries = [(WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (8,)), (COMPRESSION, 3, (kind,)), (PHOTOMETRIC, 3, (1,)), (SAMPLES, 3, (1,))]
        offsets, counts = (TILE_OFFSETS, TILE_COUNTS) if side else (STRIP_OFFSETS, STRIP_COUNTS)
        entries += [(TILE_WIDTH, 3, (side,)), (TILE_HEIGHT, 3, (side,))] if side else [(ROWS_PER_STRIP, 4, (bh,))]
        entries += [(PREDICTOR, 3, (differ,))] if differ == 2 else []
        heads.append((sorted([*entries, (offsets, 4, ()), (counts, 4, tuple(map(len, blocks)))]), offsets, blocks))
    for k, (entries, offsets, blocks) in enumerate(heads):
        body = at + 2 + 12 * len(entries) + 4
        extra = body
        for tag, _, values in entries:
            extra += 4 * len(blocks) if tag in (offsets, COUNTS[offsets]) and len(blocks) > 1 else 0
        places, where = [], extra
        for b in blocks:
            places.append(where)
            where += len(b) + len(b) % 2
        packed, tail, more = [struct.pack(order + "H", len(entries))], body, []
        for tag, kind, values in entries:
            values = tuple(places) if tag == offsets else values
            raw = struct.pack(order + str(len(values)) + TYPES[kind], *values)
            if len(raw) > 4:
                more.append(raw)
                packed.append(struct.pack(order + "HHII", tag, kind, len(values), tail))
                tail += len(raw)
            else:
                packed.append(struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        packed.append(struct.pack(order + "I", where if k + 1 < len(heads) else 0))
        parts += [*packed, *more, *(b + b"\0" * (len(b) % 2) for b in blocks)]
        at = where
    return b"".join(parts)


COUNTS = {STRIP_OFFSETS: STRIP_COUNTS, TILE_OFFSETS: TILE_COUNTS}
ROW, PAGE_ROWS = 192, 512


def store(payload: bytes) -> bytes:
    """A payload of a positive multiple of 192 bytes as a TIFF of pages of up to 512 rows of 192 samples.

    The crc of a page decides its form: one page in eight is LZW, two are PackBits, the others deflate with the
    predictor; half of them are tiled.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    images = [rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)]
    crcs = [zlib.crc32(x.tobytes()) for x in images]
    kinds = [(LZW, PACKBITS, PACKBITS, *[DEFLATE] * 5)[c % 8] for c in crcs]
    return encode(images, kinds, predictor=[2 if k == DEFLATE else 1 for k in kinds], tile=[64 if c >> 3 & 1 and len(x) >= 64 else 0 for c, x in zip(crcs, images, strict=True)])


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    return data.ljust(max(1, -(-len(data) // ROW)) * ROW, b" ")


def media_row(text: str | None) -> tuple:
    """Digests and features of a text's payload, from the stored bytes read back."""
    n = len((text or "").encode())
    media = store(payload_of(text))
    digest, kinds, total, edges, tail, size, count = hashlib.sha256(), [], 0, 0, b"", 0, 0
    for tags, image in pages(media):
        raw = image.tobytes()
        digest.update(raw)
        size += len(raw)
        tail = (tail + raw)[-16:]
        total += int(image.sum(dtype=np.int64))
        edges += int(np.count_nonzero(image[1:] != image[:-1]))
        count += 1
        kinds.append("t" if TILE_WIDTH in tags else "s")
    feature = f"pages={count};form={kinds[0]}{kinds[-1]};mean={total / size:.6f};edges={edges}"
    return n, size, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature


def media_digests(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text stored as a TIFF and read back: one row a document."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for pdf in batches:
            rows = pd.DataFrame(list(map(media_row, pdf["text"])), columns=names)
            rows.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield rows

    kind = dict(source.dtypes)["doc_id"]
    return source.mapInPandas(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def tiff_pages(files: DataFrame, *, key: str, media: str) -> DataFrame:
    """One row a page of each file: key, page, width, height, samples, bits, compression, tiled, data, error."""
    source = files.select(F.col(key).alias("key"), F.col(media).alias("media"))
    names = ["key", "page", "width", "height", "samples", "bits", "compression", "tiled", "data", "error"]

    def run(batches):
        for pdf in batches:
            for k, data in zip(pdf["key"], pdf["media"], strict=True):
                page = 0
                try:
                    for page, (tags, image) in enumerate(pages(bytes(data)) if data is not None else ()):
                        h, w, s = image.shape
                        yield pd.DataFrame([(k, page, w, h, s, tags[BITS][0], tags.get(COMPRESSION, (NONE,))[0], TILE_WIDTH in tags, image.tobytes(), None)], columns=names)
                except ValueError as e:
                    yield pd.DataFrame([(k, page, None, None, None, None, None, None, None, str(e))], columns=names).astype({c: "Int64" for c in names[2:7]})

    kind = dict(source.dtypes)["key"]
    return source.mapInPandas(run, f"key {kind}, page int, width int, height int, samples int, bits int, compression int, tiled boolean, data binary, error string")
