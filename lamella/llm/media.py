"""TIFF pages in a media column: a reader that walks image directories, and the writer that makes its test material.

The reader takes a binary column and emits one row a page: it follows the chain of directories in either byte order,
decodes strips or tiles (uncompressed, PackBits, LZW or deflate), undoes the horizontal predictor, and cuts tiles to
the image. Work is per file, in the tasks that read it; nothing is shuffled. Samples of 8, 16 or 32 bits with all
channels together are read; separate planes, 1, 2 or 4 bits, predictor 3 and 64-bit files are errors.

Cases: a null or unreadable value gives one row with page null and `error` set, whatever is wrong with it; so does a file
without pages. Pages before the first bad one are emitted, the error's row comes after them, and later pages are not
read. No more memory is taken than a page's stored bytes can unpack to: a page that declares more is an error;
empty texts are one row of zeros when stored; equal bytes give equal rows; other columns pass through under their own
names (`page`, `width`, `height`, `samples`, `compression`, `data` and `error` are replaced if they were there).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lamella.llm.common import gathered, materialise, rows

#: Fixed values of the format: tags, field sizes and compression codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 284, 317, 322, 323, 324, 325
FIELDS = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 16: ("Q", 8)}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, END = 256, 257


def unpack_bits(data: bytes, most: int) -> bytes:
    """The bytes of runs and literals, until `most` are there."""
    out, i, size = [], 0, 0
    while i < len(data) and size < most:
        n = data[i]
        if n < 128:
            out.append(data[i + 1 : i + 2 + n])
            size += n + 1
            i += n + 2
        else:
            if n > 128:
                out.append(data[i + 1 : i + 2] * (257 - n))
                size += 257 - n
            i += 2 if n > 128 else 1
    return b"".join(out)


def pack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while run < 128 and i + run < len(data) and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i
        while j < len(data) and j - i < 128 and not (j + 2 < len(data) and data[j] == data[j + 1] == data[j + 2]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def unpack_lzw(data: bytes, most: int) -> bytes:
    """Codes of 9 to 12 bits, high bit first, until `most` bytes are there; the width grows one code early, as the format has it."""
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, last, width, held, bits, size = list(start), [], b"", 9, 0, 0, 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == CLEAR:
            table, last, width = list(start), b"", 9
            continue
        if code == END or size >= most:
            break
        if code > len(table) or (code == len(table) and not last):
            raise ValueError(f"LZW code {code} where the table has {len(table)}")
        entry = table[code] if code < len(table) else last + last[:1]
        if last:
            if len(table) < 1 << 12:
                table.append(last + entry[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(entry)
        size += len(entry)
        last = entry
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    start = {bytes([i]): i for i in range(256)}
    table, count, width, held, bits, out = dict(start), 258, 9, CLEAR, 9, bytearray()
    word = b""

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = count
        count += 1
        if count > (1 << width) - 1 and width < 12:
            width += 1
        if count >= 4094:
            put(CLEAR)
            table, count, width = dict(start), 258, 9
        word = data[i : i + 1]
    if word:
        put(table[word])
        count += 1
        if count > (1 << width) - 1 and width < 12:
            width += 1
    put(END)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def inflate(data: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(data, most)


DECODE = {NONE: lambda b, most: b, LZW: unpack_lzw, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: unpack_bits}
#: Bytes that one stored byte can unpack to at most: a run of 128 in two; an entry of 4,096 in a code of nine bits; 1,032 in deflate.
GROWTH = {NONE: 1, LZW: 4096, DEFLATE: 1032, OLD_DEFLATE: 1032, PACKBITS: 64}
ENCODE = {NONE: bytes, LZW: pack_lzw, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: pack_bits}


def _directories(raw: bytes) -> Iterator[dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack(order + "I", raw[4:8])
    seen = set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", raw, at)
        found: dict = {"order": order}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
            if kind not in FIELDS:
                continue
            code, size = FIELDS[kind]
            place = at + 10 + 12 * i
            if size * count > 4:
                (place,) = struct.unpack_from(order + "I", raw, place)
            if place + size * count > len(raw):
                raise ValueError(f"field {tag} lies beyond the file")
            found[tag] = struct.unpack_from(f"{order}{count * len(code)}{code[0]}", raw, place)
        yield found
        (at,) = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)


def _undo_predictor(block: np.ndarray) -> np.ndarray:
    """Rows of differences from the sample on the left, per channel (rows x width x channels)."""
    return np.cumsum(block.astype(np.uint64), axis=1).astype(block.dtype)


def _page(raw: bytes, d: dict[int, tuple]) -> tuple[int, int, int, int, bytes]:
    width, height, channels = d[WIDTH][0], d[HEIGHT][0], d.get(SAMPLES, (1,))[0]
    bits, how, predictor = max(d.get(BITS, (1,))), d.get(COMPRESSION, (NONE,))[0], d.get(PREDICTOR, (1,))[0]
    if min(d.get(BITS, (1,))) != bits or bits not in (8, 16, 32) or how not in DECODE or predictor not in (1, 2) or d.get(PLANAR, (1,))[0] != 1:
        raise ValueError(f"unsupported: {bits} bits, compression {how}, predictor {predictor}")
    kind = np.dtype(f"{d['order']}u{bits // 8}")
    tiled = TILE_OFFSETS in d
    w, h = (d[TILE_WIDTH][0], d[TILE_HEIGHT][0]) if tiled else (width, min(height, d.get(ROWS_PER_STRIP, (height,))[0]))
    offsets, counts = (d[TILE_OFFSETS], d[TILE_COUNTS]) if tiled else (d[STRIP_OFFSETS], d[STRIP_COUNTS])
    if min(width, height, channels, w, h) < 1:
        raise ValueError("a side or the number of samples is 0")
    across = -(-width // w)
    if len(offsets) != len(counts) or len(offsets) != across * -(-height // h):
        raise ValueError("strips or tiles do not fill the page")
    if any(o + c > len(raw) for o, c in zip(offsets, counts, strict=True)):
        raise ValueError("a strip or tile lies beyond the file")
    tall = [h if tiled else min(h, height - i // across * h) for i in range(len(offsets))]
    sizes = [t * w * channels * kind.itemsize for t in tall]
    if any(size > GROWTH[how] * c for size, c in zip(sizes, counts, strict=True)):
        raise ValueError("a strip or tile declares more than it can hold")
    image = np.zeros((height, width, channels), kind)
    for i, (o, c, size) in enumerate(zip(offsets, counts, sizes, strict=True)):
        y, x = i // across * h, i % across * w
        block = np.frombuffer(DECODE[how](raw[o : o + c], size), kind, size // kind.itemsize).reshape(tall[i], w, channels)
        if predictor == 2:
            block = _undo_predictor(block)
        image[y : y + tall[i], x : x + w] = block[: height - y, : width - x]
    return width, height, channels, how, image.tobytes()


#: What reading a broken file can raise.
BROKEN = (ValueError, LookupError, TypeError, ArithmeticError, MemoryError, struct.error, zlib.error)


def pages(raw: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    """Width, height, channels, compression code and samples of each page of one file."""
    for directory in _directories(raw):
        yield _page(raw, directory)


def read_pages(df: DataFrame, media: str = "media") -> DataFrame:
    """One row a page: the other columns of df, then page, width, height, samples, compression, data, error."""
    own = ["page", "width", "height", "samples", "compression", "data", "error"]
    others = [c for c in df.columns if c not in (*own, media)]
    schema = T.StructType([*df.select(*others).schema, *(T.StructField(c, T.IntegerType()) for c in own[:5]), T.StructField("data", T.BinaryType()), T.StructField("error", T.StringType())])
    arrow = to_arrow_schema(schema)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for *rest, raw in rows(batches, *others, media):
            n = 0
            try:
                for found in pages(raw or b""):
                    yield *rest, n, *found, None
                    n += 1
                if not n:
                    yield *rest, *[None] * 6, "no page"
            except BROKEN as e:
                yield *rest, *[None] * 6, f"{type(e).__name__}: {e}"[:200]

    return df.select(*others, media).mapInArrow(lambda b: gathered(made(b), arrow, lambda r: len(r[-2] or b"")), schema)


def write_tiff(payload: bytes, width: int = 64, rows_per_page: int = 4096, rows_per_strip: int = 512, compression: int = DEFLATE, predictor: int = 1, tile: int = 0, order: str = "<") -> bytes:
    """An 8-bit grey file of pages of `width` columns; with `tile`, pages hold square tiles of that side."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for top in range(0, len(image), rows_per_page):
        page = image[top : top + rows_per_page]
        height = len(page)
        if tile:
            padded = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile), np.uint8)
            padded[:height, :width] = page
            blocks = [padded[y : y + tile, x : x + tile] for y in range(0, len(padded), tile) for x in range(0, padded.shape[1], tile)]
        else:
            blocks = [page[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        stored = []
        for b in blocks:
            if predictor == 2:
                b = np.concatenate([b[:, :1], np.diff(b, axis=1)], axis=1)
            stored.append(ENCODE[compression](np.ascontiguousarray(b).tobytes()))
        offsets = []
        for s in stored:
            offsets.append(len(out))
            out += s + b"\0" * (len(s) % 2)
        places, sizes = (TILE_OFFSETS, TILE_COUNTS) if tile else (STRIP_OFFSETS, STRIP_COUNTS)
        fields = {WIDTH: [width], HEIGHT: [height], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor], places: offsets, sizes: [len(s) for s in stored]}
        fields |= {TILE_WIDTH: [tile], TILE_HEIGHT: [tile]} if tile else {ROWS_PER_STRIP: [rows_per_strip]}
        far = {}
        for tag, values in fields.items():
            if len(values) > 1:
                far[tag] = len(out)
                out += struct.pack(f"{order}{len(values)}I", *values)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields))
        for tag, values in sorted(fields.items()):
            out += struct.pack(order + "HHII", tag, 4, len(values), far.get(tag, values[0]))
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


#: The forms of storage: LZW strips, PackBits strips in the other byte order, deflate strips with differences, deflate tiles.
FORMS = [
    {"compression": LZW, "rows_per_page": 1024, "rows_per_strip": 64},
    {"compression": PACKBITS, "rows_per_page": 1024, "rows_per_strip": 128, "order": ">"},
    {"compression": DEFLATE, "rows_per_page": 1024, "rows_per_strip": 256, "predictor": 2},
    {"compression": DEFLATE, "rows_per_page": 256, "tile": 64},
]


def store_text(text: str) -> bytes:
    """A text as a file: UTF-8, zeros up to a positive multiple of 64, one sample a byte, 64 columns.

    One of the FORMS, by a checksum of the payload: each takes a quarter of the texts of every size.
    """
    raw = text.encode()
    payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
    return write_tiff(payload, **FORMS[zlib.crc32(payload) % len(FORMS)])


def stored_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, media_bytes, media_sha256 of every whole text, written to the shared folder."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for doc_id, text in rows(batches, "doc_id", "text"):
            media = store_text(text or "")
            yield doc_id, len((text or "").encode()), media, len(media), hashlib.sha256(media).hexdigest()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = slim.mapInArrow(lambda b: gathered(made(b), schema, lambda r: r[3]), "doc_id long, n_bytes long, media binary, media_bytes long, media_sha256 string")
    return materialise(found.withColumn("uid", F.monotonically_increasing_id()), "media")


def page_features(paged: DataFrame) -> DataFrame:
    """Per document, from its pages as they come out of its task: payload size and digests, and a feature text.

    The feature names pages, the mean and deviation of the samples, and the strongest of 16 brightness classes.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        uid = own = None
        for *key, page, data, error in rows(batches, "uid", "doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "data", "error"):
            if error:
                raise ValueError(f"document {key[1]}: {error}")
            if key[0] != uid:
                if own:
                    yield closed(own)
                uid, own = key[0], {"key": key, "sha": hashlib.sha256(), "n": 0, "tail": b"", "pages": 0, "hist": np.zeros(256, np.int64)}
            own["sha"].update(data)
            own["n"] += len(data)
            own["tail"] = (own["tail"] + data[-64:])[-64:]
            own["pages"] += 1
            own["hist"] += np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        if own:
            yield closed(own)

    def closed(own: dict) -> tuple:
        _, doc_id, n_bytes, media_bytes, sha = own["key"]
        h, level = own["hist"], np.arange(256)
        mean = float(h @ level) / own["n"]
        dev = max(0.0, float(h @ level**2) / own["n"] - mean**2) ** 0.5
        classes = h.reshape(16, 16).sum(axis=1)
        return doc_id, n_bytes, own["n"], own["sha"].hexdigest(), zlib.crc32(own["tail"]), media_bytes, sha, f"pages={own['pages']};mean={mean:.3f};sd={dev:.3f};class={int(classes.argmax())}"

    return paged.mapInArrow(lambda b: gathered(made(b), schema, lambda r: 300), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
