"""Media columns: TIFF files, read by their image directories; one row per page.

Strips and tiles, stored plain or by PackBits, LZW or deflate, with or without the horizontal predictor, in either byte
order and either order of bits, with interleaved or separate planes, of samples of 1, 2, 4, 8, 16 or 32 bits.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the TIFF 6.0 format: tags, compression schemes, field types with their struct codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANES = 256, 257, 258, 259, 262, 266, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPES = {1: "B", 3: "H", 4: "I"}


def unpack_bits(data: bytes, most: int | None = None) -> bytes:
    """Stops once there are `most` bytes."""
    out, at = bytearray(), 0
    while at < len(data) and (most is None or len(out) < most):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more equal bytes as repeats, the rest as they are."""
    samples = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(samples)) + 1
    starts, ends = np.append(0, edges), np.append(edges, len(data))
    long = np.flatnonzero(ends - starts > 2)
    out, at = bytearray(), 0
    for start, end in [*zip(starts[long].tolist(), ends[long].tolist()), (len(data), len(data))]:
        for a in range(at, start, 128):
            part = data[a : min(a + 128, start)]
            out.append(len(part) - 1)
            out += part
        for n in [128] * ((end - start) // 128) + [(end - start) % 128]:
            if n:
                out += bytes(((257 - n) & 255, data[start])) if n > 1 else bytes((0, data[start]))
        at = end
    return bytes(out)


CLEAR, END = 256, 257
#: Codes after a CLEAR until the table is full, and the length of each; it grows one code early.
SEGMENT = 4094 - 258
#: Codes that make the table's entries whole; further ones, up to the next CLEAR, repeat entries.
TABLE = 4096 - 258 + 1
LENGTHS = np.select([np.arange(SEGMENT + 1) < n for n in (512 - 258, 1024 - 258, 2048 - 258)], [9, 10, 11], 12)


def lzw_codes(data: bytes):
    """Runs of codes, each up to the next CLEAR or END; codes are 9 to 12 bits long, first bit highest."""
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.int64)
    bit, last, length = 0, 8 * len(data), LENGTHS
    while bit + 9 <= last:
        first = np.cumsum(length) - length
        n = int(np.searchsorted(first + length, last - bit, side="right"))
        at = bit + first[:n]
        byte = at >> 3
        window = (raw[byte] << 16) | (raw[byte + 1] << 8) | raw[byte + 2]
        codes = (window >> (24 - (at & 7) - length[:n])) & ((1 << length[:n]) - 1)
        stops = np.flatnonzero((codes == CLEAR) | (codes == END))
        if not len(stops) and n == len(length):  # no CLEAR although the table is full
            length = np.append(length, np.full(2 * len(length), 12))
            continue
        stop = int(stops[0]) if len(stops) else n
        if stop:
            yield codes[:stop]
        if stop == n or codes[stop] == END:
            return
        bit, length = bit + int(first[stop] + length[stop]), LENGTHS


def lzw_run(codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes of a run of codes that starts with a fresh table, and where each code's bytes start.

    The table's entry 258 + i is what code i stands for and the first byte of the next one, so that each byte of the
    output is another one further ahead, or a literal: the literals are found by following all bytes at once.
    """
    n = len(codes)
    parent = codes - 258
    if n and (parent >= np.arange(n)).any():
        raise ValueError("an LZW code beyond the table")
    length, up = np.ones(n, np.int64), np.where(parent >= 0, parent, n)
    length[parent < 0] = 0
    up, length = np.append(up, n), np.append(length, 0)
    while (up < n).any():
        length, up = length + length[up], up[up]
    length = length[:n] + 1
    start = np.cumsum(length) - length
    owner = np.repeat(np.arange(n), length)
    place = np.arange(len(owner)) - start[owner]
    literal, of = (parent < 0)[owner], np.maximum(parent, 0)[owner]
    source = np.where(place < length[of], start[of] + place, start[np.minimum(of + 1, n - 1)])
    source[literal] = np.flatnonzero(literal)
    while (further := source[source]).tobytes() != source.tobytes():
        source = further
    return codes[owner].astype(np.uint8)[source].tobytes(), start


def lzw_decode(data: bytes, most: int | None = None) -> bytes:
    """Stops after the run of codes that reaches `most` bytes; a run that makes a table is at most some MB."""
    out, size = [], 0
    for codes in lzw_codes(data):
        made, start = lzw_run(codes[:TABLE])
        out.append(made)
        size += len(made)
        for code in codes[TABLE:].tolist():
            if most is not None and size >= most:
                break
            out.append(bytes((code,)) if code < 256 else made[start[code - 258] : start[code - 257] + 1])
            size += len(out[-1])
        if most is not None and size >= most:
            break
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    codes, table, size, before = [CLEAR], {}, 258, data[0] if data else None
    put, find = codes.append, table.get
    for c in data[1:]:
        longer = before << 8 | c
        known = find(longer)
        if known is not None:
            before = known
            continue
        put(before)
        table[longer] = size
        size += 1
        if size == 4094:
            put(CLEAR)
            table.clear()
            size = 258
        before = c
    if data:
        put(before)
    codes.append(END)
    code = np.array(codes, ">u2")
    # A CLEAR is as long as its place after the former one says; the first is 9 bits long.
    clears = np.flatnonzero(code == CLEAR)
    place = np.arange(len(code)) - clears[np.searchsorted(clears, np.arange(len(code))) - 1] - 1
    place[0] = 0
    bits = np.unpackbits(code.view(np.uint8)).reshape(-1, 16)
    return np.packbits(bits[np.arange(16) >= 16 - LENGTHS[place][:, None]]).tobytes()


#: Bytes of samples of a page, and of a strip or tile, beyond which a page is refused: what a task has to hold at once.
MOST_BYTES = 1 << 28

#: Each byte with its bits in reverse.
REVERSED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8), bitorder="little")).tobytes()


def inflated(scheme: int, data: bytes, most: int) -> bytes:
    if scheme == PLAIN:
        return data
    if scheme in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, most)
    if scheme == LZW:
        return lzw_decode(data, most)
    if scheme == PACKBITS:
        return unpack_bits(data, most)
    raise ValueError(f"compression {scheme}")


def directories(data: bytes):
    """(byte order, tags) of each image directory; a chain that comes back to a directory ends there."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4]) != (42,):
        raise ValueError("not a TIFF file")
    (at,), seen = struct.unpack(order + "I", data[4:8]), set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind in TYPES:
                form = f"{order}{count}{TYPES[kind]}"
                place = at + 10 + 12 * i
                tags[tag] = struct.unpack_from(form, data, place if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", data, place)[0])
        yield order, tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def samples_of(raw: bytes, rows: int, row: int, bits: int, item: np.dtype) -> np.ndarray:
    """The samples of a strip or tile, by row; those of less than a byte are taken out of their bytes, first bit highest."""
    if bits >= 8:
        return np.frombuffer(raw, item, rows * row).reshape(rows, row)
    packed = np.frombuffer(raw, np.uint8, rows * -(-row * bits // 8)).reshape(rows, -1)
    parts = [packed >> shift & (1 << bits) - 1 for shift in range(8 - bits, -1, -bits)]
    return np.stack(parts, axis=2).reshape(rows, -1)[:, :row]


def page_samples(data: bytes, order: str, tags: dict, most: int = MOST_BYTES) -> tuple[dict, bytes]:
    """What the directory says, and the page's samples by row, in the machine's byte order; those below a byte have one each."""
    one = lambda tag, other: tags.get(tag, (other,))[0]
    width, height, samples, bits = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1)
    scheme, predictor, planes = one(COMPRESSION, PLAIN), one(PREDICTOR, 1), one(PLANES, 1)
    info = {"width": width, "height": height, "bits": bits, "samples": samples, "compression": scheme, "predictor": predictor}
    if bits not in (1, 2, 4, 8, 16, 32) or len(set(tags.get(BITS, ()))) > 1 or predictor not in (1, 2) or bits < 8 and predictor == 2:
        raise ValueError(f"{' '.join(map(str, tags.get(BITS, (1,))[:8]))} bits with predictor {predictor}")
    per_pixel = samples if planes == 1 else 1
    tiled = TILE_OFFSETS in tags
    if tiled:
        w, h, offsets, counts = one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0), tags[TILE_OFFSETS], tags[TILE_COUNTS]
    else:
        w, h, offsets, counts = width, min(height, one(ROWS_PER_STRIP, height)), tags[STRIP_OFFSETS], tags[STRIP_COUNTS]
    if min(width, height, samples, w, h) < 1:
        raise ValueError("a page without samples")
    item = np.dtype("u1") if bits <= 8 else np.dtype(f"{order}u{bits // 8}")
    row = w * per_pixel
    if max(height * width * samples, h * row) * item.itemsize > most:
        raise ValueError(f"a page of over {most} bytes")
    across, down = -(-width // w), -(-height // h)
    parts = across * down * (samples // per_pixel)
    if min(len(offsets), len(counts)) < parts:
        raise ValueError("strips or tiles are missing")
    out = np.zeros((height, width, samples), item.newbyteorder("="))
    for i, (offset, count) in enumerate(zip(offsets[:parts], counts)):
        plane, place = divmod(i, across * down)
        y, x = place // across * h, place % across * w
        rows = h if tiled else min(h, height - y)
        size = rows * (-(-row * bits // 8))
        stored = data[offset : offset + count]
        raw = inflated(scheme, stored.translate(REVERSED) if one(FILL_ORDER, 1) == 2 else stored, size)
        if len(raw) < size:
            raise ValueError("a strip or tile is too short")
        part = samples_of(raw, rows, row, bits, item).astype(out.dtype).reshape(rows, w, per_pixel)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=out.dtype)
        into = out[y : y + h, x : x + w]
        into[:, :, plane : plane + per_pixel] = part[: into.shape[0], : into.shape[1]]
    return info, out.tobytes()


def write_tiff(pages: list[np.ndarray], scheme: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 256, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A file of pages (height, width[, samples]) of 8-bit or 16-bit samples."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    squeeze = {PLAIN: bytes, DEFLATE: lambda x: zlib.compress(x, 1), OLD_DEFLATE: lambda x: zlib.compress(x, 1), LZW: lzw_encode, PACKBITS: pack_bits}[scheme]
    for page in pages:
        page = page if page.ndim == 3 else page[:, :, None]
        height, width, samples = page.shape
        w, h = tile or (width, min(rows_per_strip, height))
        offsets, counts = [], []
        for y in range(0, height, h):
            for x in range(0, width, w):
                part = page[y : y + h, x : x + w]
                if tile:
                    part = np.pad(part, ((0, h - part.shape[0]), (0, w - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
                stored = squeeze(part.astype(part.dtype.newbyteorder(order)).tobytes())
                offsets.append(len(out))
                counts.append(len(stored))
                out += stored + b"\0" * (len(stored) % 2)
        tags = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8 * page.dtype.itemsize] * samples), (COMPRESSION, 3, [scheme]), (PHOTOMETRIC, 3, [1 if samples < 3 else 2]), (SAMPLES, 3, [samples]), (PLANES, 3, [1]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 4, [w]), (TILE_HEIGHT, 4, [h]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [h]), (STRIP_COUNTS, 4, counts)]
        entries, at = b"", len(out)
        extra, beyond = b"", at + 2 + 12 * len(tags) + 4
        for tag, kind, values in sorted(tags):
            body = struct.pack(f"{order}{len(values)}{TYPES[kind]}", *values)
            entries += struct.pack(order + "HHI", tag, kind, len(values))
            if len(body) <= 4:
                entries += body.ljust(4, b"\0")
            else:
                entries += struct.pack(order + "I", beyond + len(extra))
                extra += body + b"\0" * (len(body) % 2)
        struct.pack_into(order + "I", out, link, at)
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += struct.pack(order + "I", 0) + extra
    return bytes(out)


PAGE_COLUMNS = "page long, width long, height long, bits long, samples long, compression long, predictor long, data binary, error string"


def pages_of(data: bytes | None, most: int = MOST_BYTES):
    """(page, facts, samples, error) of each page; of what can't be read, one row that says why."""
    page = 0
    try:
        for order, tags in directories(data or b""):
            yield page, *page_samples(data, order, tags, most), None
            page += 1
    except (ValueError, struct.error, zlib.error, KeyError, IndexError, OverflowError, MemoryError) as e:
        yield page, {}, None, str(e)[:200] or type(e).__name__


def tiff_pages(media: DataFrame, key: str = "doc_id", column: str = "media", most: int = MOST_BYTES) -> DataFrame:
    """One row per page of each TIFF file in a binary column: key, page and PAGE_COLUMNS.

    A null, empty or damaged file gives the pages up to the damage and a row with an error; a file without directories
    gives none. A page of more than `most` bytes of samples, however small its file, is such a row with an error. Keys
    that repeat are files of their own; other columns play no part.
    """

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys = batch.column(0).slice(i, 1)
                for page, facts, data, error in pages_of(batch.column(1)[i].as_py(), most):
                    rest = [pa.array([facts.get(x)], pa.int64()) for x in ("width", "height", "bits", "samples", "compression", "predictor")]
                    yield pa.RecordBatch.from_arrays([keys, pa.array([page], pa.int64()), *rest, pa.array([data], pa.binary()), pa.array([error], pa.string())], names=[key, *(x.split()[0] for x in PAGE_COLUMNS.split(", "))])

    return media.select(key, column).mapInArrow(run, f"{key} {media.schema[key].dataType.simpleString()}, {PAGE_COLUMNS}")


# ---- texts as pictures

UNIT, PAGE_ROWS = 64, 4096
SCHEMES = (LZW, PACKBITS, DEFLATE, OLD_DEFLATE)


def stored(text: bytes) -> bytes:
    """A text's bytes as a grey picture of 64 samples a row, with rows of 0 behind, in pages of at most 4096 rows.

    The text's checksum decides, whatever its size, on scheme, predictor, strips or tiles, and byte order; equal texts,
    equal files.
    """
    samples = np.frombuffer(text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b"\0"), np.uint8).reshape(-1, UNIT)
    pages = [samples[a : a + PAGE_ROWS] for a in range(0, len(samples), PAGE_ROWS)]
    kind = zlib.crc32(text)
    tile = (32, min(256, -(-len(samples) // 16) * 16)) if kind >> 3 & 1 else None
    return write_tiff(pages, SCHEMES[kind & 3], 1 + (kind >> 2 & 1), 1024, tile, "<>"[kind >> 4 & 1])


def feature(samples: np.ndarray, pages: int) -> str:
    """Pages, mean, deviation, and eight shares of the samples by brightness."""
    shares = np.bincount(samples >> 5, minlength=8) / len(samples)
    return ";".join([f"pages={pages}", f"mean={samples.mean():.3f}", f"std={samples.std():.3f}", "hist=" + ",".join(f"{x:.4f}" for x in shares)])


MEDIA_COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_batches(batches):
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        for rows in (batch.slice(a, 500) for a in range(0, batch.num_rows, 500)):
            out = []
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).cast(pa.binary()).to_pylist()):
                media = stored(text)
                parts = []
                for _, _, data, error in pages_of(media):
                    if error:
                        raise ValueError(error)
                    parts.append(data)
                payload = b"".join(parts)
                out.append((doc, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(np.frombuffer(payload, np.uint8), len(parts))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in MEDIA_COLUMNS.split(", ")])


def text_media(docs: DataFrame) -> DataFrame:
    """Each whole text stored as a TIFF file, read back page by page, and described: MEDIA_COLUMNS.

    A null text counts as empty and is stored as 64 bytes 0. Equal texts have equal files; rows that repeat are rows of
    their own; other columns play no part. An empty table gives no rows.
    """
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(media_batches, MEDIA_COLUMNS)
