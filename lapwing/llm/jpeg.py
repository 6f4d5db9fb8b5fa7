"""Baseline JPEG columns: texts stored as images, and DC-only luminance thumbnails of images.

A payload byte is the brightness of an 8 x 8 block: with a DC quantizer of 8 the quantized DC is
the byte less 128 exactly, so the DC-only thumbnail of the image is the payload, byte for byte.
Every row of 64 blocks is a restart interval. Encoding and decoding run over all intervals of
a batch in step, a block at a time, in numpy.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm.common import runs, table

#: Blocks of a row; rows of an image, whose height is a 16-bit number. Longer payloads go on in a next image.
ROW, ROWS = 64, 8191
STEP = 8
#: Fixed values of the format's example tables: codes of each length for luminance DC.
DC_LENGTHS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
#: Blocks here have no AC coefficients: one code, end of block.
AC_LENGTHS = (1, *[0] * 15)
AC_SYMBOLS = (0,)
#: Bytes of texts, or of images, that are worked on at once.
RUN = 4 << 20


def _codes(lengths, symbols) -> dict[int, tuple[int, int]]:
    """Canonical codes: symbol -> (code, bits)."""
    out, code, at = {}, 0, 0
    for bits, n in enumerate(lengths, 1):
        for symbol in symbols[at : at + n]:
            out[symbol] = (code, bits)
            code += 1
        at += n
        code <<= 1
    return out


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Of each DC difference from -255 to 255: the bits of its whole block and their number."""
    dc, (eob, eob_bits) = _codes(DC_LENGTHS, DC_SYMBOLS), _codes(AC_LENGTHS, AC_SYMBOLS)[0]
    code, bits = np.zeros(511, dtype=np.uint32), np.zeros(511, dtype=np.uint32)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        c, n = dc[size]
        extra = diff if diff >= 0 else diff + (1 << size) - 1
        code[diff + 255] = ((c << size | extra) << eob_bits) | eob
        bits[diff + 255] = n + size + eob_bits
    return code, bits


_CODE, _BITS = _block_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    return (
        b"\xff\xd8" + _segment(0xDB, b"\0" + bytes([STEP] * 64)) + _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + b"\x01\x11\x00")
        + _segment(0xC4, b"\x00" + bytes(DC_LENGTHS) + bytes(DC_SYMBOLS)) + _segment(0xC4, b"\x10" + bytes(AC_LENGTHS) + bytes(AC_SYMBOLS))
        + _segment(0xDD, struct.pack(">H", ROW)) + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG stream for each payload; payloads are positive multiples of 64 bytes."""
    x = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, ROW)
    of = np.array([len(p) // ROW for p in payloads])
    images = [min(ROWS, n - at) for n in of for at in range(0, n, ROWS)]
    diff = np.empty(x.shape, dtype=np.int16)
    diff[:, 0] = x[:, 0].astype(np.int16) - 128
    np.subtract(x[:, 1:], x[:, :-1], out=diff[:, 1:], dtype=np.int16)
    symbol = (diff + 255).T.copy()
    ends = _BITS[symbol].sum(axis=0)
    width = int(ends.max() + 7) // 8 + 3
    packed = np.zeros(len(x) * width, dtype=np.uint8)
    base, at = np.arange(len(x)) * width, np.zeros(len(x), dtype=np.uint32)
    for j in range(ROW):
        code, bits = _CODE[symbol[j]], _BITS[symbol[j]]
        window = code << (24 - (at & 7) - bits)
        byte = base + (at >> 3)
        packed[byte] |= (window >> 16).astype(np.uint8)
        packed[byte + 1] |= (window >> 8).astype(np.uint8)
        packed[byte + 2] |= window.astype(np.uint8)
        at += bits
    size = ((at + 7) >> 3).astype(np.int64)
    packed[base + size - 1] |= ((1 << (size * 8 - at)) - 1).astype(np.uint8)  # ones fill the last byte
    data = packed.reshape(-1, width)[np.arange(width) < size[:, None]]
    stuffed = data == 0xFF
    # where each byte goes: after stuffed zeros, restart markers, and other images' headers and ends
    row_of = np.repeat(np.arange(len(x)), size)
    image_of = np.repeat(np.arange(len(images)), images)
    place = np.arange(len(x)) - np.repeat(np.cumsum(images) - images, images)
    head = len(_header(1))
    shift = 2 * (np.arange(len(x)) - image_of) + (head + 2) * image_of + head
    to = np.arange(len(data)) + np.cumsum(stuffed) - stuffed + shift[row_of]
    row_end = np.cumsum(size)
    out_end = row_end + np.cumsum(stuffed)[row_end - 1] + shift
    out = np.zeros(int(out_end[-1]) + 2, dtype=np.uint8)
    out[to] = data
    last = np.append(place[1:] == 0, True)
    out[out_end] = 0xFF
    out[out_end + 1] = np.where(last, 0xD9, 0xD0 + place % 8)
    stop = out_end[last] + 2
    start = np.concatenate([[0], stop[:-1]])
    for a, rows in zip(start.tolist(), images, strict=True):
        out[a : a + head] = np.frombuffer(_header(rows), dtype=np.uint8)
    last_image = np.cumsum(-(-of // ROWS)) - 1
    whole, ends = out.tobytes(), stop[last_image].tolist()
    return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


@dataclass
class _Image:
    """What the markers of one image say."""

    width: int = 0
    height: int = 0
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal and vertical sampling, quantizer
    quant: dict[int, int] = field(default_factory=dict)  # of DC only
    tables: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)  # lengths and symbols by class and id
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # id, DC and AC table
    interval: int = 0
    start: int = 0
    stop: int = 0

    def layout(self):
        """(all that must agree for images to be decoded in step)."""
        return tuple(self.scan), tuple((i, h, v) for i, h, v, _ in self.parts), tuple(sorted((k, t) for k, t in self.tables.items()))


def parse(stream: bytes, base: int, markers: np.ndarray) -> list[_Image]:
    """The images of one stream that begins at ``base`` of a batch; ``markers`` are places of markers other than restarts."""
    out, at = [], 0
    while at < len(stream):
        if stream[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        image, at = _Image(), at + 2
        while True:
            marker, n = stream[at + 1], struct.unpack_from(">H", stream, at + 2)[0]
            body, at = stream[at + 4 : at + 2 + n], at + 2 + n
            if marker == 0xDB:
                k = 0
                while k < len(body):
                    wide = body[k] >> 4
                    image.quant[body[k] & 15] = struct.unpack_from(">H", body, k + 1)[0] if wide else body[k + 1]
                    k += 1 + 64 * (1 + wide)
            elif marker == 0xC4:
                k = 0
                while k < len(body):
                    total = sum(body[k + 1 : k + 17])
                    image.tables[body[k]] = (body[k + 1 : k + 17], body[k + 17 : k + 17 + total])
                    k += 17 + total
            elif marker in (0xC0, 0xC1):
                _, image.height, image.width, parts = struct.unpack_from(">BHHB", body)
                image.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(parts)]
            elif marker == 0xDD:
                image.interval = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                image.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                break
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("not baseline")
        image.start = base + at
        image.stop = int(markers[np.searchsorted(markers, image.start)])
        at = image.stop - base + 2
        out.append(image)
    return out


def _lookup(lengths: bytes, symbols: bytes) -> np.ndarray:
    """By the next 16 bits: bits of the code and, in the low byte, its symbol."""
    out = np.zeros(1 << 16, dtype=np.uint16)
    for symbol, (code, bits) in _codes(lengths, symbols).items():
        out[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | symbol
    return out


def _decode_alike(images: list[_Image], start: np.ndarray, blocks: np.ndarray, window: np.ndarray) -> np.ndarray:
    """(interval, luminance block) DC values of images that share a layout; intervals in step, most blocks first."""
    image = images[0]
    sampled = {i: h * v for i, h, v, _ in image.parts}
    order = [(i == image.parts[0][0], _lookup(*image.tables[dc]), _lookup(*image.tables[16 | ac])) for i, dc, ac in image.scan for _ in range(sampled[i] if len(image.scan) > 1 else 1)]
    luma = sum(first for first, _, _ in order)
    by_size = np.argsort(-blocks, kind="stable")
    position, units = start[by_size] * 8, blocks[by_size]
    out = np.zeros((int(units[0]) * luma, len(units)), dtype=np.int32)

    def peek(at):
        return (window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(16)

    for mcu in range(int(units[0])):
        live = int(np.searchsorted(-units, -mcu, side="left"))
        at, k = position[:live], 0
        for first, dc, ac in order:
            entry = dc[peek(at)]
            at = at + (entry >> 8)
            size = (entry & 255).astype(np.uint32)
            if first:
                value = (peek(at) >> (np.uint32(16) - size)).astype(np.int32)
                value -= ((value << 1) >> size == 0) * ((1 << size.astype(np.int32)) - 1) * (size > 0)
                out[mcu * luma + k, :live] = value
                k += 1
            at = at + size
            todo, done = np.arange(live), np.ones(live, dtype=np.uint8)
            while len(todo):
                entry = ac[peek(at if len(todo) == live else at[todo])]
                move = (entry >> 8) + (entry & 15)
                if len(todo) == live:
                    at = at + move
                else:
                    at[todo] += move
                low = entry & 255
                if not low.any():  # every block ends here
                    break
                done[todo] = np.where(low == 0, 64, np.minimum(64, done[todo] + (low >> 4) + 1))
                todo = todo[done[todo] < 64]
        position[:live] = at
    back = np.empty_like(by_size)
    back[by_size] = np.arange(len(by_size))
    return np.cumsum(out.reshape(-1, len(units)), axis=0)[:, back].T


def thumbnails(streams: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """[(width, height, thumbnail) of each image] of each stream; a thumbnail has a pixel per luminance block."""
    whole = np.frombuffer(b"".join(streams) + b"\0" * 8, dtype=np.uint8)
    ff = np.flatnonzero(whole[:-1] == 0xFF)
    after = whole[ff + 1]
    restarts = ff[(after >= 0xD0) & (after <= 0xD7)]
    markers = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7))]
    keep = np.ones(len(whole), dtype=bool)
    keep[ff[after == 0] + 1] = False  # stuffed zeros
    plain, moved = whole[keep], np.cumsum(keep) - keep
    w = plain.astype(np.uint32)
    window = np.zeros(len(w), dtype=np.uint32)
    window[:-3] = w[:-3] << 24 | w[1:-2] << 16 | w[2:-1] << 8 | w[3:]
    found, base = [], 0
    for stream in streams:
        found.append(parse(stream, base, markers))
        base += len(stream)
    alike: dict[tuple, list[_Image]] = {}
    for image in (i for images in found for i in images):
        alike.setdefault(image.layout(), []).append(image)
    pictures: dict[int, np.ndarray] = {}
    for images in alike.values():
        starts, units, spans = [], [], []
        for image in images:
            h, v = max(p[1] for p in image.parts), max(p[2] for p in image.parts)
            if len(image.scan) == 1:
                h = v = 1
            wide, high = -(-image.width // (8 * h)), -(-image.height // (8 * v))
            own = restarts[np.searchsorted(restarts, image.start) : np.searchsorted(restarts, image.stop)]
            starts.append(np.concatenate([[image.start], own + 2]))
            each = image.interval or wide * high
            units.append(np.diff(np.append(np.arange(0, wide * high, each), wide * high)))
            spans.append((len(units[-1]), wide, high))
        dc = _decode_alike(images, moved[np.concatenate(starts)].astype(np.int64), np.concatenate(units), window)
        at = 0
        for image, (n, wide, high), own in zip(images, spans, units, strict=True):
            _, lh, lv, q = image.parts[0]
            lh, lv = (lh, lv) if len(image.scan) > 1 else (1, 1)
            rows = dc[at : at + n]
            at += n
            flat = rows.ravel() if len(set(own.tolist())) == 1 and rows.shape[1] == own[0] * lh * lv else np.concatenate([r[: k * lh * lv] for r, k in zip(rows, own, strict=True)])
            grid = flat.reshape(high, wide, lv, lh).transpose(0, 2, 1, 3).reshape(high * lv, wide * lh)
            grid = grid[: -(-image.height // 8), : -(-image.width // 8)]
            pictures[id(image)] = np.clip((grid * image.quant[q] + 4) // 8 + 128, 0, 255).astype(np.uint8)
    return [[(i.width, i.height, pictures[id(i)]) for i in images] for images in found]


def thumbnail_hash(picture: np.ndarray) -> str:
    """64 bits: of 8 bands by 9 columns of mean brightness, which column is brighter than its left neighbour."""
    rows = np.linspace(0, picture.shape[0], 9).astype(int)
    cols = np.linspace(0, picture.shape[1], 10).astype(int)
    total = np.zeros((picture.shape[0] + 1, picture.shape[1] + 1), dtype=np.int64)
    total[1:, 1:] = picture.cumsum(axis=0, dtype=np.int64).cumsum(axis=1)
    top, bottom, left, right = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1).clip(max=picture.shape[0]), cols[:-1], np.maximum(cols[1:], cols[:-1] + 1).clip(max=picture.shape[1])
    top, left = np.minimum(top, bottom - 1), np.minimum(left, right - 1)
    sums = total[np.ix_(bottom, right)] - total[np.ix_(top, right)] - total[np.ix_(bottom, left)] + total[np.ix_(top, left)]
    mean = sums / ((bottom - top)[:, None] * (right - left)[None, :])
    return np.packbits((mean[:, 1:] > mean[:, :-1]).ravel()).tobytes().hex()


def payload(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % ROW if text else ROW)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text as a JPEG stream; null counts as empty."""

    def write(batches):
        for batch in batches:
            for at, texts in runs(batch.column(1), RUN):
                n = [len(t) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), pa.array(n, pa.int64()), pa.array(encode([payload(t) for t in texts]), pa.binary())], names=["id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(write, f"id {kind}, n_bytes long, media binary")


FIELDS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def examine(media: DataFrame) -> DataFrame:
    """Reads stored streams: the payload's digests, the stream's, and as feature the dimensions and thumbnail hash of each image."""

    def read(batches):
        for batch in batches:
            for at, streams in runs(batch.column(2), RUN):
                rows = []
                for stream, images in zip(streams, thumbnails(streams), strict=True):
                    data = b"".join(p.tobytes() for _, _, p in images)
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-ROW:]), len(stream), hashlib.sha256(stream).hexdigest(), ";".join(f"{w}x{h}:{thumbnail_hash(p)}" for w, h, p in images)))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(at, len(rows)) for i in (0, 1)], *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=["id", "n_bytes", *[f.split()[0] for f in FIELDS.split(", ")]])

    kind = media.schema["id"].dataType.simpleString()
    return media.select("id", "n_bytes", "media").mapInArrow(read, f"id {kind}, n_bytes long, {FIELDS}")


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document. Null and empty texts are 64 zero bytes; equal texts give equal values;
    repeated rows keep a row each; extra columns are ignored; an empty table gives no rows."""
    return examine(store(docs, id_col, text_col)).withColumnRenamed("id", id_col)


def op6_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))
