"""Media columns: Netpbm and BMP codecs on numpy, area resizing by integral images, NPY tiles, difference hashes.

``decode`` reads P1-P6 (ASCII and raw, 8- and 16-bit) and uncompressed BMP of 1, 4, 8, 24 and 32 bits.
``area_resize`` takes exact area means: every output pixel is a difference of four values of the
summed-area table, linearly interpolated at fractional edges. Only the rows under one band of output
rows are summed at a time, so a tall image never needs a table of its own full size.

Defined cases: a null text is the empty text (one padded row); equal texts give equal values; repeated
rows are kept as they are; extra columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, whole_text

#: One stored row: 64 pixels of three 8-bit samples.
ROW_BYTES, ROW_PIXELS = 192, 64
#: Difference hash: 8 rows of 8 comparisons between 9 columns.
HASH_ROWS, HASH_COLS = 8, 8


# ---------------------------------------------------------------- Netpbm
def encode_ppm(pixels: np.ndarray) -> bytes:
    """P6 for (h, w, 3), P5 for (h, w); 8-bit samples."""
    h, w = pixels.shape[:2]
    kind = b"P6" if pixels.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, w, h) + np.ascontiguousarray(pixels, dtype=np.uint8).tobytes()


def _netpbm_fields(data: bytes, count: int) -> tuple[list[int], int]:
    """The header's numbers after the magic, and where they end; # comments run to the line's end."""
    values, at = [], 2
    while len(values) < count:
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == 0x23):
            if data[at] == 0x23:
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            at += 1
        start = at
        while at < len(data) and 0x30 <= data[at] <= 0x39:
            at += 1
        if start == at:
            raise ValueError("broken Netpbm header")
        values.append(int(data[start:at]))
    return values, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """(h, w) or (h, w, 3); uint8, or uint16 where the maximum is over 255. Bitmaps give 0 for black and 255 for white."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    bitmap = kind in (b"P1", b"P4")
    fields, at = _netpbm_fields(data, 2 if bitmap else 3)
    w, h = fields[:2]
    top = 1 if bitmap else fields[2]
    if w < 1 or h < 1 or not 1 <= top <= 65535:
        raise ValueError("broken Netpbm header")
    depth = 3 if kind in (b"P3", b"P6") else 1
    need = h * w * depth
    if kind in (b"P1", b"P2", b"P3"):
        body = b"\n".join(line.split(b"#", 1)[0] for line in data[at:].split(b"\n"))
        if kind == b"P1":
            digits = np.frombuffer(body, np.uint8)
            samples = digits[(digits == 0x30) | (digits == 0x31)] - 0x30
        else:
            samples = np.array(body.split(), dtype=np.int64)
        samples = samples[:need]
    else:
        at += 1  # the single white space after the header
        if kind == b"P4":
            stride = (w + 7) // 8
            rows = np.frombuffer(data, np.uint8, count=stride * h, offset=at).reshape(h, stride)
            samples = np.unpackbits(rows, axis=1)[:, :w].reshape(-1)
        else:
            samples = np.frombuffer(data, np.uint8 if top < 256 else ">u2", count=need, offset=at)
    if samples.size != need:
        raise ValueError("Netpbm data is cut short")
    if bitmap:
        samples = (1 - samples) * 255
    out = samples.astype(np.uint8 if top < 256 else np.uint16)
    return out.reshape((h, w, 3) if depth == 3 else (h, w))


# ---------------------------------------------------------------- BMP
def encode_bmp(pixels: np.ndarray) -> bytes:
    """Uncompressed 24-bit bottom-up BMP of an (h, w, 3) RGB array of 8-bit samples."""
    h, w = pixels.shape[:2]
    stride = (w * 3 + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : w * 3] = pixels[::-1, :, ::-1].reshape(h, w * 3)
    head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """(h, w, 3) uint8 of an uncompressed BMP; a negative height means top-down rows."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    start, size = struct.unpack_from("<II", data, 10)
    w, h, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
    colours = struct.unpack_from("<I", data, 46)[0]
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32) or w < 1 or h == 0:
        raise ValueError("BMP form is not supported")
    if packing == 3 and (bits != 32 or struct.unpack_from("<III", data, 54) != (0xFF0000, 0xFF00, 0xFF)):
        raise ValueError("BMP form is not supported")
    tall = abs(h)
    stride = (w * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, count=stride * tall, offset=start).reshape(tall, stride)
    if bits >= 24:
        step = bits // 8
        out = rows[:, : w * step].reshape(tall, w, step)[:, :, 2::-1]
    else:
        table = np.frombuffer(data, np.uint8, count=4 * (colours or 1 << bits), offset=14 + size).reshape(-1, 4)[:, 2::-1]
        if bits == 8:
            index = rows[:, :w]
        elif bits == 4:
            index = np.stack([rows >> 4, rows & 15], axis=2).reshape(tall, -1)[:, :w]
        else:
            index = np.unpackbits(rows, axis=1)[:, :w]
        out = table[index]
    return np.ascontiguousarray(out[::-1] if h > 0 else out)


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


# ---------------------------------------------------------------- resizing
def area_resize(gray: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Exact area means of an (h, w) array, as float64 (rows, cols), through summed-area tables."""
    h, w = gray.shape
    ys, xs = np.arange(rows + 1) * (h / rows), np.arange(cols + 1) * (w / cols)
    x0 = np.minimum(xs.astype(np.int64), w - 1)
    fx = xs - x0
    out = np.empty((rows, cols))
    for r in range(rows):
        top, low = ys[r], ys[r + 1]
        first, last = min(int(top), h - 1), min(int(np.ceil(low)), h)
        band = gray[first:last].astype(np.int64)
        table = np.zeros((band.shape[0] + 1, w + 1), np.int64)
        np.cumsum(np.cumsum(band, axis=0), axis=1, out=table[1:, 1:])

        def line(y: float, table: np.ndarray = table, first: int = first) -> np.ndarray:
            at = min(int(y - first), table.shape[0] - 2)
            part = y - first - at
            row = table[at] + part * (table[at + 1] - table[at])
            return row[x0] + fx * (row[x0 + 1] - row[x0])

        edge = line(low) - line(top)
        out[r] = (edge[1:] - edge[:-1]) / ((low - top) * (w / cols))
    return out


def to_gray(pixels: np.ndarray) -> np.ndarray:
    """Sum of the channels' integer weights 299, 587, 114 for colour; single-channel samples times 1000."""
    if pixels.ndim == 2:
        return pixels.astype(np.int32) * 1000
    return pixels[:, :, 0].astype(np.int32) * 299 + pixels[:, :, 1].astype(np.int32) * 587 + pixels[:, :, 2].astype(np.int32) * 114


def difference_hash(pixels: np.ndarray) -> tuple[str, np.ndarray]:
    """16 hex digits, a bit for each left-to-right rise in the 8 x 9 area means, and those means as a uint8 tile."""
    means = area_resize(to_gray(pixels), HASH_ROWS, HASH_COLS + 1)
    bits = (means[:, 1:] > means[:, :-1] + 1e-9).reshape(-1)
    return np.packbits(bits).tobytes().hex(), np.clip(np.rint(means / 1000), 0, 255).astype(np.uint8)


def npy_tile(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(tile), version=(1, 0), allow_pickle=False)
    return out.getvalue()


# ---------------------------------------------------------------- operator
def text_payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 padded with blanks to a positive multiple of 192 bytes, and the length before padding."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // ROW_BYTES)) * ROW_BYTES, b" "), len(raw)


def store_payload(payload: bytes, form: str = "ppm") -> bytes:
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, ROW_PIXELS, 3)
    return encode_bmp(pixels) if form == "bmp" else encode_ppm(pixels)


def media_columns(docs: DataFrame, form: str = "ppm", keep_media: bool = False) -> DataFrame:
    """Store each text as an image, read the stored bytes back, and return the media's features.

    ``feature`` is the difference hash and ``tile`` the NPY bytes of the resized image. With
    ``keep_media`` the stored bytes come along as ``media``. One pass, no shuffle.
    """

    def make():
        def step(cols):
            for doc_id, text in zip(*cols, strict=True):
                payload, n_bytes = text_payload(text)
                media = store_payload(payload, form)
                pixels = decode(media)
                back = pixels.tobytes()
                feature, tile = difference_hash(pixels)
                row = (doc_id, n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, npy_tile(tile))
                yield (*row, media) if keep_media else row

        return step

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"
    return map_rows(docs.select(F.col("doc_id").cast("long"), whole_text()), schema + (", media binary" if keep_media else ""), make, 500)
