"""Checks of uploaded files by their headers: sizes of images and numbers of pages, from a few byte ranges of each file.

Files are listed by Spark without their contents; tasks read the ranges that a header asks for, by ``open_ranges``.
Nothing is decoded. Image sizes come from the headers of PNG, JPEG, BMP and TIFF, a PDF's pages from the
count at the root of its page tree, by cross-reference tables or streams.

Defined cases: a cut or foreign file is malformed, an empty one too, but Spark lists none that is empty; a PDF that is encrypted still tells its pages where its
page tree isn't in an object stream; a file that can't be opened has the error unreadable; bytes read of one
file are at most ``MOST`` whatever its size.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

# Limits, and the extension of a content type where the name has none.
MAX_PAGES, MAX_PIXELS = 100, 40_000_000
CONTENT_TYPES = {"application/pdf": ".pdf", "image/png": ".png", "image/jpeg": ".jpg", "image/tiff": ".tiff"}
#: Bytes read of one file at most, and of a PDF's object or stream.
MOST, CHUNK = 8 << 20, 1 << 16

Read = Callable[[int, int], bytes]


class Malformed(ValueError):
    """A header that doesn't say what it should."""


# ---------------------------------------------------------------- images
def png_size(read: Read) -> tuple[int, int]:
    head = read(0, 24)
    if len(head) < 24 or head[12:16] != b"IHDR":
        raise Malformed("png")
    return struct.unpack(">II", head[16:24])


def bmp_size(read: Read) -> tuple[int, int]:
    head = read(14, 12)
    if len(head) < 12:
        raise Malformed("bmp")
    width, height = struct.unpack("<HH", head[4:8]) if head[:4] == b"\x0c\0\0\0" else struct.unpack("<ii", head[4:12])
    return width, abs(height)


def jpeg_size(read: Read) -> tuple[int, int]:
    """From the first frame header; the segments before it are stepped over."""
    at = 2
    for _ in range(1000):
        mark = read(at, 9)
        if len(mark) < 4 or mark[0] != 0xFF:
            break
        if mark[1] == 0xFF or mark[1] in (0x01, *range(0xD0, 0xD8)):
            at += 1 if mark[1] == 0xFF else 2
        elif mark[1] in range(0xC0, 0xD0) and mark[1] not in (0xC4, 0xC8, 0xCC):
            if len(mark) < 9:
                break
            height, width = struct.unpack(">HH", mark[5:9])
            return width, height
        elif mark[1] in (0xD9, 0xDA):
            break
        else:
            at += 2 + struct.unpack(">H", mark[2:4])[0]
    raise Malformed("jpeg")


def tiff_size(read: Read) -> tuple[int, int]:
    head = read(0, 8)
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(head[:4])
    if order is None or len(head) < 8:
        raise Malformed("tiff")
    start = struct.unpack(order + "I", head[4:])[0]
    count = read(start, 2)
    if len(count) < 2:
        raise Malformed("tiff")
    entries, found = read(start + 2, 12 * struct.unpack(order + "H", count)[0]), {}
    for at in range(0, len(entries) - 11, 12):
        tag, kind = struct.unpack(order + "HH", entries[at : at + 4])
        if tag in (256, 257):
            found[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), entries[at + 8 : at + (10 if kind == 3 else 12)])[0]
    if len(found) < 2:
        raise Malformed("tiff")
    return found[256], found[257]


# ---------------------------------------------------------------- PDF
def inflated(dictionary: bytes, data: bytes) -> bytes:
    """A stream's bytes, at most ``MOST`` of them; the rows of a predictor are undone."""
    if b"/FlateDecode" in dictionary:
        try:
            data = zlib.decompressobj().decompress(data, MOST)
        except zlib.error as e:
            raise Malformed("stream") from e
    predictor, columns = (re.search(rb"/%s\s+(\d+)" % k, dictionary) for k in (b"Predictor", b"Columns"))
    if predictor is None or int(predictor[1]) < 10:
        return data
    width, out, above = int(columns[1]) if columns else 1, bytearray(), b""
    for at in range(0, len(data) - width, width + 1):
        row = bytearray(data[at + 1 : at + 1 + width])
        if data[at] == 2:
            row = bytearray((x + y) & 255 for x, y in zip(row, above or bytes(width), strict=True))
        elif data[at] == 1:
            for i in range(1, width):
                row[i] = (row[i] + row[i - 1]) & 255
        above = bytes(row)
        out += row
    return bytes(out)


def stream_at(read: Read, at: int) -> tuple[bytes, bytes]:
    """The dictionary and the bytes of the stream object at a place."""
    head = read(at, CHUNK)
    begin = head.find(b"stream")
    if begin < 0:
        raise Malformed("stream")
    dictionary = head[:begin]
    start = begin + 6 + (2 if head[begin + 6 : begin + 8] == b"\r\n" else 1)
    length = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", dictionary)
    size = min(MOST, int(length[1])) if length else MOST
    data = head[start : start + size]
    if len(data) < size and len(head) == CHUNK:
        data += read(at + len(head), size - len(data))
    return dictionary, inflated(dictionary, data)


def pdf_pages(read: Read, size: int) -> int:
    """The count of the page tree's root. Sections of the cross-reference are followed from the last one back."""
    if read(0, 5) != b"%PDF-":
        raise Malformed("pdf")
    tail = read(max(0, size - 2048), 2048)
    found = re.findall(rb"startxref\s+(\d+)", tail)
    if not found:
        raise Malformed("pdf")
    at, seen, places, root = int(found[-1]), set(), {}, None
    while at is not None and at not in seen and len(seen) < 64:
        seen.add(at)
        head = read(at, CHUNK)
        if head.lstrip()[:4] == b"xref":
            body, spot = head, head.find(b"xref") + 4
            while (section := re.compile(rb"\s*(\d+)\s+(\d+)\s*?\r?\n?").match(body, spot)) and b"trailer" not in body[spot : section.end()]:
                first, count = int(section[1]), int(section[2])
                start = section.end() + len(re.compile(rb"\s*").match(body, section.end())[0])
                need = start + 20 * count + 4096
                if need > len(body):
                    body += read(at + len(body), min(MOST, need - len(body)))
                for k in range(count):
                    entry = body[start + 20 * k : start + 20 * k + 18]
                    if entry[17:18] == b"n":
                        places.setdefault(first + k, (1, int(entry[:10]), 0))
                spot = start + 20 * count
            dictionary = body[spot : spot + 4096]
        else:
            dictionary, data = stream_at(read, at)
            widths = re.search(rb"/W\s*\[\s*(\d+)\s+(\d+)\s+(\d+)\s*\]", dictionary)
            if widths is None:
                raise Malformed("xref")
            w = [int(x) for x in widths.groups()]
            total = re.search(rb"/Size\s+(\d+)", dictionary)
            index = re.search(rb"/Index\s*\[([\d\s]*)\]", dictionary)
            spans = [int(x) for x in index[1].split()] if index else [0, int(total[1]) if total else 0]
            spot = 0
            for first, count in zip(spans[::2], spans[1::2], strict=False):
                for k in range(count):
                    parts = [int.from_bytes(data[spot + sum(w[:i]) : spot + sum(w[: i + 1])], "big") for i in range(3)]
                    kind = parts[0] if w[0] else 1
                    if kind in (1, 2):
                        places.setdefault(first + k, (kind, parts[1], parts[2]))
                    spot += sum(w)
        named = re.search(rb"/Root\s+(\d+)\s+\d+\s+R", dictionary)
        root = root if root is not None else int(named[1]) if named else None
        before = re.search(rb"/Prev\s+(\d+)", dictionary)
        beside = re.search(rb"/XRefStm\s+(\d+)", dictionary)
        at = int(beside[1]) if beside and int(beside[1]) not in seen else int(before[1]) if before else None

    def object_(n: int) -> bytes:
        kind, place, inside = places.get(n, (0, 0, 0))
        if kind == 1:
            return read(place, 4096).partition(b"endobj")[0]
        if kind == 2 and places.get(place, (0,))[0] == 1:
            dictionary, data = stream_at(read, places[place][1])
            first = int(re.search(rb"/First\s+(\d+)", dictionary)[1])
            numbers = [int(x) for x in data[:first].split()]
            starts = dict(zip(numbers[::2], numbers[1::2], strict=False))
            later = sorted(x for x in starts.values() if x > starts.get(n, -1))
            return data[first + starts[n] : first + later[0] if later else None] if n in starts else b""
        return b""

    tree = re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", object_(root)) if root is not None else None
    count = re.search(rb"/Count\s+(\d+)", object_(int(tree[1]))) if tree else None
    if count is None:
        raise Malformed("pdf")
    return int(count[1])


# ---------------------------------------------------------------- files
SIZES = {"png": png_size, "jpg": jpeg_size, "jpeg": jpeg_size, "bmp": bmp_size, "tif": tiff_size, "tiff": tiff_size}


def open_ranges(path: str) -> Read:
    """Reads byte ranges of a file that the task's machine can reach: by the operating system, or by Arrow's file systems."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if path.startswith("/"):
        held = open(path, "rb")  # noqa: SIM115  closed with the task's reference
    else:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        held = system.open_input_file(inner)

    def read(at: int, n: int) -> bytes:
        held.seek(at)
        return held.read(n)

    return read


def facts(path: str, length: int, extension: str, max_pages: int, max_pixels: int, opened: Callable[[str], Read] = open_ranges) -> tuple:
    """(width, height, pages, bytes_read, error) of a file."""
    taken, width, height, pages, error = 0, None, None, None, None

    def counted(at: int, n: int) -> bytes:
        nonlocal taken
        n = max(0, min(n, length - at, MOST - taken))
        data = inner(at, n) if n else b""
        taken += len(data)
        return data

    try:
        inner = opened(path)
        if extension == "pdf":
            pages = pdf_pages(counted, length)
            error = "no_pages" if not pages else "too_many_pages" if pages > max_pages else None
        elif extension in SIZES:
            width, height = SIZES[extension](counted)
            error = "too_many_pixels" if width * height > max_pixels else "malformed" if width * height == 0 else None
        else:
            error = "unsupported_extension"
    except OSError:
        error = "unreadable"
    except (Malformed, ValueError, TypeError, IndexError, struct.error):
        error = "malformed"
    return width, height, pages, taken, error


def check_files(spark: SparkSession, path: str, max_pages: int = MAX_PAGES, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """(path, length, extension, width, height, pages, bytes_read, error) of the files under a path; error is null for accepted ones."""
    ship(spark)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("extension"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for b in batches:
            rows = [facts(*row, max_pages, max_pixels) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["path", "length", "extension", "width", "height", "pages", "bytes_read", "error"])

    return listed.mapInArrow(run, "path string, length long, extension string, width long, height long, pages long, bytes_read long, error string")


def extension_of(name: Column, content_type: Column) -> Column:
    """The name's extension in lower case with its point, else that of the content type, else empty."""
    suffix = F.lower(F.regexp_extract(F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/\\]*)$", 1), r"^.+(\.[^.]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv])
    return F.coalesce(F.nullif(suffix, F.lit("")), F.try_element_at(known, content_type), F.lit(""))
