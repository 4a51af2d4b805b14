"""Metadata out of JPEG and PNG files: parsed into parts, filtered, joined. Pixels are not touched."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_IMAGE = 50_000_000
PNG = b"\x89PNG\r\n\x1a\n"
# Parts that are metadata.
PNG_METADATA = (b"tEXt", b"zTXt", b"iTXt", b"eXIf", b"tIME")
ICC, EXIF, ORIENTATION = b"ICC_PROFILE\0", b"Exif\0\0", 0x0112


def kind_of(data: bytes) -> str | None:
    return "jpeg" if data[:3] == b"\xff\xd8\xff" else "png" if data[:4] == PNG[:4] else None


def kind_column(content: Column) -> Column:
    """kind_of without Python."""
    return F.when(F.startswith(content, F.unhex(F.lit("FFD8FF"))), F.lit("jpeg")).when(F.startswith(content, F.unhex(F.lit("89504E47"))), F.lit("png"))


def orientation_of(tiff: bytes) -> int | None:
    """2 to 8 if a TIFF block turns the image, else None."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    try:
        if order is None or struct.unpack_from(order + "H", tiff, 2)[0] != 42:
            return None
        at = struct.unpack_from(order + "I", tiff, 4)[0]
        entries = list(struct.iter_unpack(order + "HHIHxx", tiff[at + 2 : at + 2 + 12 * struct.unpack_from(order + "H", tiff, at)[0]]))
        if len(entries) < struct.unpack_from(order + "H", tiff, at)[0]:
            return None
    except struct.error:
        return None
    first = next((e for e in entries if e[0] == ORIENTATION), None)
    return first[3] if first and first[1:3] == (3, 1) and 2 <= first[3] <= 8 else None


def tiff_with(orientation: int) -> bytes:
    """The least TIFF block that says an orientation."""
    return struct.pack("<2sHIHHHIHHI", b"II", 42, 8, 1, ORIENTATION, 3, 1, orientation, 0, 0)


@dataclass
class Segment:
    """Of a JPEG: marker, all its bytes, and its payload (None for a bare marker, scan data or a rest)."""

    marker: int
    raw: bytes
    payload: bytes | None = None


#: Scan data goes on over stuffed bytes and restart markers.
SCAN = re.compile(rb"(?:[^\xff]|\xff[\x00\xd0-\xd7])*", re.S)


def segments(data: bytes) -> Iterator[Segment]:
    at, closed = 2, False
    while at < len(data) and not closed:
        if data[at] != 0xFF:
            yield Segment(0, data[at:])
            return
        if at + 1 >= len(data):
            raise ValueError("JPEG ends within a marker")
        marker = data[at + 1]
        if marker == 0x01 or 0xD0 <= marker <= 0xD9:
            closed = marker == 0xD9
            yield Segment(marker, data[at : at + 2])
            at += 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big") if at + 4 <= len(data) else 0
        if size < 2 or at + 2 + size > len(data):
            raise ValueError(f"JPEG segment at {at} goes beyond the end")
        yield Segment(marker, data[at : at + 2 + size], data[at + 4 : at + 2 + size])
        at += 2 + size
        if marker == 0xDA:
            scan = SCAN.match(data, at)
            yield Segment(0, scan[0])
            at = scan.end()
    if not closed:
        raise ValueError("JPEG ends early")


def strip_jpeg(data: bytes) -> bytes:
    """Without APP1 to APP15 and comments, but for colour profiles and the orientation."""
    if data[:2] != b"\xff\xd8" or len(data) < 4:
        raise ValueError("not a JPEG")
    parts = list(segments(data))
    profiles = [s for s in parts if s.marker == 0xE2 and s.payload and s.payload.startswith(ICC) and len(s.payload) >= len(ICC) + 2]
    numbers = sorted(s.payload[len(ICC)] for s in profiles)
    totals = {s.payload[len(ICC) + 1] for s in profiles}
    whole = len(profiles) == 1 or totals == {len(profiles)} and numbers == list(range(1, len(profiles) + 1))

    def kept(s: Segment) -> bytes:
        if not (0xE1 <= s.marker <= 0xEF or s.marker == 0xFE) or s.payload is None or whole and any(s is p for p in profiles):
            return s.raw
        turned = orientation_of(s.payload[len(EXIF) :]) if s.marker == 0xE1 and s.payload.startswith(EXIF) else None
        if turned is None:
            return b""
        payload = EXIF + tiff_with(turned)
        return b"\xff\xe1" + struct.pack(">H", len(payload) + 2) + payload

    return data[:2] + b"".join(map(kept, parts))


def png_chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def strip_png(data: bytes) -> bytes:
    """Without text, time and EXIF chunks, but for the orientation. What follows IEND goes."""
    if data[:8] != PNG:
        raise ValueError("not a PNG")
    out, at = [PNG], 8
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        end = at + 12 + size
        if end > len(data):
            raise ValueError(f"PNG chunk at {at} goes beyond the end")
        turned = orientation_of(data[at + 8 : at + 8 + size]) if kind == b"eXIf" else None
        if kind not in PNG_METADATA:
            out.append(data[at:end])
        elif turned is not None:
            out.append(png_chunk(b"eXIf", tiff_with(turned)))
        if kind == b"IEND":
            return b"".join(out)
        at = end
    raise ValueError("PNG ends without IEND")


def sanitize(data: bytes) -> tuple[str, bytes]:
    if len(data) > MAX_IMAGE:
        raise ValueError(f"image is larger than {MAX_IMAGE} bytes")
    kind = kind_of(data)
    if kind is None:
        raise ValueError("neither JPEG nor PNG")
    return kind, strip_jpeg(data) if kind == "jpeg" else strip_png(data)


SCRUBBED = T.StructType([T.StructField("kind", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("stripped_bytes", T.LongType()), T.StructField("error", T.StringType())])


def scrubbed(content: Column) -> Column:
    """kind, content, stripped_bytes of image bytes; error where they can't be read. Null is null."""

    @F.pandas_udf(SCRUBBED)
    def run(rows: pd.Series) -> pd.DataFrame:
        def one(data: bytes | None) -> tuple:
            if data is None:
                return (None, None, None, None)
            try:
                kind, clean = sanitize(bytes(data))
                return (kind, clean, len(data) - len(clean), None)
            except ValueError as e:
                return (None, None, None, str(e))

        made = pd.DataFrame([one(d) for d in rows], columns=SCRUBBED.names)
        return made.assign(stripped_bytes=made.stripped_bytes.astype("Int64"))

    return run(content)
