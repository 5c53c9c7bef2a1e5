"""Width and height of encoded images from their headers; no pixel is decoded."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

# Markers of JPEG frames: C0 to CF without the tables C4, C8 and CC.
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}


def jpeg_size(raw: bytes) -> tuple[int, int] | None:
    """(width, height) of the first frame; segments before it are skipped by their length."""
    at = 2
    while at + 9 <= len(raw) and raw[at] == 0xFF:
        marker = raw[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD7:
            at += 2
        elif marker in FRAMES:
            return int.from_bytes(raw[at + 7 : at + 9], "big"), int.from_bytes(raw[at + 5 : at + 7], "big")
        else:
            at += 2 + int.from_bytes(raw[at + 2 : at + 4], "big")
    return None


def _jpeg_sizes(content: pa.Array) -> pa.Array:
    found = (jpeg_size(v.as_py()) if v.is_valid else None for v in content)
    return pa.array([None if s is None else {"width": s[0], "height": s[1]} for s in found], pa.struct([("width", pa.int64()), ("height", pa.int64())]))


def _number(content: Column, start: int, size: int, little: bool) -> Column:
    """Unsigned number of ``size`` bytes from the 1-based place ``start``."""
    places = range(start + size - 1, start - 1, -1) if little else range(start, start + size)
    digits = F.concat(*[F.hex(F.substring(content, p, 1)) for p in places])
    return F.conv(digits, 16, 10).cast("bigint")


def image_size(content: Column) -> Column:
    """Struct of width and height of PNG, GIF, BMP and JPEG bytes; null for others and for headers cut short."""
    magic = F.hex(F.substring(content, 1, 8))
    is_jpeg = magic.startswith("FFD8FF")
    jpeg = arrow_udf(_jpeg_sizes, "struct<width:bigint,height:bigint>")(F.when(is_jpeg, content))
    # A BMP counts its rows below zero if they run top down.
    rows = _number(content, 23, 4, True)
    rows = F.when(rows >= 1 << 31, (1 << 32) - rows).otherwise(rows)
    pair = lambda width, height: F.struct(width.alias("width"), height.alias("height"))
    size = (
        F.when(magic == "89504E470D0A1A0A", pair(_number(content, 17, 4, False), _number(content, 21, 4, False)))
        .when(magic.startswith("47494638"), pair(_number(content, 7, 2, True), _number(content, 9, 2, True)))
        .when(magic.startswith("424D"), pair(_number(content, 19, 4, True), rows))
        .when(is_jpeg, jpeg)
    )
    return F.when((F.length(content) >= 26) | is_jpeg, size)
