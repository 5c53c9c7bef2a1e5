"""Colour-space conversions on 8-bit channels, as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .numeric import delta_e

# sRGB (D65) to XYZ rows already divided by the white point, and the CIE constants.
XYZ_ROWS = (
    (0.412453, 0.357580, 0.180423),
    (0.212671, 0.715160, 0.072169),
    (0.019334, 0.119193, 0.950227),
)
WHITE = (0.950456, 1.0, 1.088754)
LAB_CUT = 0.008856
LAB_SLOPE = 7.787


def byte(value: Column) -> Column:
    """Round half-even and saturate to 0..255."""
    return F.least(F.greatest(F.bround(value, 0), F.lit(0.0)), F.lit(255.0)).cast("int")


def _linear(channel: Column) -> Column:
    v = channel / 255.0
    return F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92)


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """8-bit CIELAB: L scaled by 255/100, a and b shifted by 128."""
    lr, lg, lb = _linear(r), _linear(g), _linear(b)
    x, y, z = [
        (lr * row[0] + lg * row[1] + lb * row[2]) / white
        for row, white in zip(XYZ_ROWS, WHITE, strict=True)
    ]
    fx, fy, fz = [
        F.when(v > LAB_CUT, F.cbrt(v)).otherwise(v * LAB_SLOPE + 16.0 / 116.0) for v in (x, y, z)
    ]
    lightness = F.when(y > LAB_CUT, F.cbrt(y) * 116.0 - 16.0).otherwise(y * 903.3)
    return (
        byte(lightness * 255.0 / 100.0),
        byte((fx - fy) * 500.0 + 128.0),
        byte((fy - fz) * 200.0 + 128.0),
    )


def rgb_to_hls(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """8-bit HLS: hue halved to 0..180, lightness and saturation scaled to 255."""
    rf, gf, bf = r / 255.0, g / 255.0, b / 255.0
    top, low = F.greatest(rf, gf, bf), F.least(rf, gf, bf)
    spread, both = top - low, top + low
    saturation = (
        F.when(spread <= 0.0, F.lit(0.0))
        .when(both < 1.0, spread / both)
        .otherwise(spread / (2.0 - both))
    )
    hue = (
        F.when(spread <= 0.0, F.lit(0.0))
        .when(top == rf, (gf - bf) / spread * 60.0)
        .when(top == gf, (bf - rf) / spread * 60.0 + 120.0)
        .otherwise((rf - gf) / spread * 60.0 + 240.0)
    )
    hue = F.when(hue < 0.0, hue + 360.0).otherwise(hue)
    return byte(hue / 2.0), byte(both / 2.0 * 255.0), byte(saturation * 255.0)


def hls_to_rgb(h: Column, l: Column, s: Column) -> tuple[Column, Column, Column]:
    light, sat = l / 255.0, s / 255.0
    high = F.when(light <= 0.5, light * (sat + 1.0)).otherwise(light + sat - light * sat)
    low = light * 2.0 - high

    def channel(shift: float) -> Column:
        sector = F.pmod(h * 2.0 / 60.0 + shift, F.lit(6.0))
        return byte(
            255.0
            * F.when(sector < 1.0, low + (high - low) * sector)
            .when(sector < 3.0, high)
            .when(sector < 4.0, low + (high - low) * (4.0 - sector))
            .otherwise(low)
        )

    return channel(2.0), channel(0.0), channel(-2.0)


def _lab_rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, 3)


def _delta(first: pa.Array, second: pa.Array) -> pa.Array:
    return pa.array(delta_e(_lab_rows(first), _lab_rows(second)))


def ciede2000_lab(first: Column, second: Column) -> Column:
    """CIEDE2000 distance in [0, 1] of two LAB array columns without nulls.

    As a plain expression the formula's shared terms multiply beyond what code generation takes; one
    Arrow call per batch evaluates each term once.  Declared non-deterministic only to keep the
    optimiser from evaluating it twice.
    """
    call = arrow_udf(_delta, "double").asNondeterministic()
    return call(first.cast("array<double>"), second.cast("array<double>"))


def hex_color(r: Column, g: Column, b: Column) -> Column:
    """``#rrggbb`` of mean channels, rounding halves up."""
    return F.format_string("#%02x%02x%02x", *[F.floor(c + 0.5).cast("int") for c in (r, g, b)])
