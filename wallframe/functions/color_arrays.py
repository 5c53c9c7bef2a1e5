"""The conversions of ``color`` on arrays of 8-bit pixels (rows of three channels), for Arrow functions."""

from __future__ import annotations

import numpy as np

from .color import LAB_CUT, LAB_SLOPE, WHITE, XYZ_ROWS


def _byte(value: np.ndarray) -> np.ndarray:
    return np.clip(np.round(value), 0, 255).astype(np.uint8)


def cut_byte(value: np.ndarray) -> np.ndarray:
    """Saturate and truncate."""
    return np.floor(np.clip(value, 0.0, 255.0)).astype(np.uint8)


_LEVELS = np.arange(256) / 255.0
LINEAR = np.where(_LEVELS > 0.04045, ((_LEVELS + 0.055) / 1.055) ** 2.4, _LEVELS / 12.92)


def lab8(rgb: np.ndarray) -> np.ndarray:
    linear = LINEAR[rgb]
    x, y, z = [(linear[:, 0] * a + linear[:, 1] * b + linear[:, 2] * c) / white for (a, b, c), white in zip(XYZ_ROWS, WHITE, strict=True)]
    fx, fy, fz = [np.where(v > LAB_CUT, np.cbrt(v), v * LAB_SLOPE + 16.0 / 116.0) for v in (x, y, z)]
    lightness = np.where(y > LAB_CUT, np.cbrt(y) * 116.0 - 16.0, y * 903.3)
    return np.stack([_byte(lightness * 255.0 / 100.0), _byte((fx - fy) * 500.0 + 128.0), _byte((fy - fz) * 200.0 + 128.0)], axis=1)


def hls8(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb / 255.0).T
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    spread, both = top - low, top + low
    with np.errstate(divide="ignore", invalid="ignore"):
        saturation = np.where(spread <= 0, 0.0, np.where(both < 1.0, spread / both, spread / (2.0 - both)))
        hue = np.where(top == r, (g - b) / spread * 60.0, np.where(top == g, (b - r) / spread * 60.0 + 120.0, (r - g) / spread * 60.0 + 240.0))
    hue = np.where(spread <= 0, 0.0, hue)
    hue = np.where(hue < 0, hue + 360.0, hue)
    return np.stack([_byte(hue / 2.0), _byte(both / 2.0 * 255.0), _byte(saturation * 255.0)], axis=1)


def rgb8(hls: np.ndarray) -> np.ndarray:
    hue, light, sat = hls[:, 0].astype(np.float64), hls[:, 1] / 255.0, hls[:, 2] / 255.0
    high = np.where(light <= 0.5, light * (sat + 1.0), light + sat - light * sat)
    low = light * 2.0 - high

    def channel(shift: float) -> np.ndarray:
        sector = np.mod(hue * 2.0 / 60.0 + shift, 6.0)
        rising, falling = low + (high - low) * sector, low + (high - low) * (4.0 - sector)
        return _byte(255.0 * np.where(sector < 1.0, rising, np.where(sector < 3.0, high, np.where(sector < 4.0, falling, low))))

    return np.stack([channel(2.0), channel(0.0), channel(-2.0)], axis=1)
