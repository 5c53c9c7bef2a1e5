"""Colour difference, vectorised for Arrow kernels."""

from __future__ import annotations

import numpy as np


def delta_e(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """CIEDE2000 colour difference over 100, clipped to [0, 1], of LAB arrays with channels last.

    The arrays broadcast, so (n, 1, 3) against (1, m, 3) gives a matrix.
    """
    l1, a1, b1 = (first[..., k] for k in range(3))
    l2, a2, b2 = (second[..., k] for k in range(3))
    chroma = (np.hypot(a1, b1) + np.hypot(a2, b2)) / 2.0
    c7 = chroma * chroma * chroma * chroma * chroma * chroma * chroma
    stretch = 1.5 - 0.5 * np.sqrt(c7 / (c7 + 25.0**7))
    x1, x2 = a1 * stretch, a2 * stretch
    p1, p2 = np.hypot(x1, b1), np.hypot(x2, b2)
    h1, h2 = np.mod(np.degrees(np.arctan2(b1, x1)), 360.0), np.mod(np.degrees(np.arctan2(b2, x2)), 360.0)
    grey = (p1 * p2) == 0.0

    turn = h2 - h1
    turn = np.where(turn > 180.0, turn - 360.0, np.where(turn < -180.0, turn + 360.0, turn))
    turn = np.where(grey, 0.0, turn)
    both = h1 + h2
    middle = np.where(
        np.abs(h1 - h2) <= 180.0, both / 2.0, np.where(both < 360.0, both / 2.0 + 180.0, both / 2.0 - 180.0)
    )
    middle = np.where(grey, both, middle)

    light = (l1 + l2) / 2.0 - 50.0
    p_mean = (p1 + p2) / 2.0
    p7 = p_mean * p_mean * p_mean * p_mean * p_mean * p_mean * p_mean
    tint = (
        1.0
        - 0.17 * np.cos(np.radians(middle - 30.0))
        + 0.24 * np.cos(np.radians(middle * 2.0))
        + 0.32 * np.cos(np.radians(middle * 3.0 + 6.0))
        - 0.20 * np.cos(np.radians(middle * 4.0 - 63.0))
    )
    d_light = (l2 - l1) / (1.0 + 0.015 * light * light / np.sqrt(20.0 + light * light))
    d_chroma = (p2 - p1) / (1.0 + 0.045 * p_mean)
    d_hue = 2.0 * np.sqrt(p1 * p2) * np.sin(np.radians(turn / 2.0)) / (1.0 + 0.015 * p_mean * tint)
    bend = (middle - 275.0) / 25.0
    twist = -2.0 * np.sqrt(p7 / (p7 + 25.0**7)) * np.sin(np.exp(-1.0 * bend * bend) * (np.pi / 3.0))
    total = d_light * d_light + d_chroma * d_chroma + d_hue * d_hue + twist * d_chroma * d_hue
    return np.clip(np.sqrt(np.where(total > 0.0, total, 0.0)) / 100.0, 0.0, 1.0)


def light_gap(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The lightness term of ``delta_e`` from L alone, a lower bound of it: the other terms together are never negative."""
    light = (first + second) / 2.0 - 50.0
    light *= light
    light /= np.sqrt(20.0 + light)
    light *= 0.015
    light += 1.0
    gap = np.abs(second - first)
    gap /= light
    gap /= 100.0
    return np.minimum(gap, 1.0, out=gap)
