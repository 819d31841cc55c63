"""Filter taps: lists for fixed kernels, numpy functions of distance for position-dependent ones."""

from __future__ import annotations

import math

import numpy as np

from framelake.errors import within


def gaussian(sigma: float, reach: float = 3.0, longest: int = 64) -> list[float]:
    """Normalized Gaussian taps; the half width is ``ceil(reach*sigma)``, 1 at least and at most ``longest``."""
    half = int(within("gaussian half width", max(math.ceil(reach * sigma), 1), 1, longest))
    raw = [math.exp(-(i * i) / (2.0 * sigma * sigma)) for i in range(-half, half + 1)]
    total = sum(raw)
    return [v / total for v in raw]


def gaussian_fixed(sigma: float, half: int) -> list[float]:
    raw = [math.exp(-(i * i) / (2.0 * sigma * sigma)) for i in range(-half, half + 1)]
    total = sum(raw)
    return [v / total for v in raw]


def cubic(b: float, c: float):
    """The two-parameter cubic family (Mitchell and Netravali 1988)."""

    def weight(d: np.ndarray) -> np.ndarray:
        d = np.abs(d)
        near = np.polyval([12 - 9 * b - 6 * c, -18 + 12 * b + 6 * c, 0, 6 - 2 * b], d) / 6
        far = np.polyval([-b - 6 * c, 6 * b + 30 * c, -12 * b - 48 * c, 8 * b + 24 * c], d) / 6
        return np.where(d < 1, near, np.where(d < 2, far, 0.0))

    return weight


def lanczos(lobes: int):
    """Windowed sinc with ``lobes`` lobes."""
    return lambda d: np.where(np.abs(d) < lobes, np.sinc(d) * np.sinc(d / lobes), 0.0)


def tent(d: np.ndarray) -> np.ndarray:
    """Linear interpolation weight."""
    return np.maximum(1.0 - np.abs(d), 0.0)


def flat(d: np.ndarray) -> np.ndarray:
    """Nearest sample."""
    return np.ones_like(d)
