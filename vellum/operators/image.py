"""Page image clean-up in numpy: shadows, contrast, skew. Grey pictures are 2-d uint8 arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Too little ink to measure, longest side for measuring, angles tried and applied.
LEAST_INK, MEASURED_SIDE = 50, 1000
STEP, MOST, LEAST_ANGLE = 0.5, 15.0, 0.1


def otsu(grey: np.ndarray) -> int:
    """The level that parts dark from light with the greatest variance between them."""
    share = np.bincount(grey.ravel(), minlength=256) / grey.size
    dark, mean = np.cumsum(share), np.cumsum(share * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mean[-1] * dark - mean) ** 2 / (dark * (1 - dark))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def rotated(grey: np.ndarray, angle: float, fill: int = 255) -> np.ndarray:
    """Turned counter-clockwise about its middle, nearest pixels."""
    h, w = grey.shape
    a = np.deg2rad(angle)
    y, x = np.mgrid[:h, :w]
    dx, dy = x - (w - 1) / 2, y - (h - 1) / 2
    sx = np.rint(np.cos(a) * dx - np.sin(a) * dy + (w - 1) / 2).astype(int)
    sy = np.rint(np.sin(a) * dx + np.cos(a) * dy + (h - 1) / 2).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    return np.where(inside, grey[np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)], fill).astype(np.uint8)


def skew(grey: np.ndarray) -> float:
    """The turn that makes rows of ink sharpest, the first of equals; 0 with too little ink."""
    ink = grey <= otsu(grey)
    if ink.sum() < LEAST_INK:
        return 0.0
    by = max(1, -(-max(grey.shape) // MEASURED_SIDE))
    y, x = np.nonzero(ink)
    y, x = (y - (grey.shape[0] - 1) / 2) / by, (x - (grey.shape[1] - 1) / 2) / by
    reach = int(np.hypot(*grey.shape) / by) + 2
    scores = []
    angles = np.arange(-MOST, MOST + STEP / 2, STEP)
    for a in np.deg2rad(angles):
        rows = np.bincount(np.rint(np.cos(a) * y - np.sin(a) * x + reach / 2).astype(int), minlength=reach).astype(float)
        scores.append((rows**2).sum())
    return float(angles[int(np.argmax(scores))])


def without_shadow(grey: np.ndarray) -> np.ndarray:
    """255 less the distance from a background (greatest of 7x7, then mean of 21x21), stretched to the full range."""
    def over(a: np.ndarray, k: int, f) -> np.ndarray:
        for axis in (0, 1):
            pad = [(k // 2, k // 2) if i == axis else (0, 0) for i in (0, 1)]
            a = f(np.lib.stride_tricks.sliding_window_view(np.pad(a, pad, mode="edge"), k, axis=axis), axis=-1)
        return a

    back = over(over(grey, 7, np.max).astype(np.float32), 21, np.mean)
    flat = 255 - np.abs(grey - back)
    low, high = float(flat.min()), float(flat.max())
    return np.rint((flat - low) * (255 / (high - low)) if high > low else flat).astype(np.uint8)


def stretched(grey: np.ndarray) -> np.ndarray:
    """Contrast from the 1st to the 99th hundredth."""
    low, high = np.percentile(grey, (1, 99))
    return grey if high <= low else np.clip(np.rint((grey - low) * (255 / (high - low))), 0, 255).astype(np.uint8)


def enhanced(grey: np.ndarray, deskew: bool = True, contrast: bool = True, shadow: bool = False) -> tuple[np.ndarray, float]:
    """(picture, angle it was turned by): skew is measured on the raw picture and mended last."""
    angle = skew(grey) if deskew else 0.0
    out = without_shadow(grey) if shadow else grey
    out = stretched(out) if contrast else out
    return (rotated(out, angle), angle) if LEAST_ANGLE < abs(angle) <= MOST else (out, 0.0)


def enhance(images: DataFrame, **options: bool) -> DataFrame:
    """path, width, height, grey pixels and angle of pictures as vellum.sources.files.images reads them; one that fails keeps its grey pixels."""

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                pixels = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                grey = pixels[..., 0] if r.nChannels == 1 else np.rint(pixels[..., :3] @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)
                try:
                    out, angle = enhanced(grey, **options)
                except (ValueError, ArithmeticError):
                    out, angle = grey, 0.0
                yield pd.DataFrame([(r.path, r.width, r.height, out.tobytes(), angle)], columns=["path", "width", "height", "grey", "angle"])

    return images.select("path", "width", "height", "nChannels", "data").mapInPandas(clean, "path string, width int, height int, grey binary, angle double")
