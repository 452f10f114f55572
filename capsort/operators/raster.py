"""Raster statistics of 8-bit gray images in a binary column, by Arrow batches in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def box_downsample(gray: np.ndarray, to_w: int, to_h: int) -> np.ndarray:
    """Whole-number means (truncated) of the boxes each target cell covers."""
    h, w = gray.shape
    ys, xs = np.arange(to_h + 1) * h // to_h, np.arange(to_w + 1) * w // to_w
    table = np.zeros((h + 1, w + 1), np.int64)
    table[1:, 1:] = gray.astype(np.int64).cumsum(0).cumsum(1)
    y0, x0 = ys[:-1], xs[:-1]
    y1, x1 = np.maximum(ys[1:], y0 + 1), np.maximum(xs[1:], x0 + 1)
    total = table[np.ix_(y1, x1)] - table[np.ix_(y0, x1)] - table[np.ix_(y1, x0)] + table[np.ix_(y0, x0)]
    return (total // np.outer(y1 - y0, x1 - x0)).astype(np.uint8)


def laplacian_variance(gray: np.ndarray) -> float:
    """Population variance of the four-neighbour Laplacian over inner pixels; 0 if there are none."""
    if min(gray.shape) < 3:
        return 0.0
    g = gray.astype(np.int64)
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def luminance(gray: np.ndarray, high: int = 250, low: int = 5) -> tuple[float, float, float]:
    """Mean in [0, 1], share of highlights, share of shadows."""
    if not gray.size:
        return 0.0, 0.0, 0.0
    bright = gray >= high
    return float(gray.mean() / 255), float(bright.mean()), float(((gray <= low) & ~bright).mean())


def difference_hash(gray: np.ndarray) -> int:
    """64 bits, left > right of a 9 x 8 reduction, first comparison in the highest bit; signed."""
    small = box_downsample(gray, 9, 8)
    return int(np.packbits(small[:, :-1] > small[:, 1:]).view(">i8")[0])


def _over(f: Callable[[np.ndarray], object], returns: T.DataType) -> Callable[[Column, Column, Column], Column]:
    def run(gray: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        def one(data, w, h):
            if data is None or not w or not h or len(data) < w * h:
                return None
            return f(np.frombuffer(data, np.uint8, w * h).reshape(h, w))

        return pd.Series([one(*x) for x in zip(gray, width, height, strict=True)], dtype=object)

    return F.pandas_udf(run, returns)


sharpness = _over(laplacian_variance, T.DoubleType())
visual_hash = _over(difference_hash, T.LongType())


# Types as objects: importing this module needs no session.
@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("mean", "highlights", "shadows")]))
def profile(gray: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    rows = [luminance(np.frombuffer(d, np.uint8, w * h)) if d is not None and len(d) >= w * h else (None,) * 3 for d, w, h in zip(gray, width, height, strict=True)]
    return pd.DataFrame(rows, columns=["mean", "highlights", "shadows"])
