"""Perceptual hashes of grey pixel arrays: the signs of low frequencies against their median, 256 bits in four words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: The picture is brought to GRID x GRID by area, of whose cosine transform the lowest SIDE x SIDE values are kept.
GRID, SIDE = 32, 16
#: Values are rounded, so that what is equal but for the order of sums (a flat picture's zeros) is equal.
DIGITS = 6


@cache
def basis(n: int) -> np.ndarray:
    """SIDE x n: the transform's rows over GRID cells, each the mean of its share of n pixels."""
    edges = np.arange(GRID + 1) * (n / GRID)
    pixel = np.arange(n)
    share = np.clip(np.minimum(edges[1:, None], pixel + 1) - np.maximum(edges[:-1, None], pixel), 0, None) * (GRID / n)
    wave = np.cos(np.pi / GRID * (np.arange(GRID) + 0.5) * np.arange(SIDE)[:, None])
    return wave @ share


def spectrum(pictures: np.ndarray) -> np.ndarray:
    """(pictures, SIDE, SIDE) of (pictures, height, width): rows and columns are transformed one after the other."""
    _, height, width = pictures.shape
    return basis(height) @ (pictures.astype(np.float64) @ basis(width).T)


def words(values: np.ndarray) -> np.ndarray:
    """(pictures, 4) bigints: bit 64 w + b of a picture is set where the value in that place isn't below the median."""
    flat = np.round(values.reshape(len(values), -1), DIGITS)
    bits = flat >= np.median(flat, axis=1, keepdims=True)
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")


def _hashed(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for pixels, width, height in batches:
        length = pixels.map(lambda b: len(b) if b is not None else -1)
        right = (width.fillna(0) > 0) & (height.fillna(0) > 0) & (length == width.fillna(0) * height.fillna(0))
        out = pd.DataFrame({f"h{k}": pd.array([None] * len(pixels), dtype="Int64") for k in range(4)})
        shapes = pd.DataFrame({"h": height, "w": width})[right]
        for (h, w), rows in shapes.groupby(["h", "w"]).indices.items():
            at = shapes.index[rows]
            # few pictures at a time, so that the memory is bounded by the batch and not by its pictures as doubles
            few = max(1, (1 << 22) // int(h * w))
            for k in range(0, len(at), few):
                part = at[k : k + few]
                grey = np.frombuffer(b"".join(pixels.loc[part]), np.uint8).reshape(len(part), int(h), int(w))
                out.loc[part, :] = words(spectrum(grey))
        yield out


def perceptual_hash(pixels, width, height):
    """struct(h0 .. h3) of grey bytes by rows, one byte a pixel; nulls where a part is null or the bytes aren't width x height.

    A flat picture's values are tied at the median, so most of its bits are set and hashes.informative leaves it out.
    """
    schema = "h0 bigint, h1 bigint, h2 bigint, h3 bigint"
    return F.pandas_udf(_hashed, schema)(pixels, width.cast("bigint"), height.cast("bigint"))
