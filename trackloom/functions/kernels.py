"""Arrow kernels over decoded pixels: rows carry bytes (row by row), height and width; decoding and scaling come before."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

VECTOR = T.ArrayType(T.DoubleType())


def _grid(pixels: bytes, height: int, width: int, channels: int = 1) -> np.ndarray:
    return np.frombuffer(pixels, np.uint8).reshape((height, width) if channels == 1 else (height, width, channels))


def laplacian_sharpness(image: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian on a logarithmic scale, 0 to 1 (at a variance of 1000)."""
    if image.size == 0:
        return 0.0
    p = np.pad(image.astype(np.float64), 1, mode="reflect" if min(image.shape) > 1 else "edge")
    edges = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    return float(np.clip(np.log1p(edges.var()) / np.log(1001.0), 0.0, 1.0))


def split_level(image: np.ndarray) -> int:
    """The grey level that parts an image's levels into the two classes furthest apart."""
    counts = np.bincount(image.ravel(), minlength=256).astype(float)
    below, weighted = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (weighted / below - (weighted[-1] - weighted) / above) ** 2
    return int(np.nan_to_num(between).argmax())


def layout_descriptor(image: np.ndarray, columns: int = 6, rows: int = 4) -> np.ndarray:
    """Share of light pixels in each cell of a grid, less the mean, at length one: where the pattern lies, mirror images apart."""
    light = image > split_level(image)
    h, w = image.shape[0] // rows, image.shape[1] // columns
    cells = light[: h * rows, : w * columns].reshape(rows, h, columns, w).mean(axis=(1, 3)).ravel()
    cells = cells - cells.mean()
    return cells / max(float(np.linalg.norm(cells)), 1e-12)


def colour_histogram(image: np.ndarray, bins: int = 12) -> np.ndarray:
    """Histograms of all channels end to end, at length one."""
    channels = image[..., None] if image.ndim == 2 else image
    edges = np.linspace(0, 255, bins + 1)
    found = np.concatenate([np.histogram(channels[..., c], edges)[0] for c in range(channels.shape[2])]).astype(float)
    return found / max(float(np.linalg.norm(found)), 1e-12)


def bits_fingerprint(frames: list[np.ndarray]) -> str:
    """SHA-256 of which pixels of each small frame reach its mean; no frame gives an empty text."""
    bits = b"".join(np.packbits(f >= f.mean()).tobytes() for f in frames)
    return hashlib.sha256(bits).hexdigest() if frames else ""


@F.pandas_udf(T.DoubleType())
def sharpness(pixels: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else laplacian_sharpness(_grid(p, h, w)) for p, h, w in zip(pixels, height, width, strict=True)], dtype="float64")


@F.pandas_udf(VECTOR)
def layout(pixels: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else layout_descriptor(_grid(p, h, w)).tolist() for p, h, w in zip(pixels, height, width, strict=True)])


@F.pandas_udf(VECTOR)
def histogram(pixels: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else colour_histogram(_grid(p, h, w, c)).tolist() for p, h, w, c in zip(pixels, height, width, channels, strict=True)])


@F.pandas_udf(T.StringType())
def fingerprint(frames: pd.Series) -> pd.Series:
    """Of an array of square grey frames, as sampled from a recording."""
    return pd.Series([bits_fingerprint([_grid(f, int(len(f) ** 0.5), int(len(f) ** 0.5)) for f in own]) for own in frames])
