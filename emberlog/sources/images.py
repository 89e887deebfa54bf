"""From decoded frame images to text pixels.

A frame is turned into rows only for its combat-text pixels (a few percent of the image), and
the census needs no rows at all: both run per Arrow batch of images without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from emberlog.operators.frames import CENSUS_RANGES


def _bgr(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    arr = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    return arr[:, :, [0, 0, 0]] if channels == 1 else arr[:, :, :3]


def hsv(bgr: np.ndarray) -> np.ndarray:
    """Same formula as the column version, on one image."""
    b, g, r = (bgr[:, :, i].astype(np.float64) for i in range(3))
    v = np.maximum(np.maximum(r, g), b)
    spread = v - np.minimum(np.minimum(r, g), b)
    div = np.where(spread == 0, 1, spread)
    deg = np.where(v == r, (g - b) / div * 60, np.where(v == g, (b - r) / div * 60 + 120, (r - g) / div * 60 + 240))
    h = np.rint(np.where(spread == 0, 0, deg) / 2)
    s = np.rint(spread / np.where(v == 0, 1, v) * 255)
    return np.stack([np.where(h < 0, h + 180, h), s, v], axis=2)


def text_mask(image: np.ndarray) -> np.ndarray:
    out = np.zeros(image.shape[:2], dtype=bool)
    for ranges in CENSUS_RANGES:
        hit = np.ones(image.shape[:2], dtype=bool)
        for i, (lo, hi) in enumerate(ranges):
            hit &= (image[:, :, i] >= lo) & (image[:, :, i] <= hi)
        out |= hit
    return out


def _flat(frames: DataFrame) -> DataFrame:
    return frames.select("session_id", "frame_index", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def image_census(frames: DataFrame) -> DataFrame:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = [int(text_mask(hsv(_bgr(d, h, w, c))).sum()) for d, h, w, c in zip(pdf["data"], pdf["height"], pdf["width"], pdf["channels"])]
            yield pd.DataFrame({"session_id": pdf["session_id"], "frame_index": pdf["frame_index"], "text_pixels": n, "pixels": pdf["height"] * pdf["width"]})

    return _flat(frames).mapInPandas(count, "session_id string, frame_index int, text_pixels bigint, pixels bigint")


def text_pixels(frames: DataFrame) -> DataFrame:
    """Combat-text pixels of every frame as (session_id, frame_index, x, y, r, g, b)."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                bgr = _bgr(row.data, row.height, row.width, row.channels)
                y, x = np.nonzero(text_mask(hsv(bgr)))
                px = bgr[y, x].astype(np.int32)
                yield pd.DataFrame(
                    {"session_id": row.session_id, "frame_index": row.frame_index, "x": x.astype(np.int32), "y": y.astype(np.int32), "r": px[:, 2], "g": px[:, 1], "b": px[:, 0]}
                )

    return _flat(frames).mapInPandas(pick, "session_id string, frame_index int, x int, y int, r int, g int, b int")


def thumbnails(frames: DataFrame, width: int = 320, height: int = 180) -> DataFrame:
    """Grey thumbnails (nearest sample) as arrays for the motion gate."""

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            thumbs = []
            for d, h, w, c in zip(pdf["data"], pdf["height"], pdf["width"], pdf["channels"]):
                bgr = _bgr(d, h, w, c).astype(np.float64)
                grey = np.rint(bgr[:, :, 2] * 0.299 + bgr[:, :, 1] * 0.587 + bgr[:, :, 0] * 0.114)
                ys, xs = np.arange(height) * h // height, np.arange(width) * w // width
                thumbs.append(grey[np.ix_(ys, xs)].ravel())
            yield pd.DataFrame({"session_id": pdf["session_id"], "frame_index": pdf["frame_index"], "thumb": thumbs})

    return _flat(frames).mapInPandas(shrink, "session_id string, frame_index int, thumb array<double>")
