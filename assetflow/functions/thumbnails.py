"""Gray thumbnails of decoded images, vectorised per image with NumPy.

Grayscale conversion and block-mean resizing touch every pixel; as Column
lambdas they are interpreted per pixel.  This Arrow-batched UDF does the
same arithmetic with NumPy (integral image for the block sums) and returns
one small array per requested side; quantisation and hashing stay native.
It equals ``resize_box(grayscale_bgr(data, n), h, w, side, side)``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from assetflow.functions.hashing import PHASH_CONFIGS


def thumbnails_udf(sides=tuple(sorted({s for s, _ in PHASH_CONFIGS}))):
    """``(data, height, width, nChannels) -> STRUCT<s4: ARRAY<INT>, ...>``."""
    sides = tuple(sides)
    schema = ", ".join(f"s{s}: array<int>" for s in sides)

    def gray_of(buf, h, w, n):
        px = np.frombuffer(buf, np.uint8)
        if n == 1:
            return px[: h * w].reshape(h, w).astype(np.int64)
        px = px[: h * w * n].reshape(h, w, n).astype(np.float64)
        x = px[..., 2] * 0.299 + px[..., 1] * 0.587 + px[..., 0] * 0.114
        fl = np.floor(x)
        return np.where(x - fl >= 0.5, fl + 1, fl).astype(np.int64)  # round half up

    def bounds(size, out):
        i = np.arange(out)
        lo = i * size // out
        return lo, np.maximum(lo + 1, (i + 1) * size // out)

    def resize(gray, side):
        h, w = gray.shape
        integral = np.zeros((h + 1, w + 1), np.int64)
        integral[1:, 1:] = gray.cumsum(0).cumsum(1)
        r0, r1 = bounds(h, side)
        c0, c1 = bounds(w, side)
        total = (integral[np.ix_(r1, c1)] - integral[np.ix_(r0, c1)]
                 - integral[np.ix_(r1, c0)] + integral[np.ix_(r0, c0)])
        return (total // np.outer(r1 - r0, c1 - c0)).reshape(-1).astype(np.int32).tolist()

    @F.pandas_udf(f"struct<{schema}>")
    def thumbs(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.DataFrame:
        out = {f"s{s}": [] for s in sides}
        for buf, h, w, n in zip(data, height, width, channels):
            ok = buf is not None and h is not None and h > 0 and w > 0
            gray = gray_of(buf, int(h), int(w), int(n)) if ok else None
            for s in sides:
                out[f"s{s}"].append(resize(gray, s) if ok else None)
        return pd.DataFrame(out)

    return thumbs


def with_thumbnails(df, data: str = "data", height: str = "height", width: str = "width",
                    channels: str = "nChannels", col: str = "thumbs"):
    """Add the thumbnail struct (one UDF evaluation per image)."""
    return df.withColumn(col, thumbnails_udf()(F.col(data), F.col(height), F.col(width), F.col(channels)))


def phash_map_from_thumbs(thumbs: Column, configs=PHASH_CONFIGS) -> Column:
    """All perceptual hashes from precomputed thumbnails (native quantisation)."""
    from assetflow.functions.hashing import bits_to_hex, gray_levels, levels_to_bits, phash_name
    kv = []
    for side, bits in configs:
        small = thumbs[f"s{side}"]
        kv += [F.lit(phash_name(side, bits)), bits_to_hex(levels_to_bits(gray_levels(small, bits), bits))]
    return F.create_map(*kv)
