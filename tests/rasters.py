"""Plain rasters and brute force for tests."""

from __future__ import annotations

import numpy as np
import pandas as pd


def to_pixels(spark, image: np.ndarray, band: int = 1):
    r, c = np.indices(image.shape)
    v = image.ravel()
    data = pd.DataFrame({"band": np.full(v.size, band, np.int32), "r": r.ravel().astype("int64"), "c": c.ravel().astype("int64"), "v": v.astype("int64") if image.dtype.kind in "iu" else v.astype(float)})
    return spark.createDataFrame(data)


def windows(image: np.ndarray, spec):
    """(bi, bj, k, window) by slicing, as defined."""
    s, b = spec.largest, spec.block
    for bi, i in enumerate(range(0, image.shape[0] - (s - b), b)):
        for bj, j in enumerate(range(0, image.shape[1] - (s - b), b)):
            for k in spec.scales:
                o = s // 2 - k // 2
                yield bi, bj, k, image[i + o : i + o + k, j + o : j + o + k]


def table(df, names) -> dict:
    return {(row["bi"], row["bj"], row["k"]): [row[n] for n in names] for row in df.collect()}


def same(got: dict, image: np.ndarray, spec, measure, rtol: float = 1e-6, atol: float = 1e-6) -> None:
    want = {(bi, bj, k): measure(w, k) for bi, bj, k, w in windows(image, spec)}
    assert got.keys() == want.keys()
    for key, x in want.items():
        np.testing.assert_allclose(got[key], x, rtol=rtol, atol=atol, err_msg=str(key))


def five(x: np.ndarray) -> list[float]:
    """max, mean, var, skew, kurt with half the variance as deviation."""
    x = np.asarray(x, float)
    if x.max() == 0:
        return [0.0] * 5
    var = x.var(ddof=1)
    s = var * 0.5
    with np.errstate(all="ignore"):
        out = [x.max(), x.mean(), var, ((x - x.mean()) ** 3).mean() / s**3, ((x - x.mean()) ** 4).mean() / s**4]
    return [v if np.isfinite(v) else 0.0 for v in out]


def weighted(w: np.ndarray, k: int) -> list[float]:
    total = 0.0
    for r in range(w.shape[0]):
        for c in range(w.shape[1]):
            d = np.hypot(c - k / 2, r - k / 2)
            total += w[r, c] / d if d else 0.0
    m = total / w.size
    return [m, ((w - m) ** 2).mean()]
