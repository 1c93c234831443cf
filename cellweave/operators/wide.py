"""Textures of wide windows on tiles: the same numbers as by spread pixels, without a copy of a pixel for every window.

Sums over windows are differences of running sums of a whole tile; what is not a sum walks the places of a window
once and takes them of all cells at the same time. A task holds a tile, and a few lines of cells where more is needed.
"""

from __future__ import annotations

import numpy as np

from cellweave.operators.kernels import FIVE, moments, one_layer
from cellweave.operators.shapes import PAIR_OFFSETS, rays
from cellweave.operators.tiles import Cells, Kernel
from cellweave.spec import FeatureSpec

#: Fixed-point magnitudes of gradients.
MAGNITUDE = 1e6


def whole(image: np.ndarray, spec: FeatureSpec) -> dict[int, np.ndarray]:
    return {0: np.floor(image[:1]).astype(np.int64)}


def pair_layers(image: np.ndarray, spec: FeatureSpec) -> dict[int, np.ndarray]:
    """Of every pixel the squared difference to the pixel at each offset, 0 where there is none."""
    v = np.floor(image[0]).astype(np.int64)
    h, w = v.shape
    out = np.zeros((len(PAIR_OFFSETS), h, w), np.int64)
    for x, (dr, dc) in enumerate(PAIR_OFFSETS):
        a, b = max(0, -dc), w - max(0, dc)
        if dr < h and a < b:
            out[x, : h - dr, a:b] = (v[dr:, a + dc : b + dc] - v[: h - dr, a:b]) ** 2
    return {0: out}


def least_contrast(cells: Cells, spec: FeatureSpec) -> np.ndarray:
    out = np.full(cells.count, np.inf)
    for x, (dr, dc) in enumerate(PAIR_OFFSETS):
        n = max(0, cells.h - dr) * max(0, cells.w - abs(dc))
        if n:
            out = np.minimum(out, cells.sums(cells.layer[x], 0, cells.h - dr, max(0, -dc), cells.w - max(0, dc)).astype(float) / n)
    return np.where(np.isfinite(out), out, 0.0)[..., None]


def box_masses(cells: Cells, spec: FeatureSpec) -> np.ndarray:
    """Lacunarity by differential box counting."""
    r, out = spec.box, np.zeros((*cells.count, 1))
    up = lambda x, n: -(-x // n)
    for lines, part in cells.chunks(512):
        top = int(part.layer.max(initial=0)) + 3
        count = np.zeros((top, *part.count), np.int64)
        i, j = np.ogrid[: part.count[0], : part.count[1]]
        for x in range(0, part.h, r):
            for y in range(0, part.w, r):
                h, w = min(r, part.h - x), min(r, part.w - y)
                box = [part.at(x + a, y + b) for a in range(h) for b in range(w)]
                side = min(r, h, w)
                mass = up(np.maximum(np.maximum.reduce(box), 1), side) - up(np.minimum.reduce(box), side) + 1
                count[mass, i, j] += 1
        m = np.arange(top)[:, None, None]
        ns, s1, s2 = count.sum(0), (m * count * count).sum(0).astype(float), (m * m * count * count).sum(0).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[lines, :, 0] = np.where(s1 > 0, ns * s2 / (s1 * s1), 0.0)
    return out


def slope_layers(image: np.ndarray, spec: FeatureSpec) -> dict[int, np.ndarray]:
    """Values, differences along rows and along columns; what has no neighbour in the tile is at no window's inside."""
    v = np.floor(image[0]).astype(np.int64)
    gr, gc = np.zeros_like(v), np.zeros_like(v)
    gr[1:-1], gc[:, 1:-1] = v[2:] - v[:-2], v[:, 2:] - v[:, :-2]
    return {0: np.stack([v, gr, gc])}


def oriented(cells: Cells, spec: FeatureSpec) -> np.ndarray:
    """Moments of nine oriented-gradient bins; at a window's border the difference across it is 0."""
    v, gr, gc = cells.layer
    h, w = cells.h, cells.w
    angle = np.degrees(np.arctan2(gr, gc))
    angle = np.where(angle < 0, angle + 180.0, angle)
    angle = np.where(angle >= 180, angle - 180.0, angle)
    b = np.minimum(np.floor(angle / 20.0), 8).astype(int)
    fixed = lambda x: np.floor(np.sqrt(x) * MAGNITUDE + 0.5).astype(np.int64)
    inside = fixed((gc * gc + gr * gr).astype(float))
    bins = [cells.sums(np.where(b == x, inside, 0), 1, max(1, h - 1), 1, max(1, w - 1)) for x in range(9)]
    along, across = fixed((gc * gc).astype(float)), fixed((gr * gr).astype(float))
    for r in {0, h - 1}:  # along the upper and lower border only differences of columns are left: 0 degrees
        bins[0] = bins[0] + cells.sums(along, r, r + 1, 1, max(1, w - 1))
    for c in {0, w - 1}:  # 90 degrees
        bins[4] = bins[4] + cells.sums(across, 1, max(1, h - 1), c, c + 1)
    a = np.stack([x.astype(float) / MAGNITUDE / float(h * w) for x in bins], -1)
    a = np.minimum(a / np.sqrt((a * a).sum(-1) + 1e-10)[..., None], 0.2)
    a = a / np.sqrt((a * a).sum(-1) + 1e-10)[..., None]
    return np.where((cells.sums((v > 0).astype(np.int64)) > 0)[..., None], moments(a), 0.0)


def pyramid(cells: Cells, spec: FeatureSpec) -> np.ndarray:
    """Moments of the sums of a mask over the tiles of three levels."""
    bins = []
    for level in (2, 4, 8):
        ty, tx = cells.h // level, cells.w // level
        if min(ty, tx) > 1:
            starts = [[(x, min(x + t, n)) for x in range(0, n - 1, t) if min(t, n - x) > 1] for t, n in ((ty, cells.h), (tx, cells.w))]
            bins += [cells.sums(cells.layer, r0, r1, c0, c1) for r0, r1 in starts[0] for c0, c1 in starts[1]]
    return moments(np.stack(bins, -1).astype(float)) if bins else np.zeros((*cells.count, 5))


def powers(cells: Cells, spec: FeatureSpec) -> np.ndarray:
    """max, mean, var, skew, kurt by power sums; all 0 where the largest value is 0."""
    v, n = cells.layer.astype(np.int64), float(cells.h * cells.w)
    s1, s2, s3, s4 = (cells.sums(v**p).astype(float) for p in (1, 2, 3, 4))
    top = np.full(cells.count, np.iinfo(np.int64).min)
    for r in range(cells.h):
        for c in range(cells.w):
            np.maximum(top, cells.at(r, c, v), out=top)
    m = s1 / n
    m2 = s2 / n - m * m
    m3 = s3 / n - 3.0 * m * (s2 / n) + 2.0 * m * m * m
    m4 = s4 / n - 4.0 * m * (s3 / n) + 6.0 * m * m * (s2 / n) - 3.0 * m * m * m * m
    var = m2 * n / max(n - 1.0, 1.0)
    sd = var * 0.5
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.stack([top.astype(float), m, var, m3 / (sd * sd * sd), m4 / (sd * sd * sd * sd)], -1)
    out[~np.isfinite(out)] = 0.0
    out[top == 0] = 0.0
    return out


def line_features(cells: Cells, spec: FeatureSpec) -> np.ndarray:
    """Statistics of the lengths of homogeneous lines from the centre: each line is walked for all cells at once."""
    h, w, half = cells.h, cells.w, spec.block // 2
    lines = rays(h, w, spec.line_skip)
    ny, nx = -(-h // spec.line_skip), -(-w // spec.line_skip)
    place = [(max(0, n // 2 - half), n // 2 + (1 if spec.block == 1 else half)) for n in (h, w)]
    area = (min(place[0][1], h) - place[0][0]) * (min(place[1][1], w) - place[1][0])
    out = np.zeros((*cells.count, 6))
    for rows, part in cells.chunks(16 * len(lines)):
        v = part.layer.astype(np.int64)
        centre = part.sums(v, place[0][0], min(place[0][1], h), place[1][0], min(place[1][1], w)).astype(float) / area
        lengths, weighted = np.zeros((len(lines), *part.count)), np.zeros(part.count)
        for x, line in enumerate(lines):
            far, n, s1, s2 = np.zeros(part.count), np.zeros(part.count, int), np.zeros(part.count), np.zeros(part.count)
            for r, c in line:
                going = far < spec.line_threshold
                if not going.any():
                    break
                value = np.where(going, part.at(r, c, v), 0).astype(float)
                far += np.where(going, np.abs(centre - value), 0.0)
                n += going
                s1 += value
                s2 += value * value
            ends = np.array([np.sqrt(float((r - h // 2) ** 2 + (c - w // 2) ** 2)) for r, c in line])
            d = lengths[x] = ends[np.minimum(n, len(line) - 1)]
            with np.errstate(divide="ignore", invalid="ignore"):
                sd = (s2 - s1 * s1 / n) / n * 0.5
                weighted += np.where(sd > 1e-9, 0.1 * (d - 1.0) / sd, 0.0)
        mean = lengths.sum(0) / len(lines)
        least = np.where(lengths > 0, lengths, np.inf).min(0)
        apart = np.zeros(part.count)
        for e in range(min(ny, nx)):
            apart = np.maximum(apart, np.maximum(np.abs(lengths[e] - lengths[2 * ny + nx + e]), np.abs(lengths[ny + e] - lengths[2 * ny + e])))
        out[rows] = np.stack([lengths.max(0), np.where(np.isfinite(least), least, 0.0), mean, weighted / len(lines), np.sqrt(((lengths - mean) ** 2).sum(0) / len(lines)), apart], -1)
    return out


PANTEX = Kernel(("contrast",), pair_layers, least_contrast, joint=True)
LACUNARITY = Kernel(("lacunarity",), whole, box_masses)
HOG = Kernel(FIVE, slope_layers, oriented, joint=True)
PYRAMID = Kernel(FIVE, whole, pyramid)
POWERS = Kernel(FIVE, one_layer, powers)
SFS = Kernel(("max", "min", "mean", "wmean", "std", "orthogonal"), whole, line_features)
