"""NumPy kernels of windows and tiles."""

from __future__ import annotations

from math import cos, exp, pi, sin

import numpy as np

from cellweave.operators.tiles import Cells, Kernel, one_by_one
from cellweave.spec import FeatureSpec

#: Structuring elements of the morphological profile; samples and radii of the local binary patterns.
PROFILE = (3, 5, 7, 9, 11, 13, 15)
PATTERNS = ((8, 1), (16, 2), (32, 4))
#: Orientations, deviation, wavelength, aspect and phase of the Gabor bank.
GABOR = {"thetas": tuple(pi * t / 32 for t in range(0, 32, 4)), "sigma": 3.0, "wavelength": 10.0, "aspect": 0.5, "phase": 1.0}
GABOR_UNIT = 1_000_000
WEIGHT = 1e9


def one_layer(image: np.ndarray, spec: FeatureSpec) -> dict[int, np.ndarray]:
    return {0: image[:1]}


def moments(x: np.ndarray) -> np.ndarray:
    """max, mean, variance, skewness and kurtosis along the last axis; the deviation is half the variance; 0 where the largest is 0."""
    n = x.shape[-1]
    mean = x.mean(-1)
    d = x - mean[..., None]
    var = (d * d).sum(-1) / max(n - 1, 1)
    sd = var * 0.5
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.stack([x.max(-1), mean, var, (d**3).mean(-1) / sd**3, (d**4).mean(-1) / sd**4], -1)
    out[~np.isfinite(out)] = 0.0
    out[x.max(-1) == 0] = 0.0
    return out


def distance_weights(h: int, w: int, k: int) -> np.ndarray:
    """1 / distance to the centre of a window of scale k, clipped to h x w, in fixed point."""
    d = np.hypot(np.arange(h)[:, None] - k / 2, np.arange(w)[None, :] - k / 2)
    with np.errstate(divide="ignore"):
        return np.where(d > 0, np.floor(WEIGHT / np.where(d > 0, d, 1) + 0.5), 0).astype(np.int64)


def mean_var(cells: Cells, spec: FeatureSpec) -> np.ndarray:
    """Distance-weighted mean and the mean square deviation from it, of whole numbers."""
    x, n = cells.layer.astype(np.int64), cells.h * cells.w
    weights = distance_weights(cells.h, cells.w, cells.k)
    weighted = np.zeros(cells.count, np.int64)
    for lines, part in cells.chunks(256):
        for r in range(cells.h):
            for c in np.flatnonzero(weights[r]).tolist():
                weighted[lines] += weights[r, c] * part.at(r, c, x)
    m = weighted / WEIGHT / n
    s1, s2 = cells.sums(x).astype(float), cells.sums(x * x).astype(float)
    return np.stack([m, s2 / n - 2.0 * m * (s1 / n) + m * m], -1)


def spectrum(stack: np.ndarray, spec: FeatureSpec, k: int) -> np.ndarray:
    """Mean and deviation of the ring means of the log power spectrum, without the innermost and the outermost ring; 0 where not finite."""
    n, h, w = stack.shape
    f = np.abs(np.fft.fftshift(np.fft.fft2(stack), axes=(1, 2)))
    f[f < 1e-9 * np.maximum(stack.sum((1, 2)), 1)[:, None, None]] = 0.0
    centre = (w - 1) / 2
    ring = np.hypot(np.arange(w)[None, :] - centre, np.arange(h)[:, None] - centre).astype(int).ravel()
    _, ring, count = np.unique(ring, return_inverse=True, return_counts=True)
    out = np.zeros((n, 2))
    if len(count) < 3:
        return out
    with np.errstate(divide="ignore", invalid="ignore"):
        level = 20.0 * np.log(f.reshape(n, -1))
        profile = np.stack([level[:, ring == x].mean(1) for x in range(1, len(count) - 1)], 1)
        out[:, 0], out[:, 1] = profile.mean(1), profile.std(1)
    out[~np.isfinite(out)] = 0.0
    return out


def binary_patterns(image: np.ndarray, samples: int, radius: int) -> np.ndarray:
    """Uniform, rotation-invariant codes: the number of samples not below the centre, or samples + 1 where they change more than twice around."""
    h, w = image.shape
    pad = np.zeros((h + 2 * radius + 2, w + 2 * radius + 2))
    o = radius + 1
    pad[o : o + h, o : o + w] = image
    signs = []
    for p in range(samples):
        dr, dc = round(-radius * sin(2 * pi * p / samples), 5), round(radius * cos(2 * pi * p / samples), 5)
        r, c = int(np.floor(dr)), int(np.floor(dc))
        fr, fc = dr - r, dc - c
        part = lambda i, j: pad[o + r + i : o + r + i + h, o + c + j : o + c + j + w]  # noqa: B023, E731
        value = (1 - fr) * ((1 - fc) * part(0, 0) + (fc * part(0, 1) if fc else 0)) + (fr * ((1 - fc) * part(1, 0) + (fc * part(1, 1) if fc else 0)) if fr else 0)
        signs.append(value >= image - 1e-9)
    signs = np.array(signs)
    changes = (signs != np.roll(signs, 1, axis=0)).sum(0)
    return np.where(changes <= 2, signs.sum(0), samples + 1)


def pattern_layers(image: np.ndarray, spec: FeatureSpec) -> dict[int, np.ndarray]:
    return {0: np.stack([binary_patterns(image[0], p, r) for p, r in PATTERNS])}


def counted(cells: Cells, layer: np.ndarray, n: int) -> np.ndarray:
    """Counts of the codes 0 .. n - 1 of every window."""
    return np.stack([cells.sums((layer == x).astype(np.int64)) for x in range(n)], -1)


def pattern_histogram(cells: Cells, spec: FeatureSpec) -> np.ndarray:
    """The 10 + 18 + 34 counts of the three layers."""
    return np.concatenate([counted(cells, cells.layer[x], p + 2) for x, (p, _) in enumerate(PATTERNS)], -1).astype(float)


def pattern_moments(cells: Cells, spec: FeatureSpec) -> np.ndarray:
    """Moments of the counts of the codes up to the largest that a layer has in the window (2, 3 and 4 entries at least)."""
    values, used = [], []
    for x, (p, _) in enumerate(PATTERNS):
        c = counted(cells, cells.layer[x], p + 2)
        last = c.shape[-1] - 1 - np.argmax(c[..., ::-1] > 0, -1)  # of the codes that the window has
        values.append(c.astype(float))
        used.append(np.arange(p + 2) <= np.maximum(last, x + 1)[..., None])
    values, used = np.concatenate(values, -1), np.concatenate(used, -1)
    n = used.sum(-1)
    mean = np.where(used, values, 0.0).sum(-1) / n
    d = np.where(used, values - mean[..., None], 0.0)
    var = (d * d).sum(-1) / np.maximum(n - 1, 1)
    sd, top = var * 0.5, np.where(used, values, 0.0).max(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.stack([top, mean, var, (d**3).sum(-1) / n / sd**3, (d**4).sum(-1) / n / sd**4], -1)
    out[~np.isfinite(out)] = 0.0
    out[top == 0] = 0.0
    return out


def spread_max(image: np.ndarray, size: int) -> np.ndarray:
    """The largest value of the size x size square around; what is outside doesn't count."""
    out = image
    for axis in (0, 1):
        best = out
        for d in range(1, size // 2 + 1):
            for s in (d, -d):
                moved = np.full_like(out, np.iinfo(out.dtype).min)
                a, b = [slice(None)] * 2, [slice(None)] * 2
                a[axis], b[axis] = (slice(s, None), slice(None, -s)) if s > 0 else (slice(None, s), slice(-s, None))
                moved[tuple(a)] = out[tuple(b)]
                best = np.maximum(best, moved)
        out = best
    return out


def reconstructed(marker: np.ndarray, mask: np.ndarray, size: int) -> np.ndarray:
    """The marker, spread under the mask until nothing changes."""
    while True:
        grown = np.minimum(spread_max(marker, size), mask)
        if np.array_equal(grown, marker):
            return marker
        marker = grown


def profile_layer(image: np.ndarray, spec: FeatureSpec) -> dict[int, np.ndarray]:
    """Mean slope of the differential morphological profile (openings, then closings by reconstruction), modulo 256."""
    base = np.floor(image[0]).astype(np.int64)
    layers = []
    for sign in (1, -1):  # closings are openings of the negative
        own, marker, before = sign * base, sign * base, sign * base
        for size in PROFILE:
            marker = -spread_max(-marker, size)
            now = reconstructed(marker, own, size)
            layers.append(before - now)
            before = now
    slope = np.gradient(np.array(layers, float), axis=0).mean(0)
    return {0: (np.trunc(slope).astype(np.int64) & 255)[None]}


def gabor_bank(k: int) -> list[np.ndarray]:
    """Eight kernels of an odd side (k or k - 1) as whole numbers of millionths."""
    half = (k - 1 + k % 2) // 2
    out = []
    for theta in GABOR["thetas"]:
        own = np.zeros((2 * half + 1, 2 * half + 1))
        for y in range(-half, half + 1):
            for x in range(-half, half + 1):
                a, b = x * cos(theta) + y * sin(theta), -x * sin(theta) + y * cos(theta)
                own[half - y, half - x] = exp(-(a * a + GABOR["aspect"] ** 2 * b * b) / (2 * GABOR["sigma"] ** 2)) * cos(2 * pi * a / GABOR["wavelength"] + GABOR["phase"])
        own /= 1.5 * own.sum()
        out.append(np.floor(own * GABOR_UNIT + 0.5).astype(np.int64))
    return out


def gabor_layers(image: np.ndarray, spec: FeatureSpec) -> dict[int, np.ndarray]:
    """For each scale, the image correlated with its eight kernels, rounded, 0 to 255; edges are mirrored."""
    base = np.floor(image[0]).astype(np.int64)
    h, w = base.shape
    out = {}
    for k in spec.scales:
        layers = []
        for kernel in gabor_bank(k):
            half = len(kernel) // 2
            pad = np.pad(base, half, "reflect") if min(h, w) > half else np.pad(base, half, "symmetric")
            total = np.zeros((h, w), np.int64)
            for i, j in np.argwhere(kernel).tolist():  # far from the centre weights are 0
                total += kernel[i, j] * pad[i : i + h, j : j + w]
            layers.append(np.clip(np.floor(total / GABOR_UNIT + 0.5), 0, 255).astype(np.int64))
        out[k] = np.stack(layers)
    return out


#: The circle of 16 pixels (rows, columns) of the corner test, in order.
CIRCLE = [(-3, 0), (-3, 1), (-2, 2), (-1, 3), (0, 3), (1, 3), (2, 2), (3, 1), (3, 0), (3, -1), (2, -2), (1, -3), (0, -3), (-1, -3), (-2, -2), (-3, -1)]


def corners(image: np.ndarray, threshold: float = 20.0) -> np.ndarray:
    """Scores of the pixels with nine neighbours in a row on the circle all brighter or all darker; 0 elsewhere and where a neighbour scores more."""
    h, w = image.shape
    pad = np.pad(image.astype(float), 3, "reflect" if min(h, w) > 3 else "symmetric")
    ring = np.array([pad[3 + i : 3 + i + h, 3 + j : 3 + j + w] for i, j in CIRCLE]) - image
    score = np.zeros((h, w))
    for sign in (1, -1):
        over = sign * ring > threshold
        arc = np.zeros((h, w), bool)
        for start in range(16):
            arc |= np.all([over[(start + x) % 16] for x in range(9)], axis=0)
        score = np.maximum(score, np.where(arc, np.where(over, sign * ring - threshold, 0).sum(0), 0))
    pad = np.pad(score, 1)
    around = np.max([pad[1 + i : 1 + i + h, 1 + j : 1 + j + w] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j], axis=0)
    return np.where(score >= np.maximum(around, 1e-12), score, 0.0)


def resized(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, by pixel centres."""
    place = lambda n, m: np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
    r, c = place(h, image.shape[0]), place(w, image.shape[1])
    r0, c0 = np.minimum(r.astype(int), max(image.shape[0] - 2, 0)), np.minimum(c.astype(int), max(image.shape[1] - 2, 0))
    r1, c1 = np.minimum(r0 + 1, image.shape[0] - 1), np.minimum(c0 + 1, image.shape[1] - 1)
    fr, fc = (r - r0)[:, None], (c - c0)[None, :]
    part = lambda i, j: image[i][:, j]
    return (1 - fr) * ((1 - fc) * part(r0, c0) + fc * part(r0, c1)) + fr * ((1 - fc) * part(r1, c0) + fc * part(r1, c1))


def keypoint_mask(image: np.ndarray, spec: FeatureSpec, levels: int = 8, factor: float = 1.2, share: float = 0.25) -> np.ndarray:
    """1 where a corner of any pyramid level is, for the best ones up to a share of the pixels (ties: all levels in order)."""
    base = image[0]
    h, w = base.shape
    found = []
    for level in range(levels):
        scale = factor**level
        n, m = round(h / scale), round(w / scale)
        if min(n, m) < 7:
            break
        score = corners(base if not level else resized(base, n, m))
        r, c = np.nonzero(score)
        found += [(-s, level, min(h - 1, int(i * h / n)), min(w - 1, int(j * w / m))) for s, i, j in zip(score[r, c], r, c, strict=True)]
    out = np.zeros((h, w), np.int64)
    for _, _, i, j in sorted(found)[: int(share * h * w)]:
        out[i, j] = 1
    return out


def segment_areas(image: np.ndarray, scale: float = 50.0, least: int = 5) -> np.ndarray:
    """Size of the segment of every pixel: neighbours are merged in order of their colour distance while it is within what their segments vary by.

    image: bands x rows x cols of 8-bit values. A segment of n pixels allows its own largest distance plus scale / 255 / n.
    """
    bands, h, w = image.shape
    colour, number = np.floor(image) / 255.0, np.arange(h * w).reshape(h, w)
    pairs = []
    for a, b in ((np.s_[:, :-1], np.s_[:, 1:]), (np.s_[:-1, :], np.s_[1:, :]), (np.s_[:-1, :-1], np.s_[1:, 1:]), (np.s_[1:, :-1], np.s_[:-1, 1:])):
        cost = np.sqrt(((colour[(slice(None), *a)] - colour[(slice(None), *b)]) ** 2).sum(0))
        pairs.append((cost.ravel(), number[a].ravel(), number[b].ravel()))
    cost, left, right = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.argsort(cost, kind="stable")
    root, size, inner = list(range(h * w)), [1] * (h * w), [0.0] * (h * w)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def merge(a: int, b: int, c: float) -> None:
        root[b] = a
        size[a] += size[b]
        inner[a] = c

    edges = list(zip(cost[order].tolist(), left[order].tolist(), right[order].tolist(), strict=True))
    for c, x, y in edges:
        a, b = find(x), find(y)
        if a != b and c < min(inner[a] + scale / 255 / size[a], inner[b] + scale / 255 / size[b]):
            merge(a, b, c)
    for c, x, y in edges:
        a, b = find(x), find(y)
        if a != b and (size[a] < least or size[b] < least):
            merge(a, b, max(inner[a], inner[b], c))
    return np.array([size[find(x)] for x in range(h * w)]).reshape(h, w)


def segment_layer(image: np.ndarray, spec: FeatureSpec) -> np.ndarray:
    """The area image, rescaled like any other: cut at the largest value of the image, 0 to 255."""
    low, high = spec.range()
    scaled = np.floor((np.clip(image, low, high) - low) / (high - low) * 255)
    return np.floor((np.clip(segment_areas(scaled), low, high) - low) / (high - low) * 255)


def equalized_tile(image: np.ndarray, spec: FeatureSpec, bins: int = 256) -> np.ndarray:
    """The share of the section's pixels up to a value's bin, times 255, cut."""
    base = image[0]
    low, high = base.min(), base.max()
    place = np.zeros(base.shape, int) if high == low else np.minimum(np.floor((base - low) / ((high - low) / bins)), bins - 1).astype(int)
    upto = np.cumsum(np.bincount(place.ravel(), minlength=bins)) / base.size
    return np.floor(upto[place] * 255)


def adaptive_equalized(image: np.ndarray, spec: FeatureSpec, clip: float = 0.05, bins: int = 256) -> np.ndarray:
    """Contrast-limited equalisation of an 8-bit tile: histograms of blocks, cut at a share of their pixels, their sums interpolated between block centres."""
    base = np.floor(image[0]).astype(np.int64)
    h, w = base.shape
    side = max(8, h // 128), max(8, w // 128)
    rows, cols = max(1, h // side[0]), max(1, w // side[1])
    maps = np.zeros((rows, cols, bins))
    edge_r, edge_c = np.linspace(0, h, rows + 1).astype(int), np.linspace(0, w, cols + 1).astype(int)
    for i in range(rows):
        for j in range(cols):
            block = base[edge_r[i] : edge_r[i + 1], edge_c[j] : edge_c[j + 1]]
            n = np.bincount(block.ravel(), minlength=bins)[:bins].astype(float)
            limit = max(1.0, clip * block.size)
            n = np.minimum(n, limit) + np.maximum(n - limit, 0).sum() / bins
            maps[i, j] = np.cumsum(n) / block.size * 255
    centre = lambda e: (e[1:] + e[:-1] - 1) / 2
    place = lambda n, e: np.interp(np.arange(n), centre(e), np.arange(len(e) - 1))
    r, c = place(h, edge_r), place(w, edge_c)
    r0, c0 = np.minimum(r.astype(int), max(rows - 2, 0)), np.minimum(c.astype(int), max(cols - 2, 0))
    r1, c1 = np.minimum(r0 + 1, rows - 1), np.minimum(c0 + 1, cols - 1)
    fr, fc = (r - r0)[:, None], (c - c0)[None, :]
    at = lambda i, j: maps[i[:, None], j[None, :], base]
    return np.floor((1 - fr) * ((1 - fc) * at(r0, c0) + fc * at(r0, c1)) + fr * ((1 - fc) * at(r1, c0) + fc * at(r1, c1)))


def sobel(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences along columns and along rows; edges are mirrored."""
    h, w = image.shape
    p = np.pad(image, 1, "reflect" if min(h, w) > 1 else "edge")
    at = lambda i, j: p[1 + i : 1 + i + h, 1 + j : 1 + j + w]
    dx = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
    dy = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
    return dx, dy


def line_layers(image: np.ndarray, spec: FeatureSpec) -> dict[int, np.ndarray]:
    """Orientation in degrees, magnitude and both differences of the root of the standardised section."""
    base = image[0]
    sd = base.std()
    z = (base - base.mean()) / sd if sd > 0 else np.zeros_like(base)
    dx, dy = sobel(np.sqrt(z + abs(z.min())))
    return {0: np.stack([np.degrees(np.arctan2(dy, dx)) % 360, np.hypot(dx, dy), dx, dy])}


def thinned(mask: np.ndarray) -> np.ndarray:
    """A one-pixel skeleton: border pixels are peeled in two alternating passes as long as that keeps what is connected."""
    out = np.pad(mask.astype(np.uint8), 1)
    while True:
        changed = False
        for turn in (0, 1):
            c = out[1:-1, 1:-1]
            around = [out[:-2, 1:-1], out[:-2, 2:], out[1:-1, 2:], out[2:, 2:], out[2:, 1:-1], out[2:, :-2], out[1:-1, :-2], out[:-2, :-2]]
            n = sum(x.astype(int) for x in around)
            rises = sum(((a == 0) & (b == 1)).astype(int) for a, b in zip(around, around[1:] + around[:1], strict=True))
            up, right, down, left = around[0], around[2], around[4], around[6]
            sides = (up * right * down == 0) & (right * down * left == 0) if turn == 0 else (up * right * left == 0) & (up * down * left == 0)
            gone = (c == 1) & (n >= 2) & (n <= 6) & (rises == 1) & sides
            if gone.any():
                c[gone] = 0
                changed = True
        if not changed:
            return out[1:-1, 1:-1].astype(bool)


def labelled(mask: np.ndarray) -> list[np.ndarray]:
    """Flat places of the 4-connected parts of a mask, by first place: neighbours take the least place that either knows, until none learns more."""
    places = np.arange(mask.size).reshape(mask.shape)
    right, below = mask[:, :-1] & mask[:, 1:], mask[:-1] & mask[1:]
    one = np.concatenate([places[:, :-1][right], places[:-1][below]])
    other = np.concatenate([places[:, 1:][right], places[1:][below]])
    root = places.ravel().copy()
    while True:
        a, b = root[one], root[other]
        differ = a != b
        if not differ.any():
            break
        one, other = one[differ], other[differ]
        np.minimum.at(root, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while not np.array_equal(further := root[root], root):
            root = further
    own = places[mask]
    order = np.argsort(root[own], kind="stable")
    own = own[order]
    return np.split(own, np.flatnonzero(np.diff(root[own])) + 1) if len(own) else []


def support_lines(edges: np.ndarray, dx: np.ndarray, dy: np.ndarray, least: int = 5) -> list[tuple[np.ndarray, float, float]]:
    """(places, length, contrast) of the lines two steps off the skeleton of an edge mask; the last part found is left out."""
    if not edges.any():
        return []
    skeleton = thinned(edges)
    near = skeleton.copy()
    for _ in range(2):
        inner = near.copy()
        near[1:] |= inner[:-1]
        near[:-1] |= inner[1:]
        near[:, 1:] |= inner[:, :-1]
        near[:, :-1] |= inner[:, 1:]
    w, out = edges.shape[1], []
    for part in labelled(near & ~inner)[:-1]:
        n = len(part)
        if n <= least:
            continue
        f = np.fft.fftshift(np.fft.fft((part // w * (part % w)).astype(float))) / n
        at = n // 2 + 1
        contrast = np.maximum(np.abs(dx.ravel()[part]), np.abs(dy.ravel()[part])).max()
        out.append((part, 2 * (abs(f[at + 1]) + abs(f[at - 1])), float(contrast)))
    return out


def line_support(layers: np.ndarray, spec: FeatureSpec, k: int) -> np.ndarray:
    """Entropy of line lengths, mean contrast and entropy of contrasts of line support regions, window by window.

    Edge pixels (magnitude over 0.5) are put into bins of 45 degrees twice, half a bin apart; where two lines
    meet in a pixel the longer gains a vote and the other loses one; lines with more gains count.
    """
    out = np.zeros((len(layers), 3))
    for i, (angle, magnitude, dx, dy) in enumerate(layers):
        edge = magnitude > 0.5
        if not edge.any():
            continue
        maps = []
        for start in (0.0, 22.5):
            bins = np.ceil(((angle - start) % 360) / 45)  # a bin holds its upper end, not its lower one
            bins[(bins == 0) & (angle > 0)] = 8
            lines = []
            for b in range(1, 9):
                lines += support_lines(edge & (bins == b), dx, dy)
            maps.append(lines)
        own = [np.full(angle.size, -1), np.full(angle.size, -1)]
        for m in (0, 1):
            for number, (part, _, _) in enumerate(maps[m]):
                own[m][part] = number
        lengths = [np.array([line[1] for line in side]) for side in maps]
        met = [np.where(o >= 0, x[o] if len(x) else 0.0, 0.0) for o, x in zip(own, lengths, strict=True)]
        gain = np.where(met[0] > met[1], 1.0, -1.0)
        votes = [np.bincount(o[o >= 0], (sign * gain)[o >= 0], len(x)) for o, x, sign in zip(own, lengths, (1, -1), strict=True)]
        kept = [(length, contrast) for m in (0, 1) for (_, length, contrast), v in zip(maps[m], votes[m], strict=True) if v > 0]
        if not kept:
            continue
        length, contrast = np.array(kept).T
        entropies = []
        for x, edges in ((length, np.arange(5, 204, 4)), (contrast, np.linspace(0, 10, 20))):
            n = np.searchsorted(edges, x).astype(float)
            p = n / n.sum() if n.sum() else np.zeros_like(n)
            entropies.append(-(p * np.log(p + 1e-5)).sum())
        out[i] = entropies[0], contrast.mean(), entropies[1]
    return out


FIVE = ("max", "mean", "var", "skew", "kurt")
FOURIER = Kernel(("mean", "std"), one_layer, one_by_one(spectrum))
LBP_MOMENTS = Kernel(FIVE, pattern_layers, pattern_moments, lambda spec: 5, joint=True)
LBP_HISTOGRAM = Kernel(tuple(f"p{p}_{i}" for p, _ in PATTERNS for i in range(p + 2)), pattern_layers, pattern_histogram, lambda spec: 5, joint=True)
DMP = Kernel(("mean", "var"), profile_layer, mean_var)
GABOR_BANK = Kernel(("mean", "var"), gabor_layers, mean_var, lambda spec: spec.largest // 2)
MEAN = Kernel(("mean", "var"), one_layer, mean_var)
LSR = Kernel(("length_entropy", "contrast_mean", "contrast_entropy"), line_layers, one_by_one(line_support), joint=True)
