"""Kernels without SQL against plain loops, pixel by pixel: key points, segments, adaptive equalisation, line support."""

from __future__ import annotations

import cmath
import math

import numpy as np
import pytest

from cellweave.operators import kernels
from cellweave.spec import FeatureSpec

SPEC = FeatureSpec(triggers=("mean",), block=4, scales=(8,))
#: The circle of radius 3 around a pixel.
RING = ((-3, 0), (-3, 1), (-2, 2), (-1, 3), (0, 3), (1, 3), (2, 2), (3, 1), (3, 0), (3, -1), (2, -2), (1, -3), (0, -3), (-1, -3), (-2, -2), (-3, -1))


def blocks(seed: int, shape: tuple[int, int], side: int = 6, noise: int = 5) -> np.ndarray:
    """Flat blocks of random grey with some noise."""
    rng = np.random.default_rng(seed)
    grey = rng.integers(0, 250, (shape[0] // side + 1, shape[1] // side + 1)).repeat(side, 0).repeat(side, 1)[: shape[0], : shape[1]]
    return grey + rng.integers(0, noise + 1, shape)


def mirrored(i: int, n: int) -> int:
    return -i if i < 0 else 2 * (n - 1) - i if i >= n else i


def plain_corners(image) -> dict[tuple[int, int], float]:
    h, w = len(image), len(image[0])
    score = {}
    for r in range(h):
        for c in range(w):
            for sign in (1, -1):
                over = [sign * (image[mirrored(r + i, h)][mirrored(c + j, w)] - image[r][c]) - 20 for i, j in RING]
                if any(all(over[(s + x) % 16] > 0 for x in range(9)) for s in range(16)):
                    score[r, c] = max(score.get((r, c), 0), sum(x for x in over if x > 0))
    around = lambda r, c: [score.get((r + i, c + j), 0) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    return {p: s for p, s in score.items() if s >= max(around(*p))}


def smaller(image, n: int, m: int):
    h, w = len(image), len(image[0])

    def value(r, c):
        y, x = min(max((r + 0.5) * h / n - 0.5, 0), h - 1), min(max((c + 0.5) * w / m - 0.5, 0), w - 1)
        i, j = min(int(y), h - 2), min(int(x), w - 2)
        y, x = y - i, x - j
        return (1 - y) * ((1 - x) * image[i][j] + x * image[i][j + 1]) + y * ((1 - x) * image[i + 1][j] + x * image[i + 1][j + 1])

    return [[value(r, c) for c in range(m)] for r in range(n)]


@pytest.mark.parametrize(("seed", "levels", "share"), [(1, 1, 0.25), (2, 1, 0.004), (3, 8, 0.25)])
def test_key_points(seed, levels, share):
    image = blocks(seed, (40, 33))
    h, w = image.shape
    found = []
    for level in range(levels):
        n, m = round(h / 1.2**level), round(w / 1.2**level)
        if min(n, m) < 7:
            break
        grey = image.tolist() if not level else smaller(image.tolist(), n, m)
        found += [(-s, level, int(r * h / n), int(c * w / m)) for (r, c), s in plain_corners(grey).items()]
    want = {(r, c) for _, _, r, c in sorted(found)[: int(share * h * w)]}
    got = kernels.keypoint_mask(image[None].astype(float), SPEC, levels=levels, share=share)
    assert len(want) > 3 and set(zip(*map(list, np.nonzero(got)), strict=True)) == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_segments(seed):
    image = np.stack([blocks(seed * 10 + b, (14, 12), 5, 30) for b in range(3)])
    _, h, w = image.shape
    colour = (image / 255.0).tolist()
    edges = []
    for dr, dc in ((0, 1), (1, 0), (1, 1), (-1, 1)):
        for r in range(h):
            for c in range(w):
                if 0 <= r + dr < h and c + dc < w:
                    edges.append((math.sqrt(sum((band[r][c] - band[r + dr][c + dc]) ** 2 for band in colour)), (r, c), (r + dr, c + dc)))
    edges.sort(key=lambda e: e[0])
    own = {(r, c): {(r, c)} for r in range(h) for c in range(w)}
    inner = {id(s): 0.0 for s in own.values()}

    def merge(a: set, b: set, cost: float) -> None:
        a |= b
        inner[id(a)] = cost
        for p in b:
            own[p] = a

    for cost, p, q in edges:
        a, b = own[p], own[q]
        if a is not b and cost < min(inner[id(s)] + 50 / 255 / len(s) for s in (a, b)):
            merge(a, b, cost)
    for cost, p, q in edges:
        a, b = own[p], own[q]
        if a is not b and min(len(a), len(b)) < 5:
            merge(a, b, cost)
    want = [[len(own[r, c]) for c in range(w)] for r in range(h)]
    assert 1 < len({id(s) for s in own.values()}) < h * w / 5
    np.testing.assert_array_equal(kernels.segment_areas(image.astype(float)), want)


def test_adaptive_equalisation():
    image = np.minimum(blocks(4, (37, 42), 9, 20), 255)
    h, w = image.shape
    rows, cols = h // 8, w // 8
    top, left = [h * i // rows for i in range(rows + 1)], [w * j // cols for j in range(cols + 1)]

    def mapped(i: int, j: int, v: int) -> float:
        block = image[top[i] : top[i + 1], left[j] : left[j + 1]].ravel().tolist()
        limit = 0.05 * len(block)
        count = [block.count(x) for x in range(256)]
        cut = sum(max(0, n - limit) for n in count)
        return sum(min(n, limit) + cut / 256 for n in count[: v + 1]) / len(block) * 255

    def near(x: int, edges: list[int]) -> list[tuple[int, float]]:
        """The blocks between whose centres a pixel is, with their shares."""
        centre = [(a + z - 1) / 2 for a, z in zip(edges, edges[1:])]
        if x <= centre[0] or x >= centre[-1]:
            return [(0 if x <= centre[0] else len(centre) - 1, 1.0)]
        k = max(i for i, c in enumerate(centre) if c <= x)
        part = (x - centre[k]) / (centre[k + 1] - centre[k])
        return [(k, 1 - part), (k + 1, part)]

    want = np.array([[sum(p * q * mapped(i, j, image[r, c]) for i, p in near(r, top) for j, q in near(c, left)) for c in range(w)] for r in range(h)])
    got = kernels.adaptive_equalized(image[None].astype(float), SPEC)
    # Whole numbers by cutting: those at a border may fall to either side of it.
    assert (np.abs(got - np.floor(want)) <= (np.abs(want - np.round(want)) < 1e-6)).all() and len(np.unique(got)) > 50


def plain_thinned(mask: set) -> set:
    out = set(mask)
    ring = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
    while True:
        before = len(out)
        for turn in (0, 1):
            gone = set()
            for r, c in out:
                p = [(r + i, c + j) in out for i, j in ring]
                up, right, down, left = p[::2]
                rises = sum(not a and b for a, b in zip(p, p[1:] + p[:1]))
                sides = not (up and right and down) and not (right and down and left) if turn == 0 else not (up and right and left) and not (up and down and left)
                if 2 <= sum(p) <= 6 and rises == 1 and sides:
                    gone.add((r, c))
            out -= gone
        if len(out) == before:
            return out


def plain_lines(edges: set, layers, shape) -> list[tuple[list, float, float]]:
    if not edges:
        return []
    rings = [plain_thinned(edges)]
    for _ in range(2):
        rings.append({(r + i, c + j) for r, c in rings[-1] for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) if 0 <= r + i < shape[0] and 0 <= c + j < shape[1]})
    left, parts = rings[2] - rings[1], []
    while left:
        part, front = set(), {min(left)}
        while front:
            part |= front
            front = {(r + i, c + j) for r, c in front for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))} & left - part
        left = left - part
        parts.append(sorted(part))
    out = []
    for part in parts[:-1]:
        n = len(part)
        if n > 5:
            power = [abs(sum(r * c * cmath.exp(-2j * math.pi * f * t / n) for t, (r, c) in enumerate(part))) / n for f in (0, 2)]
            out.append((part, 2 * sum(power), max(max(abs(layers[2][p]), abs(layers[3][p])) for p in part)))
    return out


def plain_support(layers: np.ndarray) -> list[float]:
    shape = layers.shape[1:]
    places = [(r, c) for r in range(shape[0]) for c in range(shape[1]) if layers[1][r, c] > 0.5]
    lines: list[list] = [[], []]
    for m, start in enumerate((0.0, 22.5)):
        for b in range(8):
            # A bin holds its upper end, so an angle at the start of the first is in the last, but for 0 itself.
            turned = {p: (layers[0][p] - start) % 360 for p in places}
            inside = {p for p, a in turned.items() if 45 * b < a <= 45 * (b + 1) or (b == 7 and a == 0 and layers[0][p] > 0)}
            lines[m] += plain_lines(inside, layers, shape)
    own: list[dict] = [{p: x for x, line in enumerate(side) for p in line[0]} for side in lines]
    votes = [[0] * len(side) for side in lines]
    for p in own[0].keys() | own[1].keys():
        first = (lines[0][own[0][p]][1] if p in own[0] else 0) > (lines[1][own[1][p]][1] if p in own[1] else 0)
        for m, wins in ((0, first), (1, not first)):
            if p in own[m]:
                votes[m][own[m][p]] += 1 if wins else -1
    kept = [line for m in (0, 1) for line, v in zip(lines[m], votes[m]) if v > 0]
    if not kept:
        return [0.0, 0.0, 0.0]

    def entropy(values: list[float], borders: list[float]) -> float:
        n = [sum(b < x for b in borders) for x in values]
        shares = [x / sum(n) if sum(n) else 0.0 for x in n]
        return -sum(p * math.log(p + 1e-5) for p in shares)

    return [entropy([x[1] for x in kept], list(range(5, 204, 4))), sum(x[2] for x in kept) / len(kept), entropy([x[2] for x in kept], [10 * i / 19 for i in range(20)])]


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_line_support(seed):
    image = blocks(seed, (40, 36), 9, 3).astype(float)
    layers = kernels.line_layers(image[None], FeatureSpec(triggers=("lsr",), block=4, scales=(8,)))[0]
    z = (image - image.mean()) / image.std()
    root = np.sqrt(z + abs(z.min()))
    at = lambda r, c: root[mirrored(r, 40), mirrored(c, 36)]
    for r in range(40):
        for c in range(36):
            dx = sum(k * (at(r + i, c + 1) - at(r + i, c - 1)) for i, k in ((-1, 1), (0, 2), (1, 1)))
            dy = sum(k * (at(r + 1, c + j) - at(r - 1, c + j)) for j, k in ((-1, 1), (0, 2), (1, 1)))
            assert layers[1:, r, c] == pytest.approx([math.hypot(dx, dy), dx, dy], abs=1e-9)
            if math.hypot(dx, dy) > 1e-6:
                assert (layers[0, r, c] - math.degrees(math.atan2(dy, dx)) + 180) % 360 == pytest.approx(180, abs=1e-6)
    got = kernels.line_support(np.stack([layers, layers[:, ::-1]]), SPEC, 40)
    assert got[0, 1] > 0
    for own, one in zip(got, (layers, layers[:, ::-1]), strict=True):
        np.testing.assert_allclose(own, plain_support(one), rtol=1e-6, atol=1e-9)
