from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from rasters import five, same, table, to_pixels, weighted

from cellweave.operators import shapes, stencils, texture, window
from cellweave.operators.kernels import FIVE
from cellweave.spec import FeatureSpec

#: Clipped windows, one scale as large as the block, odd scales with block 1, whole windows only.
SPECS = [FeatureSpec(block=4, scales=(4, 8)), FeatureSpec(block=6, scales=(8, 16)), FeatureSpec(block=1, scales=(3, 5)), FeatureSpec(block=2, scales=(2, 6))]


def raster(seed: int, top: int = 255, shape=(27, 22)) -> np.ndarray:
    rng = np.random.default_rng(seed)
    image = rng.integers(0, top + 1, shape)
    image[:9, :9] = 0  # some windows are all zero
    return image


@pytest.mark.parametrize("spec", SPECS, ids=lambda s: f"b{s.block}k{s.scales}")
def test_weighted_mean(spark, spec):
    image = raster(1)
    same(table(window.window_mean(to_pixels(spark, image), spec), ("mean", "var")), image, spec, weighted, 1e-6, 1e-3)


@pytest.mark.parametrize(
    ("image", "k", "mean", "var"),
    [
        (np.full((4, 4), 10), 4, 6.2317718108, 14.1995436856), (np.full((5, 5), 10), 5, 6.3303508255, 13.4663250642),
        (np.array([[(7 * r + 3 * c) % 32 for c in range(8)] for r in range(8)]), 8, 5.7574089663, 177.1680800504),
    ],
)
def test_weighted_mean_of_known_windows(spark, image, k, mean, var):
    spec = FeatureSpec(block=k, scales=(k,)) if k % 2 == 0 else FeatureSpec(block=1, scales=(k,))
    got = window.window_mean(to_pixels(spark, image), spec).collect()
    assert len(got) == 1 and got[0]["mean"] == pytest.approx(mean, abs=1e-7) and got[0]["var"] == pytest.approx(var, abs=1e-5)


def test_nulls_are_counted_but_not_summed(spark):
    pixels = spark.createDataFrame([(1, r, c, None if (r, c) == (0, 0) else 10) for r in range(4) for c in range(4)], "band int, r long, c long, v long")
    got = window.window_mean(pixels, FeatureSpec(block=4, scales=(4,)), (4, 4)).first()
    assert got["mean"] == pytest.approx(6.2317718108 - 10 / np.hypot(2, 2) / 16, abs=1e-6)


@pytest.mark.parametrize("spec", SPECS, ids=lambda s: f"b{s.block}k{s.scales}")
@pytest.mark.parametrize("shape", [(27, 22), (32, 24)])
def test_plain_sums(spark, spec, shape):
    image = raster(2, shape=shape)
    measure = lambda w, k: [w.size, w.sum(), w.min(), w.max(), w.mean(), w.var(), w.var(ddof=1)]
    same(table(window.window_basic(to_pixels(spark, image), spec), ("n", "sum", "min", "max", "mean", "var_pop", "var_samp")), image, spec, measure)


@pytest.mark.parametrize("spec", SPECS[:2], ids=lambda s: f"b{s.block}k{s.scales}")
def test_moments(spark, spec):
    image = raster(3)
    same(table(window.window_moments(to_pixels(spark, image), spec), FIVE), image, spec, lambda w, k: five(w.ravel()), 1e-5, 1e-6)


@pytest.mark.parametrize("spec", SPECS, ids=lambda s: f"b{s.block}k{s.scales}")
def test_contrast_is_that_of_a_co_occurrence_matrix(spark, spec):
    image = raster(4, 31)

    def measure(w, k):
        least = []
        for dr, dc in texture.PAIR_OFFSETS:
            p = np.zeros((32, 32))
            for r in range(w.shape[0]):
                for c in range(w.shape[1]):
                    if 0 <= r + dr < w.shape[0] and 0 <= c + dc < w.shape[1]:
                        p[w[r, c], w[r + dr, c + dc]] += 1
                        p[w[r + dr, c + dc], w[r, c]] += 1
            if p.sum():
                i, j = np.indices(p.shape)
                least.append(((i - j) ** 2 * p / p.sum()).sum())
        return [min(least, default=0.0)]

    same(table(texture.pantex(to_pixels(spark, image), spec), ("contrast",)), image, spec, measure)


def test_known_contrast_and_lacunarity(spark):
    image = np.array([[(7 * r + 3 * c) % 32 for c in range(8)] for r in range(8)])
    spec = FeatureSpec(block=8, scales=(8,))
    assert texture.pantex(to_pixels(spark, image), spec).first()["contrast"] == pytest.approx(23.8571428571, abs=1e-9)
    assert texture.lacunarity(to_pixels(spark, image), spec).first()["lacunarity"] == pytest.approx(0.1159358393, abs=1e-9)
    assert texture.lacunarity(to_pixels(spark, np.zeros((8, 8), int)), spec).first()["lacunarity"] == pytest.approx(1 / 16)


@pytest.mark.parametrize("spec", SPECS[:3], ids=lambda s: f"b{s.block}k{s.scales}")
def test_lacunarity(spark, spec):
    image = raster(5, 31)

    def measure(w, k):
        mass = []
        for r in range(0, w.shape[0], 2):
            for c in range(0, w.shape[1], 2):
                box = w[r : r + 2, c : c + 2]
                side = min(box.shape)
                mass.append(int(np.ceil(max(1, box.max()) / side) - np.ceil(box.min() / side) + 1))
        p = {m: mass.count(m) / len(mass) for m in mass}
        return [sum(m * m * p[m] for m in mass) / sum(m * p[m] for m in mass) ** 2]

    same(table(texture.lacunarity(to_pixels(spark, image), spec), ("lacunarity",)), image, spec, measure)


@pytest.mark.parametrize("spec", SPECS[:2], ids=lambda s: f"b{s.block}k{s.scales}")
def test_oriented_gradients(spark, spec):
    image = raster(6)

    def measure(w, k):
        if w.max() == 0:
            return [0.0] * 5
        gr, gc = np.zeros(w.shape), np.zeros(w.shape)
        gr[1:-1] = w[2:] - w[:-2]
        gc[:, 1:-1] = w[:, 2:] - w[:, :-2]
        angle = np.degrees(np.arctan2(gr, gc)) % 180
        h = np.array([np.hypot(gr, gc)[np.minimum(angle // 20, 8) == b].sum() for b in range(9)]) / w.size
        h = np.minimum(h / np.sqrt((h**2).sum() + 1e-10), 0.2)
        return five(h / np.sqrt((h**2).sum() + 1e-10))

    got = table(texture.hog(to_pixels(spark, image), spec), FIVE)
    same({key: x[:3] for key, x in got.items()}, image, spec, lambda w, k: measure(w, k)[:3], 1e-5, 1e-6)
    # Skewness and kurtosis are ratios of tiny numbers where the bins are nearly equal.
    same({key: x[3:] if x[2] > 1e-3 else [0, 0] for key, x in got.items()}, image, spec, lambda w, k: measure(w, k)[3:] if measure(w, k)[2] > 1e-3 else [0, 0], 1e-3, 1e-3)


def plain_line(r0, c0, r1, c1):
    """A place for each step along the longer side, by exact fractions; halves go away from the start."""
    n = max(abs(r1 - r0), abs(c1 - c0))
    at = lambda a, z, i: a + (1 if z > a else -1) * math.floor(Fraction(abs(z - a) * i, n) + Fraction(1, 2))
    return [(at(r0, r1, i), at(c0, c1, i)) for i in range(n + 1)] if n else [(r0, c0)]


@pytest.mark.parametrize("spec", [FeatureSpec(triggers=("sfs",), block=4, scales=(8,)), FeatureSpec(triggers=("sfs",), block=6, scales=(8, 16)), FeatureSpec(triggers=("sfs",), block=1, scales=(5,), line_skip=2), FeatureSpec(triggers=("sfs",), block=2, scales=(8, 16), section_size=20)], ids=lambda s: f"b{s.block}k{s.scales}")
def test_lines(spark, spec):
    image = raster(7, 60)

    def measure(w, k):
        (h, wd), b = w.shape, spec.block
        r, c, half = h // 2, wd // 2, b // 2
        ctr = w[r, c] if b == 1 else w[r - half : r + half, c - half : c + half].mean()
        sides = [[(e, 0) for e in range(0, h, spec.line_skip)], [(e, wd - 1) for e in range(0, h, spec.line_skip)], [(0, e) for e in range(0, wd, spec.line_skip)], [(h - 1, e) for e in range(0, wd, spec.line_skip)]]
        lengths, wmean = [], 0.0
        for end in sum(sides, []):
            line, ph, n = plain_line(r, c, *end), 0.0, 0
            assert line[0] == (r, c) and line[-1] == end
            while n < len(line) and ph < spec.line_threshold:
                ph += abs(ctr - w[line[n]])
                n += 1
            stop = line[min(n, len(line) - 1)]
            d = np.hypot(stop[0] - r, stop[1] - c)
            sd = np.var([w[p] for p in line[:n]]) * 0.5
            wmean += 0.1 * (d - 1) / sd if sd > 1e-9 else 0.0
            lengths.append(d)
        x = np.array(lengths)
        a, z = len(sides[0]), len(sides[2])
        left, right, top, bottom = x[:a], x[a : 2 * a], x[2 * a : 2 * a + z], x[2 * a + z :]
        m = min(a, z)
        orthogonal = max(np.abs(left[:m] - bottom[:m]).max(), np.abs(right[:m] - top[:m]).max())
        return [x.max(), min(x[x > 0], default=0.0), x.mean(), wmean / len(x), x.std(), orthogonal]

    same(table(texture.sfs(to_pixels(spark, image), spec), ("max", "min", "mean", "wmean", "std", "orthogonal")), image, spec, measure)


def test_line_places_are_the_midpoint_line():
    assert shapes.line_places(1, 1, 8, 8) == [(i, i) for i in range(1, 9)]
    assert shapes.line_places(2, 2, 2, 2) == [(2, 2)]
    for end in [(0, 5), (7, 1), (3, 0), (0, 0), (6, 7)]:
        line = shapes.line_places(4, 4, *end)
        assert all(max(abs(a - c), abs(b - d)) == 1 for (a, b), (c, d) in zip(line, line[1:]))


def test_pyramid_of_a_mask(spark):
    image = (np.random.default_rng(8).random((30, 24)) < 0.3).astype(int)
    spec = FeatureSpec(triggers=("orb",), block=6, scales=(8, 16))

    def bins(w):
        out = []
        for level in (2, 4, 8):
            ty, tx = w.shape[0] // level, w.shape[1] // level
            if ty > 1 and tx > 1:
                for r in range(0, w.shape[0] - 1, ty):
                    for c in range(0, w.shape[1] - 1, tx):
                        part = w[r : r + ty, c : c + tx]
                        if min(part.shape) > 1:
                            out.append(part.sum())
        return out

    same(table(window.keypoint_moments(to_pixels(spark, image), spec), FIVE), image, spec, lambda w, k: five(bins(w)), 1e-5, 1e-6)


def test_gradient_is_the_mean_of_four_kernel_pairs(spark):
    image = raster(9)
    s = np.pad(np.sqrt(image), 1, "symmetric")[:-1, :-1]
    a, b, c, d = s[:-1, :-1], s[:-1, 1:], s[1:, :-1], s[1:, 1:]
    want = np.floor(sum(np.hypot(g, g) for g in (c - b, d - a, c + d - a - b, b + d - a - c)) / 4 + 1e-9)
    got = np.zeros(image.shape)
    for row in stencils.gradient(to_pixels(spark, image), *image.shape).collect():
        got[row["r"], row["c"]] = row["v"]
    np.testing.assert_array_equal(got, want)


def test_smoothing_weighs_by_nearness_and_likeness(spark):
    image = raster(10, 3)
    p, want = np.pad(image, 2, "reflect"), np.zeros(image.shape)
    for r in range(image.shape[0]):
        for c in range(image.shape[1]):
            top = weight = 0.0
            for i in range(-2, 3):
                for j in range(-2, 3):
                    if i * i + j * j <= 4:
                        v = p[r + 2 + i, c + 2 + j]
                        x = np.exp(-((v - image[r, c]) ** 2) / (2 * 0.8**2)) * np.exp(-(i * i + j * j) / (2 * 1.1**2))
                        top, weight = top + x * v, weight + x
            want[r, c] = np.floor(top / weight + 0.5)
    got = np.zeros(image.shape)
    for row in stencils.smoothed(to_pixels(spark, image), 5, *image.shape, sigma_colour=0.8, sigma_space=1.1).collect():
        got[row["r"], row["c"]] = row["v"]
    np.testing.assert_array_equal(got, want)

WIDE = [FeatureSpec(block=2, scales=(16, 24), section_size=24), FeatureSpec(block=4, scales=(8, 34), section_size=34), FeatureSpec(block=1, scales=(9,), section_size=18, line_skip=2, box=3)]


@pytest.mark.parametrize("spec", WIDE, ids=lambda s: f"b{s.block}k{s.scales}")
def test_wide_windows_on_tiles_give_the_same_numbers(spark, spec, monkeypatch):
    """Clipped windows, boxes that do not divide the window, several sections."""
    image = raster(11, 31, (53, 46))
    pixels = to_pixels(spark, image).cache()
    mask = to_pixels(spark, (image > 20).astype(int)).cache()
    made = {
        "pantex": lambda: texture.pantex(pixels, spec), "lac": lambda: texture.lacunarity(pixels, spec), "hog": lambda: texture.hog(pixels, spec),
        "moments": lambda: window.window_moments(pixels, spec), "orb": lambda: window.keypoint_moments(mask, spec),
    }
    for name, make in made.items():
        tables = []
        for most in (0, 10**9):
            monkeypatch.setattr(texture, "MOST_COPIES", most)
            monkeypatch.setattr(window, "MOST_COPIES", most)
            df = make()
            names = [c for c in df.columns if c not in ("band", "k", "bi", "bj")]
            assert df.dtypes[1:4] == [("k", "int"), ("bi", "bigint"), ("bj", "bigint")]
            tables.append(table(df, names))
        assert tables[0].keys() == tables[1].keys() and len(tables[0]) == len(spec.scales) * np.prod(spec.out_size(53, 46)), name
        for key, x in tables[0].items():
            loose = name == "hog" and x[2] < 1e-3 or name == "moments" and x[2] < 1e-2
            np.testing.assert_allclose(x[: 3 if loose else None], tables[1][key][: 3 if loose else None], rtol=1e-6, atol=1e-6, err_msg=f"{name} {key}")
