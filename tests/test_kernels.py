from __future__ import annotations

import numpy as np
import pytest
from rasters import five, same, table, to_pixels

from cellweave.operators import kernels
from cellweave.operators.tiles import image_on_tiles, on_tiles
from cellweave.spec import FeatureSpec


def raster(seed: int, shape=(45, 38)) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 256, shape)


def spec_of(trigger: str, **more) -> FeatureSpec:
    return FeatureSpec(**({"triggers": (trigger,), "block": 4, "scales": (4, 8), "section_size": 16} | more))


def test_spectrum(spark):
    image, spec = raster(1), spec_of("fourier", block=6, scales=(8, 16), section_size=32)

    def measure(w, k):
        h, wd = w.shape
        f = 20 * np.log(np.abs(np.fft.fftshift(np.fft.fft2(w))))
        rings = {}
        for r in range(h):
            for c in range(wd):
                rings.setdefault(int(np.hypot(r - (wd - 1) / 2, c - (wd - 1) / 2)), []).append(f[r, c])
        profile = [np.mean(rings[x]) for x in sorted(rings)][1:-1]
        return [np.mean(profile), np.std(profile)]

    same(table(on_tiles(to_pixels(spark, image), spec, kernels.FOURIER), ("mean", "std")), image, spec, measure)


def test_a_flat_window_has_no_spectrum(spark):
    got = on_tiles(to_pixels(spark, np.full((16, 16), 7)), spec_of("fourier"), kernels.FOURIER).collect()
    assert got and all(row["mean"] == 0 and row["std"] == 0 for row in got)


def codes(image: np.ndarray, samples: int, radius: int) -> np.ndarray:
    h, w = image.shape
    value = lambda r, c: image[r, c] if 0 <= r < h and 0 <= c < w else 0
    out = np.zeros(image.shape, int)
    for r in range(h):
        for c in range(w):
            signs = []
            for p in range(samples):
                y, x = r + round(-radius * np.sin(2 * np.pi * p / samples), 5), c + round(radius * np.cos(2 * np.pi * p / samples), 5)
                i, j = int(np.floor(y)), int(np.floor(x))
                v = (1 - y + i) * ((1 - x + j) * value(i, j) + (x - j) * value(i, j + 1)) + (y - i) * ((1 - x + j) * value(i + 1, j) + (x - j) * value(i + 1, j + 1))
                signs.append(v >= image[r, c] - 1e-9)
            changes = sum(a != b for a, b in zip(signs, signs[1:] + signs[:1]))
            out[r, c] = sum(signs) if changes <= 2 else samples + 1
    return out


def test_binary_patterns(spark):
    image, spec = raster(2, (24, 20)), spec_of("lbp")
    layers = [codes(image, p, r) for p, r in kernels.PATTERNS]
    names = kernels.LBP_HISTOGRAM.names
    got = table(on_tiles(to_pixels(spark, image), spec, kernels.LBP_HISTOGRAM), names)
    numbered = np.arange(image.size).reshape(image.shape)
    pick = lambda w, x: layers[x].ravel()[w.ravel()]
    same(got, numbered, spec, lambda w, k: np.concatenate([np.bincount(pick(w, x), minlength=p + 2) for x, (p, _) in enumerate(kernels.PATTERNS)]))
    got = table(on_tiles(to_pixels(spark, image), spec, kernels.LBP_MOMENTS), kernels.FIVE)
    same(got, numbered, spec, lambda w, k: five(np.concatenate([np.bincount(pick(w, x), minlength=x + 2) for x in range(3)])), 1e-5)


@pytest.mark.parametrize(("kernel", "trigger"), [(kernels.FOURIER, "fourier"), (kernels.LBP_HISTOGRAM, "lbp"), (kernels.GABOR_BANK, "gabor"), (kernels.MEAN, "mean")])
def test_the_size_of_tiles_does_not_matter(spark, kernel, trigger):
    pixels = to_pixels(spark, raster(3)).cache()
    key = lambda row: (row["k"], row["layer"], row["bi"], row["bj"])
    a, z = (sorted(on_tiles(pixels, spec_of(trigger, section_size=n), kernel).collect(), key=key) for n in (16, 64))
    assert [key(r) for r in a] == [key(r) for r in z]
    np.testing.assert_allclose([r[5:] for r in a], [r[5:] for r in z], atol=1e-9)


def dilate(x, size):
    p = np.pad(x, size // 2, constant_values=-(10**9))
    return np.max([p[i : i + x.shape[0], j : j + x.shape[1]] for i in range(size) for j in range(size)], axis=0)


def test_morphological_profile():
    image = raster(4, (20, 17))
    layers = []
    for sign in (1, -1):
        own = marker = before = sign * image
        for size in kernels.PROFILE:
            marker = -dilate(-marker, size)
            now = marker
            while True:
                new = np.minimum(dilate(now, size), own)
                if (new == now).all():
                    break
                now = new
            layers.append(before - now)
            before = now
    slope = np.zeros(image.shape)
    for i in range(14):
        lo, hi = max(0, i - 1), min(13, i + 1)
        slope += (layers[hi] - layers[lo]) / (hi - lo)
    want = np.trunc(slope / 14).astype(int) & 255
    np.testing.assert_array_equal(kernels.profile_layer(image[None].astype(float), spec_of("dmp"))[0][0], want)


def test_gabor_bank_is_normalised_and_of_odd_side():
    for k, side in ((8, 7), (7, 7), (4, 3)):
        bank = kernels.gabor_bank(k)
        assert len(bank) == 8 and all(x.shape == (side, side) and abs(x.sum() / kernels.GABOR_UNIT - 1 / 1.5) < 1e-4 for x in bank)


def test_corners_are_found_and_flat_images_have_none(spark):
    image = np.zeros((32, 32), int)
    image[8:24, 8:24] = 200
    pixels = to_pixels(spark, image)
    got = {(r["r"], r["c"]) for r in image_on_tiles(pixels, spec_of("orb", section_size=64), lambda x, spec: kernels.keypoint_mask(x, spec, levels=1)).where("v = 1").collect()}
    assert any(abs(r - 8) <= 1 and abs(c - 8) <= 1 for r, c in got) and not any(12 < r < 19 and 12 < c < 19 for r, c in got)
    assert kernels.keypoint_mask(np.full((1, 20, 20), 9.0), spec_of("orb")).sum() == 0


def test_segments_of_two_flat_halves():
    image = np.zeros((3, 10, 10))
    image[:, :, 4:] = 250
    image[:, 0, 0] = 120  # a speck is smaller than a segment may be
    areas = kernels.segment_areas(image)
    assert set(areas[:, :4].ravel()) == {40} and set(areas[:, 4:].ravel()) == {60}


def test_equalised_tiles():
    image = raster(5, (64, 64))[None].astype(float)
    spec = spec_of("mean")
    flat = kernels.equalized_tile(image, spec)
    assert abs(flat.mean() - 127.5) < 3 and flat.max() == 255
    order = np.argsort(image[0].ravel(), kind="stable")
    assert (np.diff(flat.ravel()[order]) >= 0).all()
    out = kernels.adaptive_equalized(image, spec)
    assert out.shape == (64, 64) and 0 <= out.min() and out.max() <= 255
    assert len(np.unique(kernels.adaptive_equalized(np.full((1, 32, 32), 9.0), spec))) == 1


def test_line_support_of_a_stripe_and_of_nothing():
    spec = spec_of("lsr")
    flat = kernels.line_layers(np.full((1, 32, 32), 5.0), spec)[0]
    assert kernels.line_support(flat[None], spec, 32).tolist() == [[0.0, 0.0, 0.0]]
    image = np.zeros((1, 48, 48))
    image[0, :, 20:28] = 200
    image[0, 30:36, :] = 120
    got = kernels.line_support(kernels.line_layers(image, spec)[0][None], spec, 48)
    assert got[0, 1] > 0 and got[0, 0] > 0 and np.isfinite(got).all()


def test_thinning_keeps_a_line_and_its_connection():
    mask = np.zeros((12, 20), bool)
    mask[4:8, 2:18] = True
    thin = kernels.thinned(mask)
    assert thin.sum() < mask.sum() / 2 and len(kernels.labelled(np.array([[1, 1, 0], [0, 0, 1]], bool))) == 2 and (thin & ~mask).sum() == 0


def test_missing_pixels_and_thin_rasters(spark):
    spec = spec_of("fourier")
    assert on_tiles(to_pixels(spark, raster(6, (3, 40))), spec, kernels.FOURIER).count() == 0
    empty = spark.createDataFrame([], "band int, r long, c long, v long")
    assert on_tiles(empty, spec, kernels.FOURIER).count() == 0
