from __future__ import annotations

import pytest

from cellweave.spec import FeatureSpec, SpecError


def test_output_sizes_of_known_grids():
    spec = FeatureSpec(block=4, scales=(8,), section_size=1024)
    assert spec.out_size(1024, 1024) == (255, 255)
    assert spec.out_size(1024, 152)[1] == 37 and spec.out_size(681, 1169) == (170, 292)
    assert spec.out_size(4, 100) == (0, 24)  # not larger than the halo: no lines


def test_section_size_is_raised_until_the_largest_scale_divides_it():
    assert FeatureSpec(scales=(16,), section_size=1000).section_size == 1008
    assert FeatureSpec(scales=(8,), section_size=1000).section_size == 1000


def test_band_plan_and_names():
    spec = FeatureSpec(triggers=("mean", "pantex"), bands=(1, 2), block=4, scales=(16, 8))
    assert spec.scales == (8, 16)
    assert spec.band_ranges() == {"mean": (1, 8), "pantex": (9, 12)}
    assert spec.out_band("mean", 2, 16, 1) == 8 and spec.out_band("pantex", 1, 16, 0) == 10
    one = FeatureSpec(block=4, scales=(8,))
    assert one.tile_name("test_image", 1) == "test_image__BD1_BK4_SC8__ST1-002__TL000001"
    assert one.base_name("test_image") == "test_image__BD1_BK4_SC8_TRmean"


@pytest.mark.parametrize(
    "bad",
    [
        {"triggers": ("hough",)}, {"triggers": ("nothing",)}, {"triggers": ()}, {"block": 16, "scales": (8,)}, {"scales": (7, 8), "block": 2}, {"block": 3, "scales": (8,)}, {"smooth": 2}, {"smooth": 4},
        {"storage": "int64"}, {"block": 0}, {"section_size": 0},
    ],
)
def test_what_cannot_be_computed_is_refused(bad):
    with pytest.raises(SpecError):
        FeatureSpec(**bad)


def test_ranges():
    assert FeatureSpec().range() == (0.0, 255.0)
    assert FeatureSpec(storage="uint16").range() == (0.0, 10000.0)
    assert FeatureSpec(image_min=5.0, image_max=9.0).range() == (5.0, 9.0)
