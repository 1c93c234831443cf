from __future__ import annotations

import json

import numpy as np
import pytest
from rasters import to_pixels

from cellweave.plans import features, mosaic
from cellweave.sources import grids
from cellweave.spec import STATISTICS, FeatureSpec, SpecError
from cellweave.streaming import ingest


def image(seed: int = 1, shape=(40, 36), bands: int = 1) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [rng.integers(0, 256, shape) for _ in range(bands)]


def pixels_of(spark, layers):
    out = to_pixels(spark, layers[0], 1)
    for b, x in enumerate(layers[1:], 2):
        out = out.union(to_pixels(spark, x, b))
    return out


def test_every_trigger_gives_its_statistics_for_every_cell(spark):
    spec = FeatureSpec(triggers=tuple(sorted(STATISTICS)), bands=(1,), block=8, scales=(16,), section_size=32)
    pixels = pixels_of(spark, image(bands=4)).cache()
    got = features.spatial_features(pixels, spec, (40, 36)).groupBy("trigger").count().collect()
    n, m = spec.out_size(40, 36)
    assert {r["trigger"]: r["count"] for r in got} == {t: n * m * STATISTICS[t] for t in spec.triggers}


def test_output_bands_are_gapless_and_in_order(spark):
    spec = FeatureSpec(triggers=("mean", "lac"), bands=(1, 2), block=8, scales=(8, 16), section_size=32)
    got = features.spatial_features(pixels_of(spark, image(bands=2)), spec, (40, 36))
    rows = got.select("trigger", "band", "k", "stat", "out_band").distinct().collect()
    assert sorted(r["out_band"] for r in rows) == list(range(1, 13))
    assert all(spec.out_band(r["trigger"], r["band"], r["k"], r["stat"]) == r["out_band"] for r in rows)
    wide = features.wide_form(got, spec)
    assert wide.columns[:3] == ["bi", "bj", "mean_1_8_0"] and len(wide.columns) == 14 and wide.where("mean_2_16_1 IS NULL").count() == 0


def test_neighbours_repeat_the_edge(spark):
    cells = spark.createDataFrame([("t", 1, 8, 0, i, j, float(10 * i + j)) for i in range(2) for j in range(2)], "trigger string, band int, k int, stat int, bi long, bj long, value double")
    got = {(r["bi"], r["bj"], r["side"]): r["value"] for r in features.neighbors(cells).collect()}
    assert got[0, 0, "own"] == got[0, 0, "top"] == got[0, 0, "left"] == 0 and got[0, 0, "right"] == 1 and got[0, 0, "bottom"] == 10 and got[1, 1, "top"] == 1 and got[1, 1, "left"] == 10


def test_preprocessing_options(spark):
    pixels = pixels_of(spark, image()).cache()
    plain = features.spatial_features(pixels, FeatureSpec(block=8, scales=(16,), section_size=32), (40, 36))
    for more in ({"equalize": True}, {"equalize_adapt": True}, {"smooth": 3}):
        other = features.spatial_features(pixels, FeatureSpec(block=8, scales=(16,), section_size=32, **more), (40, 36))
        assert other.count() == plain.count()


def test_wide_windows_go_to_tiles_with_the_same_result(spark):
    pixels = pixels_of(spark, image()).cache()
    spec = FeatureSpec(block=2, scales=(24,), section_size=24)
    by_tiles = features.spatial_features(pixels, spec, (40, 36))
    from cellweave.operators.window import window_mean

    want = {(r["bi"], r["bj"]): (r["mean"], r["var"]) for r in window_mean(pixels, spec, (40, 36)).collect()}
    got = by_tiles.groupBy("bi", "bj").pivot("name", ["mean", "var"]).max("value").collect()
    assert len(got) == len(want) and all(np.allclose((r["mean"], r["var"]), want[r["bi"], r["bj"]]) for r in got)


def test_tiles_are_written_and_resumed(spark, tmp_path):
    spec = FeatureSpec(triggers=("mean", "grad"), block=4, scales=(8,), section_size=16)
    pixels, path = pixels_of(spark, image()).cache(), f"file://{tmp_path}/out"
    states = mosaic.write_tiles(pixels, spec, path, (40, 36))
    assert mosaic.finished(states).first()["all_finished"] and states.count() == 2 * mosaic.all_tiles(spark, spec, 40, 36).count()
    whole = {tuple(r) for r in spark.read.parquet(f"{path}/tiles").select("trigger", "stat", "bi", "bj", "value").collect()}
    want = {(r["trigger"], r["stat"], r["bi"], r["bj"], r["value"]) for r in features.spatial_features(pixels, spec, (40, 36)).collect()}
    assert whole == want
    assert mosaic.unfinished(spark, spec, path, 40, 36).count() == 0
    # One tile is found corrupt: only it is made again, with the same values.
    bad = spark.createDataFrame([("grad", 1, 1, 1, spec.section_size, "corrupt")], "trigger string, band int, tr long, tc long, section_size int, state string")
    bad.selectExpr("*", "current_timestamp() AS written").write.mode("append").parquet(f"{path}/status")
    assert [tuple(r) for r in mosaic.unfinished(spark, spec, path, 40, 36).collect()] == [("grad", 1, 1, 1)]
    states = mosaic.write_tiles(pixels, spec, path, (40, 36))
    assert mosaic.finished(states).first()["all_finished"]
    assert {tuple(r) for r in spark.read.parquet(f"{path}/tiles").select("trigger", "stat", "bi", "bj", "value").collect()} == want
    other = FeatureSpec(triggers=("mean",), block=4, scales=(8,), section_size=32)
    assert mosaic.unfinished(spark, other, path, 40, 36).count() == mosaic.all_tiles(spark, other, 40, 36).count()


def test_mosaic_stack_and_overviews(spark):
    tiles = spark.createDataFrame([(0, 0, 1, 0, 0, 1.0), (1, 0, 1, 0, 0, 2.0), (0, 0, 1, 1, 1, float("nan")), (0, 0, 1, 2, 2, None)], "tr int, tc int, out_band int, bi long, bj long, value double")
    assert {(r["bi"], r["value"]) for r in mosaic.mosaic(tiles).collect()} == {(0, 2.0), (1, 0.0), (2, 0.0)}
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "bi long, bj long, x double")
    b = spark.createDataFrame([(0, 1, 3.0), (1, 0, 4.0)], "bi long, bj long, x double")
    assert {tuple(r) for r in mosaic.stack([a, b]).collect()} == {(0, 0, 1.0, None), (0, 1, 2.0, 3.0), (1, 0, None, 4.0)}
    cells = spark.createDataFrame([(1, i, j, float(i * 10 + j)) for i in range(5) for j in range(5)], "out_band int, bi long, bj long, value double")
    got = {(r["factor"], r["bi"], r["bj"]): r["value"] for r in mosaic.overviews(cells, (2, 4)).collect()}
    assert got[2, 1, 2] == 24.0 and got[4, 1, 1] == 44.0 and len(got) == 9 + 4
    assert {(r["bi"], r["bj"]): r["value"] for r in mosaic.overviews(cells, (4,), how="mean").collect()}[0, 0] == np.mean([i * 10 + j for i in range(4) for j in range(4)])


@pytest.mark.parametrize("dtype", ["u1", "u2", "i2", "f4", "f8"])
def test_geotiff_round_trip(dtype):
    values = (np.random.default_rng(2).random((3, 70, 33)) * 200).astype(dtype)
    back = grids.parse_geotiff(grids.format_geotiff(grids.Grid(values, 2951.5, -2873.5, 4.0, 4.0, 0.0), 32))
    assert np.array_equal(back.values, values) and (back.left, back.top, back.cell_x, back.nodata) == (2951.5, -2873.5, 4.0, 0.0)


def test_plain_strips_and_lzw():
    import struct

    data = bytes(range(12))
    fields = [(256, 3, 4), (257, 3, 3), (258, 3, 8), (259, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, 3), (279, 4, 12)]
    raw = b"II*\0" + struct.pack("<I", 20) + data + struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in fields) + b"\0" * 4
    assert grids.parse_geotiff(raw).values.tolist() == [[[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]]
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 257))
    coded = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert grids.lzw(coded) == bytes([7, 7, 7, 8, 8, 7, 7])
    with pytest.raises(grids.GridError):
        grids.parse_geotiff(b"no grid at all")


def test_ascii_and_raw_files_are_read_as_pixels(spark, tmp_path):
    grid = grids.Grid(np.array([[[1.0, 2.0, -9.0], [4.0, 5.5, 6.0]]]), 10.0, 20.0, 0.5, 0.5, -9.0)
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.asc").write_bytes(grids.format_ascii(grid))
    got = {(r["image_id"], r["r"], r["c"]): r["v"] for r in grids.read_pixels(spark, f"file://{tmp_path}/a", "ascii").collect()}
    assert got["one", 1, 1] == 5.5 and got["one", 0, 2] is None and len(got) == 6
    meta = grids.read_meta(spark, f"file://{tmp_path}/a", "ascii").first()
    assert (meta["rows"], meta["cols"], meta["left"], meta["top"]) == (2, 3, 10.0, 20.0)
    (tmp_path / "r").mkdir()
    (tmp_path / "r/x.raw").write_bytes(np.arange(12, dtype="<u2").tobytes())
    rows = grids.read_pixels(spark, f"file://{tmp_path}/r", "raw", wanted=(2,), rows=2, cols=3, bands=2, dtype="<u2").collect()
    assert {(r["band"], r["r"], r["c"], r["v"]) for r in rows} == {(2, i // 3, i % 3, 6.0 + i) for i in range(6)}
    with pytest.raises(grids.GridError):
        grids.parse_raw(b"123", 2, 2, 1, "u1")


def test_features_as_files(spark, tmp_path):
    spec = FeatureSpec(block=4, scales=(8,), section_size=16)
    layers = image()
    made = features.spatial_features(pixels_of(spark, layers), spec, (40, 36))
    files = grids.encoded_tiles(made, spec, "img", 2.0, -2.0, 4.0, tile=5)
    names = [r["name"] for r in grids.write_files(files, f"file://{tmp_path}/tiles").collect()]
    assert len(names) == 2 * 2 and all(n.startswith("img__BD1_BK4_SC8_TRmean__r") for n in names)
    back = grids.read_pixels(spark, f"file://{tmp_path}/tiles/*.tif", "geotiff")
    assert back.count() == made.count()
    first = grids.read_meta(spark, f"file://{tmp_path}/tiles/*r000001c000001.tif", "geotiff").first()
    assert (first["left"], first["top"], first["bands"]) == (2.0 + 5 * 4, -2.0 - 5 * 4, 2)


WHOLE_SECTIONS = [{"triggers": ("mean", "orb"), "equalize": True}, {"triggers": ("seg", "sfs"), "smooth": 3}]


def test_margins_hold_what_stencils_and_smoothing_look_at():
    assert mosaic.margin_of(FeatureSpec(smooth=35)) >= 16 + 17 and mosaic.margin_of(FeatureSpec(scales=(64,))) >= 64
    assert mosaic.sections_around(FeatureSpec(triggers=("mean", "ndvi"))) == 0 < mosaic.sections_around(FeatureSpec(triggers=("mean", "orb")))


@pytest.mark.parametrize("more", WHOLE_SECTIONS, ids=lambda m: "-".join(m["triggers"]))
def test_resumed_tiles_have_the_values_of_a_fresh_run(spark, tmp_path, more):
    """One tile of every trigger is found corrupt; what is made again equals the whole image's values."""
    size, path = (112, 104), f"file://{tmp_path}/out"
    spec = FeatureSpec(block=8, scales=(16,), section_size=32, **more)
    pixels = pixels_of(spark, image(3, size, 3)).cache()
    want = {tuple(r) for r in features.spatial_features(pixels, spec, size).select("trigger", "band", "k", "stat", "bi", "bj", "value").collect()}
    mosaic.write_tiles(pixels, spec, path, size)
    read = lambda: {tuple(r) for r in spark.read.parquet(f"{path}/tiles").selectExpr("trigger", "cast(band as int) band", "k", "stat", "bi", "bj", "value").collect()}
    assert read() == want
    bad = spark.createDataFrame([(t, 1, 1, 2, spec.section_size, "corrupt") for t in spec.triggers], "trigger string, band int, tr long, tc long, section_size int, state string")
    bad.selectExpr("*", "current_timestamp() AS written").write.mode("append").parquet(f"{path}/status")
    assert mosaic.finished(mosaic.write_tiles(pixels, spec, path, size)).first()["all_finished"]
    assert read() == want


def test_own_formulas_sensors_and_the_log(spark, tmp_path):
    pixels = pixels_of(spark, image(5, bands=4)).cache()
    spec = FeatureSpec(triggers=("ndvi", "own"), block=8, scales=(16,), section_size=32, formulas={"own": "try_divide(nir - red, nir + red)"})
    got = features.spatial_features(pixels, spec, (40, 36)).collect()
    of = lambda t: {(r["stat"], r["bi"], r["bj"]): r["value"] for r in got if r["trigger"] == t}
    assert of("own") == of("ndvi") and {r["out_band"] for r in got} == {1, 2, 3, 4}
    for bad in ({"sensor_bands": {"red": 1}}, {"formulas": {"mean": "red"}, "triggers": ("mean",)}, {"triggers": ("own",), "formulas": {"own": "yellow / red"}}):
        with pytest.raises(SpecError):
            FeatureSpec(**({"triggers": ("ndvi",)} | bad))
    for k in (1, 2):
        mosaic.log_parameters(spark, spec, f"file://{tmp_path}/o", run=k)
    lines = [json.loads(r[0]) for r in spark.read.text(f"file://{tmp_path}/o/parameters").collect()]
    assert sorted(x["run"] for x in lines) == [1, 2] and lines[0]["triggers"] == ["ndvi", "own"] and lines[0]["block"] == 8


@pytest.mark.parametrize("more", [{"triggers": ("ndvi", "grad"), "smooth": 3}, {"triggers": ("orb",), "equalize": True}], ids=lambda m: "-".join(m["triggers"]))
def test_streamed_pixels_give_the_same_features(spark, tmp_path, more):
    size = (64, 56)
    spec = FeatureSpec(block=8, scales=(16,), section_size=32, **more)
    pixels = pixels_of(spark, image(4, size, 4)).selectExpr("cast(band as int) band", "r", "c", "cast(v as double) v").cache()
    for part in ("r < 30", "r >= 25 AND r < 50", "r >= 45", "r < 5"):
        pixels.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ingest.read_pixel_stream(spark, f"{tmp_path}/in", 1)
    ingest.feature_stream(stream, spec, size, f"file://{tmp_path}/out").awaitTermination()
    names = ("trigger", "stat", "bi", "bj", "value")
    got = [tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out/features").select(*names).collect()]
    assert len(got) == len(set(got)) and set(got) == {tuple(r) for r in features.spatial_features(pixels, spec, size).select(*names).collect()}


def test_streams_refuse_what_needs_the_whole_image(spark, tmp_path):
    stream = ingest.read_pixel_stream(spark, str(tmp_path))
    with pytest.raises(SpecError):
        ingest.feature_stream(stream, FeatureSpec(triggers=("saliency",)), (64, 64), f"file://{tmp_path}/out")
