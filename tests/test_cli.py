from __future__ import annotations

import numpy as np

from cellweave import cli
from cellweave.sources import grids


def test_features_of_a_file(spark, tmp_path, capsys):
    image = np.random.default_rng(1).integers(0, 256, (1, 30, 26)).astype("u1")
    (tmp_path / "scene.tif").write_bytes(grids.format_geotiff(grids.Grid(image, 100.0, 50.0, 2.0, 2.0)))
    code = cli.main(["-i", f"file://{tmp_path}/scene.tif", "-o", f"file://{tmp_path}/out", "-b", "4", "-s", "8", "--section-size", "16", "--format", "geotiff", "--overviews"])
    assert code == 0 and "corrupt 0" in capsys.readouterr().out
    meta = grids.read_meta(spark, f"file://{tmp_path}/out/files", "geotiff").first()
    assert (meta["rows"], meta["cols"], meta["bands"], meta["left"], meta["top"], meta["cell_x"]) == (7, 6, 2, 104.0, 46.0, 8.0)
    assert spark.read.parquet(f"file://{tmp_path}/out/overviews").where("factor = 2").count() == 2 * 4 * 3
    spark.range(1).selectExpr("id bi", "id bj", "id x").write.parquet(f"file://{tmp_path}/w")
    assert cli.main(["--stack-only", f"file://{tmp_path}/w", "-o", f"file://{tmp_path}/s"]) == 0
    assert spark.read.parquet(f"file://{tmp_path}/s/stack").columns == ["bi", "bj", "x"]


def test_options_and_refusals(capsys):
    assert cli.main(["--options"]) == 0 and "pantex: 1" in capsys.readouterr().out
    assert cli.main(["-i", "x", "-o", "y", "-tr", "hough"]) == 2
    assert cli.main(["-tr", "mean"]) == 2
    assert cli.main(["-i", "x", "-o", "y", "-tr", "ndvi", "--sensor", "rgb"]) == 2
    assert cli.main(["-i", "x", "-o", "y", "-tr", "rb", "--formula", "rb"]) == 2
    a = cli.parser().parse_args(["--n-jobs", "-1", "--full-path", "--stack", "-tr", "rb", "--sensor", "rgb", "--formula", "rb=red - blue"])
    assert cli.specification(a).colours("rb") == ("blue", "red") and cli.specification(a).sensor_bands["red"] == 1
    assert cli.main(["--examples"]) == 0 and "--formula" in capsys.readouterr().out
    assert cli.main(["--raster-options"]) == 0
