"""Command line: features of gridded files, or the columns of feature tables side by side.

    python -m cellweave.cli -i scene.tif -o out -bp 1 -tr mean pantex -b 4 -s 8 16
    python -m cellweave.cli -i scene.tif -o out -tr ndvi rb --sensor bgrn --formula "rb=try_divide(red - blue, red + blue)"
"""

from __future__ import annotations

import argparse
import sys

from cellweave.spec import SENSORS, STATISTICS, UNSUPPORTED, FeatureSpec, SpecError

VERSION = "0.1"
#: Options that are taken and change nothing: Spark plans the work, and feature tables are stacked by --stack-only.
INERT_FLAGS = ("--convert", "--visualize", "--stack", "--reset", "--full-path")
INERT_NUMBERS = ("--n-jobs", "--gdal-cache", "--chunk-size", "--sfs-rs", "--hline-threshold", "--hline-min", "--hline-gap")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cellweave", description="Contextual features of gridded imagery")
    p.add_argument("-i", "--input", help="a file, or a folder or pattern of files")
    p.add_argument("-o", "--output", help="folder for tiles, states and files")
    p.add_argument("-k", "--kind", default="geotiff", choices=("geotiff", "ascii", "raw", "parquet"), help="of the input; parquet: pixels (band, r, c, v)")
    p.add_argument("--format", default="parquet", choices=("parquet", "geotiff", "ascii"), help="of the output besides the tiles' tables")
    p.add_argument("-bp", "--band-positions", type=int, nargs="+", default=[1])
    p.add_argument("-tr", "--triggers", nargs="+", default=["mean"], help=", ".join(sorted(STATISTICS)))
    p.add_argument("-b", "--block", type=int, default=2)
    p.add_argument("-s", "--scales", type=int, nargs="+", default=[8])
    p.add_argument("--section-size", "--sect-size", type=int, default=1000)
    p.add_argument("--image-min", type=float, default=-999.0)
    p.add_argument("--image-max", type=float, default=-999.0)
    p.add_argument("--storage", default="byte")
    p.add_argument("--rgb", "--vis-order", default="bgr", choices=("bgr", "rgb"), help="order of the visible bands")
    p.add_argument("--smooth", type=int, default=0)
    p.add_argument("--equalize", action="store_true")
    p.add_argument("--equalize-adapt", action="store_true")
    p.add_argument("--sensor", choices=sorted(SENSORS), help="whose bands the colours of spectral indices are")
    p.add_argument("--formula", nargs="+", default=[], metavar="NAME=EXPRESSION", help="further spectral indices: Spark SQL over the sensor's colours; their names are triggers")
    p.add_argument("--sfs-threshold", "--sfs-th", type=float, default=40.0)
    p.add_argument("--sfs-skip", type=int, default=4)
    p.add_argument("--lac-r", type=int, default=2)
    p.add_argument("--weight", action="store_true", help="weigh pantex by the windows' means")
    p.add_argument("--neighbors", action="store_true")
    p.add_argument("--overviews", action="store_true")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--stack-only", nargs="+", metavar="TABLE", help="put the columns of wide feature tables side by side")
    p.add_argument("--rows", type=int, help="of raw files")
    p.add_argument("--cols", type=int, help="of raw files")
    p.add_argument("--dtype", default="u1", help="of raw files")
    for name in INERT_FLAGS:
        p.add_argument(name, action="store_true", help="no effect")
    for name in INERT_NUMBERS:
        p.add_argument(name, type=float, metavar="N", help="no effect")
    p.add_argument("-e", "--examples", action="store_true", help="show how it is called")
    p.add_argument("--raster-options", action="store_true", help="list the kinds of input and output")
    p.add_argument("--options", action="store_true", help="list the triggers and their statistics")
    p.add_argument("--version", action="version", version=VERSION)
    return p


def specification(a: argparse.Namespace) -> FeatureSpec:
    formulas = dict(x.split("=", 1) if "=" in x else (x, "") for x in a.formula)
    if empty := [n for n, x in formulas.items() if not n.isidentifier() or not x.strip()]:
        raise SpecError(f"a formula is NAME=EXPRESSION, not {', '.join(empty)}")
    return FeatureSpec(
        triggers=tuple(a.triggers), bands=tuple(a.band_positions), block=a.block, scales=tuple(a.scales), section_size=a.section_size, image_min=a.image_min, image_max=a.image_max, storage=a.storage, smooth=a.smooth,
        equalize=a.equalize, equalize_adapt=a.equalize_adapt, visible_order=a.rgb, line_threshold=a.sfs_threshold, line_skip=a.sfs_skip, box=a.lac_r, weight=a.weight, neighbors=a.neighbors,
        sensor_bands=dict(SENSORS[a.sensor or "bgrn"]), formulas=formulas,
    )


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.options:
        print("\n".join(f"{t}: {n} statistics a scale" for t, n in sorted(STATISTICS.items())) + f"\nwithout implementation: {', '.join(UNSUPPORTED)}")
        return 0
    if a.examples:
        print(__doc__.strip())
        return 0
    if a.raster_options:
        print("input: geotiff, ascii, raw, parquet\noutput: parquet, geotiff, ascii")
        return 0
    try:
        spec = specification(a)
    except SpecError as e:
        print(f"cellweave: {e}", file=sys.stderr)
        return 2
    if not a.output or not (a.input or a.stack_only):
        print("cellweave: an output, and an input or tables to stack, are needed", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from cellweave.plans import features, mosaic
    from cellweave.sources import grids

    spark = SparkSession.builder.appName("cellweave").getOrCreate()
    if a.stack_only:
        mosaic.stack([spark.read.parquet(x) for x in a.stack_only]).write.mode("overwrite").parquet(f"{a.output}/stack")
        return 0
    left, top, cell = 0.0, 0.0, 1.0
    if a.kind == "parquet":
        pixels = spark.read.parquet(a.input)
    else:
        options = {"rows": a.rows, "cols": a.cols, "bands": max(a.band_positions), "dtype": a.dtype} if a.kind == "raw" else {}
        pixels = grids.read_pixels(spark, a.input, a.kind, **options)
        meta = grids.read_meta(spark, a.input, a.kind, **options).limit(2).collect()
        if len(meta) != 1:
            print("cellweave: one image at a time", file=sys.stderr)
            return 2
        left, top, cell = meta[0]["left"], meta[0]["top"], meta[0]["cell_x"]
    pixels = pixels.select("band", "r", "c", "v")
    if pixels.where(F.col("band").isin(*spec.bands)).where(F.isnan("v")).limit(1).count():
        print("cellweave: the image has values that are no numbers", file=sys.stderr)
        return 1
    mosaic.log_parameters(spark, spec, a.output, input=a.input, version=VERSION)
    states = mosaic.write_tiles(pixels, spec, a.output, overwrite=a.overwrite)
    found = mosaic.finished(states).first()
    made = mosaic.mosaic(features.with_out_band(spark.read.parquet(f"{a.output}/tiles"), spec))
    shift = (spec.largest - spec.block) / 2 * cell
    if a.format != "parquet":
        name = a.input.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
        grids.write_files(grids.encoded_tiles(made, spec, name, left + shift, top - shift, cell * spec.block, a.format), f"{a.output}/files").count()
    if a.overviews:
        mosaic.overviews(made).write.mode("overwrite").partitionBy("factor").parquet(f"{a.output}/overviews")
    print(f"complete {found['complete']}, corrupt {found['corrupt']}, incomplete {found['incomplete']}")
    return 0 if found["all_finished"] else 1


if __name__ == "__main__":
    sys.exit(main())
