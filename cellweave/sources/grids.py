"""Data sources of gridded files: ESRI ASCII grids, raw band-sequential grids and GeoTIFF, read by Spark's tasks.

Every file is listed and read with Spark's own file readers (binaryFile), so any store that Spark knows will do.
A file of many bands or lines is cut into pixels by its task in batches of lines.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXELS = "image_id string, band int, r long, c long, v double"
META = "image_id string, rows long, cols long, bands int, left double, top double, cell_x double, cell_y double, nodata double"
#: Pixels of a batch.
BATCH = 1 << 18


class GridError(ValueError):
    """A file that is not the grid it says it is."""


@dataclass
class Grid:
    """values: bands x rows x cols; left, top: the upper left corner; nodata: the value of places without one."""

    values: np.ndarray
    left: float = 0.0
    top: float = 0.0
    cell_x: float = 1.0
    cell_y: float = 1.0
    nodata: float | None = None


def parse_ascii(data: bytes) -> Grid:
    """An ESRI ASCII grid of one band; the corner or the centre of the lower left cell may be given."""
    tokens = data.split()
    head: dict[str, float] = {}
    at = 0
    while at + 1 < len(tokens) and tokens[at][:1].isalpha() and tokens[at].lower() not in (b"nan", b"inf"):
        head[tokens[at].lower().decode()] = float(tokens[at + 1])
        at += 2
    try:
        rows, cols, cell = int(head["nrows"]), int(head["ncols"]), head["cellsize"]
    except KeyError as e:
        raise GridError(f"no {e.args[0]} in the header") from None
    values = np.array(tokens[at:], dtype=np.float64)
    if len(values) != rows * cols:
        raise GridError(f"{len(values)} values of {rows * cols}")
    left = head.get("xllcorner", head.get("xllcenter", cell / 2) - cell / 2)
    bottom = head.get("yllcorner", head.get("yllcenter", cell / 2) - cell / 2)
    return Grid(values.reshape(1, rows, cols), left, bottom + rows * cell, cell, cell, head.get("nodata_value"))


def format_ascii(grid: Grid) -> bytes:
    rows, cols = grid.values.shape[1:]
    head = f"ncols {cols}\nnrows {rows}\nxllcorner {grid.left!r}\nyllcorner {grid.top - rows * grid.cell_y!r}\ncellsize {grid.cell_x!r}\n"
    if grid.nodata is not None:
        head += f"NODATA_value {grid.nodata:g}\n"
    return head.encode() + b"".join(" ".join(f"{x:.17g}" for x in line).encode() + b"\n" for line in grid.values[0])


#: Sample format and bits of a TIFF as a type; sizes of field types.
SAMPLES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


def parse_geotiff(data: bytes) -> Grid:
    """A classic or big TIFF in strips or tiles, uncompressed, deflated or LZW-coded, interleaved by pixel or by band."""
    end = {b"II": "<", b"MM": ">"}.get(data[:2])
    if end is None or len(data) < 8:
        raise GridError("not a TIFF")
    big = struct.unpack_from(end + "H", data, 2)[0] == 43
    at = struct.unpack_from(end + ("Q" if big else "I"), data, 8 if big else 4)[0]
    count, at = struct.unpack_from(end + ("Q" if big else "H"), data, at)[0], at + (8 if big else 2)
    tags: dict[int, tuple] = {}
    inline, entry = (8, 20) if big else (4, 12)
    for k in range(count):
        tag, kind = struct.unpack_from(end + "HH", data, at + entry * k)
        n = struct.unpack_from(end + ("Q" if big else "I"), data, at + entry * k + 4)[0]
        if kind not in FIELD:
            continue
        form = f"{end}{n}s" if kind == 2 else end + FIELD[kind] * n
        place = at + entry * k + entry - inline
        if struct.calcsize(form) > inline:
            place = struct.unpack_from(end + ("Q" if big else "I"), data, place)[0]
        tags[tag] = struct.unpack_from(form, data, place)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    cols, rows, bands = one(256, 0), one(257, 0), one(277, 1)
    kind = SAMPLES.get((one(339, 1), one(258, 1)))
    if kind is None:
        raise GridError(f"samples of {one(258, 1)} bits are not supported")
    dtype = np.dtype(end + kind)
    planar, squeeze, predictor = one(284, 1) == 2, one(259, 1), one(317, 1)
    tiled = 322 in tags
    h, w = (one(323, 0), one(322, 0)) if tiled else (min(one(278, rows), rows), cols)
    offsets, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    across, down = -(-cols // w), -(-rows // h)
    deep = 1 if planar else bands
    out = np.zeros((bands, rows, cols), dtype.newbyteorder("="))
    for i, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
        raw = data[offset : offset + size]
        if not size:
            continue
        if squeeze in (8, 32946):
            raw = zlib.decompress(raw)
        elif squeeze == 5:
            raw = lzw(raw)
        elif squeeze != 1:
            raise GridError(f"compression {squeeze} is not supported")
        plane, cell = divmod(i, across * down)
        r, c = cell // across * h, cell % across * w
        lines = h if tiled else min(h, rows - r)
        block = np.frombuffer(raw, dtype, lines * w * deep).reshape(lines, w, deep)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=dtype.newbyteorder("="))
        elif predictor != 1:
            raise GridError(f"predictor {predictor} is not supported")
        part = block[: rows - r, : cols - c]
        for b in range(deep):
            out[plane + b, r : r + part.shape[0], c : c + part.shape[1]] = part[:, :, b]
    scale, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0.0,) * 6)
    nodata = tags[42113][0].split(b"\0")[0].strip() if 42113 in tags else b""
    return Grid(out, tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], scale[1], float(nodata) if nodata else None)


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bit first, 256 clears the table and 257 ends."""
    table: list[bytes] = []
    out, bits, held, width, last = [], 0, 0, 9, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code < len(table):
            word = table[code]
        elif last:
            word = last + last[:1]
        else:
            raise GridError("LZW data is damaged")
        out.append(word)
        if last:
            table.append(last + word[:1])
        last = word
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def format_geotiff(grid: Grid, tile: int = 256) -> bytes:
    """A little-endian TIFF in deflated tiles, a plane for each band."""
    values = np.ascontiguousarray(grid.values)
    bands, rows, cols = values.shape
    code = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    down, across = -(-rows // tile), -(-cols // tile)
    blocks = []
    for b in range(bands):
        for i in range(down):
            for j in range(across):
                block = np.zeros((tile, tile), values.dtype.newbyteorder("<"))
                part = values[b, i * tile : (i + 1) * tile, j * tile : (j + 1) * tile]
                block[: part.shape[0], : part.shape[1]] = part
                blocks.append(zlib.compress(block.tobytes(), 6))
    starts = np.cumsum([8, *(len(x) + len(x) % 2 for x in blocks)]).tolist()
    fields = [
        (256, "I", [cols]), (257, "I", [rows]), (258, "H", [values.dtype.itemsize * 8] * bands), (259, "H", [8]), (262, "H", [1]), (277, "H", [bands]), (284, "H", [2]),
        (322, "I", [tile]), (323, "I", [tile]), (324, "I", starts[:-1]), (325, "I", [len(x) for x in blocks]), (339, "H", [code] * bands),
        (33550, "d", [grid.cell_x, grid.cell_y, 0.0]), (33922, "d", [0.0, 0.0, 0.0, grid.left, grid.top, 0.0]),
    ]
    if grid.nodata is not None:
        fields.append((42113, "s", f"{grid.nodata:g}\0".encode()))
    at = starts[-1]
    extra_at, entries, extra = at + 2 + 12 * len(fields) + 4, b"", b""
    for tag, form, x in fields:
        raw = x if form == "s" else struct.pack("<" + form * len(x), *x)
        kind = {"H": 3, "I": 4, "d": 12, "s": 2}[form]
        if len(raw) <= 4:
            value = raw.ljust(4, b"\0")
        else:
            value = struct.pack("<I", extra_at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        entries += struct.pack("<HHI", tag, kind, len(x)) + value
    body = b"".join(x + b"\0" * (len(x) % 2) for x in blocks)
    return b"II*\0" + struct.pack("<I", at) + body + struct.pack("<H", len(fields)) + entries + b"\0\0\0\0" + extra


def parse_raw(data: bytes, rows: int, cols: int, bands: int, dtype: str) -> Grid:
    """Band after band of plain values."""
    values = np.frombuffer(data, np.dtype(dtype))
    if len(values) != rows * cols * bands:
        raise GridError(f"{len(values)} values of {rows * cols * bands}")
    return Grid(values.reshape(bands, rows, cols))


def parser(kind: str, **options):
    if kind == "raw":
        return lambda data: parse_raw(data, **options)
    return {"ascii": parse_ascii, "geotiff": parse_geotiff}[kind]


def stem(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]


def read_pixels(spark: SparkSession, path: str, kind: str, wanted: tuple[int, ...] | None = None, **options) -> DataFrame:
    """(image_id, band, r, c, v) of every file under a path; image_id is the file's name. Only the bands wanted are cut out; nodata is null. A raw file needs rows, cols, bands and dtype."""
    parse = parser(kind, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                grid = parse(data.as_py())
                n, rows, cols = grid.values.shape
                lines = max(1, BATCH // max(cols, 1))
                for b in range(n):
                    if wanted is not None and b + 1 not in wanted:
                        continue
                    for r in range(0, rows, lines):
                        part = grid.values[b, r : r + lines].astype(np.float64)
                        flat = part.ravel()
                        gone = np.isnan(flat) if grid.nodata is None else np.isnan(flat) | (flat == grid.nodata)
                        yield pa.RecordBatch.from_arrays([
                            pa.array([stem(name)] * len(flat)), pa.array(np.full(len(flat), b + 1, np.int32)), pa.array(np.repeat(np.arange(r, r + part.shape[0]), cols)),
                            pa.array(np.tile(np.arange(cols), part.shape[0])), pa.array(flat, mask=gone),
                        ], ["image_id", "band", "r", "c", "v"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, PIXELS)


def read_meta(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """(image_id, rows, cols, bands, left, top, cell_x, cell_y, nodata) of every file under a path."""
    parse = parser(kind, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                g = parse(data.as_py())
                n, rows, cols = g.values.shape
                row = {"image_id": stem(name), "rows": rows, "cols": cols, "bands": n, "left": g.left, "top": g.top, "cell_x": g.cell_x, "cell_y": g.cell_y, "nodata": g.nodata}
                schema = pa.schema([("image_id", pa.string()), ("rows", pa.int64()), ("cols", pa.int64()), ("bands", pa.int32()), *((x, pa.float64()) for x in ("left", "top", "cell_x", "cell_y", "nodata"))])
                yield pa.RecordBatch.from_pylist([row], schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, META)


def encoded_tiles(features: DataFrame, spec, image: str, left: float, top: float, cell: float, kind: str = "geotiff", tile: int = 512) -> DataFrame:
    """(name, content): features (out_band, bi, bj, value) as files of ``tile`` x ``tile`` cells with all bands; places without a value 0.

    A task holds one tile at a time.
    """
    bands = max(hi for _, hi in spec.band_ranges().values())
    base = spec.base_name(image)
    write = {"geotiff": format_geotiff, "ascii": format_ascii}[kind]
    suffix = {"geotiff": "tif", "ascii": "asc"}[kind]

    def run(key: tuple, group: pa.Table) -> pa.Table:
        i, j = (x.as_py() for x in key)
        bi, bj, band, value = (group.column(x).to_numpy() for x in ("bi", "bj", "out_band", "value"))
        out = np.zeros((bands, int(bi.max()) % tile + 1, int((bj % tile).max()) + 1), np.float32)
        out[band - 1, bi % tile, bj % tile] = np.nan_to_num(value.astype(np.float64))
        grid = Grid(out, left + j * tile * cell, top - i * tile * cell, cell, cell, 0.0)
        return pa.table({"name": [f"{base}__r{i:06d}c{j:06d}.{suffix}"], "content": pa.array([write(grid)], pa.binary())})

    keyed = features.select("out_band", "bi", "bj", "value", F.floor(F.col("bi") / tile).alias("ti"), F.floor(F.col("bj") / tile).alias("tj"))
    return keyed.groupBy("ti", "tj").applyInArrow(run, "name string, content binary")


def write_files(files: DataFrame, directory: str) -> DataFrame:
    """Writes (name, content) rows as files into a directory that all executors reach, by its scheme (file, hdfs, s3, gs, ..); returns the names and sizes.

    Tasks write by Arrow's file systems. A file is written under a temporary name and moved, so a task that runs twice
    leaves one whole file. A path without a scheme is a local one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(directory if "://" in directory else f"file://{directory}")
        store.create_dir(base, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                part = f"{base}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(row["content"])
                store.move(part, f"{base}/{row['name']}")
                yield pa.RecordBatch.from_arrays([pa.array([row["name"]]), pa.array([len(row["content"])], pa.int64())], ["name", "bytes"])

    return files.mapInArrow(run, "name string, bytes long")
