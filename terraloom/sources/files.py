"""File sources and sinks: inventories, mappings, lighting CSV, rasters and point files, reports, manifests."""

from __future__ import annotations

import json
import platform
import struct
import sys
import zlib
from collections.abc import Mapping
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.functions.pixels import clean
from terraloom.operators.align import blocks, mosaic, source_resolution


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Tiles of inventory documents {"values": [...]}; a document without the list is an error."""
    docs = spark.read.option("multiLine", True).json(path)
    if "values" not in docs.columns or not docs.schema["values"].dataType.typeName() == "array":
        raise ValueError("an inventory must hold a list of values")
    return docs.select(F.inline("values"))


def int_keys(column, value: str = "double"):
    """A JSON object's text as a map with integer keys; a key that is no number is an error."""
    return F.transform_keys(F.from_json(column, f"map<string,{value}>"), lambda k, _: k.cast("int"))


def read_mapping(text: str, kind: type = int) -> dict[int, float]:
    """A mapping file's contents with integer keys."""
    found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError("a mapping must be an object")
    return {int(k): kind(v) for k, v in found.items()}


def read_lighting(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, tile, feature, triangle, lighted) of `;` separated results in a folder tree.

    pos orders the rows of a file, also of one that is read in several splits.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path, sep=";", header=True)
    names = raw.columns
    number = lambda i: F.expr(f"try_cast(`{names[i]}` as int)")
    lit = F.lower(F.trim(F.col(f"`{names[4]}`"))) == "true"
    return raw.select(F.col("_metadata.file_path").alias("file"), _file_order().alias("pos"), number(0).alias("tile"), number(1).alias("feature"), number(2).alias("triangle"), F.coalesce(lit, F.lit(False)).alias("lighted"))


def _file_order():
    """The split's first byte, then the row's number in its task: a file's splits may be read anywhere, each in order."""
    return F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length) of a folder tree, without reading contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).drop("content")


def read_raster(spark: SparkSession, path: str, *nodata: float) -> DataFrame:
    """Long-form pixels (row, col, v, ...) from Parquet with missing values as NULL."""
    pixels = spark.read.parquet(path)
    return pixels.withColumn("v", clean("v", *nodata))


# --- TIFF: strips or tiles, any number of bands, plain, LZW or deflated --------------------------------------

# TIFF tag numbers, compressions, and sample formats by (format, bits).
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, BANDS, ROWS_STRIP, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT, SCALE, TIEPOINT, GEOKEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
PLAIN, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
SAMPLES = {(1, 8): "u1", (1, 16): "u2", (2, 16): "i2", (1, 32): "u4", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
_SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}


def lzw_decode(data: bytes) -> bytes:
    """A strip's bytes: codes of 9 to 12 bits, high bit first; 256 starts the table anew, 257 ends."""
    single = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, last = list(single), [], None
    held = bits = 0
    width = 9
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(single), 9, None
            continue
        if code > len(table) or last is None and code > 255:
            raise ValueError("broken LZW data")
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last is not None:
            table.append(last + entry[:1])
            # The reader is one entry behind the writer, whose codes widen one early.
            width = min(12, max(9, (len(table) + 1).bit_length()))
        last = entry
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """Bytes as LZW codes; the table starts anew once 12 bits are full."""
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 0xFF)
        held &= (1 << bits) - 1

    table: dict[tuple[int, int], int] = {}
    size, width, now = 258, 9, None
    put(256, 9)
    for byte in data:
        if now is None:
            now = byte
        elif (now, byte) in table:
            now = table[(now, byte)]
        else:
            put(now, width)
            table[(now, byte)] = size
            size, now = size + 1, byte
            if size == 4094:
                put(256, width)
                table, size, width = {}, 258, 9
            else:
                width = max(9, size.bit_length())
    if now is not None:
        put(now, width)
        width = max(9, min(12, (size + 1).bit_length()))
    put(257, width)
    if bits:
        put(0, 8 - bits)
    return bytes(out)


def _unpacked(data: bytes, compression: int) -> bytes:
    if compression == PLAIN:
        return data
    if compression == LZW:
        return lzw_decode(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    raise ValueError(f"TIFF compression {compression} is not read")


def _tags(data: bytes) -> tuple[str, dict]:
    """Byte order and tags of a file's first image; 64-bit files have wider counts and places."""
    end = {b"II": "<", b"MM": ">"}.get(data[:2])
    magic = struct.unpack(end + "H", data[2:4])[0] if end and len(data) >= 8 else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    wide = magic == 43
    number, entry, inline = ("Q", 20, 8) if wide else ("I", 12, 4)
    at = struct.unpack_from(end + number, data, 8 if wide else 4)[0]
    n, at = struct.unpack_from(end + ("Q" if wide else "H"), data, at)[0], at + (8 if wide else 2)
    tags = {}
    for place in range(at, at + n * entry, entry):
        tag, kind, count = struct.unpack_from(end + "HH" + number, data, place)
        if kind not in _SIZES:
            continue
        size = struct.calcsize("=" + _SIZES[kind]) * count
        value = place + entry - inline
        value = value if size <= inline else struct.unpack_from(end + number, data, value)[0]
        raw = data[value : value + size]
        tags[tag] = raw.rstrip(b"\0").decode("ascii", "replace") if kind == 2 else struct.unpack(end + _SIZES[kind] * count if kind == 5 else f"{end}{count}{_SIZES[kind]}", raw)
    return end, tags


def parse_tiff(data: bytes) -> dict:
    """values (rows, columns, or with bands last), x0, y1, res and nodata of a TIFF file's first image."""
    end, tags = _tags(data)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, bands, planar = one(WIDTH, 0), one(HEIGHT, 0), one(BANDS, 1), one(PLANAR, 1) == 2
    kind = SAMPLES.get((one(FORMAT, 1), one(BITS, 1)))
    if kind is None:
        raise ValueError(f"TIFF samples of format {one(FORMAT, 1)} and {one(BITS, 1)} bits are not read")
    tiled, deep = TILE_OFFSETS in tags, 1 if planar else bands
    w, h = (one(TILE_WIDTH, width), one(TILE_HEIGHT, height)) if tiled else (width, min(height, one(ROWS_STRIP, height)))
    across, down = -(-width // w), -(-height // h)
    values = np.empty((height, width, bands), kind)
    for k, (o, n) in enumerate(zip(tags[TILE_OFFSETS if tiled else OFFSETS], tags[TILE_COUNTS if tiled else COUNTS], strict=True)):
        plane, (r, c) = k // (across * down), divmod(k % (across * down), across)
        rows = h if tiled else min(h, height - r * h)
        part = np.frombuffer(_unpacked(data[o : o + n], one(COMPRESSION, PLAIN)), end + kind, rows * w * deep).reshape(rows, w, deep)
        if one(PREDICTOR, 1) == 2:
            part = np.cumsum(part, axis=1, dtype=part.dtype.newbyteorder("="))
        elif one(PREDICTOR, 1) != 1:
            raise ValueError("TIFF predictors of floating point are not read")
        part = part[: height - r * h, : width - c * w]
        values[r * h : r * h + part.shape[0], c * w : c * w + part.shape[1], slice(plane, plane + 1) if planar else slice(None)] = part
    tie, scale = tags.get(TIEPOINT, (0,) * 6), tags.get(SCALE, (1.0, 1.0, 0.0))
    return {"values": values[:, :, 0] if bands == 1 else values, "x0": tie[3] - tie[0] * scale[0], "y1": tie[4] + tie[1] * scale[1], "res": source_resolution(scale[0], scale[1]), "nodata": float(tags[NODATA]) if tags.get(NODATA) else None}


def build_tiff(values: np.ndarray, x0: float = 0.0, y1: float = 0.0, res: float = 1.0, nodata: float | None = None, compress: bool = False, epsg: int | None = None) -> bytes:
    """A little-endian TIFF file of one band or, with a third axis, several; with georeference and nodata tags, LZW if asked for."""
    cube = values[:, :, None] if values.ndim == 2 else values
    fmt, bits = next(k for k, v in SAMPLES.items() if v == values.dtype.str[1:])
    height, width, bands = cube.shape
    rows = max(1, min(height, (1 << 16) // max(1, width * bands * values.dtype.itemsize)))
    plain = [np.ascontiguousarray(cube[r : r + rows]).astype(values.dtype.newbyteorder("<")).tobytes() for r in range(0, height, rows)]
    strips = [lzw_encode(x) for x in plain] if compress else plain
    counts = [len(x) for x in strips]
    body, starts = b"".join(strips), [8 + sum(counts[:i]) for i in range(len(counts))]
    text = b"" if nodata is None else f"{nodata:.17g}".encode() + b"\0"
    entries = [
        (WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (bits,) * bands), (COMPRESSION, 3, (LZW if compress else PLAIN,)), (PHOTOMETRIC, 3, (1,)), (OFFSETS, 4, starts), (BANDS, 3, (bands,)), (ROWS_STRIP, 4, (rows,)),
        (COUNTS, 4, counts), (PLANAR, 3, (1,)), (FORMAT, 3, (fmt,) * bands), (SCALE, 12, (res, res, 0.0)), (TIEPOINT, 12, (0.0, 0.0, 0.0, x0, y1, 0.0)),
    ]
    if epsg:  # a projected system, pixels as areas
        entries.append((GEOKEYS, 3, (1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg)))
    if text:
        entries.append((NODATA, 2, text))
    at = 8 + len(body) + len(body) % 2
    extra, after = b"", at + 2 + 12 * len(entries) + 4
    table = struct.pack("<H", len(entries))
    for tag, kind, v in entries:
        raw = v if kind == 2 else struct.pack(f"<{len(v)}{_SIZES[kind]}", *v)
        table += struct.pack("<HHI", tag, kind, len(v))
        if len(raw) > 4:
            table += struct.pack("<I", after + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            table += raw.ljust(4, b"\0")
    return struct.pack("<2sHI", b"II", 42, at) + body + b"\0" * (len(body) % 2) + table + b"\0\0\0\0" + extra


def _tiff_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tif*").load(path).select("path", "content")


def _pixels(bands: bool):
    """Frames of files to frames of pixels, some rows of a raster at a time."""

    def pixels(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                t = parse_tiff(bytes(content))
                cube = t["values"] if t["values"].ndim == 3 else t["values"][:, :, None]
                rows = max(1, 200_000 // max(1, cube.shape[1] * (cube.shape[2] if bands else 1)))
                for lo in range(0, cube.shape[0], rows):
                    part = cube[lo : lo + rows].astype(float)
                    if t["nodata"] is not None:
                        part = np.where(part == t["nodata"], np.nan, part)
                    r, c = np.indices(part.shape[:2])
                    v = list(part.reshape(-1, part.shape[2]).astype(np.float32)) if bands else part[:, :, 0].ravel()
                    yield pd.DataFrame({"tile_id": name.rsplit("/", 1)[-1], "row": (r.ravel() + lo).astype(np.int32), "col": c.ravel().astype(np.int32), "v": v, "x0": t["x0"], "y1": t["y1"], "res": t["res"]})

    return pixels


def read_tiff(spark: SparkSession, path: str, nodata_as: float | None = None) -> DataFrame:
    """(tile_id, row, col, v, x0, y1, res): the first band of every TIFF file under a folder, one file a task's unit.

    Missing values are NULL, or `nodata_as` (a single-tile load of the reference makes them 200).
    """
    out = _tiff_files(spark, path).mapInPandas(_pixels(False), "tile_id string, row int, col int, v double, x0 double, y1 double, res double")
    out = out.withColumn("v", clean("v"))
    return out if nodata_as is None else out.fillna(float(nodata_as), ["v"])


def read_tiff_bands(spark: SparkSession, path: str) -> DataFrame:
    """(tile_id, row, col, probs, x0, y1, res): all bands of every pixel, as class probabilities come."""
    out = _tiff_files(spark, path).mapInPandas(_pixels(True), "tile_id string, row int, col int, v array<float>, x0 double, y1 double, res double")
    return out.withColumnRenamed("v", "probs")


def read_mosaic(spark: SparkSession, path: str, nodata: float = -9999.0) -> DataFrame:
    """(row, col, v, x0, y1, res): all tiles of a folder on one grid, the first tile by name winning; missing pixels are `nodata`.

    The grid's corner is the tiles' outermost one; only the tiles' corners, one row a file, are reduced for it.
    """
    tiles = read_tiff(spark, path)
    corner = tiles.agg(F.min("x0").alias("left"), F.max("y1").alias("top"))
    shift = lambda a: F.round(a / F.col("res")).cast("int")
    at = tiles.crossJoin(F.broadcast(corner))  # one row
    at = at.withColumns({"row": F.col("row") + shift(F.col("top") - F.col("y1")), "col": F.col("col") + shift(F.col("x0") - F.col("left"))})
    one = mosaic(at)
    geo = at.agg(F.first("left").alias("x0"), F.first("top").alias("y1"), F.first("res").alias("res"))
    return one.fillna(float(nodata), ["v"]).crossJoin(F.broadcast(geo))


def encode_tiff(raster: DataFrame, by: str = "tile_id", dtype: str = "f4", nodata: float = float("nan"), compress: bool = True, epsg: int | None = None) -> DataFrame:
    """(tile_id, content): one TIFF file's bytes per tile, at the place that x0, y1 and res say if the raster has them.

    A tile is bounded and one task's group.
    """
    geo = [c for c in ("x0", "y1", "res") if c in raster.columns]

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((frame["row"].max() + 1, frame["col"].max() + 1), nodata, dtype)
        some = frame["v"].notna()
        grid[frame["row"][some], frame["col"][some]] = frame["v"][some]
        place = {c: float(frame[c].iloc[0]) for c in geo}
        return pd.DataFrame({by: [frame[by].iloc[0]], "content": [build_tiff(grid, **place, nodata=nodata, compress=compress, epsg=epsg)]})

    return raster.select(by, "row", "col", "v", *geo).groupBy(by).applyInPandas(build, f"{by} string, content binary")


# --- LAS: uncompressed point files ----------------------------------------------------------------------


def parse_las(data: bytes) -> pd.DataFrame:
    """seq, x, y, z and class of an uncompressed LAS 1.0-1.4 file."""
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    start, = struct.unpack("<I", data[96:100])
    fmt, size = data[104], struct.unpack("<H", data[105:107])[0]
    if fmt & 0x80:
        raise ValueError("compressed point files are not read")
    n, = struct.unpack("<I", data[107:111])
    if data[25] >= 4 and n == 0:
        n, = struct.unpack("<Q", data[247:255])
    scale, offset = np.frombuffer(data, "<f8", 3, 131), np.frombuffer(data, "<f8", 3, 155)
    raw = np.frombuffer(data, np.uint8, n * size, start).reshape(n, size)
    xyz = np.ascontiguousarray(raw[:, :12]).view("<i4") * scale + offset
    cls = raw[:, 16] if fmt >= 6 else raw[:, 15] & 0x1F
    return pd.DataFrame({"seq": np.arange(n), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "cls": cls.astype(np.int16)})


def read_las(spark: SparkSession, path: str) -> DataFrame:
    """(tile_id, seq, x, y, z, cls) of every .las file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.las").load(path).select("path", "content")

    def points(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                yield parse_las(bytes(content)).assign(tile_id=name.rsplit("/", 1)[-1])[["tile_id", "seq", "x", "y", "z", "cls"]]

    return files.mapInPandas(points, "tile_id string, seq long, x double, y double, z double, cls short")


# --- sinks ------------------------------------------------------------------------------------------------


def shapefile_columns(table: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """table with names a shapefile can hold; a name over ten characters is an error."""
    out = table.withColumnsRenamed(dict(renames))
    long = [c for c in out.columns if len(c) > 10]
    if long:
        raise ValueError(f"names over ten characters: {long}")
    return out


def geojson_features(cells: DataFrame) -> DataFrame:
    """(feature): one GeoJSON feature a cell (minx, miny, maxx, maxy), its other columns as properties."""
    corner = lambda x, y: F.array(F.col(x).cast("double"), F.col(y).cast("double"))
    ring = F.array(corner("maxx", "miny"), corner("maxx", "maxy"), corner("minx", "maxy"), corner("minx", "miny"), corner("maxx", "miny"))
    rest = [c for c in cells.columns if c not in ("minx", "miny", "maxx", "maxy")]
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return cells.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*rest).alias("properties"), shape.alias("geometry"))).alias("feature"))


def build_shapefile(frame: pd.DataFrame) -> dict[str, bytes]:
    """The .shp, .shx and .dbf files of cells (minx, miny, maxx, maxy), with their numeric and text columns."""
    boxes = frame[["minx", "miny", "maxx", "maxy"]].to_numpy("<f8")
    rest = [c for c in frame.columns if c not in ("minx", "miny", "maxx", "maxy")]
    size = 44 + 4 + 5 * 16  # box, counts, the one part's start, five corners
    span = [*boxes[:, :2].min(axis=0), *boxes[:, 2:].max(axis=0)] if len(boxes) else [0.0] * 4

    def head(length: int) -> bytes:
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, length // 2) + struct.pack("<2i", 1000, 5) + struct.pack("<8d", *span, 0, 0, 0, 0)

    shp, shx = bytearray(head(100 + len(boxes) * (8 + size))), bytearray(head(100 + len(boxes) * 8))
    for k, (x0, y0, x1, y1) in enumerate(boxes):
        shx += struct.pack(">2i", len(shp) // 2, size // 2)
        ring = (x0, y0, x0, y1, x1, y1, x1, y0, x0, y0)  # clockwise
        shp += struct.pack(">2i", k + 1, size // 2) + struct.pack("<i4d2ii10d", 5, x0, y0, x1, y1, 1, 5, 0, *ring)
    fields, rows = [], [b" "] * len(frame)
    for c in rest:
        whole, text = pd.api.types.is_integer_dtype(frame[c]), not pd.api.types.is_numeric_dtype(frame[c])
        cells = [("" if pd.isna(v) else str(v) if text else f"{int(v)}" if whole else f"{v:.15g}").encode("utf-8", "replace")[:254] for v in frame[c]]
        width = max([18 if not text else 1, *map(len, cells)])
        fields.append(c.encode()[:10].ljust(11, b"\0") + (b"C" if text else b"N") + bytes(4) + bytes([width, 0 if text or whole else 15]) + bytes(14))
        rows = [r + (v.ljust(width) if text else v.rjust(width)) for r, v in zip(rows, cells, strict=True)]
    record = len(rows[0]) if rows else 1
    dbf = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(rows), 33 + 32 * len(fields), record) + b"".join(fields) + b"\r" + b"".join(rows) + b"\x1a"
    return {"shp": bytes(shp), "shx": bytes(shx), "dbf": dbf}


def encode_shapefile(cells: DataFrame, renames: Mapping[str, str] | None = None) -> DataFrame:
    """(suffix, content) of a shapefile's three files; the format is one file, so this is one task, of 2 GB at most."""
    table = shapefile_columns(cells, renames or {}).withColumn("one_", F.lit(1))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        found = build_shapefile(frame.drop(columns="one_"))
        return pd.DataFrame({"suffix": list(found), "content": list(found.values())})

    return table.groupBy("one_").applyInPandas(build, "suffix string, content binary")


def write_blocks(raster: DataFrame, path: str, size: int = 256) -> None:
    """Pixels as Parquet clustered by block, so that a window reads few files."""
    blocks(raster, size).repartition("block_row", "block_col").sortWithinPartitions("block_row", "block_col", "row", "col").write.partitionBy("block_row").parquet(path)


def to_json(value) -> str:
    return json.dumps(value, sort_keys=True, indent=2)


def manifest(spark: SparkSession, arguments: Mapping) -> str:
    """A run's time, arguments, versions and session settings."""
    return to_json(
        {
            "created_utc": datetime.now(timezone.utc).isoformat(),
            "argv": sys.argv,
            "arguments": dict(arguments),
            "python": sys.version,
            "platform": platform.platform(),
            "packages": {"pyspark": pyspark.__version__, "numpy": np.__version__, "pandas": pd.__version__},
            "spark": {k: v for k, v in spark.sparkContext.getConf().getAll() if k.startswith("spark.sql.")},
        }
    )
