"""Files, settings, time, sun, streams."""

import json
import math
import struct
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.functions import pixels as px
from terraloom.operators import align, inventory, lighting, points, solar, timegen
from terraloom.plans import settings
from terraloom.sources import files
from terraloom.streaming import incremental


def test_inventories(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"values": [{"nom": "1845_5175", "url": "https://x/a/1845_5175.laz"}, {"nom": "1846_5175", "url": "https://x/b.laz"}]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"tiles": []}))
    tiles = inventory.tile_origin(files.read_inventory(spark, str(tmp_path / "a.json")))
    got = inventory.select(tiles, 1_845_000, 1_845_000, 5_175_000, 5_175_000).select(px.url_basename("url").alias("f")).collect()
    assert [r.f for r in got] == ["1845_5175.laz"]
    with pytest.raises(ValueError):
        files.read_inventory(spark, str(tmp_path / "b.json"))
    box = spark.createDataFrame([(1_845_000, 5_175_000, "a.laz"), (1_846_000, 5_175_000, "b.laz")], "x_min long, y_min long, url string")
    assert [r.url for r in inventory.select(inventory.tile_origin(box), 1_845_000, 1_845_000, 5_175_000, 5_175_000).collect()] == ["a.laz"]
    with pytest.raises(Exception, match="without an origin"):
        inventory.tile_origin(spark.createDataFrame([(None, 1, "bad")], "x_min long, y_min long, nom string")).collect()
    with pytest.raises(ValueError):
        inventory.select(box, 10, 5, 0, 1)


def test_mappings_and_settings():
    assert files.read_mapping('{"1": "2"}') == {1: 2} and files.read_mapping('{"8": 1.25, "14": 0.5}', float) == {8: 1.25, 14: 0.5}
    with pytest.raises(ValueError):
        files.read_mapping('{"a": 1}')
    for bad in (lambda: settings.Box(10, 5, 0, 1), lambda: settings.odd_positive(4, "window"), lambda: settings.positive(0, "res"), lambda: settings.site(91, 0, 2000, 2001), lambda: settings.site(0, 0, 0, 1), lambda: settings.run_limits(1, -1, 1, 0), lambda: settings.load_yaml("- 1")):
        with pytest.raises(ValueError):
            bad()
    assert settings.pick(None, 0, 5) == 0 and settings.pick(None, fallback=3) == 3
    assert settings.reweight_config({"weights": {"8": 2}, "mapping": {"8": "0"}}) == ({8: 2.0}, {8: 0}, 255)
    assert str(settings.config_path("c/a.yml", "c/a.yml", "exp")) == "exp/a.yml" and str(settings.config_path("own.yml", "c/a.yml", "exp")) == "own.yml"


def test_inference_settings_and_missing_files(tmp_path):
    template = {"modalities": {"AERIAL_RGBI": {"channels": [1, 2, 3, 4], "norm": 1}, "DEM": {}}, "tasks": [1]}
    got = settings.inference_settings(template, "m.tif", "out", "run", "w.ckpt", False, 4, 0, 512, 128, 0.2)
    assert got["output_type"] == "class_prob" and got["modalities"]["AERIAL_RGBI"] == {"channels": [1, 2, 3], "norm": 1, "input_img_path": "m.tif"}
    assert got["tasks"] == [1] and template["modalities"]["AERIAL_RGBI"]["channels"] == [1, 2, 3, 4]
    source = tmp_path / "there.json"
    source.write_text("{}")
    target = str(tmp_path / "new" / "inventory.json")
    with pytest.raises(FileNotFoundError):
        settings.ensure_file(target, "inventory", source.as_uri())
    assert settings.ensure_file(target, "inventory", source.as_uri(), download_missing=True).read_text() == "{}"
    assert settings.ensure_file(target, "inventory").name == "inventory.json"


def test_tiff_round_trip(spark, tmp_path):
    for kind in ("u1", "i2", "f4", "f8"):
        values = np.arange(12).reshape(3, 4).astype(kind)
        got = files.parse_tiff(files.build_tiff(values, 10.0, 20.0, 0.5, 255))
        assert (got["values"] == values).all() and (got["x0"], got["y1"], got["res"], got["nodata"]) == (10.0, 20.0, 0.5, 255.0)
    (tmp_path / "one.tif").write_bytes(files.build_tiff(np.array([[1, -9999], [3, np.nan]], "f4"), nodata=-9999))
    rows = {(r.row, r.col): r.v for r in files.read_tiff(spark, str(tmp_path)).collect()}
    assert rows == {(0, 0): 1.0, (0, 1): None, (1, 0): 3.0, (1, 1): None}
    assert {r.v for r in files.read_tiff(spark, str(tmp_path), 200).collect()} == {1.0, 3.0, 200.0}
    back = files.encode_tiff(files.read_tiff(spark, str(tmp_path))).first()
    assert np.isnan(files.parse_tiff(bytes(back.content))["values"][0, 1])
    placed = files.read_tiff(spark, str(tmp_path)).withColumns({"x0": F.lit(7.0), "y1": F.lit(9.0), "res": F.lit(0.5)})
    t = files.parse_tiff(bytes(files.encode_tiff(placed, epsg=2154).first().content))
    assert (t["x0"], t["y1"], t["res"]) == (7.0, 9.0, 0.5)
    with pytest.raises(ValueError):
        files.parse_tiff(b"no")


@pytest.mark.parametrize("size", [0, 1, 2, 300, 5000, 70_000])
def test_lzw_round_trip(size):
    rng = np.random.default_rng(size)
    for data in (rng.integers(0, 256, size, np.uint8), rng.integers(0, 3, size, np.uint8), np.zeros(size, np.uint8)):
        assert files.lzw_decode(files.lzw_encode(data.tobytes())) == data.tobytes()


def test_lzw_of_the_published_example():
    """The TIFF 6.0 description's own string, code by code: clear, 7, 258, 8, 8, 258, 6, 6, end."""
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    packed = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    data = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert files.lzw_decode(packed) == data and files.lzw_encode(data) == packed


@pytest.mark.parametrize("compress", [False, True])
def test_tiff_of_many_bands(spark, tmp_path, compress):
    """Nineteen bands, more than one strip, and what the readers make of them."""
    cube = np.random.default_rng(3).random((70, 60, 19)).astype("f4")
    data = files.build_tiff(cube, 100.0, 200.0, 0.2, compress=compress)
    assert (files.parse_tiff(data)["values"] == cube).all()
    (tmp_path / "p.tif").write_bytes(data)
    rows = files.read_tiff_bands(spark, str(tmp_path)).collect()
    assert len(rows) == 4200 and all(np.array_equal(np.array(r.probs, "f4"), cube[r.row, r.col]) for r in rows[::97])
    assert {(r.row, r.col): r.v for r in files.read_tiff(spark, str(tmp_path)).filter("row = 3").collect()}[(3, 5)] == cube[3, 5, 0]


def _tiled(values, wide, predictor):
    """A tiled, deflated file as other writers make them, in 64-bit form if asked for."""
    import zlib

    height, width = values.shape
    tiles = []
    for r in range(0, height, 16):
        for c in range(0, width, 16):
            t = np.zeros((16, 16), values.dtype)
            part = values[r : r + 16, c : c + 16]
            t[: part.shape[0], : part.shape[1]] = part
            if predictor == 2:
                t[:, 1:] = t[:, 1:] - t[:, :-1]
            tiles.append(zlib.compress(t.tobytes()))
    start, number, kind = (16, "Q", 16) if wide else (8, "I", 4)
    places = [start + sum(map(len, tiles[:i])) for i in range(len(tiles))]
    entries = [(256, 3, [width]), (257, 3, [height]), (258, 3, [16]), (259, 3, [8]), (317, 3, [predictor]), (322, 3, [16]), (323, 3, [16]), (324, kind, places), (325, kind, [len(t) for t in tiles]), (339, 3, [1])]
    body = b"".join(tiles)
    at = start + len(body)
    after = at + (8 + 20 * len(entries) + 8 if wide else 2 + 12 * len(entries) + 4)
    table, extra = struct.pack("<Q" if wide else "<H", len(entries)), b""
    for tag, k, v in entries:
        raw = struct.pack(f"<{len(v)}{ {3: 'H', 4: 'I', 16: 'Q'}[k]}", *v)
        table += struct.pack("<HH" + number, tag, k, len(v))
        if len(raw) > (8 if wide else 4):
            table += struct.pack("<" + number, after + len(extra))
            extra += raw
        else:
            table += raw.ljust(8 if wide else 4, b"\0")
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) if wide else struct.pack("<2sHI", b"II", 42, at)
    return head + body + table + b"\0" * (8 if wide else 4) + extra


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiled_tiff(wide, predictor):
    values = np.random.default_rng(1).integers(0, 60_000, (37, 50)).astype("u2")
    assert (files.parse_tiff(_tiled(values, wide, predictor))["values"] == values).all()


def test_cells_as_features_and_shapefile(spark):
    cells = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 1.5, "a", 3), (10.0, 0.0, 20.0, 10.0, None, "é", 4)], "minx double, miny double, maxx double, maxy double, infiltration double, name string, k int")
    found = [json.loads(r.feature) for r in files.geojson_features(cells).collect()]
    assert found[0]["geometry"]["coordinates"][0][0] == [10.0, 0.0] and len(found[0]["geometry"]["coordinates"][0]) == 5 and found[0]["properties"] == {"infiltration": 1.5, "name": "a", "k": 3}
    with pytest.raises(ValueError):
        files.encode_shapefile(cells)
    out = {r.suffix: bytes(r.content) for r in files.encode_shapefile(cells, {"infiltration": "infil"}).collect()}
    shp, shx, dbf = out["shp"], out["shx"], out["dbf"]
    assert struct.unpack(">i", shp[:4])[0] == 9994 and struct.unpack(">i", shp[24:28])[0] * 2 == len(shp) and struct.unpack(">i", shx[24:28])[0] * 2 == len(shx) == 116
    assert struct.unpack("<4d", shp[36:68]) == (0.0, 0.0, 20.0, 10.0)
    at = struct.unpack(">i", shx[108:112])[0] * 2
    assert struct.unpack(">2i", shp[at : at + 8]) == (2, 64) and struct.unpack("<4d", shp[at + 12 : at + 44]) == (10.0, 0.0, 20.0, 10.0)
    n, head, size = struct.unpack("<IHH", dbf[4:12])
    assert n == 2 and dbf[32:37] == b"infil" and dbf[head - 1 : head] == b"\r" and len(dbf) == head + n * size + 1
    widths, at, cells_ = [dbf[32 + 32 * k + 16] for k in range(3)], head + 1, []
    for row in range(n):
        at = head + row * size + 1
        cells_.append([dbf[at + sum(widths[:k]) : at + sum(widths[: k + 1])].decode().strip() for k in range(3)])
    assert cells_ == [["1.5", "a", "3"], ["", "é", "4"]]
    assert [r.c for r in spark.createDataFrame([(0.0,), (0.049,), (0.05,), (1.0,)], "v double").select(px.index_class("v").alias("c")).collect()] == [0, 0, 1, 19]


def test_mosaic_of_a_folder(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(files.build_tiff(np.array([[1, 2], [3, -1]], "f4"), 10.0, 20.0, 1.0, -1, compress=True))
    (tmp_path / "b.tif").write_bytes(files.build_tiff(np.array([[5, 6]], "f4"), 11.0, 19.0, 1.0, -1))
    rows = files.read_mosaic(spark, str(tmp_path)).collect()
    assert {(r.row, r.col): r.v for r in rows} == {(0, 0): 1.0, (0, 1): 2.0, (1, 0): 3.0, (1, 1): 5.0, (1, 2): 6.0}
    assert {(r.x0, r.y1, r.res) for r in rows} == {(10.0, 20.0, 1.0)}
    (tmp_path / "b.tif").write_bytes(files.build_tiff(np.array([[-1, 6]], "f4"), 11.0, 19.0, 1.0, -1))
    assert {(r.row, r.col): r.v for r in files.read_mosaic(spark, str(tmp_path)).collect()}[(1, 1)] == -9999.0
    assert align.source_resolution(0.2, -0.2) == 0.2
    with pytest.raises(ValueError):
        align.source_resolution(0.2, 0.3)


def test_las(spark, tmp_path):
    points_ = [(100, 200, 300, 5), (110, 190, 310, 2)]
    body = b"".join(struct.pack("<iiiHBBbBH", x, y, z, 0, 0, c, 0, 0, 0) for x, y, z, c in points_)
    header = bytearray(227)
    header[:4], header[24], header[25] = b"LASF", 1, 2
    header[96:100], header[104], header[105:107], header[107:111] = struct.pack("<I", 227), 0, struct.pack("<H", 20), struct.pack("<I", 2)
    header[131:155], header[155:179] = struct.pack("<3d", 0.01, 0.01, 0.01), struct.pack("<3d", 1000, 2000, 0)
    (tmp_path / "t.las").write_bytes(bytes(header) + body)
    got = [(r.seq, round(r.x, 2), round(r.y, 2), round(r.z, 2), r.cls) for r in files.read_las(spark, str(tmp_path)).orderBy("seq").collect()]
    assert got == [(0, 1001.0, 2002.0, 3.0, 5), (1, 1001.1, 2001.9, 3.1, 2)]


def test_lighting_csv(spark, tmp_path):
    for k, lit in ((1, " True"), (2, "false")):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "output.csv").write_text(f"tile;feature;triangle;time;lighted\n{k};0;0;t;{lit}\n{k};0;1;t;true\n")
    rows = files.read_lighting(spark, str(tmp_path))
    assert {r.n_lit for r in lighting.lit_count(rows).collect()} == {2, 1}
    assert {r.n_lit for r in lighting.lit_count(rows, skip_first=True).collect()} == {1}
    assert sorted(tuple(r.flags) for r in lighting.flags_by_tile(rows).collect()) == [(False, True), (True, True)]
    listed = inventory.latest(files.list_files(spark, str(tmp_path), "*.csv"))
    assert listed.first().path.endswith("output.csv")


def test_times(spark):
    s = timegen.snapshots(spark, datetime(2024, 1, 1), datetime(2024, 1, 1, 6), 3)
    assert [r[0].hour for r in s.orderBy("snapshot").collect()] == [0, 3, 6]
    assert json.loads(timegen.snapshot_json(s).first().json) == ["2024-01-01T00:00:00", "2024-01-01T03:00:00", "2024-01-01T06:00:00"]
    assert timegen.snapshots(spark, datetime(2024, 1, 2), datetime(2024, 1, 1), 1).count() == 0
    assert timegen.calendar(spark, 2024, 2024).count() == 8784 and timegen.calendar(spark, 2023, 2023).count() == 8760
    for bad in (lambda: timegen.snapshots(spark, datetime(2024, 1, 1), datetime(2024, 1, 2), 0), lambda: timegen.calendar(spark, 5, 4)):
        with pytest.raises(ValueError):
            bad()


def test_sun_position_meets_published_example(spark):
    """Golden, Colorado, 2003-10-17 12:30:30 local: zenith 50.11162, azimuth 194.34024 degrees."""
    ts = F.lit(datetime(2003, 10, 17, 19, 30, 30, tzinfo=timezone.utc)).cast("timestamp")
    altitude, azimuth = solar.position(ts, 39.742476, -105.1786, 820.0, 11.0)
    got = spark.range(1).select(altitude, azimuth).first()
    assert math.isclose(90 - got[0], 50.11162, abs_tol=0.01) and math.isclose(got[1], 194.34024, abs_tol=0.01)


def test_annual_lines(spark):
    sun = solar.ephemeris(timegen.calendar(spark, 2024, 2024).filter("date = '2024-06-21'"), 45.76, 4.85)
    line = solar.annual_lines(sun).first().line.split(";")
    day = {r.hour: r.line for r in solar.day_lines(sun).collect()}
    assert len(day) >= 24 and all(x.startswith(f"{h},") and len(x.split(",")) == 3 for h, x in day.items())
    whole = [r.line for r in solar.annual_file(sun, 45.76, 4.85).collect()]
    assert whole[0].startswith("45.76;4.85;E 00:00:00;A 00:00:00;E 01:00:00") and len(whole[0].split(";")) == 50 and whole[1].split(";")[1:3] == ["--", "--"]
    assert len(line) == 49 and line[0] == "2024-06-21" and line[1] == "--" and float(line[25]) > 60
    assert len(solar.annual_lines(sun, compat=True).first().line.split(";")) == 51


def test_sinks(spark, tmp_path):
    table = spark.createDataFrame([(1.0, 2.0)], "infiltration_index double, slope double")
    with pytest.raises(ValueError):
        files.shapefile_columns(table, {})
    assert files.shapefile_columns(table, {"infiltration_index": "infil_idx"}).columns == ["infil_idx", "slope"]
    raster = spark.createDataFrame([(300, 5, 1.0), (2, 600, 2.0)], "row int, col int, v double")
    files.write_blocks(raster, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert {(r.block_row, r.block_col, r.v) for r in back.collect()} == {(1, 0, 1.0), (0, 2, 2.0)}
    assert json.loads(files.manifest(spark, {"a": 1}))["arguments"] == {"a": 1}
    assert align.block_average(raster, 1000).count() == 1


def test_streams_equal_batch(spark, tmp_path):
    rows = [(f"2024-01-01 0{i % 6}:00:00", i % 3, i % 2, float(i * 7 % 11), i % 7, i) for i in range(60)]
    batch = spark.createDataFrame(rows, "ts string, row int, col int, z double, cls int, seq long").withColumn("ts", F.to_timestamp("ts"))
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = incremental.rasterize_windows(stream, ["seq"]).writeStream.outputMode("complete").format("memory").queryName("pixels").start()
    try:
        query.processAllAvailable()
        got = {(r.row, r.col, r.dsm, r.dtm, r.cls) for r in spark.table("pixels").collect()}
    finally:
        query.stop()
    assert got == {(r.row, r.col, r.dsm, r.dtm, r.cls) for r in points.rasterize(batch, ["seq"]).collect()}
