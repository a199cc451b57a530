"""Hand-computed small rasters for each operator, with missing, empty and boundary cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.functions import pixels as px
from terraloom.operators import align, evaluate, points, stencil, zonal
from terraloom.plans import settings

NAN = float("nan")


def grid(spark, text, name="v", kind="double"):
    """Rows "a b; c d" with _ for missing."""
    rows = [(r, c, None if x == "_" else float(x) if kind in ("double", "float") else int(x)) for r, line in enumerate(text.split(";")) for c, x in enumerate(line.split())]
    return spark.createDataFrame(rows, f"row int, col int, {name} {kind}")


def layers(spark, **texts):
    out = None
    for name, text in texts.items():
        g = grid(spark, text, name, "double" if name in ("h", "top", "ground", "v") else "int")
        out = g if out is None else out.join(g, ["row", "col"])
    return out


def values(df, name="v"):
    return [r[0] for r in df.orderBy("row", "col").select(name).collect()]


def test_fill_in_place(spark):
    g = grid(spark, "1 1 1; 1 _ 3; 1 5 7").withColumn("tile_id", F.lit("t"))
    assert values(stencil.fill_in_place(g, 3)) == [1, 1, 1, 1, 2.5, 3, 1, 5, 7]
    later = grid(spark, "1 1 1 1; 1 _ _ 1; 9 9 9 9").withColumn("tile_id", F.lit("t"))
    got = values(stencil.fill_in_place(later, 3))
    first = (4 * 1 + 3 * 9) / 7
    assert math.isclose(got[5], first) and math.isclose(got[6], (3 + first + 1 + 27) / 8)
    assert values(stencil.fill_in_place(grid(spark, "_ 2").withColumn("tile_id", F.lit("t")), 3)) == [0, 2]
    with pytest.raises(ValueError):
        stencil.fill_in_place(g, 4)


def test_zero_missing(spark):
    assert values(grid(spark, "_ 2").withColumn("v", px.zero_missing("v"))) == [0, 2]


def test_legacy_height_and_class(spark):
    f = layers(spark, top="10 8; 6 4", ground="1 2; 1 1", cls="5 1; 2 1", mask="255 0; 255 255")
    assert values(f.withColumn("v", px.legacy_height("top", "ground", "cls", "mask"))) == [9, 6, None, None]
    got = values(grid(spark, "0.75 2 6 20 0.5 1.5 5 15 0.49 _").withColumn("v", px.legacy_class("v")))
    assert got == [1, 2, 3, 4, 1, 2, 3, 4, None, None]
    f = layers(spark, lidar="1 2 3 4 _", image_map="3 3 3 3 2")
    assert values(f.withColumn("v", px.legacy_fuse("lidar", "image_map"))) == [1, 1, 2, 3, 2]


def test_rounding_is_by_exact_value(spark):
    rng = np.random.default_rng(2)
    xs = [0.0, -0.0, 2.5, 2.675, 0.125, 0.375, -0.125, 1.005, 0.005, -0.004, 359.995, 0.0625, 1e-9, 45.0, *rng.uniform(-360, 360, 3000).tolist(), *(rng.integers(-36000, 36000, 2000) / 200).tolist(), *(rng.integers(-9000, 9000, 1000) / 16).tolist()]
    f = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    for r in f.select("x", px.rounded("x", 2).cast("string").alias("two"), px.rounded("x", 3).alias("three")).collect():
        assert r.two == str(round(r.x, 2) if r.x else 0.0) and r.three == round(r.x, 3), r


def test_vegetation_map(spark):
    f = layers(spark, cls="2 2 5", h="6 6 6", mask="0 255 255", image_map="1 1 1")  # the image mask alone decides the image map
    assert values(f.withColumn("v", px.vegetation_map("cls", "h", "mask", "image_map")[1])) == [2, None, None]
    f = layers(spark, cls="5 1; 8 2", h="0.2 2; 6 10", mask="0 0; 0 255", image_map="3 1; 2 0")
    lidar, image = px.vegetation_map("cls", "h", "mask", "image_map", (0.30, 5), (0.75, 5), keep_class1=True)
    assert values(f.withColumn("v", lidar)) == [0, 1, 2, None] and values(f.withColumn("v", image)) == [0, 1, 2, None]
    f = layers(spark, cls="5 5; 5 5", h="0.4 1.6; 4 8", mask="0 0; 0 0", image_map="0 0; 0 0")
    lidar, image = px.vegetation_map("cls", "h", "mask", "image_map", (1.5, 3.5), (0.5, 6))
    assert values(f.withColumn("v", lidar)) == [0, 1, 2, 2] and values(f.withColumn("v", image)) == [0, 1, 1, 2]
    _, untouched = px.vegetation_map("cls", "h", "mask", "image_map", modify_image_map=False)
    assert values(f.withColumn("v", untouched)) == [0, 0, 0, 0]
    on = values(grid(spark, "0.3 5 0.29 _").withColumn("v", px.classify_heights("v", F.lit(True), 0.30, 5.0)))
    assert on == [1, 2, 0, None]


def test_fuse(spark):
    f = layers(spark, lidar="0 _; 2 _", image_map="1 0; 1 2")
    assert values(f.withColumn("v", px.fuse("lidar", "image_map", everywhere=False))) == [0, 0, 2, None]
    assert values(f.withColumn("v", px.fuse("lidar", "image_map"))) == [0, 0, 2, 2]


def test_fill_jacobi(spark):
    f = layers(spark, v="10 _; 14 16", cls="0 9; 0 0")
    assert values(stencil.fill_jacobi(f)) == [10, 10, 14, 16]
    f = layers(spark, v="12 _ _; _ _ _; _ _ _", cls="0 0 0; 0 0 0; 0 0 0")
    assert values(stencil.fill_jacobi(f)) == [12.0] * 9
    f = grid(spark, "1 _ _ 9")
    assert values(stencil.fill_jacobi(f, cls=None)) == [1, 1, 9, 9]
    assert values(stencil.fill_jacobi(grid(spark, "_ _"), cls=None)) == [0, 0]


def test_reweight_argmax_remap(spark):
    bands = {(0, 0): {8: 0.9, 14: 0.1}, (0, 1): {8: 0.1, 14: 0.8}, (1, 0): {12: 0.6}, (1, 1): {}}
    rows = [(r, c, [b.get(k, 0.0) for k in range(19)]) for (r, c), b in bands.items()]
    f = spark.createDataFrame(rows, "row int, col int, probs array<float>")
    best = px.argmax(px.reweight("probs", px.weight_array({8: 1, 14: 2, 12: 1}, 19)))
    assert values(f.withColumn("b", best).withColumn("v", px.remap("b", {8: 0, 14: 1, 12: 2}, 255))) == [0, 1, 2, 255]
    with pytest.raises(ValueError, match="missing class band"):
        px.weight_array({3: 1.0}, 2)
    assert values(grid(spark, "1 2 7 _", kind="int").withColumn("v", px.remap("v", {1: 2, 2: 3}))) == [2, 3, None, None]


def test_pad_and_shape(spark):
    a, b = grid(spark, "1 2; 3 4", "a"), grid(spark, "1 1 1; 1 1 1; 1 1 1", "b")
    out = align.pad_outer(a, b)
    assert values(out, "a") == [1, 2, None, 3, 4, None, None, None, None]
    assert align.pad_left(a, b).count() == 4
    with pytest.raises(ValueError):
        align.pad_left(a, b, crop=False)
    shapes = [spark.createDataFrame([(h - 1, w - 1)], "row int, col int") for h, w in ((2, 5), (4, 3), (1, 9))]
    assert tuple(align.shape(*shapes).first()) == (4, 9)
    assert align.resampled_size(4, 0.05, 0.1) == 2 and align.resampled_size(1, 1, 10) == 1


def test_bilinear(spark):
    a = np.arange(16.0).reshape(4, 4)
    f = grid(spark, ";".join(" ".join(map(str, r)) for r in a))
    assert values(align.bilinear(f, 4, 4, 0.05, 0.1)) == [2.5, 4.5, 10.5, 12.5]
    assert values(align.bilinear(f, 4, 4, 1.0, 1.0)) == a.ravel().tolist()
    assert values(align.bilinear(grid(spark, "1 _; 3 5"), 2, 2, 1.0, 2.0)) == [3.0]


def test_mosaic_takes_the_first_value(spark):
    t = spark.createDataFrame([("a", 0, 0, None), ("b", 0, 0, 2.0), ("c", 0, 0, 3.0), ("c", 0, 1, None)], "tile_id string, row int, col int, v double")
    assert values(align.mosaic(t)) == [2.0, None]


def test_overlap_confusion(spark):
    ref = grid(spark, "0 1 2 3; 1 2 2 5; 3 4 5 0; 0 1 2 3", kind="int")
    pred = grid(spark, "0 1; 2 3", kind="int")
    joined = align.overlap(ref, pred, (0.0, 4.0, 1.0), (1.0, 3.0, 1.0))
    pairs = joined.select(px.remap("ref", {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2}).alias("ref"), px.remap("pred", {0: 0, 1: 1, 2: 2, 3: 2}).alias("pred"))
    cm = {(r.ref, r.pred): r.n for r in evaluate.confusion(pairs, 4, empty=3).collect()}
    assert len(cm) == 16 and {k: v for k, v in cm.items() if v} == {(1, 0): 1, (1, 1): 1, (2, 2): 2}
    with pytest.raises(ValueError):
        align.overlap(ref, pred, (0.0, 4.0, 1.0), (100.0, 3.0, 1.0))


def test_confusion_edges(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 1), (None, 1)], "ref int, pred int")
    cm = evaluate.confusion(pairs, 3, empty=2)
    assert {(r.ref, r.pred): r.percent for r in evaluate.percent(cm).collect()}[(1, 0)] == 0.0
    m = {r.class_id: r for r in evaluate.metrics(cm).collect()}
    assert m[0].iou == 0.5 and m[1].recall is None and m[1].precision == 0.0 and m[2].precision is None
    assert evaluate.summary(evaluate.metrics(cm), {0: "Grass", 1: "Bush", 2: "Autre"}).first().mean_iou == 0.25
    assert evaluate.confusion(pairs.limit(0), 2).agg(F.sum("n")).first()[0] == 0
    lines = [r.line for r in evaluate.report(evaluate.metrics(cm), {0: "Grass", 1: "Bush", 2: "Autre"}).orderBy("pos").collect()]
    assert lines == [
        "==== Segmentation Performance Report ====", "", "Class                      IoU      Precision         Recall           Dice", "-" * 75, "Grass                    0.500          1.000          0.500          0.667",
        "Bush                     0.000          0.000            nan          0.000", "Autre                    0.000            nan          0.000          0.000", "", "==== Global Means (excluding 'Autre') ====",
        "Mean IoU       : 0.250", "Mean Precision : 0.500", "Mean Recall    : 0.500", "Mean Dice      : 0.333",
    ]
    with pytest.raises(Exception, match="out of range"):
        evaluate.confusion(spark.createDataFrame([(7, 0)], "ref int, pred int"), 3).collect()


def test_highest_point_as_a_loop_finds_it(spark):
    """A stored single-precision height is replaced by every greater point, in file order."""
    rng, rows, want = random.Random(3), [], {}
    for cell in range(300):
        top = rng.choice([5.0, 5.1, 0.3, 7.7, 1.1])
        zs = [top if rng.random() < 0.6 else rng.choice([0.1, 0.2]) for _ in range(5)]
        stored, cls = np.float32(-np.inf), None
        for k, z in enumerate(zs):
            rows.append((0, cell, z, k, cell * 10 + k))
            if z > float(stored):
                stored, cls = np.float32(z), k
        want[cell] = cls
    p = spark.createDataFrame(rows, "row int, col int, z double, cls short, seq long")
    assert {r.col: r.cls for r in points.rasterize(p, [], sequential="seq").collect()} == want


def test_filling_tiles_apart(spark):
    rows = [(t, 0, c, v, 0) for t, vs in (("a", (1.0, None, 3.0)), ("b", (100.0, None, 300.0)), ("c", (None, None, None)), ("d", (None, 4.0, 9.0))) for c, v in enumerate(vs)]
    f = spark.createDataFrame(rows, "tile_id string, row int, col int, v double, cls int").withColumn("cls", F.when((F.col("tile_id") == "d") & (F.col("col") == 2), 9).otherwise(0))
    got = {(r.tile_id, r.col): r.v for r in stencil.fill_jacobi(f, by=("tile_id",)).collect()}
    assert [got["a", 1], got["b", 1], got["c", 1], got["d", 0], got["d", 2]] == [2.0, 200.0, 0.0, 4.0, 4.0] and len(got) == 12


def test_slope_on_grid_cells(spark):
    """Cells from the lower left corner, partial ones dropped, empty ones 0."""
    f = grid(spark, "1 2 3 4 5; 6 7 8 9 10; 11 12 13 14 15").withColumns({"slope_deg": F.col("v"), "slope_rad": F.col("v")})
    got = {(r.i, r.j): r.slope for r in zonal.zonal_slope_on_grid(f, (0.0, 3.0, 1.0), (0.0, 0.0, 5.0, 3.0), 2.0, "slope_max").collect()}
    assert got == {(0, 0): 12.0, (1, 0): 14.0}
    far = {(r.i, r.j): r.slope for r in zonal.zonal_slope_on_grid(f, (0.0, 3.0, 1.0), (4.0, 0.0, 8.0, 2.0), 2.0, "slope_max").collect()}
    assert far == {(0, 0): 15.0, (1, 0): 0.0}


def test_rasterize_ties_and_terrain(spark):
    rows = [(0.2, 0.9, 5.0, 6, 1), (0.3, 0.8, 5.0, 2, 0), (0.4, 0.7, 1.0, 1, 2), (0.1, 0.6, 2.0, 9, 3), (1.5, 0.5, 3.0, 3, 4), (2.0, 0.0, 8.0, 4, 5)]
    p = spark.createDataFrame(rows, "x double, y double, z double, cls short, seq long")
    ext = points.extent(p, 1.0)
    assert tuple(ext.first()) == (0.1, 0.9, 2, 1)
    got = {(r.row, r.col): (r.dsm, r.dtm, r.cls) for r in points.rasterize(points.locate(p, ext, 1.0), ["seq"]).collect()}
    assert got == {(0, 0): (5.0, 2.0, 2), (0, 1): (8.0, None, 4)}
    assert points.rasterize(points.locate(p.limit(0), points.extent(p, 1.0), 1.0), ["seq"]).count() == 0


def test_height_of_either_side(spark):
    f = layers(spark, top="3 3 _ _", ground="1 _ 1 _")
    assert values(f.withColumn("v", px.height("top", "ground"))) == [2, 3, 1, 0]


@pytest.mark.parametrize("shape", [(9, 7), (1, 5), (5, 1), (1, 1), (2, 2)])
def test_gradient_and_lower_neighbours_equal_numpy(spark, shape):
    a = np.random.default_rng(1).integers(0, 9, shape).astype(float)
    f = grid(spark, ";".join(" ".join(map(str, r)) for r in a))
    g = stencil.gradient(f)
    for name, axis in (("d_row", 0), ("d_col", 1)):
        want = np.gradient(a, axis=axis) if shape[axis] > 1 else np.zeros(shape)
        assert np.allclose(values(g, name), want.ravel())
    area = np.ones(shape)
    for r in range(1, shape[0] - 1):
        for c in range(1, shape[1] - 1):
            area[r, c] += (a[r - 1 : r + 2, c - 1 : c + 2] < a[r, c]).sum()
    assert values(stencil.lower_neighbours(f), "area") == area.ravel().tolist()


def test_grid_and_zones(spark):
    cells = [tuple(r) for r in zonal.grid(spark, 0, 0, 25, 12, 10).collect()]
    assert sorted(c[:2] for c in cells) == [(0, 0), (1, 0)] and zonal.grid(spark, 0, 0, 5, 5, 10).count() == 0
    f = grid(spark, "1 2; 3 _")
    box = spark.createDataFrame([(0, 0, 0.5, 0.5, 1.5, 1.5), (9, 9, 50.0, 50.0, 51.0, 51.0)], "i int, j int, minx double, miny double, maxx double, maxy double")
    got = {r.i: r["mean"] for r in zonal.weighted_mean(box, f).collect()}
    assert math.isclose(got[0], 2.0) and got[9] is None
    same = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert [r.s for r in zonal.min_max(same, "v", "s").collect()] == [None, None]
    with pytest.raises(ValueError):
        zonal.slope_stat("other")


@pytest.mark.parametrize(("xs", "ys", "zs", "want"), [([0, 1, 0, 1], [0, 0, 1, 1], [0, 1, 0, 1], 45.0), ([0, 1, 2], [0, 0, 0], [0, 1, 2], 45.0), ([0, 1], [0, 0], [0, 9], 0.0), ([2, 2, 2], [2, 2, 2], [1, 2, 3], 0.0)])
def test_best_fit_plane(spark, xs, ys, zs, want):
    rows = [(1_800_000.0 + x, 5_000_000.0 + y, float(z)) for x, y, z in zip(xs, ys, zs, strict=True)]
    f = spark.createDataFrame(rows, "x double, y double, z double")
    assert math.isclose(f.agg(zonal.slope_stat("best_fit_plane")).first()[0], want, abs_tol=1e-6)


def test_clean_makes_missing_null(spark):
    f = spark.createDataFrame([(0, 0, NAN), (0, 1, -9999.0), (0, 2, 3.0), (0, 3, None)], "row int, col int, v double")
    assert values(f.withColumn("v", px.clean("v", -9999.0))) == [None, None, 3.0, None]


def test_parameter_sets():
    assert settings.band_weights("baseline") == [1.0] * 19
    w = settings.band_weights("weights_more_modified")
    assert (w[8], w[14], w[12], w[13], w[0]) == (5.0, 30.0, 1.0, 1.0, 0.5)
