import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweave.operators import catalog as C
from rasterweave.operators import inference, labels, metrics, splitting, tiling


def pixels(spark, h, w):
    return spark.createDataFrame([(i, j, float(i * w + j)) for i in range(h) for j in range(w)], "i int, j int, v double")


def test_cubify_drops_partial_tiles(spark):
    got = tiling.cubify(pixels(spark, 30, 52), 30, 52, 25)
    assert got.select("cube_no").distinct().count() == 2 and got.count() == 2 * 625


@pytest.mark.parametrize("extent", [256, 300, 422, 600, 100])
def test_origins_cover_and_anchor(extent):
    o = tiling.origins(extent)
    assert o[0] == 0 and (extent <= 256 or o[-1] == extent - 256)
    assert all(b - a <= 256 - 90 for a, b in zip(o, o[1:], strict=False))


def test_every_pixel_survives_the_crop(spark):
    t = tiling.crop_rim(tiling.overlap_tiles(pixels(spark, 40, 33), 40, 33, 16, 6), 40, 33, 16, 2)
    assert t.select("i", "j").distinct().count() == 40 * 33


def test_rotation_is_numpys(spark):
    a = np.arange(25).reshape(5, 5)
    df = spark.createDataFrame([(1, r, c, int(a[r, c])) for r in range(5) for c in range(5)], "cube_id long, r int, c int, v int")
    for k in range(5):
        out = np.zeros((5, 5), int)
        for row in tiling.rotate_cubes(df, 5, F.lit(k)).collect():
            out[row["r"], row["c"]] = row["v"]
        assert (out == np.rot90(a, k)).all()
    assert tiling.rotate_cubes(df, 5).count() == 25


def test_pages_take_each_row_once(spark):
    got = tiling.pages(spark.range(19).withColumnRenamed("id", "n"), ["n"], 9)
    assert [r["count"] for r in got.groupBy("page").count().orderBy("page").collect()] == [9, 9, 1]


def touches(ring, i, j):
    """Cell and polygon share a point: a corner or centre inside, or a side crossing the square, by clipping."""

    def inside(x, y):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
        return odd

    def crosses(a, b):
        t0, t1 = 0.0, 1.0
        for d, s, lo in ((b[0] - a[0], a[0], j), (b[1] - a[1], a[1], i)):
            if d == 0:
                if not lo <= s <= lo + 1:
                    return False
            else:
                u, v = sorted(((lo - s) / d, (lo + 1 - s) / d))
                t0, t1 = max(t0, u), min(t1, v)
        return t0 <= t1 + 1e-12

    return inside(j + 0.5, i + 0.5) or any(crosses(a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def test_touched_cells_against_every_cell(spark):
    rng = random.Random(6)
    rings = [[(rng.random() * 20, rng.random() * 20) for _ in range(rng.randrange(3, 8))] for _ in range(12)] + [[(2.0, 2.0), (6.0, 2.0), (6.0, 5.0), (2.0, 5.0)]]
    df = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in r]) for k, r in enumerate(rings)] + [(99, None), (98, [{"x": 1.0, "y": 1.0}])], "poly_seq int, ring array<struct<x: double, y: double>>")
    want = {(k, i, j) for k, r in enumerate(rings) for i in range(-2, 23) for j in range(-2, 23) if touches(r, i, j)}
    for how in ({}, {"spread": 4}):
        rows = [(r["poly_seq"], r["i"], r["j"]) for r in labels.touched_cells(df, "ring", **how).collect()]
        assert set(rows) == want and len(rows) == len(want)


def test_later_polygon_wins_and_black_stays(spark):
    box = lambda x, y: [{"x": x + 0.5, "y": y + 0.5}, {"x": x + 1.5, "y": y + 0.5}, {"x": x + 1.5, "y": y + 1.5}, {"x": x + 0.5, "y": y + 1.5}]
    polys = spark.createDataFrame([(1, box(0, 0), 5), (2, box(1, 0), 3)], "poly_seq int, geometry array<struct<x: double, y: double>>, label int")
    got = labels.labelled(pixels(spark, 3, 4), labels.burnt(polys, "geometry", "label", "poly_seq"), F.col("v") == 1)
    at = {(r["i"], r["j"]): r["label"] for r in got.collect()}
    assert at[0, 0] == 5 and at[0, 1] == 0 and at[1, 1] == 3 and at[0, 2] == 3 and at[2, 3] == 1


def test_ladder_admits_strictly_and_falls_back(spark):
    rows = [(1, "a", 0.0), (2, "a", 0.5), (3, "a", 7.0), (4, "b", 19.5), (5, "c", 25.0), (6, "d", None)]
    df = spark.createDataFrame(rows, "image_id long, tile string, cloud_pct double").withColumn("ts", F.lit("2020-01-01").cast("timestamp_ntz"))
    got = {(r["tile"], r["image_id"]): r["rung"] for r in C.cloud_ladder(df, ["tile"], n_min=1).collect()}
    assert got == {("a", 1): 1.0, ("a", 2): 1.0, ("b", 4): 20.0}
    got = {(r["tile"], r["image_id"]): r["rung"] for r in C.cloud_ladder(df, ["tile"], n_min=3).collect()}
    assert got == {("a", 1): 8.0, ("a", 2): 8.0, ("a", 3): 8.0, ("b", 4): 20.0}


def test_footprints_meet_once(spark):
    images = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 100.0), (2, 200.0, 0.0, 300.0, 10.0)], "image_id long, xmin double, ymin double, xmax double, ymax double")
    areas = spark.createDataFrame([(1, -5.0, -5.0, 250.0, 50.0), (2, 100.0, 100.0, 120.0, 120.0), (3, 101.0, 0.0, 102.0, 1.0)], "aoi_id int, a_xmin double, a_ymin double, a_xmax double, a_ymax double")
    got = sorted((r["image_id"], r["aoi_id"]) for r in C.footprint_join(images, areas, 7.0).collect())
    assert got == [(1, 1), (1, 2), (2, 1)]


def test_metrics_of_absent_classes_and_votes(spark):
    seg = spark.createDataFrame([(1, 0, 0, 0, 0), (1, 0, 1, 1, 0), (1, 1, 0, 255, 1)], "cube_id long, r int, c int, label int, pred int")
    m = {r["class"]: r for r in metrics.class_metrics(seg, 3).collect()}
    assert abs(m[2]["iou"] - 1) < 1e-9 and abs(m[0]["iou"] - 0.5) < 1e-5 and m[1]["tp"] == 0
    votes = spark.createDataFrame([(1, 3), (1, 3), (1, 1), (1, 1), (2, -1), (3, None)], "p int, k int")
    assert {r["p"]: r["k"] for r in metrics.vote(votes, ["p"], "k").collect()} == {1: 3, 2: None, 3: None}


def test_blur_is_the_mirrored_convolution(spark):
    rng = np.random.default_rng(0)
    a = rng.random((9, 8))
    df = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(9) for j in range(8)], "i int, j int, v double")
    for k in (3, 4):
        back, forward = k // 2, (k - 1) // 2
        padded = np.pad(a, ((back, forward), (back, forward)), mode="symmetric")
        want = np.array([[padded[i : i + k, j : j + k].mean() for j in range(8)] for i in range(9)])
        got = np.zeros((9, 8))
        for r in metrics.box_blur(df, "v", 9, 8, k).collect():
            got[r["i"], r["j"]] = r["v"]
        assert np.allclose(got, want)


def test_rings_follow_the_carried_sum(spark):
    frames = spark.range(128).select(metrics.ring_zone(F.col("id").cast("int"), 256, 15).alias("z"))
    limits = [r["z"] for r in frames.collect()]
    assert limits[0] == 0 and limits[-1] == 14 and limits == sorted(limits)
    area = [sum(4 * (256 - 2 * k - 1) for k, z in enumerate(limits) if z == zone) for zone in range(15)]
    assert sum(area) == 256 * 256 and max(area) < 2 * 256 * 256 / 15


def test_contrast_of_flat_and_null_values(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, None)], "i int, v double")
    assert [r["stretched"] for r in metrics.contrast_stretch(df, "v").orderBy("i").collect()] == [0.0, 0.0, None]


def test_splits_are_whole_and_repeatable(spark):
    rows = [(k, lab) for k in range(200) for lab in {k % 7, 1}]
    df = spark.createDataFrame(rows, "cube_id long, label int")
    a = splitting.stratified_split(df).collect()
    b = splitting.stratified_split(spark.createDataFrame(rows[::-1], "cube_id long, label int")).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len({r["cube_id"] for r in a}) == len(a) == 200
    assert {s for s in ("train", "val", "test")} == {r["split"] for r in a if r["stratum"] == 2}
    tiny = splitting.ranked_split(spark.range(3).withColumnRenamed("id", "n"), "n").collect()
    assert sorted(r["split"] for r in tiny) == ["test", "train", "val"]
    assert splitting.hashed_split(spark.range(500).withColumnRenamed("id", "n"), "n", {"a": 0.5, "b": 0.5}).groupBy("split").count().count() == 2


def test_scene_prediction_is_the_same_whole_or_tiled(spark):
    df = pixels(spark, 30, 41).withColumns({"b": F.col("v") % 7, "x": F.col("v") % 3})
    model = lambda a: np.stack([a[:, 0], a[:, 1] * 2, np.full(len(a), 3.0)], 1)
    whole = inference.predict_scene(df, ["b", "x"], model, 30, 41, 64)
    tiled = inference.predict_scene(df, ["b", "x"], model, 30, 41, 16, 6, 2)
    known = inference.predict_scene(df, ["b", "x"], model, 30, 41, 16, 6, 2, 3)
    rows = lambda d: sorted((r["i"], r["j"], r["pred"], round(r["best"], 9)) for r in d.collect())
    assert rows(whole) == rows(tiled) == rows(known) and len(rows(whole)) == 30 * 41


def test_tile_models_see_whole_tiles(spark):
    tiled = tiling.overlap_tiles(pixels(spark, 20, 20), 20, 20, 16, 6)
    out = inference.score_tiles(tiled, ["v"], lambda x: np.concatenate([x, -x]), 16)
    assert out.filter("scores[0] <> i * 20 + j OR scores[1] <> -(i * 20 + j)").count() == 0 and out.count() == tiled.count()


def test_masks_join_by_key_and_composites_know_their_bands(spark):
    from rasterweave.functions import bands
    from rasterweave.operators import catalog

    a = spark.createDataFrame([(1, 5), (2, 6)], "image_id int, b8 int")
    m = spark.createDataFrame([(2, 0), (3, 1)], "image_id int, cloudy int")
    assert [tuple(r) for r in catalog.with_masks(a, m, ["image_id"]).collect()] == [(2, 6, 0)]
    with pytest.raises(ValueError):
        catalog.with_masks(a, m.withColumn("b8", F.lit(1)), ["image_id"])
    assert bands.composite(spark.createDataFrame([(1, 2, 3, 4)], "b2 int, b3 int, b4 int, b8 int"), [], ["nir", "rgb"]).columns == ["nir", "red", "green", "blue"]
    with pytest.raises(ValueError):
        bands.composite(a, [], ["uv"])
    images = spark.createDataFrame([(1, None), (2, 20.0), (3, 19.9)], "image_id int, cloud_pct double")
    assert [r["image_id"] for r in catalog.clear_images(images, 20).collect()] == [3]


def test_confidence_of_very_many_pixels(spark):
    """The cube of n - 1 is above a bigint here; t is then the normal quantile."""
    rings = spark.createDataFrame([(0, 40_000_000, 0.9, 0.3), (1, 5_000_000_000, 0.9, 0.3), (2, 1, 1.0, 0.0)], "zone int, n long, accuracy double, std double")
    got = [r["half_width"] for r in metrics.ring_confidence(rings).orderBy("zone").collect()]
    assert got == pytest.approx([metrics.NORMAL_QUANTILE[0.99] * 0.3 / n**0.5 for n in (40_000_000, 5_000_000_000)] + [0.0], rel=1e-6)
