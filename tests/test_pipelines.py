import datetime as dt

import numpy as np
import pytest

from rasterweave import cli
from rasterweave.functions.bands import BANDS
from rasterweave.plans import pipelines
from rasterweave.sources.files import chunk_pixels, read_rasters
from rasterweave.sources.params import FordeadRequest, PredictionRequest, TrainingRequest
from rasterweave.sources.transfer import copy_files

BOX = "image_id long, ts timestamp_ntz, tile_id string, cloud_pct double, xmin double, ymin double, xmax double, ymax double"
AOI = "aoi_id int, name string, geometry array<struct<x: double, y: double>>"
NAMES = [b.lower() for b in BANDS]


def images(spark):
    day = lambda d: dt.datetime(2024, 5, d, 10)
    rows = [(1, day(1), "A", 3.0), (2, day(5), "A", 9.0), (3, day(5), "B", 1.0), (4, day(9), "B", 50.0), (5, None, "A", 0.0), (6, day(5), "A", None)]
    return spark.createDataFrame([(*r, 0.0, 0.0, 100.0, 100.0) for r in rows], BOX)


def areas(spark):
    return spark.createDataFrame([(1, "in", [{"x": 50.0, "y": 50.0}]), (2, None, [{"x": 500.0, "y": 50.0}]), (3, " ", None)], AOI)


def test_selections(spark, tmp_path):
    src = str(tmp_path)
    got = pipelines.select_for_training(images(spark), areas(spark), TrainingRequest(src, 1, "2024-05-01", "2024-05-08")).collect()
    assert sorted((r["aoi_id"], r["tile_id"], r["image_id"], r["rung"]) for r in got) == [(1, "A", 1, 4.0), (1, "B", 3, 2.0)]
    got = pipelines.select_for_prediction(images(spark), areas(spark), PredictionRequest(src, 401, "2024-05-05", 5)).collect()
    assert sorted((r["label"], r["tile_id"], r["image_id"]) for r in got) == [("aoi_2", "A", 6), ("aoi_2", "B", 3), ("in", "A", 6), ("in", "B", 3)]
    got = pipelines.select_for_fordead(images(spark), areas(spark), FordeadRequest(src, 1, "2024-05-01", 5)).collect()
    assert sorted((r["image_id"], r["nr"]) for r in got) == [(1, 1), (2, 2), (3, 1), (6, 3)]


def test_labelize_then_cubes(spark):
    pixels = spark.createDataFrame([(i, j, *[0 if (i, j) == (0, 0) else 100 + k for k in range(11)]) for i in range(8) for j in range(12)], "i int, j int, " + ", ".join(f"{b} int" for b in NAMES))
    box = lambda x0, y0, x1, y1: [{"x": x, "y": y} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
    notes = spark.createDataFrame([(1, box(0.5, 0.5, 2.5, 2.5), 2020, "FPZ", " c"), (2, box(1.5, 1.5, 1.6, 1.6), 2020, "FPZ", "A"), (3, box(5.5, 5.5, 5.6, 5.6), 2021, "FPZ", "A"), (4, box(6.5, 6.5, 6.6, 6.6), 2020, "FPZ", "?")], "poly_seq int, geometry array<struct<x: double, y: double>>, capture_year int, pest_species_code string, pest_severity_code string")
    out = pipelines.labelize(pixels, notes, 2020, 4, ["FPZ"], {"A": 0, "C": 2})
    at = {(r["i"], r["j"]): r["label"] for r in out.collect()}
    assert (at[0, 0], at[1, 1], at[2, 2], at[5, 5], at[6, 6]) == (0, 2, 4, 1, 1)
    cubes = pipelines.training_cubes(out, 8, 12, size=4)
    assert cubes.select("cube_id").distinct().count() == 6 and cubes.groupBy("cube_id").agg({"split": "max"}).count() == 6


def test_prepared_pixels_have_all_channels(spark):
    pixels = spark.createDataFrame([(1, 0, 4, *[1000] * 11), (1, 1, 8, *[1000] * 11), (2, 0, 4, *[1000] * 11)], "image_id long, i int, scl int, " + ", ".join(f"{b} int" for b in NAMES))
    out = pipelines.prepared_pixels(pixels, spark.createDataFrame([(1,)], "image_id long"), ["image_id", "i"])
    rows = {r["i"]: r for r in out.collect()}
    assert len(out.columns) == 3 + 24 and rows[1]["ndvi"] is None and rows[1]["cloud"] == 1 and rows[0]["b8a_norm"] == 0.0


def test_both_ways_of_clustering_find_the_dying_pixel(spark):
    day = dt.date(2022, 1, 1)
    rows = [(i, j, t, 0, 0.9 if (i, j) == (4, 4) and t > 2 else 0.1 + 0.001 * ((i * 7 + j + t) % 5), day + dt.timedelta(days=10 * t)) for i in range(12) for j in range(12) for t in range(8)]
    series = spark.createDataFrame(rows, "i int, j int, t int, c int, v double, date date")
    assert pipelines.detect_dieback(series, "2022-03-20", method="graph", resolution=0.01).count() <= 1
    pipelines.detect_dieback(series, "2022-03-20").collect()
    with pytest.raises(ValueError):
        pipelines.detect_dieback(series, "2022-03-20", method="other")


def test_segment_gives_regions(spark):
    pixels = spark.createDataFrame([(i, j, *[float(j >= 4)] * 24) for i in range(6) for j in range(8)], "i int, j int, " + ", ".join([f"{b}_norm double" for b in NAMES] + [f"{n} double" for n in ("ndwi", "dwsi", "ngrdi", "rdi", "gli", "ndre2", "pbi", "ndvi", "gndvi", "cig", "cvi", "ndre3", "drs")]))
    out = pipelines.segment(pixels, lambda x: np.stack([1 - x[:, 0], x[:, 0]], 1), 6, 8)
    assert {(r["pred"], r["region"]): r["count"] for r in out.groupBy("pred", "region").count().collect()} == {(0, 0): 24, (1, 4): 24}


def test_display_values(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.arange(4 * 6 * 10, dtype=float).reshape(4, 6, 10))
    out = pipelines.display_values(chunk_pixels(read_rasters(spark, str(tmp_path))), "rgb", 5)
    assert out.count() == 3 * 3 * 5 and {r["color"] for r in out.collect()} == {"red", "green", "blue"}
    assert out.filter("stretched < 0 OR stretched > 1").count() == 0


def test_copying_keeps_places_and_filters(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for n in ("a/x.tif", "a/b/y.TIF", "a/b/z.txt"):
        (tmp_path / n).write_text(n)
    copy_files(spark, str(tmp_path / "a"), str(tmp_path / "out"), ["tif"])
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file() and p.suffix != ".crc") == ["b/y.TIF", "x.tif"]
    copy_files(spark, str(tmp_path / "a" / "x.tif"), str(tmp_path / "one"))
    assert (tmp_path / "one" / "x.tif").read_text() == "a/x.tif"
    with pytest.raises(FileNotFoundError):
        copy_files(spark, str(tmp_path / "none"), str(tmp_path / "o"))


def test_commands_end_to_end(spark, tmp_path):
    images(spark).write.parquet(str(tmp_path / "cat"))
    areas(spark).write.parquet(str(tmp_path / "aoi"))
    cli.run(spark, ["load-data", "S2-train", "-s", str(tmp_path / "aoi"), "-d", str(tmp_path / "o1"), "--start-date", "2024-05-01", "--end-date", "2024-05-08", "--custom-buffer", "1", "--catalog", str(tmp_path / "cat")])
    assert {r["image_id"] for r in spark.read.parquet(str(tmp_path / "o1")).collect()} == {1, 3}
    pixels = spark.createDataFrame([(i, j, *[i * j] * 11) for i in range(9) for j in range(9)], "i int, j int, " + ", ".join(f"{b} int" for b in NAMES))
    pixels.write.parquet(str(tmp_path / "px"))
    cli.run(spark, ["preprocess-data", "cubify", "-s", str(tmp_path / "px"), "-d", str(tmp_path / "o2"), "-c", "4"])
    cubes = spark.read.parquet(str(tmp_path / "o2" / "cubes"))
    assert cubes.count() == 64
    cubes.withColumnRenamed("cube_no", "cube_id").write.parquet(str(tmp_path / "c.parquet"))
    cli.run(spark, ["preprocess-data", "filter", "-s", str(tmp_path / "c.parquet"), "-d", str(tmp_path / "o3"), "-t", "0.2"])
    assert spark.read.parquet(str(tmp_path / "o3")).select("cube_id").distinct().count() == 1
    cli.run(spark, ["visualize", "h5-cubes", "-s", str(tmp_path / "c.parquet"), "-d", str(tmp_path / "o4")])
    assert spark.read.parquet(str(tmp_path / "o4")).filter("page IS NULL").count() == 0


PIXELS = "image_id long, i int, j int, scl int, " + ", ".join(f"{b} int" for b in NAMES)


def test_acquisition_judges_pixels_and_writes_channels_in_its_layout(spark, tmp_path):
    t = lambda day: f"2024-05-0{day} 10:00:00"
    rows = [(k, t(k), tile, 1.0, 0.0, 0.0, 10.0, 10.0) for k, tile in ((1, "A"), (2, "A"), (3, "B"))]
    spark.createDataFrame(rows, "image_id long, ts string, tile_id string, cloud_pct double, xmin double, ymin double, xmax double, ymax double").selectExpr("image_id", "cast(ts as timestamp_ntz) ts", "tile_id", "cloud_pct", "xmin", "ymin", "xmax", "ymax").write.parquet(str(tmp_path / "cat"))
    areas(spark).write.parquet(str(tmp_path / "aoi"))
    # Image 2 is under clouds, so it is dark once masked.
    spark.createDataFrame([(k, i, i, 9 if k == 2 else 4, *[900] * 11) for k in (1, 2, 3) for i in range(3)], PIXELS).write.parquet(str(tmp_path / "px"))
    common = ["-s", str(tmp_path / "aoi"), "--catalog", str(tmp_path / "cat"), "--before-date"]
    cli.run(spark, ["load-data", "S2-predict", *common, "2024-05-04", "-d", str(tmp_path / "p1")])
    assert {r["image_id"] for r in spark.read.parquet(str(tmp_path / "p1")).collect()} == {2, 3}
    cli.run(spark, ["load-data", "S2-predict", *common, "2024-05-04", "-d", str(tmp_path / "p2"), "-f", "--pixels", str(tmp_path / "px")])
    out = spark.read.parquet(str(tmp_path / "p2"))
    assert {r["image_id"] for r in out.collect()} == {1, 3} and {"aoi", "tile_id", "date", "b1_norm", "ndvi", "cloud"} <= set(out.columns)
    assert {p.name.split("=")[0] for p in (tmp_path / "p2").iterdir() if p.is_dir()} == {"aoi"}
    cli.run(spark, ["load-data", "S2-fordead", *common, "2024-05-01", "-d", str(tmp_path / "p3"), "-f", "-t", "0.5", "--pixels", str(tmp_path / "px")])
    long = spark.read.parquet(str(tmp_path / "p3"))
    assert {r["image_id"] for r in long.collect()} == {1, 3} and long.select("band").distinct().count() == 11
    with pytest.raises(ValueError):
        cli.run(spark, ["load-data", "S2-predict", *common, "2024-05-04", "-d", str(tmp_path / "p4"), "-f"])
    with pytest.raises(ValueError):
        cli.run(spark, ["load-data", "S2-train", "-s", str(tmp_path / "aoi"), "--catalog", str(tmp_path / "cat"), "--start-date", "2024-05-01", "--end-date", "2024-05-08", "-d", str(tmp_path / "p5"), "--saving-location", "gcs"])


def test_two_images_get_their_own_annotations_and_cubes(spark, tmp_path):
    ring = lambda x, y: [{"x": x, "y": y}, {"x": x + 15.0, "y": y}, {"x": x + 15.0, "y": y - 15.0}, {"x": x, "y": y - 15.0}]
    rows = [(1, ring(1002.0, 1998.0), 2020, "IBM", "B", "FI"), (2, ring(3012.0, 1988.0), 2020, "IBM", "C", "FI"), (3, ring(1002.0, 1998.0), 2019, "IBM", "B", "FI")]
    spark.createDataFrame(rows, "poly_seq int, geometry array<struct<x: double, y: double>>, capture_year int, pest_species_code string, pest_severity_code string, tree_species_code string").write.parquet(str(tmp_path / "gdf"))
    spark.createDataFrame([(4, "B", 0), (4, "C", 1), (2, "B", 0), (2, "C", 1)], "n_steps int, severity string, step int").write.parquet(str(tmp_path / "sev"))
    spark.createDataFrame([("fi", "ibm", 3)], "tree string, pest string, combo int").write.parquet(str(tmp_path / "combo"))
    spark.createDataFrame([(7, 1000.0, 2000.0, 10.0, 4, 4), (8, 3000.0, 2000.0, 10.0, 4, 6)], "image_id long, x0 double, y0 double, pixel double, height int, width int").write.parquet(str(tmp_path / "frames"))
    spark.createDataFrame([(k, i, j, 4, *[900] * 11) for k, w in ((7, 4), (8, 6)) for i in range(4) for j in range(w)], PIXELS).write.parquet(str(tmp_path / "px"))
    common = ["preprocess-data", "labelize", "-s", str(tmp_path / "px"), "-g", str(tmp_path / "gdf"), "-y", "2020", "--severity-map", str(tmp_path / "sev")]
    with pytest.raises(ValueError):
        cli.run(spark, [*common, "-n", "4", "-d", str(tmp_path / "l0")])
    cli.run(spark, [*common, "-n", "4", "-d", str(tmp_path / "l1"), "--frames", str(tmp_path / "frames")])
    got = {(r["image_id"], r["i"], r["j"]): r["label"] for r in spark.read.parquet(str(tmp_path / "l1")).collect()}
    assert {k for k, v in got.items() if v != 1} == {(7, i, j) for i in (0, 1) for j in (0, 1)} | {(8, i, j) for i in (1, 2) for j in (1, 2)}
    assert got[7, 0, 0] == 2 and got[8, 1, 1] == 3 and len(got) == 40
    cli.run(spark, [*common, "-n", "120", "-d", str(tmp_path / "l2"), "--frames", str(tmp_path / "frames"), "--combinations", str(tmp_path / "combo")])
    codes = {(r["image_id"], r["label"]) for r in spark.read.parquet(str(tmp_path / "l2")).collect()}
    assert codes == {(7, 1), (8, 1), (7, 2 + 2 + 3 * 2 + 0), (8, 2 + 2 + 3 * 2 + 1)}
    cli.run(spark, ["preprocess-data", "cubify", "-s", str(tmp_path / "l1"), "-d", str(tmp_path / "c"), "-c", "2"])
    cubes = spark.read.parquet(str(tmp_path / "c" / "cubes"))
    assert cubes.count() == 40 and cubes.select("cube_id").distinct().count() == 10 and cubes.select("cube_id", "r", "c").distinct().count() == 40
    cli.run(spark, ["preprocess-data", "filter", "-s", str(tmp_path / "c" / "cubes"), "-d", str(tmp_path / "f"), "--delete-original"])
    assert spark.read.parquet(str(tmp_path / "f")).count() == 40 and not (tmp_path / "c" / "cubes").exists()


def test_clipping_by_polygon_and_by_buffer(spark):
    p = spark.createDataFrame([(1, 1.0, 1.0), (1, 9.0, 1.0), (2, 50.0, 50.0), (2, None, 1.0)], "image_id long, x double, y double")
    a = spark.createDataFrame([(1, [{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 10.0}, {"x": 0.0, "y": 10.0}]), (2, [{"x": 52.0, "y": 49.0}]), (3, None)], "aoi_id int, geometry array<struct<x: double, y: double>>")
    assert [(r["x"], r["aoi_id"]) for r in pipelines.clip(p, a, "x", "y").collect()] == [(1.0, 1)]
    assert sorted((r["x"], r["aoi_id"]) for r in pipelines.clip(p, a, "x", "y", 3).collect()) == [(1.0, 1), (9.0, 1), (50.0, 2)]
