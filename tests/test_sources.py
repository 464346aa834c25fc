import json
import struct

import numpy as np
import pytest

from rasterweave import cli
from rasterweave.operators import pixel_graph
from rasterweave.sources import files, params


def test_listing_is_sorted_filtered_and_strict(spark, tmp_path):
    for n in ("b.npy", "a.npy", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.npy").write_bytes(b"x")
    names = lambda **k: [r["path"].rsplit("/", 1)[1] for r in files.list_files(spark, str(tmp_path), ".npy", **k).collect()]
    assert names() == ["a.npy", "b.npy"] and names(recursive=True) == ["a.npy", "b.npy", "d.npy"]
    with pytest.raises(NotADirectoryError):
        files.list_files(spark, str(tmp_path / "none"))


def test_arrays_come_back_whole(spark, tmp_path):
    a = np.arange(2 * 5 * 7, dtype=float).reshape(2, 5, 7)
    a[0, 0, 0] = np.nan
    np.save(tmp_path / "x.npy", a)
    back = np.zeros_like(a)
    for r in files.chunk_pixels(files.read_rasters(spark, str(tmp_path), chunk=3)).collect():
        back[r["channel"], r["i"], r["j"]] = np.nan if r["v"] is None else r["v"]
    assert np.array_equal(a, back, equal_nan=True)
    for bad in (".pkl", ".jpg"):
        with pytest.raises(ValueError):
            files.read_rasters(spark, str(tmp_path), bad)
    with pytest.raises(ValueError):
        files.read_cubes(spark, "x.pkl")


def test_dated_series_masks_black_and_scales(spark, tmp_path):
    for k, day in enumerate(("2022-01-16", "2022-01-01")):
        a = np.full((3, 2, 2), 51.0 * (k + 1))
        a[:, 0, 0] = 0
        np.save(tmp_path / f"{day}_x.npy", a)
    rows = files.read_series(spark, str(tmp_path), n_bands=2).collect()
    assert len(rows) == 2 * 3 * 4
    assert {(r["t"], r["i"], r["j"]): r["v"] for r in rows if r["c"] == 2} == {(t, i, j): None if (i, j) == (0, 0) else v for t, v in ((0, 0.4), (1, 0.2)) for i in range(2) for j in range(2)}


def test_geojson_polygons_and_points_only(spark, tmp_path):
    f = lambda g: {"type": "Feature", "geometry": g, "properties": {"Name": "n"}}
    ok = [f({"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]], [[9, 9]]]}), f({"type": "Point", "coordinates": [3, 4]})]
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": ok}))
    rows = files.read_geojson(spark, str(tmp_path / "a.json")).collect()
    assert [len(r["geometry"]) for r in rows] == [3, 1] and rows[1]["geometry"][0]["y"] == 4.0 and rows[0]["properties"]["Name"] == "n"
    (tmp_path / "b.json").write_text(json.dumps({"features": [f({"type": "LineString", "coordinates": [[0, 0]]})]}))
    with pytest.raises(Exception, match="unsupported geometry"):
        files.read_geojson(spark, str(tmp_path / "b.json")).collect()


def test_destinations():
    assert files.destination("/a/b/x.tif", "/out/y.npy") == "/out/y.npy"
    assert files.destination("/a/b/x.tif", "/out", ".npy") == "/out/x.npy"
    assert files.destination("/a/b/c/x.tif", "/out", root="/a/b") == "/out/c/x.tif"


def test_layout_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("t1", "2020-01-01", "b1", 5), ("t2", "2020-01-01", "b2", 6)], "tile_id string, date string, band string, v int")
    files.save(df, str(tmp_path / "o"), "fordead")
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "o")).filter("band = 'b2'").collect()) == [6]
    for bad in (("fordead", "ftp"), ("other", "local")):
        with pytest.raises(ValueError):
            files.save(df, str(tmp_path / "p"), *bad)


def test_requests_are_checked(tmp_path):
    r = params.TrainingRequest(str(tmp_path), "-50", "2020-01-01", "2020-02-01", -20)
    assert (r.buffer_m, r.max_cloud) == (50, 20)
    for bad in (("2020-13-01", "2020-02-01"), ("2020-03-01", "2020-02-01"), ("2020-01-01x", "2020-02-01")):
        with pytest.raises(ValueError):
            params.TrainingRequest(str(tmp_path), 1, *bad)
    with pytest.raises(FileNotFoundError):
        params.PredictionRequest(str(tmp_path / "none"), 1, "2020-01-01")
    with pytest.raises(ValueError):
        params.FordeadRequest(str(tmp_path), 1, "2020-01-01", threshold=2)


def test_command_line_defaults():
    a = cli.parser().parse_args(["load-data", "S2-fordead", "-s", "x", "-d", "y", "--before-date", "2020-01-01", "--catalog", "c"])
    assert (a.date_diff_in_days, a.buffer, a.threshold, a.filter) == (730, 2560, 0.4, False)
    a = cli.parser().parse_args(["preprocess-data", "filter", "-s", "x", "-d", "y"])
    assert a.threshold == 0.8
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["load-data"])


def test_npy_is_written_by_scene_and_read_back(spark, tmp_path):
    rows = [("a b", c, i, j, None if (i, j) == (1, 1) else float(10 * i + j + c)) for c in range(2) for i in range(3) for j in range(4)] + [("z", 0, 0, 0, 5.0)]
    df = spark.createDataFrame(rows, "scene string, channel int, i int, j int, v double")
    assert [p.rsplit("/", 1)[1] for p in files.write_npy(df, str(tmp_path / "o"), "scene")] == ["a_b.npy", "z.npy"]
    back = files.chunk_pixels(files.read_rasters(spark, str(tmp_path / "o"), chunk=2)).filter("path LIKE '%a_b.npy'")
    assert {(r["channel"], r["i"], r["j"]): r["v"] for r in back.collect()} == {r[1:4]: r[4] for r in rows[:-1]}
    files.write_npy(df, str(tmp_path / "u"), "scene", dtype="uint8")
    assert np.load(tmp_path / "u" / "a_b.npy").dtype == np.uint8
    assert files.write_npy(df.limit(0), str(tmp_path / "e"), "scene") == []


def shp(shapes):
    """A main file from (type, body) pairs."""
    body = b"".join(struct.pack(">ii", k + 1, (4 + len(b)) // 2) + struct.pack("<i", t) + b for k, (t, b) in enumerate(shapes))
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8) + body


def polygon(*rings):
    points = [p for r in rings for p in r]
    starts = [sum(map(len, rings[:k])) for k in range(len(rings))]
    return struct.pack("<4d", 0, 0, 0, 0) + struct.pack("<2i", len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)


def test_shapefiles_with_holes_parts_points_and_attributes(spark, tmp_path):
    outer, hole, island = [(0, 0), (0, 9), (9, 9), (9, 0), (0, 0)], [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)], [(20, 0), (20, 5), (25, 5), (25, 0), (20, 0)]
    (tmp_path / "a.shp").write_bytes(shp([(5, polygon(outer, hole, island)), (1, struct.pack("<2d", 3, 4)), (0, b"")]))
    head = struct.pack("<BBBBIHH20x", 3, 0, 0, 0, 3, 32 + 32 + 1, 1 + 6) + b"code".ljust(11, b"\0") + b"C" + bytes(4) + bytes([6, 0]) + bytes(14) + b"\r"
    (tmp_path / "a.dbf").write_bytes(head + b" IBM   " + b" x     " + b"       ")
    rows = files.read_shapefile(spark, str(tmp_path)).collect()
    got = [(r["number"], r["kind"], len(r["geometry"] or []), [len(h) for h in r["holes"]], r["properties"]["code"]) for r in rows]
    assert got == [(1, "Polygon", 5, [5], "IBM"), (1, "Polygon", 5, [], "IBM"), (2, "Point", 1, [], "x"), (3, "Null", 0, [], None)]
    assert files.read_shapefile(spark, str(tmp_path / "a.shp")).filter("kind = 'Point'").first()["geometry"][0]["y"] == 4.0
    (tmp_path / "b.shp").write_bytes(shp([(3, polygon(outer))]))
    with pytest.raises(Exception, match="unsupported shape type"):
        files.read_shapefile(spark, str(tmp_path / "b.shp")).collect()


def test_polygons_are_written_with_their_holes_and_read_back(spark, tmp_path):
    cells = [(i, j, 1) for i in range(5) for j in range(5) if (i, j) not in ((1, 1), (2, 2), (3, 3))] + [(9, 9, 2)]
    found = pixel_graph.regions(spark.createDataFrame(cells, "i int, j int, k int"), "k")
    polygons = pixel_graph.region_polygons(found)
    got = {r["region"]: [len(x) for x in r["rings"]] for r in polygons.collect()}
    # The three holes meet in corners: one hole of the eight-neighbourhood.
    assert got == {0: [5, 13], 9 * 2**32 + 9: [5]}
    files.write_geojson(polygons, str(tmp_path / "g"), "rings", ["region"])
    text = "".join(f'{{"features": [{line}]}}\n' for p in (tmp_path / "g").glob("part*") for line in p.read_text().splitlines())
    (tmp_path / "c.json").write_text(text)
    back = files.read_geojson(spark, str(tmp_path / "c.json"), lines=True).collect()
    assert {(r["properties"]["region"], len(r["geometry"]), len(r["holes"])) for r in back} == {("0", 5, 1), (str(9 * 2**32 + 9), 5, 0)}


def test_metric_log_and_description(spark, tmp_path):
    for step in (1, 2):
        files.log_metrics(spark.createDataFrame([("a", 0.5 * step, 3)], "class string, iou double, n int"), str(tmp_path / "log"), "run", step)
    got = {(r["step"], r["name"], r["labels"]["class"]): r["value"] for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert got == {(1, "iou", "a"): 0.5, (2, "iou", "a"): 1.0, (1, "n", "a"): 3.0, (2, "n", "a"): 3.0}
    files.describe(spark, str(tmp_path / "d"), size=3)
    assert spark.read.text(str(tmp_path / "d")).first()[0] == '{"size": 3}'
