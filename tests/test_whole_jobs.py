"""Queries take every row of their input, on small tables written here."""

from pyspark.sql import functions as F

import __spark_entry__ as entry


def write(spark, folder, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")


def test_label_combine_labels_every_pixel(spark, tmp_path):
    orders = [(k, c) for k, c in ((10, 1), (70 * 50 + 12, 3), (74 * 50 + 12, 3), (4_999, 2), (5_000, 3), (5_010, 7), (600_000, 5))]
    write(spark, tmp_path, "orders", orders, "o_orderkey long, o_custkey long")
    # A rectangle from (10.5, 70.5), w 3, h 3, label 4: columns 10 to 13 of rows 70 to 73.
    write(spark, tmp_path, "part", [(10, 2)], "p_partkey long, p_size int")
    got = {r["i"] * 50 + r["j"]: r["label"] for r in entry.queries()["label_combine"](spark, str(tmp_path)).collect()}
    assert got == {k: 0 if c % 7 == 0 else 4 if k == 70 * 50 + 12 else 1 for k, c in orders}


def test_aoi_footprints_counts_the_images_of_all_times(spark, tmp_path):
    boxes = [(0.0, 0.0), (40_000.0, 90_000.0), (130_000.0, 20_000.0), (500_000.0, 500_000.0)]
    times = ["2019-01-05", "2025-06-10", "2025-07-01", None]
    images = [(n, t, "32TMT", 5.0, x, y, x + 100_000.0, y + 100_000.0) for n, (t, (x, y)) in enumerate((t, b) for t in times for b in boxes)]
    rows = spark.createDataFrame(images, "image_id long, ts string, tile_id string, cloud_pct double, xmin double, ymin double, xmax double, ymax double")
    rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/image_catalog.parquet")
    corners = {1: (10_000.0, 10_000.0), 2: (101_000.0, 95_000.0), 3: (232_600.0, 50_000.0), 4: (900_000.0, 0.0)}
    areas = [(k, [{"x": x, "y": y}, {"x": x + 500, "y": y}, {"x": x, "y": y + 500}]) for k, (x, y) in corners.items()]
    write(spark, tmp_path, "aoi", areas, "aoi_id long, geometry array<struct<x: double, y: double>>")
    want = {}
    for k, (x, y) in corners.items():
        met = [n for n, *_, x0, y0, x1, y1 in images if x0 <= x + 3_060 and x - 2_560 <= x1 and y0 <= y + 3_060 and y - 2_560 <= y1]
        if met:
            want[k] = (len(met), max(met))
    assert want.keys() == {1, 2} and want[2][0] == 8
    assert {r["aoi_id"]: (r["n_images"], r["last_image"]) for r in entry.queries()["aoi_footprints"](spark, str(tmp_path)).collect()} == want


def test_claims_come_from_all_rows_of_a_cube(spark, tmp_path):
    # One row per cube; the label is l_partkey % 7. Cubes 1 and 2 hold nothing but 3 and 6.
    labels = {0: 3, 1: 3, 2: 6, 3: 2, 5: 5}
    rows = [(8 * k, 1, v, 1) for k, v in labels.items()] + [(8 * 5, 2, 3, 1)]
    write(spark, tmp_path, "lineitem", rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    split = {r["cube_id"]: r["stratum"] for r in entry.queries()["stratified_split"](spark, str(tmp_path)).collect()}
    assert split == {0: 3, 1: 3, 2: 0, 3: 2, 5: 3}
    assert {r["cube_id"] for r in entry.queries()["remaining_cubes"](spark, str(tmp_path)).collect()} == {2}


def test_fordead_selection_spans_730_days(spark, tmp_path):
    times = ["2024-07-31", "2024-08-01", "2024-08-21", "2025-12-01", "2026-07-31", "2026-08-01", None]
    images = [(n, t, "32TMT", 5.0, 0.0, 0.0, 100_000.0, 100_000.0) for n, t in enumerate(times)]
    rows = spark.createDataFrame(images, "image_id long, ts string, tile_id string, cloud_pct double, xmin double, ymin double, xmax double, ymax double")
    rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/image_catalog.parquet")
    area = [{"x": 10.0, "y": 10.0}, {"x": 500.0, "y": 10.0}, {"x": 10.0, "y": 500.0}]
    write(spark, tmp_path, "aoi", [(1, "a", area)], "aoi_id long, name string, geometry array<struct<x: double, y: double>>")
    assert [tuple(r) for r in entry.queries()["fordead_selection"](spark, str(tmp_path)).select("aoi_id", "n", "nr").collect()] == [(1, 4, 4)]
