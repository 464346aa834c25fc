import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rasterweave.operators.nearby import edges_of, great_circle_m, in_ring, places_within, points_within, regions_containing
from rasterweave.operators.skew import hot_keys, salted_join

SCHEMA = "id int, x double, y double, extra string"


def pairs(df):
    return sorted((r["id_a"], r["id_b"]) for r in df.collect())


def brute(rows, radius):
    good = [(i, x, y) for i, x, y, _ in rows if i is not None and x is not None and y is not None and math.isfinite(x) and math.isfinite(y)]
    return sorted({(min(a[0], b[0]), max(a[0], b[0])) for a in good for b in good if a[0] != b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= radius**2})


def test_points_match_brute_force_with_negative_coordinates(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(-4000, 4000) / 2, rng.randrange(-4000, 4000) / 2, "e") for i in range(400)]
    assert pairs(points_within(spark.createDataFrame(rows, SCHEMA), "id", "x", "y", 150)) == brute(rows, 150)


def test_radius_is_included_and_equal_places_are_pairs(spark):
    rows = [(1, 0.0, 0.0, None), (2, 800.0, 0.0, None), (3, 800.0, 0.0, None), (4, 1600.5, 0.0, None)]
    assert pairs(points_within(spark.createDataFrame(rows, SCHEMA), "id", "x", "y", 800)) == [(1, 2), (1, 3), (2, 3)]


def test_bad_rows_are_near_nothing(spark):
    rows = [(1, 0.0, 0.0, None), (None, 0.0, 0.0, None), (2, None, 0.0, None), (3, float("nan"), 0.0, None), (4, float("inf"), 0.0, None), (5, 1.0, 1.0, None)]
    assert pairs(points_within(spark.createDataFrame(rows, SCHEMA), "id", "x", "y", 10)) == [(1, 5)]
    assert pairs(points_within(spark.createDataFrame([], SCHEMA), "id", "x", "y", 10)) == []


def test_a_hot_cell_is_split_without_losing_pairs(spark):
    rng = random.Random(2)
    rows = [(i, rng.random() * 10, rng.random() * 10, None) for i in range(300)] + [(1000 + i, rng.random() * 500, rng.random() * 500, None) for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert pairs(points_within(df, "id", "x", "y", 20, rows_per_task=40)) == brute(rows, 20)


def test_within_compares_equal_groups_only(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, "a"), (2, 1.0, 0.0, "a"), (3, 0.0, 1.0, "b"), (4, 0.0, 1.0, None)], SCHEMA)
    got = points_within(df, "id", "x", "y", 5, within=["extra"]).collect()
    assert [(r["id_a"], r["id_b"], r["extra"]) for r in got] == [(1, 2, "a")]


def test_places_at_the_date_line_and_the_pole(spark):
    rows = [(1, 10.0, 179.999), (2, 10.0, -179.999), (3, 89.9995, 0.0), (4, 89.9995, 180.0), (5, 0.0, 0.0)]
    got = pairs(places_within(spark.createDataFrame(rows, "id int, lat double, lon double"), "id", "lat", "lon", 300))
    assert got == [(1, 2), (3, 4)]


def test_places_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, 45 + rng.random() * 0.2, 5 + rng.random() * 0.2) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, lat double, lon double")
    both = df.alias("a").join(df.alias("b"), F.col("a.id") < F.col("b.id"))
    want = both.filter(great_circle_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) <= 900).select("a.id", "b.id").collect()
    assert pairs(places_within(df, "id", "lat", "lon", 900)) == sorted(tuple(r) for r in want)


RINGS = {
    "square": [(0, 0), (10, 0), (10, 10), (0, 10)],
    "closed": [(20, 0), (30, 0), (30, 10), (20, 10), (20, 0)],
    "clockwise": [(0, 20), (0, 30), (10, 30), (10, 20)],
    "notch": [(40, 0), (60, 0), (60, 20), (50, 5), (40, 20)],
}


def test_regions_borders_notches_and_overlaps(spark):
    regions = [(n, [{"x": float(x), "y": float(y)} for x, y in r]) for n, r in RINGS.items()] + [("square", [{"x": float(x), "y": float(y)} for x, y in RINGS["square"]]), ("line", [{"x": 0.0, "y": 0.0}, {"x": 9.0, "y": 9.0}]), (None, None), ("none", None)]
    r = spark.createDataFrame(regions, "name string, ring array<struct<x: double, y: double>>")
    points = [(1, 0.0, 0.0), (2, 10.0, 5.0), (3, 25.0, 10.0), (4, 5.0, 25.0), (5, 50.0, 10.0), (6, 50.0, 5.0), (7, 45.0, 10.0), (8, 100.0, 100.0), (9, None, 1.0), (10, float("nan"), 1.0)]
    p = spark.createDataFrame(points, "id int, x double, y double")
    got = sorted((r_["id"], r_["name"]) for r_ in regions_containing(p, "x", "y", r, "name", "ring", cell=7.0, spread="id", rows_per_task=1).collect())
    assert got == [(1, "square"), (2, "square"), (3, "closed"), (4, "clockwise"), (6, "notch"), (7, "notch")]


def test_columns_of_points_never_clash(spark):
    r = spark.createDataFrame([("r", [{"x": 0.0, "y": 0.0}, {"x": 9.0, "y": 0.0}, {"x": 9.0, "y": 9.0}])], "name string, ring array<struct<x: double, y: double>>")
    p = spark.createDataFrame([(1, 5.0, 1.0, "old", 1, "e", "k")], "id int, x double, y double, name string, _cx int, _edges string, _p string")
    got = regions_containing(p, "x", "y", r, "name", "ring", cell=2.0, spread="id").collect()
    assert [(g["id"], g["name"], g["_cx"], g["_edges"], g["_p"]) for g in got] == [(1, "r", 1, "e", "k")]


def test_in_ring_does_not_depend_on_the_direction(spark):
    rng = random.Random(5)
    ring = [(rng.randrange(20), rng.randrange(20)) for _ in range(7)]
    grid = spark.createDataFrame([(float(x), float(y)) for x in range(-1, 21) for y in range(-1, 21)], "x double, y double")
    inside = []
    for r in (ring, ring[::-1], ring[3:] + ring[:3]):
        arr = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in r])
        inside.append(sorted(tuple(v) for v in grid.filter(in_ring(edges_of(arr), F.col("x"), F.col("y"))).collect()))
    assert inside[0] == inside[1] == inside[2]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_the_plain_join(spark, how):
    many = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(200)] + [(999, None)], "id int, k string")
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), (None, 4)], "k string, v int")
    want = sorted(map(repr, many.join(few, ["k"], how).select("id", "k", "v").collect()))
    assert sorted(map(repr, salted_join(many, few, ["k"], F.col("id"), rows_per_task=10, how=how).select("id", "k", "v").collect())) == want


@pytest.mark.parametrize(("a", "b"), [(3, 500), (500, 3), (300, 300)])
def test_a_key_that_is_hot_on_either_side_is_cut_on_that_side(spark, a, b):
    many = spark.createDataFrame([(i, "hot") for i in range(a)] + [(900 + i, f"k{i}") for i in range(9)], "id int, k string")
    few = spark.createDataFrame([(i, "hot") for i in range(b)] + [(700 + i, f"k{i % 5}") for i in range(9)], "v int, k string")
    hot, n = hot_keys(many, few, ["k"], 50)
    assert n == 1 and [(r["_mp"], r["_fp"]) for r in hot.collect()] == [(-(-a // 50), -(-b // 50))]
    want = Counter(map(repr, many.join(few, ["k"]).select("id", "k", "v").collect()))
    assert Counter(map(repr, salted_join(many, few, ["k"], F.col("id"), rows_per_task=50, few_spread=F.col("v")).select("id", "k", "v").collect())) == want


def test_the_number_of_hot_keys_is_bounded(spark):
    df = spark.range(1000).selectExpr("id", "id % 100 AS k")
    assert hot_keys(df, df, ["k"], 5)[1] == 100 and hot_keys(df, df, ["k"], 3, max_keys=50)[1] == 0
    skewed = df.unionByName(spark.range(500).selectExpr("id", "7L AS k"))
    hot, n = hot_keys(skewed, df, ["k"], 5, max_keys=10)
    assert n == 1 and hot.first()["_mp"] == 51
    with pytest.raises(ValueError):
        salted_join(df, df, ["k"], F.col("id"), how="left", few_spread=F.col("id"))


def test_points_on_and_around_the_borders_of_cells(spark):
    """All pairs of a lattice whose points lie on borders and corners, at exactly the radius."""
    rows = [(100 * i + j, 20.0 * i - 90, 20.0 * j - 70, None) for i in range(10) for j in range(9)]
    for radius in (20, 40, 28.284271247461902):
        assert pairs(points_within(spark.createDataFrame(rows, SCHEMA), "id", "x", "y", radius)) == brute(rows, radius)
    assert pairs(points_within(spark.createDataFrame([*rows, (1, -70.0, -70.0, None)], SCHEMA), "id", "x", "y", 0)) == [(1, 100)]


def test_carried_columns_follow_their_ends(spark):
    df = spark.createDataFrame([(7, 0.0, 0.0, "seven"), (2, 39.0, 0.0, "two"), (5, 41.0, 0.0, "five")], SCHEMA)
    got = {(r["id_a"], r["id_b"], r["extra_a"], r["extra_b"]) for r in points_within(df, "id", "x", "y", 40, carry=["extra"]).collect()}
    assert got == {(2, 7, "two", "seven"), (2, 5, "two", "five")}


def test_a_hot_place_among_regions_and_many_regions_in_a_cell(spark):
    ring = [{"x": 0.0, "y": 0.0}, {"x": 9.0, "y": 0.0}, {"x": 9.0, "y": 9.0}, {"x": 0.0, "y": 9.0}]
    r = spark.createDataFrame([(f"r{k}", ring) for k in range(60)], "name string, ring array<struct<x: double, y: double>>")
    p = spark.createDataFrame([(k, 5.0, 1.0) for k in range(80)], "id int, x double, y double")
    got = Counter((g["id"], g["name"]) for g in regions_containing(p, "x", "y", r, "name", "ring", cell=20.0, spread="id", rows_per_task=25).collect())
    assert len(got) == 4800 and set(got.values()) == {1}


def test_regions_of_any_size_have_few_cells(spark):
    """Squares of side 2 to 3,000,000,000 over cells of side 1: a region of n cells each way would have n * n rows."""
    square = lambda a, b: [{"x": float(x), "y": float(y)} for x, y in ((a, a), (b, a), (b, b), (a, b))]
    sides = (2, 9, 50, 3_000, 3_000_000_000)
    r = spark.createDataFrame([(n, square(-n / 2, n / 2)) for n in sides] + [(0, square(7, 9))], "name long, ring array<struct<x: double, y: double>>")
    points = [(k, x) for k, x in enumerate((0.0, 1.0, 4.5, 8.0, 25.0, 25.5, 1500.0, 1501.0, 1.5e9, 1.5e9 + 1))]
    p = spark.createDataFrame([(k, x, x) for k, x in points], "id int, x double, y double")
    found = regions_containing(p, "x", "y", r, "name", "ring", cell=1.0, spread="id")
    want = sorted((k, n) for k, x in points for n, lo, hi in [(n, -n / 2, n / 2) for n in sides] + [(0, 7, 9)] if lo <= x <= hi)
    assert sorted((v["id"], v["name"]) for v in found.collect()) == want
