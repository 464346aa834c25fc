"""Queries of the two general data operators over the catalog tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.functions.tiles import one_row_per_id, standard_tile
from rasterweave.operators.nearby import EARTH_RADIUS_M, finite, places_within, points_within, regions_containing
from rasterweave.operators.regular_grid import regular_grid

#: A reading is carried over at most so many periods of five days.
MAX_GAP = 3
FIVE_DAYS_S = 5 * 86400
RADIUS_M, REGION_CELL_M = 800.0, 50_000.0


def _grid(spark: SparkSession, d: str, images: DataFrame, values: list[str]) -> DataFrame:
    readings = images.withColumn("tile_id", standard_tile(F.col("tile_id")))
    return regular_grid(readings, "tile_id", "ts", values, origin="2016-01-01", width_s=FIVE_DAYS_S, start="2016-01-01", end="2026-01-01", max_gap=MAX_GAP)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    # n_readings isn't asked for here, so rows delivered twice needn't be made single first.
    images = spark.read.parquet(f"{d}/image_catalog.parquet").select("tile_id", "ts")
    return _grid(spark, d, images, []).filter(F.col("n_readings") == 0).select("tile_id", "period_no")


def p1_grid(spark: SparkSession, d: str) -> DataFrame:
    images = one_row_per_id(spark.read.parquet(f"{d}/image_catalog.parquet"), "image_id", "ts", "tile_id", "cloud_pct")
    return _grid(spark, d, images, ["image_id", "cloud_pct"])


def _locations(spark: SparkSession, d: str) -> DataFrame:
    """One row per aoi that is a single location, whatever its kind says; rows delivered twice go as narrow ones."""
    at = F.col("geometry")[0]
    points = spark.read.parquet(f"{d}/aoi.parquet").filter(F.size("geometry") == 1).select("aoi_id", at["x"].alias("x"), at["y"].alias("y"))
    return points.filter(F.col("aoi_id").isNotNull() & finite(F.col("x")) & finite(F.col("y"))).distinct()


def _located(spark: SparkSession, d: str) -> DataFrame:
    tiles = spark.read.parquet(f"{d}/s2_tiles.parquet").select("tile_id", "geometry")
    return regions_containing(_locations(spark, d), "x", "y", tiles, "tile_id", "geometry", cell=REGION_CELL_M, spread="aoi_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return points_within(_located(spark, d), "aoi_id", "x", "y", RADIUS_M, within=["tile_id"])


def p4_near(spark: SparkSession, d: str) -> DataFrame:
    return points_within(_locations(spark, d), "aoi_id", "x", "y", RADIUS_M)


#: Metres of a degree at the equator, to read the planar tables as degrees.
DEGREE_M = 111_195.0


def p4_places(spark: SparkSession, d: str) -> DataFrame:
    """The great-circle form: the locations as degrees around the equator and the date line."""
    degrees = _locations(spark, d).select("aoi_id", (F.col("y") / DEGREE_M - 20).alias("lat"), (F.pmod(F.col("x") / DEGREE_M + 158, F.lit(360.0)) - 180).alias("lon"))
    return places_within(degrees, "aoi_id", "lat", "lon", RADIUS_M)


def p4_tiles(spark: SparkSession, d: str) -> DataFrame:
    return _located(spark, d).select("aoi_id", "tile_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_grid, p4_found, p4_near, p4_places, p4_tiles)}

TILE = "CASE WHEN regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g') <> '' THEN lpad(regexp_replace(regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g'), '^T([0-9]{{1,2}}[A-Z]{{3}})$', '\\1'), 5, '0') END"
_PERIODS = f"""
WITH r AS (SELECT DISTINCT image_id, ts, {TILE.format("tile_id")} AS tile_id, cloud_pct FROM image_catalog WHERE ts >= TIMESTAMP '2016-01-01' AND ts < TIMESTAMP '2026-01-01'),
b AS (SELECT *, CAST(floor(date_diff('day', DATE '2016-01-01', CAST(ts AS DATE)) / 5) AS BIGINT) AS p FROM r WHERE tile_id IS NOT NULL),
s AS (SELECT tile_id, unnest(range(min(p), max(p) + 1)) AS period_no FROM b GROUP BY tile_id)"""
_POINTS = """
WITH p AS (SELECT aoi_id, any_value(geometry[1].x) AS x, any_value(geometry[1].y) AS y FROM aoi WHERE len(geometry) = 1 AND isfinite(geometry[1].x) AND isfinite(geometry[1].y) GROUP BY aoi_id)"""
_BOXES = """, t AS (SELECT tile_id, min(v.x) AS x0, max(v.x) AS x1, min(v.y) AS y0, max(v.y) AS y1 FROM (SELECT tile_id, unnest(geometry) AS v FROM s2_tiles) GROUP BY tile_id),
l AS (SELECT aoi_id, x, y, tile_id FROM p JOIN t ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)"""

ORACLE = {
    "p1_found": f"{_PERIODS} SELECT tile_id, period_no FROM s WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.tile_id = s.tile_id AND b.p = s.period_no)",
    "p1_grid": f"""{_PERIODS},
g AS (SELECT tile_id, p, count(*) AS n, max(struct_pack(ts := ts, i := image_id, c := cloud_pct)) AS v FROM b GROUP BY ALL),
j AS (SELECT s.tile_id, s.period_no, n, v, last_value(CASE WHEN n IS NOT NULL THEN s.period_no END IGNORE NULLS) OVER (PARTITION BY s.tile_id ORDER BY s.period_no) AS f FROM s LEFT JOIN g ON g.tile_id = s.tile_id AND g.p = s.period_no)
SELECT j.tile_id, j.period_no, coalesce(j.n, 0) AS n_readings, CASE WHEN j.n IS NOT NULL THEN 'observed' WHEN j.period_no - j.f <= {MAX_GAP} THEN 'carried' ELSE 'missing' END AS status,
CASE WHEN j.period_no - j.f <= {MAX_GAP} THEN j.f END AS from_period, CASE WHEN j.period_no - j.f <= {MAX_GAP} THEN g.v.i END AS image_id, CASE WHEN j.period_no - j.f <= {MAX_GAP} THEN g.v.c END AS cloud_pct
FROM j LEFT JOIN g ON g.tile_id = j.tile_id AND g.p = j.f""",
    "p4_found": f"{_POINTS}{_BOXES} SELECT a.aoi_id AS aoi_id_a, b.aoi_id AS aoi_id_b, a.tile_id FROM l a JOIN l b ON a.tile_id = b.tile_id AND a.aoi_id < b.aoi_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 640000",
    "p4_near": f"{_POINTS} SELECT a.aoi_id AS aoi_id_a, b.aoi_id AS aoi_id_b FROM p a JOIN p b ON a.aoi_id < b.aoi_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 640000",
    "p4_places": f"""{_POINTS}, g AS (SELECT aoi_id, radians(y / {DEGREE_M} - 20) AS la, radians((x / {DEGREE_M} + 158) - 360 * floor((x / {DEGREE_M} + 158) / 360) - 180) AS lo FROM p)
SELECT a.aoi_id AS aoi_id_a, b.aoi_id AS aoi_id_b FROM g a JOIN g b ON a.aoi_id < b.aoi_id AND 2 * {EARTH_RADIUS_M} * asin(least(1.0, sqrt(pow(sin((b.la - a.la) / 2), 2) + cos(a.la) * cos(b.la) * pow(sin((b.lo - a.lo) / 2), 2)))) <= {RADIUS_M}""",
    "p4_tiles": f"{_POINTS}{_BOXES} SELECT aoi_id, tile_id FROM l",
}
