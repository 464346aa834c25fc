"""Logical raster inputs from the driver's tables. Engine code never sees the names of these tables.

Expressions that both engines read alike are written once, as SQL text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.functions.bands import BANDS
from rasterweave.functions.tiles import one_row_per_id, standard_tile

BAND_COLUMNS = [b.lower() for b in BANDS]
_BLACK = "l_orderkey % 5 = 0 AND l_linenumber % 3 = 0"
RAW = {b: f"CASE WHEN {_BLACK} THEN 0 ELSE (l_partkey * {7 + 4 * k} + l_suppkey * {13 + 6 * k} + l_linenumber * 131) % 5000 END" for k, b in enumerate(BAND_COLUMNS)}
RAW_KEYS = {"image_id": "l_orderkey", "i": "l_linenumber", "scl": "(l_orderkey + l_linenumber) % 12"}
SEG = {
    "cube_id": "CAST(floor(l_orderkey / 8) AS BIGINT)",
    "r": "CAST(l_orderkey % 8 AS INT)",
    "c": "CAST(l_linenumber % 8 AS INT)",
    "label": "CAST(CASE WHEN l_linenumber % 6 = 0 THEN 255 ELSE l_partkey % 5 END AS INT)",
    "pred": "CAST(CASE WHEN l_linenumber % 6 = 0 AND l_suppkey % 2 = 0 THEN 255 WHEN l_suppkey % 3 = 0 THEN (l_partkey + l_suppkey) % 5 ELSE l_partkey % 5 END AS INT)",
}
SCORES = [f"CAST((l_partkey * {k + 1} + l_suppkey * {3 * k + 7}) % 100 AS DOUBLE) / 25" for k in range(5)]
GRID_WIDTH = 50
GRID = {"i": f"CAST(floor(o_orderkey / {GRID_WIDTH}) AS INT)", "j": f"CAST(o_orderkey % {GRID_WIDTH} AS INT)", "v": "CAST(o_custkey % 1000 AS DOUBLE)", "k": "CAST(floor(o_custkey % 100 / 34) AS INT)"}
SEVERITY_OF_SIZE = "CASE p_size % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' WHEN 4 THEN 'G' ELSE 'H' END"


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _select(df: DataFrame, *named: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {c}" for group in named for c, e in group.items()])


def raw_pixels(spark: SparkSession, d: str) -> DataFrame:
    return _select(read(spark, d, "lineitem"), RAW_KEYS, RAW)


def seg_pixels(spark: SparkSession, d: str) -> DataFrame:
    return _select(read(spark, d, "lineitem"), SEG)


def scored_pixels(spark: SparkSession, d: str) -> DataFrame:
    return _select(read(spark, d, "lineitem"), {"image_id": "l_orderkey", "i": "l_linenumber", "label": SEG["label"], "scores": f"array({', '.join(SCORES)})"})


def cube_pixels(spark: SparkSession, d: str) -> DataFrame:
    return _select(read(spark, d, "lineitem"), {k: SEG[k] for k in ("cube_id", "r", "c")}, {"label": "CAST(l_partkey % 7 AS INT)"}, RAW)


def grid_pixels(spark: SparkSession, d: str) -> DataFrame:
    return _select(read(spark, d, "orders"), GRID)


def grid_height(pixels: DataFrame) -> int:
    return (pixels.agg(F.max("i")).first()[0] or 0) + 1


def series(spark: SparkSession, d: str) -> DataFrame:
    long = read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "e"))
    t = F.floor(F.col("k") / 8).cast("int")
    value = F.when(F.col("vec_id") % 7 != t, F.col("e").cast("double"))
    return long.select(F.floor(F.col("vec_id") / 25).cast("int").alias("i"), (F.col("vec_id") % 25).cast("int").alias("j"), t.alias("t"), (F.col("k") % 8).cast("int").alias("c"), value.alias("v"), F.date_add(F.lit("2022-01-01").cast("date"), t * 15).alias("date"))


def partition(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 25).cast("int").alias("i"), (F.col("vec_id") % 25).cast("int").alias("j"), "label")
    both = F.explode(F.array(F.struct(F.lit(0).alias("grid"), F.col("label").cast("long").alias("cluster_id")), F.struct(F.lit(1).alias("grid"), ((F.col("label") + F.col("i")) % 10).cast("long").alias("cluster_id"))))
    return p.select("i", "j", both.alias("p")).select("p.grid", "p.cluster_id", "i", "j")


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """Images once each, tiles in standard form; no time or cloud check here."""
    rows = one_row_per_id(read(spark, d, "image_catalog"), "image_id", "ts", "tile_id", "cloud_pct", "xmin", "ymin", "xmax", "ymax")
    return rows.withColumn("tile_id", standard_tile(F.col("tile_id"))).filter("tile_id IS NOT NULL")


def rectangles(spark: SparkSession, d: str) -> DataFrame:
    """Polygons from part: rectangles with corners in the middle of cells."""
    box = read(spark, d, "part").selectExpr("p_partkey AS poly_seq", "p_partkey % 90 + 0.5D AS x0", "(p_partkey * 7) % 90 + 0.5D AS y0", "1 + p_size % 8 AS w", "1 + p_size % 5 AS h", "CAST(p_size % 4 + 2 AS INT) AS label")
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    return box.select("poly_seq", "label", F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)).alias("geometry"))


#: Three scenes of their own widths, dealt from the keys of orders.
SCENE_WIDTH = "(40 + 10 * (o_orderkey % 3))"
SCENES = {"scene": "CAST(o_orderkey % 3 AS INT)", "i": f"CAST(floor(floor(o_orderkey / 3) / {SCENE_WIDTH}) AS INT)", "j": f"CAST(floor(o_orderkey / 3) % {SCENE_WIDTH} AS INT)", "v": GRID["v"], "k": GRID["k"]}


def scene_pixels(spark: SparkSession, d: str) -> DataFrame:
    return _select(read(spark, d, "orders"), SCENES)


def scene_series(spark: SparkSession, d: str) -> DataFrame:
    """series() twice, as two scenes; the second is turned upside down."""
    both = F.explode(F.array(F.struct(F.lit(0).alias("scene"), F.col("v").alias("v")), F.struct(F.lit(1).alias("scene"), (-F.col("v")).alias("v"))))
    rows = series(spark, d)
    return rows.withColumn("_s", both).select("_s.scene", "i", "j", "t", "c", "_s.v", "date")


# --- the same inputs in SQL -------------------------------------------------

_named = lambda *groups: ", ".join(f"{e} AS {c}" for g in groups for c, e in g.items())
RAW_SQL = f"SELECT {_named(RAW_KEYS, RAW)} FROM lineitem"
SEG_SQL = f"SELECT {_named(SEG)} FROM lineitem"
SCORED_SQL = f"SELECT row_number() OVER () AS row, l_orderkey AS image_id, l_linenumber AS i, {SEG['label']} AS label, [{', '.join(SCORES)}] AS scores FROM lineitem"
CUBE_SQL = f"SELECT {_named({k: SEG[k] for k in ('cube_id', 'r', 'c')})}, CAST(l_partkey % 7 AS INT) AS label, {_named(RAW)} FROM lineitem"
GRID_SQL = f"SELECT {_named(GRID)} FROM orders"
SCENES_SQL = f"SELECT {_named(SCENES)} FROM orders"
SERIES_SQL = "SELECT CAST(vec_id // 25 AS INT) AS i, CAST(vec_id % 25 AS INT) AS j, CAST((k - 1) // 8 AS INT) AS t, CAST((k - 1) % 8 AS INT) AS c, CASE WHEN vec_id % 7 <> (k - 1) // 8 THEN CAST(e AS DOUBLE) END AS v, DATE '2022-01-01' + CAST(15 * ((k - 1) // 8) AS INT) AS date FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS k FROM embeddings)"
PARTITION_SQL = "SELECT g AS grid, CAST(CASE WHEN g = 0 THEN label ELSE (label + vec_id // 25) % 10 END AS BIGINT) AS cluster_id, CAST(vec_id // 25 AS INT) AS i, CAST(vec_id % 25 AS INT) AS j FROM embeddings, (VALUES (0), (1)) AS grids(g)"
TILE_SQL = "CASE WHEN regexp_replace(upper(tile_id), '[^A-Z0-9]', '', 'g') <> '' THEN lpad(regexp_replace(regexp_replace(upper(tile_id), '[^A-Z0-9]', '', 'g'), '^T([0-9]{1,2}[A-Z]{3})$', '\\1'), 5, '0') END"
CATALOG_SQL = f"SELECT * FROM (SELECT DISTINCT image_id, ts, {TILE_SQL} AS tile_id, cloud_pct, xmin, ymin, xmax, ymax FROM image_catalog) WHERE tile_id IS NOT NULL"
RECT_SQL = "SELECT p_partkey AS poly_seq, p_partkey % 90 + 0.5 AS x0, (p_partkey * 7) % 90 + 0.5 AS y0, 1 + p_size % 8 AS w, 1 + p_size % 5 AS h, CAST(p_size % 4 + 2 AS INT) AS label FROM part"
