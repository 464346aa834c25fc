"""Points near other points, and the regions that contain points."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.operators.skew import ROWS_PER_TASK, salted_join
from rasterweave.session import cut_lineage

EARTH_RADIUS_M = 6_371_008.8


def finite(c: Column) -> Column:
    """True for a number, False for null, NaN and the infinities."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres of two places in degrees (haversine)."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


#: Side of a cell in radii: a wider cell copies fewer points to its neighbours but compares more of them.
CELL_RADII = 4


def _cell_key(cells: Sequence[Column], within: Sequence[Column] = ()) -> Column:
    """One 64-bit number of a cell. Cells of one number lie so far apart that the exact test never takes them for near."""
    bits = 63 // len(cells)
    key = F.lit(0).cast("long")
    for c in cells:
        key = F.shiftleft(key, bits).bitwiseOR(F.pmod(c, F.lit(1 << bits)))
    return key.bitwiseXOR(F.xxhash64(*within)) if within else key


def _pairs(points: DataFrame, id_col: str, axes: Sequence[str], radius: float, exact, within: Sequence[str], carry: Sequence[str], rows_per_task: int) -> DataFrame:
    """Pairs of rows in the same or in neighbouring cells for which exact(a, b) holds, each once."""
    side = float(radius) * CELL_RADII if radius > 0 else 1.0
    # Read by the count of hot cells and by both sides of the join.
    written = cut_lineage(points)
    cells = [F.floor(F.col(a) / F.lit(side)).cast("long") for a in axes]
    groups = [F.col(w) for w in within]
    # Rounding must not keep a point from the cell beyond the border.
    reach = [F.lit(float(radius) * (1 + 1e-6)) + F.abs(F.col(a)) * 1e-12 for a in axes]
    low = [F.col(a) - c * F.lit(side) <= r for a, c, r in zip(axes, cells, reach, strict=True)]
    high = [(c + 1) * F.lit(side) - F.col(a) <= r for a, c, r in zip(axes, cells, reach, strict=True)]

    def copy_to(offsets: tuple[int, ...]) -> Column:
        key = F.struct(_cell_key([c + F.lit(o) for c, o in zip(cells, offsets, strict=True)], groups).alias("_cell"), F.lit(any(offsets)).alias("_away"))
        for o, lo, hi in zip(offsets, low, high, strict=True):
            key = F.when(lo, key) if o < 0 else F.when(hi, key) if o > 0 else key
        return key

    # Of two neighbouring cells the points of the later one go to the earlier, if they are in reach of its border.
    targets = [o for o in product((-1, 0, 1), repeat=len(axes)) if o <= (0,) * len(axes)]
    copies = F.explode(F.filter(F.array(*[copy_to(o) for o in targets]), lambda t: t.isNotNull())).alias("_to")
    named = lambda end: [F.col(c).alias(f"{c}{end}") for c in points.columns]
    left = written.select(_cell_key(cells, groups).alias("_cell"), *named("_1"))
    right = written.select("*", copies).select("_to._cell", "_to._away", *named("_2"))
    a, b = F.col(f"{id_col}_1"), F.col(f"{id_col}_2")
    near = F.when(F.col("_away"), a != b).otherwise(a < b) & exact("_1", "_2")
    for w in within:
        near = near & (F.col(f"{w}_1") == F.col(f"{w}_2"))
    # A cell gets copies from its neighbours only, so the fullest cell proves it if no cell of either side can be hot.
    fullest = written.groupBy(_cell_key(cells, groups).alias("_cell")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if fullest * 3 ** len(axes) <= rows_per_task:
        found = left.join(right, "_cell").filter(near)
    else:
        found = salted_join(left, right, ["_cell"], a, near, rows_per_task, few_spread=b)
    ends = [F.when(a < b, F.col(f"{c}{x}")).otherwise(F.col(f"{c}{y}")).alias(f"{c}{end}") for c in (id_col, *carry) for end, x, y in (("_a", "_1", "_2"), ("_b", "_2", "_1"))]
    return found.select(*ends, *[F.col(f"{w}_1").alias(w) for w in within])


def points_within(points: DataFrame, id_col: str, x: str, y: str, radius: float, *, within: Sequence[str] = (), carry: Sequence[str] = (), rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Pairs of points at most `radius` apart in the plane, the radius included: <id>_a < <id>_b and the `within` columns.

    Points are hashed to square cells of CELL_RADII radii; a point within the radius of a border is copied to the cells
    beyond it, and the exact distance is checked in the join of each cell. With `within`, only points that agree in these
    columns are compared; `carry` columns come out for both ends, as <name>_a and <name>_b. A point with a null id, a
    null `within` column or a coordinate that is null or not finite is near nothing. Rows that repeat an id are
    compared like others but an id is never near itself: make ids single first. Ties and equal places are pairs at
    distance 0. Empty input: empty result. Extra columns are not read.

    A cell with more than rows_per_task points or copies is dealt over several tasks, none of which holds all of its pairs.
    """
    names = [id_col, *within, *carry]
    p = points.select(*names, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).filter(F.col(id_col).isNotNull() & finite(F.col("_x")) & finite(F.col("_y")))
    for w in within:
        p = p.filter(F.col(w).isNotNull())
    limit = F.lit(float(radius) ** 2)
    square = lambda axis, a, b: (F.col(axis + a) - F.col(axis + b)) * (F.col(axis + a) - F.col(axis + b))
    return _pairs(p, id_col, ["_x", "_y"], radius, lambda a, b: square("_x", a, b) + square("_y", a, b) <= limit, within, carry, rows_per_task)


def places_within(places: DataFrame, id_col: str, lat: str, lon: str, radius_m: float, *, within: Sequence[str] = (), carry: Sequence[str] = (), rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Like points_within for degrees of latitude and longitude and a great-circle radius in metres.

    Places become points on the sphere, and the cells are cubes there: poles and the date line need no special
    case, and the chord is never longer than the arc, so no pair is lost. The great-circle distance decides.
    """
    p = places.select(id_col, *within, *carry, F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon")).filter(F.col(id_col).isNotNull() & finite(F.col("_lat")) & finite(F.col("_lon")))
    for w in within:
        p = p.filter(F.col(w).isNotNull())
    r, la, lo = F.lit(EARTH_RADIUS_M), F.radians("_lat"), F.radians("_lon")
    p = p.select("*", (r * F.cos(la) * F.cos(lo)).alias("_x"), (r * F.cos(la) * F.sin(lo)).alias("_y"), (r * F.sin(la)).alias("_z"))
    arc = lambda a, b: great_circle_m(F.col("_lat" + a), F.col("_lon" + a), F.col("_lat" + b), F.col("_lon" + b))
    return _pairs(p, id_col, ["_x", "_y", "_z"], radius_m, lambda a, b: arc(a, b) <= F.lit(float(radius_m)), within, carry, rows_per_task)


#: Cells that a region spans on a side at most, but for the one that its corner may touch as well.
CELLS_ACROSS = 4

#: Regions up to which Spark may broadcast their cells ((CELLS_ACROSS + 1)**2 rows of a region at most).
BROADCAST_REGIONS = 2_000


def edges_of(ring: Column) -> Column:
    """The sides of a ring of struct<x, y>, closed if it is not, without its null or non-finite vertices."""
    good = F.filter(ring, lambda v: finite(v["x"].cast("double")) & finite(v["y"].cast("double")))
    turned = F.concat(F.slice(good, 2, F.greatest(F.size(good) - 1, F.lit(0))), F.slice(good, 1, 1))
    sides = F.zip_with(good, turned, lambda p, q: F.struct(p["x"].cast("double").alias("x1"), p["y"].cast("double").alias("y1"), q["x"].cast("double").alias("x2"), q["y"].cast("double").alias("y2")))
    return F.when(F.size(good) >= 3, sides)


def in_ring(edges: Column, x: Column, y: Column) -> Column:
    """True if (x, y) lies in the polygon or on its border."""
    on = F.exists(edges, lambda e: ((e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"])) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])))
    crossed = F.filter(edges, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & ((x - e["x1"]) * F.abs(e["y2"] - e["y1"]) < (e["x2"] - e["x1"]) * (y - e["y1"]) * F.signum(e["y2"] - e["y1"])))
    return on | (F.size(crossed) % 2 == 1)


def regions_containing(points: DataFrame, x: str, y: str, regions: DataFrame, region_id: str, ring: str, *, cell: float, spread: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """points with region_id of each region that contains them, border included; a point in no region has no row.

    Regions are hashed to the cells of side `cell` that their box touches, points to their cell; the exact test
    follows in the join; a cell with very many points or regions is dealt over several tasks. A region wider than
    CELLS_ACROSS cells goes to cells twice as wide, or four times and so on, until it isn't, and points also to their cell
    of each width that occurs; so a region has few rows, whatever its size. Regions with the same region_id are one region and must not disagree (the least ring counts); null ids and rings of
    fewer than three good vertices contain nothing. Points with null or non-finite coordinates lie nowhere. spread: the
    column that deals the points of a hot cell over several tasks. Columns of points are kept, whatever their names; one
    called like region_id gives way to the region's.
    """
    r = regions.select(region_id, ring).filter(F.col(region_id).isNotNull() & F.col(ring).isNotNull()).groupBy(region_id).agg(F.min(ring).alias("_ring"))
    r = r.select(F.col(region_id).alias("_region"), edges_of(F.col("_ring")).alias("_edges")).filter(F.col("_edges").isNotNull())
    lo = lambda k: F.array_min(F.transform("_edges", lambda e: e[k]))
    hi = lambda k: F.array_max(F.transform("_edges", lambda e: e[k]))
    r = r.select("*", lo("x1").alias("_x0"), hi("x1").alias("_x9"), lo("y1").alias("_y0"), hi("y1").alias("_y9"))
    width = F.greatest(F.col("_x9") - F.col("_x0"), F.col("_y9") - F.col("_y0"))
    r = r.withColumn("_level", F.greatest(F.ceil(F.least(F.log2(width / (CELLS_ACROSS * cell)), F.lit(1000.0))).cast("int"), F.lit(0)))
    side = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_level"))
    levels = {v["_level"]: v["n"] for v in r.groupBy("_level").agg(F.count(F.lit(1)).alias("n")).collect()}
    span = lambda a, b: F.sequence(F.floor(F.col(a) / side).cast("long"), F.floor(F.col(b) / side).cast("long"))
    r = r.withColumn("_cx", F.explode(span("_x0", "_x9"))).withColumn("_cy", F.explode(span("_y0", "_y9"))).withColumn("_cell", _cell_key([F.col("_cx"), F.col("_cy")])).drop("_cx", "_cy")
    if sum(levels.values()) > BROADCAST_REGIONS:  # Spark takes the size from before the cells
        r = r.hint("merge")
    # The points' own columns travel as one struct, so none of them can clash with a helper column.
    kept = [F.col(c) for c in points.columns if c != region_id]
    p = points.select(F.struct(*kept).alias("_p"), F.col(x).cast("double").alias("_px"), F.col(y).cast("double").alias("_py"), F.col(spread).alias("_spread")).filter(finite(F.col("_px")) & finite(F.col("_py")))
    p = p.withColumn("_level", F.explode(F.array(*map(F.lit, sorted(levels) or [0]))))
    p = p.withColumn("_cell", _cell_key([F.floor(F.col("_px") / side).cast("long"), F.floor(F.col("_py") / side).cast("long")]))
    px, py = F.col("_px"), F.col("_py")
    inside = px.between(F.col("_x0"), F.col("_x9")) & py.between(F.col("_y0"), F.col("_y9")) & in_ring(F.col("_edges"), px, py)
    return salted_join(p, r, ["_level", "_cell"], F.col("_spread"), inside, rows_per_task, few_spread=F.col("_region")).select("_p.*", F.col("_region").alias(region_id))
