"""Choosing images from a catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterweave.operators.skew import salted_join


def boxes_meet(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """True if two boxes (xmin, ymin, xmax, ymax) have a point in common."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def in_days(ts: Column, start: str, end: str) -> Column:
    """start <= ts < end; Spark pushes it to the scan."""
    return (ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(end).cast("timestamp_ntz"))


def footprint_join(images: DataFrame, areas: DataFrame, cell: float, spread: Sequence[str] = (), a_spread: Sequence[str] = ()) -> DataFrame:
    """Images and areas whose boxes meet; both have xmin, ymin, xmax, ymax, the areas' with prefix a_.

    Boxes are hashed to the grid cells they touch and joined by cell. A pair is kept in the cell of its overlap's
    lower left corner only, so it comes out once, without a distinct. A cell with very many images or areas is dealt over
    several tasks by their boxes and the columns spread and a_spread (ids, where many boxes are equal).
    """
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell).cast("long"), F.floor(F.col(hi) / cell).cast("long"))
    ordered = images.filter("xmin <= xmax AND ymin <= ymax").withColumn("_cx", F.explode(span("xmin", "xmax"))).withColumn("_cy", F.explode(span("ymin", "ymax")))
    asked = areas.filter("a_xmin <= a_xmax AND a_ymin <= a_ymax").withColumn("_cx", F.explode(span("a_xmin", "a_xmax"))).withColumn("_cy", F.explode(span("a_ymin", "a_ymax")))
    corner = (F.floor(F.greatest("xmin", "a_xmin") / cell) == F.col("_cx")) & (F.floor(F.greatest("ymin", "a_ymin") / cell) == F.col("_cy"))
    meet = boxes_meet([F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")], [F.col(c) for c in ("a_xmin", "a_ymin", "a_xmax", "a_ymax")])
    return salted_join(ordered, asked, ["_cx", "_cy"], F.xxhash64("xmin", "ymin", "xmax", "ymax", *spread), corner & meet, few_spread=F.xxhash64("a_xmin", "a_ymin", "a_xmax", "a_ymax", *a_spread)).drop("_cx", "_cy")


def clear_images(images: DataFrame, max_cloud: float) -> DataFrame:
    """Images with strictly less cloud than max_cloud percent; those of unknown cloud are left out. Spark pushes it to the scan."""
    return images.filter(F.col("cloud_pct") < F.lit(float(max_cloud)))


def collection_sizes(images: DataFrame, per: Sequence[str]) -> DataFrame:
    """per, n: the number of images of each group."""
    return images.groupBy(*per).agg(F.count(F.lit(1)).alias("n"))


def with_masks(values: DataFrame, masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """values with the mask of the same image (and pixel, if it is a key): by key, never by position. Values without a mask are left out."""
    clash = (set(values.columns) & set(masks.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns of both tables that are no key: {sorted(clash)}")
    return values.join(masks, list(keys))


def latest(images: DataFrame, per: Sequence[str], n: int, ts: str = "ts", tie: str = "image_id") -> DataFrame:
    """The n latest images of each group, ties by the greatest id first."""
    order = Window.partitionBy(*per).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return images.filter(F.col(ts).isNotNull()).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n).drop("_rank")


def latest_per_tile(images: DataFrame, area: str, tile: str, limit: int = 10) -> DataFrame:
    """Of the `limit` latest images of each area the latest one of each tile."""
    return latest(latest(images, [area], limit), [area, tile], 1)


def clearest(images: DataFrame, tile: str, max_cloud: float, start: str, end: str) -> DataFrame:
    """The image of each tile with the least cloud (strictly below max_cloud) in [start, end); then the earliest, then the least id."""
    good = images.filter(in_days(F.col("ts"), start, end) & (F.col("cloud_pct") < max_cloud))
    order = Window.partitionBy(tile).orderBy("cloud_pct", F.col("ts").asc_nulls_last(), "image_id")
    return good.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def cloud_ladder(images: DataFrame, per: Sequence[str], *, step: float = 1, top: float = 20, n_min: int = 1, n_max: int | None = None) -> DataFrame:
    """Images below the first rung of 0, step, 2 * step ... top at which a group has n_min images, with `rung`.

    An image is below a rung if its cloud is strictly less. A group that never has n_min images gets the last rung. Of
    the images below the rung the n_max clearest are kept. Two aggregations replace the repeated queries: an image is
    admitted by the rung (floor(pct / step) + 1) * step, and counts per rung are summed up the ladder.
    """
    last = int(top // step)
    admitted = images.filter(F.col("cloud_pct").isNotNull()).withColumn("_rung", F.greatest(F.floor(F.col("cloud_pct") / step) + 1, F.lit(0)).cast("int")).filter(F.col("_rung") <= last)
    counts = admitted.groupBy(*per, "_rung").agg(F.count(F.lit(1)).alias("_n"))
    below = F.sum("_n").over(Window.partitionBy(*per).orderBy("_rung").rowsBetween(Window.unboundedPreceding, 0))
    rungs = counts.withColumn("_below", below).groupBy(*per).agg(F.coalesce(F.min(F.when(F.col("_below") >= n_min, F.col("_rung"))), F.lit(last)).alias("_first"))
    kept = admitted.join(rungs, list(per)).filter(F.col("_rung") <= F.col("_first")).withColumn("rung", F.col("_first") * F.lit(float(step)))
    if n_max is not None:
        order = Window.partitionBy(*per).orderBy("cloud_pct", F.col("ts").asc_nulls_last(), "image_id")
        kept = kept.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n_max).drop("_rank")
    return kept.drop("_rung", "_first")


def bright_images(pixels: DataFrame, image: str, band: str, max_black: float) -> DataFrame:
    """image, black_share of the images whose share of masked pixels (null band) is at most max_black."""
    share = F.try_divide(F.count(F.lit(1)) - F.count(band), F.count(F.lit(1)))
    return pixels.groupBy(image).agg(share.alias("black_share")).filter(F.col("black_share") <= max_black)


def days_from(images: DataFrame, start: str, days: int) -> DataFrame:
    """Images of [start, start + days), oldest first in each tile by `nr`; images without a tile are left out."""
    end = F.lit(start).cast("date") + F.expr(f"INTERVAL {days} DAYS")
    kept = images.filter((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < end.cast("timestamp_ntz")))
    # A tile may hold a tenth of the catalog, so it is ranked month by month: within the month, plus the months before.
    month = kept.withColumn("_m", F.date_trunc("month", "ts"))
    sizes = month.groupBy("tile_id", "_m").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("tile_id").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = month.withColumn("_k", F.row_number().over(Window.partitionBy("tile_id", "_m").orderBy("ts", "image_id")))
    return ranked.join(sizes.select("tile_id", "_m", before.alias("_before")), ["tile_id", "_m"]).select(*images.columns, (F.col("_before") + F.col("_k")).cast("int").alias("nr"))


def unpivot_bands(pixels: DataFrame, keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """keys, band, value: one row per band, without a shuffle."""
    return pixels.unpivot(list(keys), list(bands), "band", "value")


def name_areas(areas: DataFrame, id_col: str, name: str) -> DataFrame:
    """areas with `label`: the name, or aoi_<id> where it is null or blank."""
    return areas.withColumn("label", F.when(F.trim(name) != "", F.col(name)).otherwise(F.concat(F.lit("aoi_"), F.col(id_col).cast("string"))))


def area_boxes(areas: DataFrame, geometry: str, buffer_m: float) -> DataFrame:
    """areas with a_xmin, a_ymin, a_xmax, a_ymax: the box of the finite vertices, widened by buffer_m."""
    good = F.filter(geometry, lambda v: F.coalesce((F.abs(v["x"]) < F.lit(float("inf"))) & (F.abs(v["y"]) < F.lit(float("inf"))) & ~F.isnan(v["x"]) & ~F.isnan(v["y"]), F.lit(False)))
    kept = areas.withColumn("_v", good).filter(F.size("_v") > 0)
    low = lambda k: F.array_min(F.transform("_v", lambda v: v[k])) - F.lit(float(buffer_m))
    high = lambda k: F.array_max(F.transform("_v", lambda v: v[k])) + F.lit(float(buffer_m))
    return kept.withColumns({"a_xmin": low("x"), "a_ymin": low("y"), "a_xmax": high("x"), "a_ymax": high("y")}).drop("_v")
