"""Burning polygons into pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.operators.nearby import edges_of


def _row_spans(edges: Column, y: Column) -> Column:
    """For the row of unit cells [y, y + 1] the runs of touched columns, as array<struct<lo, hi>>; runs may overlap.

    A side touches the closed cells that its part within the row runs through; between every two crossings of the
    row's middle line lies the inside.
    """
    met = F.filter(edges, lambda e: (F.least(e["y1"], e["y2"]) <= y + 1) & (F.greatest(e["y1"], e["y2"]) >= y))

    def along(e: Column) -> Column:
        slope = (e["x2"] - e["x1"]) / F.when(e["y2"] != e["y1"], e["y2"] - e["y1"])
        at = lambda v: e["x1"] + (F.least(F.greatest(v, F.least(e["y1"], e["y2"])), F.greatest(e["y1"], e["y2"])) - e["y1"]) * slope
        a, b = F.coalesce(at(y), e["x1"]), F.coalesce(at(y + 1), e["x2"])
        return F.struct((F.ceil(F.least(a, b)) - 1).cast("int").alias("lo"), F.floor(F.greatest(a, b)).cast("int").alias("hi"))

    middle = y + 0.5
    crossed = F.filter(edges, lambda e: (e["y1"] > middle) != (e["y2"] > middle))
    xs = F.array_sort(F.transform(crossed, lambda e: e["x1"] + (middle - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])))
    halves = F.slice(F.sequence(F.lit(0), F.floor(F.size(xs) / 2).cast("int")), 1, F.floor(F.size(xs) / 2).cast("int"))
    inner = F.transform(halves, lambda k: F.struct(F.ceil(F.get(xs, 2 * k) - 0.5).cast("int").alias("lo"), F.floor(F.get(xs, 2 * k + 1) - 0.5).cast("int").alias("hi")))
    return F.concat(F.transform(met, along), inner)


def touched_cells(polygons: DataFrame, ring: str, bounds: tuple[int, int] | None = None, spread: int | None = None) -> DataFrame:
    """polygons with i, j (row = y, column = x) of every unit cell that the polygon touches, border included, once each.

    Cells come row by row from the sides that meet the row, so the work follows the cells, not the polygon's box.
    Rings without three good vertices touch nothing. bounds: (height, width) of the raster, if known. spread: deal the
    rows of a polygon over the tasks in blocks of so many, for scenes with a few huge polygons.
    """
    p = polygons.withColumn("_e", edges_of(F.col(ring))).filter("_e IS NOT NULL")
    p = p.withColumns({"_y0": (F.ceil(F.array_min(F.transform("_e", lambda e: e["y1"]))) - 1).cast("int"), "_y1": F.floor(F.array_max(F.transform("_e", lambda e: e["y1"]))).cast("int")})
    if bounds:
        p = p.withColumns({"_y0": F.greatest("_y0", F.lit(0)), "_y1": F.least("_y1", F.lit(bounds[0] - 1))}).filter("_y0 <= _y1")
    if spread:
        p = p.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_y0") / spread), F.floor(F.col("_y1") / spread)))).repartition(F.xxhash64(F.col(ring).cast("string"), "_b"))
        p = p.withColumns({"_y0": F.greatest("_y0", (F.col("_b") * spread).cast("int")), "_y1": F.least("_y1", (F.col("_b") * spread + (spread - 1)).cast("int"))}).drop("_b")
    p = p.withColumn("i", F.explode(F.sequence("_y0", "_y1")))
    spans = _row_spans(F.col("_e"), F.col("i").cast("double"))
    if bounds:
        spans = F.transform(spans, lambda s: F.struct(F.greatest(s["lo"], F.lit(0)).alias("lo"), F.least(s["hi"], F.lit(bounds[1] - 1)).alias("hi")))
    cells = F.array_distinct(F.flatten(F.transform(F.filter(spans, lambda s: s["lo"] <= s["hi"]), lambda s: F.sequence(s["lo"], s["hi"]))))
    return p.withColumn("j", F.explode(cells)).drop("_e", "_y0", "_y1")


def burnt(polygons: DataFrame, ring: str, label: str, order: str, bounds: tuple[int, int] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """keys, i, j, label of every touched cell: that of the polygon with the greatest `order`, as if burnt one after another."""
    cells = touched_cells(polygons.select(*keys, ring, label, order), ring, bounds=bounds)
    return cells.groupBy(*keys, "i", "j").agg(F.max_by(label, order).alias("label"))


def labelled(pixels: DataFrame, raster: DataFrame, is_black: Column, keys: Sequence[str] = ()) -> DataFrame:
    """pixels with label: 0 for black pixels, the raster's label where it is set and not 0, else 1 (healthy)."""
    out = pixels.join(raster, [*keys, "i", "j"], "left")
    return out.withColumn("label", F.when(is_black, F.lit(0)).when(F.coalesce(F.col("label"), F.lit(0)) != 0, F.col("label")).otherwise(F.lit(1)))


def annotations_of(annotations: DataFrame, year: int, pests: list[str] | None, classes: int) -> DataFrame:
    """Annotations of one year; of the given pests unless there are none or the classes (120, 255) cover them all."""
    kept = annotations.filter(F.col("capture_year") == year)
    return kept if not pests or classes in (120, 255) else kept.filter(F.col("pest_species_code").isin(*pests))
