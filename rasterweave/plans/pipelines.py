"""The five pipelines as compositions of operators. Everything stays a plan until the caller writes it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.functions import bands as B
from rasterweave.functions import masks as M
from rasterweave.operators import catalog as C
from rasterweave.operators import inference, labels, metrics, pixel_graph, splitting, tiling, zones
from rasterweave.operators import series as S
from rasterweave.operators.nearby import regions_containing
from rasterweave.session import broadcast_if_small, cut_lineage
from rasterweave.sources.params import PREDICT_BLACK, FordeadRequest, PredictionRequest, TrainingRequest

CELL_M = 50_000.0


def _in_areas(images: DataFrame, areas: DataFrame, buffer_m: float) -> DataFrame:
    """Images with the areas (aoi_id, label) that they meet."""
    named = C.name_areas(areas, "aoi_id", "name").select("aoi_id", "label", "geometry")
    return C.footprint_join(images, C.area_boxes(named, "geometry", buffer_m).drop("geometry"), CELL_M, ["image_id"], ["aoi_id"])


def select_for_training(images: DataFrame, areas: DataFrame, request: TrainingRequest, n_min: int = 1, n_max: int | None = 1) -> DataFrame:
    """The images of each area and tile below the first sufficient rung of cloud cover."""
    if request.aoi_indices:
        areas = areas.filter(F.col("aoi_id").isin(*request.aoi_indices))
    span = images.filter(C.in_days(F.col("ts"), request.start, request.end))
    return C.cloud_ladder(_in_areas(span, areas, request.buffer_m), ["aoi_id", "tile_id"], step=request.step_cloud, top=request.max_cloud, n_min=n_min, n_max=n_max)


def select_for_prediction(images: DataFrame, areas: DataFrame, request: PredictionRequest, pixels: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """The latest image of each area and tile within `days` up to `before`; with pixels, without the dark ones."""
    end = F.lit(request.before).cast("date")
    span = images.filter((F.col("ts") >= F.date_sub(end, request.days).cast("timestamp_ntz")) & (F.col("ts") < F.date_add(end, 1).cast("timestamp_ntz")))
    if pixels is not None and request.filter_black:
        span = span.join(C.bright_images(pixels, "image_id", "b1", PREDICT_BLACK).select("image_id"), "image_id", "left_semi")
    return C.latest_per_tile(_in_areas(span, areas, request.buffer_m), "aoi_id", "tile_id", limit)


def select_for_fordead(images: DataFrame, areas: DataFrame, request: FordeadRequest, pixels: DataFrame | None = None) -> DataFrame:
    """All images of the span, oldest first in each tile."""
    span = C.days_from(images, request.start, request.days)
    if pixels is not None and request.filter_black:
        span = span.join(C.bright_images(pixels, "image_id", "b1", request.threshold).select("image_id"), "image_id", "left_semi")
    return _in_areas(span, areas, request.buffer_m)


def prepared_pixels(pixels: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The 24 channels of the clear pixels of chosen images, and the cloud mask."""
    kept = pixels.join(chosen.select("image_id").distinct(), "image_id", "left_semi")
    masked = kept.withColumns({b.lower(): M.masked(F.col(b.lower()), F.col("scl")) for b in B.BANDS}).withColumn("cloud", M.cloudy(F.col("scl")))
    return B.final_bands(masked, [*keys, "cloud"])


#: Severity steps of the two numbers of classes that code severity and combination together.
COMBINED_STEPS = {120: 2, 255: 5}


def annotation_classes(annotations: DataFrame, classes: int, steps: dict[str, int], combos: DataFrame | None = None) -> DataFrame:
    """annotations with `label`: the severity class, or for 120 and 255 classes the code of severity and (tree, pest) combination.

    steps: severity to step, of the caller's table for this number of classes. combos: tree, pest, combo, broadcast after a
    count. Codes are compared in capitals without blanks around them; annotations without a class are left out.
    """
    code = lambda c: F.upper(F.trim(c))
    severity = code("pest_severity_code")
    if classes not in COMBINED_STEPS:
        return annotations.withColumn("label", M.severity_class(severity, steps)).filter("label IS NOT NULL")
    if combos is None:
        raise ValueError(f"{classes} classes need a table of combinations")
    table = combos.select(code("tree").alias("_tree"), code("pest").alias("_pest"), "combo").groupBy("_tree", "_pest").agg(F.min("combo").alias("_combo"))
    known = annotations.withColumns({"_tree": code("tree_species_code"), "_pest": code("pest_species_code")}).join(broadcast_if_small(table, 100_000), ["_tree", "_pest"], "left")
    step = M.severity_class(severity, steps) - 2
    return known.withColumn("label", M.multi_class_code(severity, step, F.col("_combo"), COMBINED_STEPS[classes])).filter("label IS NOT NULL").drop("_tree", "_pest", "_combo")


def labelize(pixels: DataFrame, annotations: DataFrame, year: int, classes: int, pests: list[str] | None, steps: dict[str, int], combos: DataFrame | None = None, frames: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Pixels (keys, i, j, bands) with the class of the last annotation that touches them.

    One scene: geometries are in its pixels. Many scenes: frames has the keys, x0, y0 (the upper left corner), pixel (the
    side of a pixel) and height, width of each; an annotation is burnt into every scene that its box meets.
    """
    coded = annotation_classes(labels.annotations_of(annotations, year, pests, classes), classes, steps, combos)
    if frames is not None:
        coded = scene_rings(coded.select("poly_seq", "label", "geometry"), frames, keys)
    raster = labels.burnt(coded, "geometry", "label", "poly_seq", keys=keys)
    return labels.labelled(pixels, raster, M.black([F.col(b.lower()) for b in B.BANDS]), keys)


def scene_rings(polygons: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """poly_seq, label, keys and geometry in pixels (x = column, y = row, from above) for every scene that a polygon's box meets."""
    boxes = C.area_boxes(polygons.select("poly_seq", "label", "geometry"), "geometry", 0)
    right, low = F.col("x0") + F.col("width") * F.col("pixel"), F.col("y0") - F.col("height") * F.col("pixel")
    scenes = frames.select(*keys, "x0", "y0", "pixel", F.col("x0").alias("xmin"), low.alias("ymin"), right.alias("xmax"), F.col("y0").alias("ymax"))
    met = C.footprint_join(scenes, boxes, CELL_M, keys, ["poly_seq"])
    ring = F.transform("geometry", lambda v: F.struct(((v["x"] - F.col("x0")) / F.col("pixel")).alias("x"), ((F.col("y0") - v["y"]) / F.col("pixel")).alias("y")))
    return met.select(*keys, "poly_seq", "label", ring.alias("geometry"))


def clip(pixels: DataFrame, areas: DataFrame, x: str, y: str, buffer_m: float = 0, spread: str = "image_id") -> DataFrame:
    """pixels (x, y: their centres) within an area, with its aoi_id: by the polygon, or with a buffer by the widened box.

    A location (an area of one vertex) clips to its widened box. A pixel in several areas comes out once for each.
    """
    if buffer_m > 0:
        boxes = C.area_boxes(areas.select("aoi_id", "geometry"), "geometry", buffer_m)
        corner = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
        areas = boxes.select("aoi_id", F.array(corner("a_xmin", "a_ymin"), corner("a_xmax", "a_ymin"), corner("a_xmax", "a_ymax"), corner("a_xmin", "a_ymax")).alias("geometry"))
    return regions_containing(pixels, x, y, areas.select("aoi_id", "geometry"), "aoi_id", "geometry", cell=max(float(buffer_m), 1_000.0), spread=spread)


def acquired(pixels: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What the acquisition writes: the 24 channels and the cloud mask of the chosen images, with tile and date of the image."""
    images = chosen.select("image_id", "tile_id", F.to_date("ts").alias("date")).distinct()
    return prepared_pixels(pixels, chosen, keys).join(broadcast_if_small(images, 1_000_000), "image_id")


def training_cubes(pixels: DataFrame, height: int | None = None, width: int | None = None, max_black: float = 0.8, size: int = tiling.CUBE, keys: Sequence[str] = ()) -> DataFrame:
    """Cubes of labelled pixels that pass the quality filter, with their stratified split. keys: the scene's columns, if there are many."""
    sized = tiling.with_extents(pixels, keys) if keys else pixels
    h, w = (F.col("height"), F.col("width")) if keys else (height, width)
    cut = tiling.cubify(sized, h, w, size)
    name = F.xxhash64(*keys, "cube_no") if keys else F.col("cube_no")
    cut = cut.withColumn("cube_id", name).drop("cube_no", *(["height", "width"] if keys else []))
    good = tiling.good_cubes(cut, [b.lower() for b in B.BANDS], max_black, size * size).select("cube_id")
    kept = cut.join(good, "cube_id", "left_semi")
    return kept.join(splitting.stratified_split(kept.select("cube_id", "label")).select("cube_id", "split"), "cube_id")


def detect_dieback(series: DataFrame, before: str, days: int = 90, method: str = "zones", keys: Sequence[str] = (), **how) -> DataFrame:
    """Pixels that left their cluster; clusters from the `days` of series up to `before`, by zones or by the pixel graph, scene by scene."""
    window = series.filter(F.col("date").between(F.date_sub(F.lit(before).cast("date"), days), F.lit(before).cast("date")))
    if method == "zones":
        partition = zones.zone_partition(window, keys=keys, **how)
    elif method == "graph":
        edges = cut_lineage(pixel_graph.pixel_graph(window, keys=keys))
        partition = pixel_graph.louvain_partition(edges, window.select(*keys, "i", "j").distinct(), keys=keys, **how)
        statistics = S.cluster_statistics(S.clustered(window, partition, keys), keys)
        partition = pixel_graph.merge_small_clusters(edges, partition, statistics, keys=keys)
    else:
        raise ValueError("method must be 'zones' or 'graph'")
    return S.predict_dieback(window, cut_lineage(partition), keys=keys)


def segment(pixels: DataFrame, model: inference.Model, height: int | None = None, width: int | None = None, keys: Sequence[str] = (), **how) -> DataFrame:
    """Class and probability of every pixel, and the regions of equal class; with keys, of many scenes (classes has to be given)."""
    names = [f"{b.lower()}_norm" for b in B.BANDS] + [n.lower() for n in B.INDICES]
    if keys:
        return pixel_graph.regions(inference.predict_scenes(pixels, keys, names, model, **how), "pred", keys=keys)
    return pixel_graph.regions(inference.predict_scene(pixels, names, model, height, width, **how), "pred")


#: Channels of red, green and blue, and the near infrared shown as red.
COLORS = {"rgb": {3: "red", 2: "green", 1: "blue"}, "nir": {7: "red"}}


def display_values(pixels: DataFrame, colors: str = "rgb", size: int = 512, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """path, i, j, color, stretched: what a viewer shows of long pixels (path, channel, i, j, v).

    Each image is shrunk by whole blocks until its width fits `size`, then stretched over all shown values between the
    low and the high percentile.
    """
    names = COLORS[colors]
    shown = pixels.filter(F.col("channel").isin(*names)).withColumn("color", F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("channel")])
    by = shown.groupBy("path").agg(F.greatest(F.lit(1), F.ceil((F.max("j") + 1) / size).cast("int")).alias("_by"))
    block = lambda a: F.floor(F.col(a) / F.col("_by")).cast("int").alias(a)
    small = shown.join(by, "path").groupBy("path", "color", block("i"), block("j")).agg(F.avg("v").alias("v"))
    return metrics.contrast_stretch(small, "v", low, high, ["path"]).select("path", "i", "j", "color", "stretched")
