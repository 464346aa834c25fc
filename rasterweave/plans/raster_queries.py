"""One query per operator of the raster engine, over the logical inputs of fixtures.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.functions import bands as B
from rasterweave.functions import masks as M
from rasterweave.functions.tiles import one_row_per_id
from rasterweave.operators import catalog as C
from rasterweave.operators import inference, labels, metrics, pixel_graph, splitting, tiling, zones
from rasterweave.operators import series as S
from rasterweave.plans import fixtures as X
from rasterweave.plans import pipelines
from rasterweave.session import shared_folder
from rasterweave.sources import files
from rasterweave.sources.params import FordeadRequest, PredictionRequest, TrainingRequest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def fixed(c: Column, digits: int = 6) -> Column:
    """c cut to so many decimals in double arithmetic; round() goes through BigDecimal and would dominate wide projections."""
    k = F.lit(float(10**digits))
    return F.floor(c * k + 0.5) / k


# --- time series and dieback ------------------------------------------------


@query
def historical_window(s, d):
    return S.historical_window(X.series(s, d), "2022-01-16", "2022-03-17", [1, 4]).select("i", "j", "t", "c", *r6("v"))


def _clustered(s, d):
    return S.clustered(X.series(s, d), X.partition(s, d))


@query
def cluster_centroid(s, d):
    return S.cluster_statistics(_clustered(s, d)).select("grid", "cluster_id", "t", "c", *r6("centroid", "spread"))


@query
def adaptive_threshold(s, d):
    return S.thresholds(S.cluster_statistics(_clustered(s, d))).select("grid", "cluster_id", "c", *r6("threshold"))


def _deviated(s, d):
    rows = _clustered(s, d)
    statistics = S.cluster_statistics(rows)
    return S.deviations(rows, statistics, S.thresholds(statistics))


@query
def pixel_deviation(s, d):
    return _deviated(s, d).select("grid", "cluster_id", "i", "j", "t", "c", *r6("deviation"))


@query
def consecutive_exceedance(s, d):
    return S.sustained(S.exceedances(_deviated(s, d)))


@query
def anomaly_degree(s, d):
    return S.anomaly_degree(S.sustained(S.exceedances(_deviated(s, d)), 2))


@query
def predict_dieback(s, d):
    return S.predict_dieback(X.series(s, d), X.partition(s, d), "2022-04-16", 90)


@query
def cluster_medians(s, d):
    return S.cluster_medians(X.series(s, d), X.partition(s, d)).select("date", "grid", "cluster_id", "c", *r6("median"))


# --- pixel expressions ------------------------------------------------------

PIXEL = ["image_id", "i"]


@query
def band_normalize(s, d):
    return X.raw_pixels(s, d).select(*PIXEL, *[fixed(B.normalize(F.col(b.lower()), *p), 8).alias(b.lower()) for b, p in B.BANDS.items()])


@query
def band_denormalize(s, d):
    norm = X.raw_pixels(s, d).select(*PIXEL, *[B.normalize(F.col(b.lower()), *p).alias(b.lower()) for b, p in B.BANDS.items()])
    return norm.select(*PIXEL, *[fixed(B.denormalize(F.col(b), *B.BANDS[b.upper()])).alias(b) for b in X.BAND_COLUMNS])


@query
def vegetation_indices(s, d):
    return X.raw_pixels(s, d).select(*PIXEL, *[fixed(B.index_scaled(n)).alias(n.lower()) for n in B.INDICES])


@query
def index_values(s, d):
    return X.raw_pixels(s, d).select(*PIXEL, *[B.index_value(n).cast("float").alias(n.lower()) for n in B.INDICES])


@query
def final_bands(s, d):
    out = B.final_bands(X.raw_pixels(s, d), PIXEL)
    return out.select(*PIXEL, *[fixed(F.col(c), 8).alias(c) for c in out.columns if c not in PIXEL])


@query
def cr_swir(s, d):
    return B.append_bands(B.final_bands(X.raw_pixels(s, d), PIXEL), ["CR_SWIR"]).select(*PIXEL, *r6("cr_swir"))


@query
def rescale(s, d):
    return X.raw_pixels(s, d).select(*PIXEL, F.round(B.rescaled(B.normalize(F.col("b8"), *B.BANDS["B8"])), 6).alias("v"))


@query
def scl_masks(s, d):
    return X.raw_pixels(s, d).select(*PIXEL, M.masked(F.col("b4"), F.col("scl")).alias("b4"), M.cloudy(F.col("scl")).alias("cloud"))


@query
def black_mask(s, d):
    return X.raw_pixels(s, d).select(*PIXEL, M.unmask_black(F.array(*X.BAND_COLUMNS)).alias("v")).select(*PIXEL, F.col("v")[0].alias("b1"), F.col("v")[7].alias("b8"))


@query
def label_shift(s, d):
    return X.cube_pixels(s, d).select("cube_id", "r", "c", M.shift_label(F.col("label")).alias("label"))


@query
def binary_labels(s, d):
    return X.seg_pixels(s, d).select("cube_id", "r", "c", M.binary_label(F.col("label")).alias("label"))


def _steps(s, d, n: int) -> dict[str, int]:
    return {r["severity"]: r["step"] for r in X.read(s, d, "severity_map").filter(F.col("n_steps") == n).collect()}  # a table of 16 rows


@query
def severity_class(s, d):
    return X.read(s, d, "part").select("p_partkey", M.severity_class(F.expr(X.SEVERITY_OF_SIZE), _steps(s, d, 4)).alias("k"))


@query
def multi_class_code(s, d):
    rows = X.read(s, d, "part").select("p_partkey", F.expr(X.SEVERITY_OF_SIZE).alias("severity"), F.col("p_brand").alias("pest"), F.expr("p_size % 5").alias("tree"))
    combos = X.read(s, d, "part").filter("p_partkey % 3 = 0").groupBy(F.col("p_brand").alias("pest"), F.expr("p_size % 5").alias("tree")).agg(F.min(F.expr("p_partkey % 50")).alias("combo"))
    steps = X.read(s, d, "severity_map").filter("n_steps = 2").select("severity", "step")
    out = rows.join(combos, ["pest", "tree"], "left").join(F.broadcast(steps), "severity", "left")  # a table of 16 rows
    return out.select("p_partkey", M.multi_class_code(F.col("severity"), F.col("step"), F.col("combo"), 2).cast("long").alias("k"))


@query
def standardize(s, d):
    stats = metrics.channel_stats(X.cube_pixels(s, d), X.BAND_COLUMNS)
    long = X.cube_pixels(s, d).unpivot(["cube_id", "r", "c"], X.BAND_COLUMNS, "band", "value")
    return long.join(F.broadcast(stats), "band").select("cube_id", "r", "c", "band", F.round(M.standardized(F.col("value"), F.col("mean"), F.col("std")), 5).alias("z"))  # one row per band


# --- catalog ----------------------------------------------------------------


@query
def date_filter(s, d):
    return X.catalog(s, d).filter(C.in_days(F.col("ts"), "2021-03-01", "2021-09-01")).select("image_id", "tile_id", "ts")


@query
def cloud_filter(s, d):
    return C.clear_images(X.catalog(s, d), 20).select("image_id", "cloud_pct")


@query
def clearest_image(s, d):
    return C.clearest(X.catalog(s, d), "tile_id", 20, "2021-01-01", "2022-01-01").select("tile_id", "image_id")


@query
def latest_images(s, d):
    return C.latest(X.catalog(s, d).filter("ts < TIMESTAMP_NTZ'2026-01-01'"), ["tile_id"], 10).select("tile_id", "image_id", "ts")


@query
def latest_per_tile(s, d):
    areas = X.catalog(s, d).filter("ts < TIMESTAMP_NTZ'2026-01-01'").withColumn("area", F.substring("tile_id", 1, 2))
    return C.latest_per_tile(areas, "area", "tile_id", 40).select("area", "tile_id", "image_id")


@query
def min_cloud_ladder(s, d):
    return C.cloud_ladder(X.catalog(s, d).filter("cloud_pct >= 0"), ["tile_id"], n_min=5, n_max=8).select("tile_id", "image_id", "rung")


@query
def collection_size(s, d):
    return C.collection_sizes(X.catalog(s, d), ["tile_id"])


@query
def image_blackness(s, d):
    masked = X.raw_pixels(s, d).select("image_id", M.masked(F.col("b1"), F.col("scl")).alias("b1"))
    return C.bright_images(masked, "image_id", "b1", 0.8).select("image_id", *r6("black_share"))


@query
def fordead_window(s, d):
    return C.days_from(X.catalog(s, d), "2020-06-01", 730).select("tile_id", "image_id", "nr")


@query
def image_mask_join(s, d):
    pixels = X.raw_pixels(s, d)
    clouds = pixels.groupBy("image_id").agg(F.sum(M.cloudy(F.col("scl"))).alias("cloudy"))
    values = pixels.groupBy("image_id").agg(F.max("b8").alias("b8"))
    return C.with_masks(values, clouds, ["image_id"])


@query
def band_unpivot(s, d):
    return C.unpivot_bands(X.raw_pixels(s, d).drop("scl"), PIXEL, X.BAND_COLUMNS)


@query
def aoi_naming(s, d):
    return C.name_areas(one_row_per_id(X.read(s, d, "aoi"), "aoi_id", "name"), "aoi_id", "name").select("aoi_id", "label")


def _areas(s, d, buffer_m: float):
    return C.area_boxes(one_row_per_id(X.read(s, d, "aoi"), "aoi_id", "geometry"), "geometry", buffer_m).drop("geometry")


@query
def aoi_boxes(s, d):
    return _areas(s, d, 2560)


@query
def aoi_footprints(s, d):
    # Images of one footprint meet the same areas, so each footprint is joined once, with the number of its images.
    footprints = X.catalog(s, d).groupBy("xmin", "ymin", "xmax", "ymax").agg(F.count(F.lit(1)).alias("n"), F.max("image_id").alias("image_id"))
    return C.footprint_join(footprints, _areas(s, d, 2560), 50_000.0).groupBy("aoi_id").agg(F.sum("n").alias("n_images"), F.max("image_id").alias("last_image"))


# --- tiling -----------------------------------------------------------------


@query
def cubify(s, d):
    p = X.grid_pixels(s, d)
    return tiling.cubify(p, X.grid_height(p), X.GRID_WIDTH, 16).select("cube_no", "r", "c", "v")


def _tiles(s, d):
    p = X.grid_pixels(s, d)
    h = X.grid_height(p)
    return tiling.overlap_tiles(p, h, X.GRID_WIDTH, 16, 6), h


@query
def overlap_tiles(s, d):
    return _tiles(s, d)[0].groupBy("oi", "oj").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"), F.max("r").alias("r"), F.max("c").alias("c"))


@query
def crop_rim(s, d):
    t, h = _tiles(s, d)
    return tiling.crop_rim(t, h, X.GRID_WIDTH, 16, 2).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))


def _probabilities(df: DataFrame) -> DataFrame:
    a = (F.col("v") * 7 + F.col("oi") + F.col("oj") * 3) % 16  # sixteenths: sums are exact, so ties are ties in both engines
    return df.withColumn("prob", F.array(a / 16, 1 - a / 16))


@query
def overlap_add_merge(s, d):
    return tiling.overlap_mean(_probabilities(_tiles(s, d)[0]), classes=2).select("i", "j", "k", *r6("p"))


@query
def tiled_prediction(s, d):
    t, h = _tiles(s, d)
    return inference.merge_tiles(_probabilities(t), h, X.GRID_WIDTH, 16, 2, 2).select("i", "j", "pred", *r6("best"))


@query
def rotate_cubes(s, d):
    return tiling.rotate_cubes(X.seg_pixels(s, d), 8, F.pmod("cube_id", F.lit(4))).select("cube_id", "r", "c", "label")


@query
def cube_quality_filter(s, d):
    return tiling.good_cubes(X.cube_pixels(s, d), X.BAND_COLUMNS, 0.1).select("cube_id", *r6("black_share"))


@query
def cube_pages(s, d):
    return tiling.pages(X.read(s, d, "orders").select("o_custkey", "o_orderkey"), ["o_orderkey"], 9, ["o_custkey"]).select("o_custkey", "o_orderkey", "page")


@query
def shrink(s, d):
    return tiling.shrink(X.grid_pixels(s, d), 4, ["v"]).select("i", "j", *r6("v"))


# --- labels -----------------------------------------------------------------


@query
def rasterize_labels(s, d):
    return labels.burnt(X.rectangles(s, d), "geometry", "label", "poly_seq", (100, 100))


@query
def rasterize_overlay(s, d):
    return labels.touched_cells(X.rectangles(s, d), "geometry", bounds=(100, 100)).select("i", "j").distinct()


@query
def label_combine(s, d):
    return labels.labelled(X.grid_pixels(s, d), labels.burnt(X.rectangles(s, d), "geometry", "label", "poly_seq", (100, 100)), F.col("v") % 7 == 0).select("i", "j", "label")


@query
def annotation_filter(s, d):
    rows = one_row_per_id(X.read(s, d, "annotations"), "poly_seq", "capture_year", "pest_species_code", "labels")
    return labels.annotations_of(rows, 2020, ["FPZ", "KZH"], 5).select("poly_seq", "pest_species_code", "labels")


@query
def rasterize_annotations(s, d):
    """Every annotation polygon in pixels of 10 m: how many it touches."""
    rows = one_row_per_id(X.read(s, d, "annotations"), "poly_seq", "geometry")
    pixels = F.transform("geometry", lambda v: F.struct((v["x"] / 10).alias("x"), (v["y"] / 10).alias("y")))
    return labels.touched_cells(rows.select("poly_seq", pixels.alias("ring")), "ring").groupBy("poly_seq").agg(F.count(F.lit(1)).alias("n_pixels"))


# --- evaluation -------------------------------------------------------------


@query
def confusion_counts(s, d):
    return metrics.confusion(X.seg_pixels(s, d))


@query
def class_metrics(s, d):
    return metrics.class_metrics(X.seg_pixels(s, d), 6).select("class", "tp", "predicted", "actual", *r6("iou", "precision", "recall", "f1"))


@query
def overall_accuracy(s, d):
    return metrics.overall_accuracy(X.seg_pixels(s, d)).select(*r6("accuracy", "accuracy_fg"))


def _scored(s, d):
    return inference.classes(X.scored_pixels(s, d))


@query
def softmax_argmax(s, d):
    return _scored(s, d).select("image_id", "i", "pred", *r6("best"))


@query
def dice_loss(s, d):
    return metrics.dice_loss(_scored(s, d), 5).select(*r6("loss"))


@query
def combined_loss(s, d):
    return metrics.combined_loss(_scored(s, d), 5).select(*r6("dice", "cross_entropy", "false_positives", "loss"))


@query
def label_counts(s, d):
    return metrics.label_counts(X.cube_pixels(s, d))


@query
def healthy_only_share(s, d):
    return metrics.healthy_share(X.cube_pixels(s, d)).select("n_cubes", "n_healthy", *r6("share"))


@query
def position_accuracy(s, d):
    return metrics.position_accuracy(X.seg_pixels(s, d)).select("r", "c", *r6("accuracy"))


@query
def binary_accuracy(s, d):
    return metrics.binary_accuracy(X.seg_pixels(s, d)).select("r", "c", *r6("accuracy"))


@query
def graded_accuracy(s, d):
    return metrics.graded_accuracy(X.seg_pixels(s, d)).select("r", "c", *r6("accuracy"))


@query
def ring_accuracy(s, d):
    return metrics.ring_accuracy(X.seg_pixels(s, d), 8, 3).select("zone", "n", *r6("accuracy", "std"))


@query
def vote_mode(s, d):
    votes = X.read(s, d, "lineitem").selectExpr("l_orderkey AS pixel", "CAST(l_partkey % 4 - 1 AS INT) AS k")
    return metrics.vote(votes, ["pixel"], "k")


@query
def contrast_stretch(s, d):
    return metrics.contrast_stretch(X.grid_pixels(s, d), "v").select("i", "j", *r6("stretched"))


@query
def band_contrast(s, d):
    long = C.unpivot_bands(X.raw_pixels(s, d).select(*PIXEL, "b4", "b3", "b2"), PIXEL, ["b4", "b3", "b2"])
    return metrics.contrast_stretch(long, "value", 0.01, 0.99, ["band"]).select(*PIXEL, "band", *r6("stretched"))


@query
def rgb_composite(s, d):
    return B.composite(X.raw_pixels(s, d), PIXEL, ["rgb", "nir"])


@query
def box_blur(s, d):
    p = X.grid_pixels(s, d)
    return metrics.box_blur(p, "v", X.grid_height(p), X.GRID_WIDTH).select("i", "j", *r6("v"))


@query
def masked_channel_stats(s, d):
    return metrics.channel_stats(X.cube_pixels(s, d), X.BAND_COLUMNS).select("band", *r6("mean", "std"))


@query
def masked_batch_norm(s, d):
    return metrics.masked_batch_norm(X.cube_pixels(s, d), X.BAND_COLUMNS).select("band", F.round("mean", 4).alias("mean"), F.round("var", 2).alias("var"), F.round("scale", 9).alias("scale"))


# --- splits -----------------------------------------------------------------


def _claims(s, d):
    return X.cube_pixels(s, d).select("cube_id", "label")


@query
def stratified_split(s, d):
    return splitting.stratified_split(_claims(s, d))


@query
def random_split(s, d):
    return splitting.ranked_split(X.read(s, d, "orders").select("o_orderkey"), "o_orderkey")


@query
def remaining_cubes(s, d):
    cubes = X.seg_pixels(s, d).select("cube_id").distinct()
    taken = splitting.stratified_split(_claims(s, d)).filter("stratum IN (2, 3)")
    return splitting.not_in(cubes, taken, "cube_id")


@query
def leftover_cubes(s, d):
    """The cubes outside the training set of the split."""
    cubes = X.seg_pixels(s, d).select("cube_id").distinct()
    return splitting.not_in(cubes, splitting.stratified_split(_claims(s, d)).filter("split = 'train'"), "cube_id")


# --- zones and graphs -------------------------------------------------------


def _pixels(s, d):
    return X.partition(s, d).filter("grid = 0").select("i", "j")


@query
def overlap_zones(s, d):
    return zones.overlap_zones(_pixels(s, d))


@query
def zone_pixel_roundtrip(s, d):
    return zones.zone_pixels(zones.zone_index(zones.overlap_zones(_pixels(s, d)), 25), 25).select("grid", "zi", "zj", "idx", "pi", "pj")


@query
def zone_kmeans(s, d):
    return zones.zone_partition(X.series(s, d))


@query
def davies_bouldin(s, d):
    return zones.davies_bouldin(X.read(s, d, "embeddings"), "label", "embedding").select(*r6("score"))


@query
def label_image(s, d):
    return zones.label_image(_pixels(s, d), X.partition(s, d).filter("cluster_id <> 3"))


@query
def cluster_borders(s, d):
    return zones.cluster_borders(zones.label_image(_pixels(s, d), X.partition(s, d).filter("grid = 0")))


@query
def pixel_neighbours(s, d):
    return pixel_graph.neighbours(_pixels(s, d))


def _graph(s, d):
    return pixel_graph.pixel_graph(X.series(s, d))


@query
def pixel_graph_edges(s, d):
    return _graph(s, d).select("i", "j", "i2", "j2", *r6("weight"))


def _first_grid(s, d):
    return X.partition(s, d).filter("grid = 0")


@query
def cluster_adjacency(s, d):
    return pixel_graph.cluster_adjacency(_graph(s, d), _first_grid(s, d))


@query
def centroid_distance(s, d):
    centroids = S.cluster_statistics(S.clustered(X.series(s, d), _first_grid(s, d))).select("c", "cluster_id", "t", "centroid")
    pairs = pixel_graph.cluster_adjacency(_graph(s, d), _first_grid(s, d))
    channels = centroids.select("c").distinct()
    return pixel_graph.centroid_distances(centroids, pairs.withColumn("c", F.explode(F.lit(list(range(8))))).join(F.broadcast(channels), "c"), ["c"]).select("c", "a", "b", *r6("distance"))  # eight channels


@query
def louvain_partition(s, d):
    return pixel_graph.louvain_partition(_graph(s, d), _pixels(s, d), resolution=2.0)


@query
def merge_small_clusters(s, d):
    part = pixel_graph.louvain_partition(_graph(s, d), _pixels(s, d), resolution=20.0)
    centroids = S.cluster_statistics(S.clustered(X.series(s, d), part)).select("grid", "cluster_id", "t", "c", "centroid")
    return pixel_graph.merge_small_clusters(_graph(s, d), part, centroids)


@query
def connected_components(s, d):
    return pixel_graph.regions(X.grid_pixels(s, d), "k").select("i", "j", "k", "region")


@query
def region_sizes(s, d):
    found = pixel_graph.regions(X.grid_pixels(s, d), "k")
    return found.groupBy("region", "k").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"))


@query
def region_outlines(s, d):
    return pixel_graph.outlines(pixel_graph.regions(X.grid_pixels(s, d), "k"))


# --- models and pipelines ---------------------------------------------------


def _stub(x):
    """A model of two bands, for the tests: three linear scores."""
    import numpy as np

    return np.stack([x[:, 0] / 100, x[:, 1], (x[:, 0] + x[:, 1]) / 150], axis=1)


@query
def scene_prediction(s, d):
    p = X.grid_pixels(s, d).withColumn("w", F.col("v") % 7)
    return inference.predict_scene(p, ["v", "w"], _stub, X.grid_height(p), X.GRID_WIDTH, 16, 6, 2, 3).select("i", "j", "pred", *r6("best"))


@query
def prediction_map(s, d):
    rows = X.cube_pixels(s, d)
    return rows.select("cube_id", "r", "c", M.shown(F.col("label"), M.black([F.col(b) for b in X.BAND_COLUMNS]), 9).alias("k"))


@query
def ring_confidence(s, d):
    return metrics.ring_confidence(metrics.ring_accuracy(X.seg_pixels(s, d), 8, 3)).select("zone", *r6("half_width"))


@query
def dieback_by_zones(s, d):
    return pipelines.detect_dieback(X.series(s, d), "2022-04-16")


@query
def dieback_by_graph(s, d):
    return pipelines.detect_dieback(X.series(s, d), "2022-04-16", method="graph", resolution=2.0)


def _aoi(s, d):
    return one_row_per_id(X.read(s, d, "aoi"), "aoi_id", "name", "geometry")


@query
def training_selection(s, d):
    request = TrainingRequest(d, 2560, "2024-05-01", "2024-08-01")
    return pipelines.select_for_training(X.catalog(s, d).filter("cloud_pct >= 0"), _aoi(s, d), request, n_min=2, n_max=2).select("aoi_id", "tile_id", "image_id", "rung")


@query
def prediction_selection(s, d):
    request = PredictionRequest(d, 2560, "2024-08-01", 10)
    return pipelines.select_for_prediction(X.catalog(s, d), _aoi(s, d), request).select("aoi_id", "tile_id", "image_id")


@query
def fordead_selection(s, d):
    request = FordeadRequest(d, 2560, "2024-08-01")
    return pipelines.select_for_fordead(X.catalog(s, d), _aoi(s, d), request).groupBy("aoi_id").agg(F.count(F.lit(1)).alias("n"), F.max("nr").alias("nr"))


# --- many scenes in one plan ------------------------------------------------

SCENE = ["scene"]


@query
def image_extent(s, d):
    return tiling.extents(X.scene_pixels(s, d), SCENE)


def _sized(s, d):
    return tiling.with_extents(X.scene_pixels(s, d), SCENE)


@query
def scene_cubes(s, d):
    return tiling.cubify(_sized(s, d), F.col("height"), F.col("width"), 16).select("scene", "cube_no", "r", "c", "v")


@query
def scenes_merged(s, d):
    h, w = F.col("height"), F.col("width")
    tiles = _probabilities(tiling.overlap_tiles(_sized(s, d), h, w, 16, 6))
    return inference.merge_tiles(tiles, h, w, 16, 2, 2, SCENE).select("scene", "i", "j", "pred", *r6("best"))


@query
def scenes_predicted(s, d):
    p = X.scene_pixels(s, d).withColumn("w", F.col("v") % 7)
    return inference.predict_scenes(p, SCENE, ["v", "w"], _stub, 16, 6, 2, classes=3).select("scene", "i", "j", "pred", *r6("best"))


@query
def scene_regions(s, d):
    return pixel_graph.regions(X.scene_pixels(s, d), "k", keys=SCENE).select("scene", "i", "j", "k", "region")


@query
def scene_labels(s, d):
    polygons = X.rectangles(s, d).withColumn("scene", F.col("poly_seq") % 3)
    return labels.labelled(X.scene_pixels(s, d), labels.burnt(polygons, "geometry", "label", "poly_seq", (100, 100), SCENE), F.col("v") % 7 == 0, SCENE).select("scene", "i", "j", "label")


@query
def scene_blur(s, d):
    return metrics.box_blur(_sized(s, d), "v", F.col("height"), F.col("width"), keys=SCENE).select("scene", "i", "j", *r6("v"))


@query
def scenes_dieback(s, d):
    part = X.partition(s, d).withColumn("scene", F.explode(F.lit([0, 1])))
    return S.predict_dieback(X.scene_series(s, d), part, "2022-04-16", 90, keys=SCENE)


@query
def large_clusters(s, d):
    """The same dieback with medians found by ranks."""
    return S.predict_dieback(X.series(s, d), X.partition(s, d), "2022-04-16", 90, large=True)


# --- polygons, overlays, sets, logs ------------------------------------------


@query
def region_polygons(s, d):
    """Every region's polygon: its rings, the area within them, and how many there are."""
    found = pixel_graph.region_polygons(pixel_graph.regions(X.grid_pixels(s, d), "k"))
    cross = lambda ring: F.aggregate(F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring)), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda x, y: x + y)
    area = F.aggregate("rings", F.lit(0.0), lambda x, r: x + cross(r)) / 2
    return found.select("region", F.size("rings").alias("n_rings"), area.alias("area"))


@query
def cloud_overlay(s, d):
    out = M.overlay([F.col("b4"), F.col("b3"), F.col("b2")], M.cloudy(F.col("scl")) == 1, (255, 0, 255), 0.5)
    return X.raw_pixels(s, d).select(*PIXEL, *[c.alias(n) for c, n in zip(out, ("red", "green", "blue"), strict=True)])


@query
def clipped_pixels(s, d):
    """Image centres as pixels, clipped to the tiles' footprints as areas."""
    tiles = X.read(s, d, "s2_tiles").select(F.col("tile_id").alias("aoi_id"), "geometry")
    centres = X.catalog(s, d).select("image_id", ((F.col("xmin") + F.col("xmax")) / 2).alias("x"), ((F.col("ymin") + F.col("ymax")) / 2).alias("y"))
    return pipelines.clip(centres, tiles, "x", "y").groupBy("aoi_id").agg(F.count(F.lit(1)).alias("n"), F.max("image_id").alias("last"))


@query
def batch_loader(s, d):
    return tiling.batches(X.read(s, d, "orders").select("o_orderkey"), "o_orderkey", 12).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query
def concat_sets(s, d):
    split = splitting.ranked_split(X.read(s, d, "orders").select("o_orderkey"), "o_orderkey")
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'").drop("split")
    return tiling.concat_sets(train, test)


@query
def running_metrics(s, d):
    cents = F.round(F.col("o_totalprice").cast("double") * 100).cast("long")  # whole, so that sums are exact in any order
    log = X.read(s, d, "orders").select("o_custkey", "o_orderkey", cents.alias("v"))
    return metrics.running_metrics(log, ["o_custkey"], "o_orderkey", "v").drop("v")


@query
def combined_classes(s, d):
    """120 classes: severity and combination of the annotations of a year, combinations from the annotations of the year before."""
    rows = one_row_per_id(X.read(s, d, "annotations"), "poly_seq", "capture_year", "pest_severity_code", "pest_species_code", "tree_species_code")
    code = lambda c: F.upper(F.trim(c))
    combos = rows.filter("capture_year = 2019").groupBy(code("tree_species_code").alias("tree"), code("pest_species_code").alias("pest")).agg((F.min("poly_seq") % 50).alias("combo"))
    kept = labels.annotations_of(rows, 2020, ["FPZ"], 120)
    return pipelines.annotation_classes(kept, 120, _steps(s, d, 2), combos).select("poly_seq", F.col("label").cast("long").alias("label"))


# --- files: written, read back ------------------------------------------------


def _folder(s) -> str:
    import uuid

    return f"{shared_folder(s)}/{uuid.uuid4().hex}".removeprefix("file:")


@query
def npy_files(s, d):
    folder = _folder(s)
    files.write_npy(X.scene_pixels(s, d).withColumn("channel", F.lit(0)), folder, "scene", dtype="float64")
    back = files.chunk_pixels(files.read_rasters(s, folder, chunk=32)).filter("v IS NOT NULL")
    return back.select(F.regexp_extract("path", r"(\d+)\.npy$", 1).cast("int").alias("scene"), "i", "j", "v")


@query
def dated_series(s, d):
    folder = _folder(s)
    files.write_npy(X.series(s, d).select(F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("c").alias("channel"), "i", "j", "v"), folder, "date", dtype="float64")
    return files.read_series(s, folder, n_bands=8, scale=2).filter("v IS NOT NULL").select("i", "j", "t", "c", *r6("v"), "date")


@query
def polygon_files(s, d):
    folder = _folder(s)
    polygons = X.rectangles(s, d).withColumn("rings", F.array(F.concat("geometry", F.slice("geometry", 1, 1))))
    files.write_geojson(polygons, folder, "rings", ["poly_seq", "label"])
    lines = s.read.text(folder)
    collection = lines.select(F.format_string('{"features": [%s]}', "value").alias("value"))
    collection.write.text(f"{folder}-c")
    back = files.read_geojson(s, f"{folder}-c", lines=True)
    return back.select(F.col("properties")["poly_seq"].cast("long").alias("poly_seq"), F.col("properties")["label"].cast("int").alias("label"), F.array_min(F.transform("geometry", lambda v: v["x"])).alias("x0"), F.array_max(F.transform("geometry", lambda v: v["y"])).alias("y1"), F.size("geometry").alias("n"))


@query
def layout_files(s, d):
    folder = _folder(s)
    kept = X.catalog(s, d).filter("ts IS NOT NULL").select("image_id", "tile_id", F.to_date("ts").alias("date"), "cloud_pct").withColumn("date", F.date_trunc("year", "date").cast("date"))
    files.save(kept, folder, "train")
    return s.read.parquet(folder).groupBy("tile_id", "date").agg(F.count(F.lit(1)).alias("n"), F.max("image_id").alias("last"))


# --- invariants of what SQL cannot compute ------------------------------------


@query
def zone_kmeans_check(s, d):
    """Zones of the partition: their pixels, and whether each has 1 to 10 clusters, none of a single pixel beside others."""
    part = zones.overlap_zones(zones.zone_partition(X.series(s, d)).withColumnRenamed("grid", "g")).filter("grid = g")
    per = part.groupBy("grid", "zi", "zj", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    one = per.groupBy("grid", "zi", "zj").agg(F.sum("n").alias("n"), (F.count(F.lit(1)).between(1, 10) & ((F.min("n") > 1) | (F.count(F.lit(1)) == 1))).alias("good"))
    return one.select("grid", "zi", "zj", "n", "good")


@query
def louvain_check(s, d):
    """Pixels of the partition, each once, and whether its modularity is above that of the given clusters and of one cluster."""
    edges = _graph(s, d)
    part = pixel_graph.louvain_partition(edges, _pixels(s, d), resolution=2.0)
    own = pixel_graph.modularity(edges, part, 2.0).select(F.col("modularity").alias("m"))
    given = pixel_graph.modularity(edges, _first_grid(s, d), 2.0).select(F.col("modularity").alias("g"))
    counts = part.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("i", "j").alias("n_distinct"))
    return counts.withColumn("better", F.lit(own.first()["m"] > max(given.first()["g"], -1.0)))  # one number each


@query
def small_clusters_check(s, d):
    """After the merge: the pixels, and the clusters of fewer than 8 of them that have a neighbour."""
    edges = _graph(s, d)
    part = pixel_graph.louvain_partition(edges, _pixels(s, d), resolution=20.0)
    centroids = S.cluster_statistics(S.clustered(X.series(s, d), part)).select("grid", "cluster_id", "t", "c", "centroid")
    merged = pixel_graph.merge_small_clusters(edges, part, centroids)
    small = merged.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).filter("n < 8").select(F.col("cluster_id").alias("a"))
    pairs = pixel_graph.cluster_adjacency(edges, merged)
    both = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()
    left = small.join(both, "a", "left_semi").agg(F.count(F.lit(1)).alias("left")).scalar()
    return merged.agg(F.count(F.lit(1)).alias("n_pixels"), F.max(left).alias("n_left"))


@query
def dieback_check(s, d):
    """Pixels found by zones and by graph lie in the image, and n and degree agree."""
    found = [pipelines.detect_dieback(X.series(s, d), "2022-04-16", method=m, **how).withColumn("method", F.lit(m)) for m, how in (("zones", {}), ("graph", {"resolution": 2.0}))]
    rows = found[0].unionByName(found[1]).join(_pixels(s, d).withColumn("known", F.lit(True)), ["i", "j"], "left")
    bad = F.col("known").isNull() | (F.col("n") < 1) | (F.col("n") > F.when(F.col("method") == "zones", 2).otherwise(1)) | ((F.col("n") == 2) != (F.col("degree") == "flagged"))
    return rows.groupBy("method").agg(F.sum(bad.cast("int")).alias("n_bad"), (F.count(F.lit(1)) > 0).alias("some"))
