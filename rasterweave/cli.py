"""Command line over the pipelines: python -m rasterweave.cli COMMAND SUBCOMMAND ..."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from rasterweave.sources import params as P

# Insect codes that labelize accepts.
INSECTS = ("IBM", "IBS", "IBB", "IBD", "IBL", "IBW", "IBF")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rasterweave")
    commands = top.add_subparsers(dest="command", required=True)

    load = commands.add_parser("load-data").add_subparsers(dest="sub", required=True)
    train = load.add_parser("S2-train")
    train.add_argument("-s", "--source", required=True)
    train.add_argument("-d", "--destination", required=True)
    train.add_argument("--start-date", required=True)
    train.add_argument("--end-date", required=True)
    train.add_argument("--custom-buffer", type=int, default=P.TRAIN_BUFFER_M)
    train.add_argument("--max-cloud-cover", type=int, default=P.MAX_CLOUD)
    train.add_argument("--step-cloud-cover", type=int, default=P.STEP_CLOUD)
    train.add_argument("--aoi-indices", type=int, nargs="*", default=[])
    train.add_argument("--saving-location", choices=("local", "gcs"), default="local")
    predict = load.add_parser("S2-predict")
    predict.add_argument("-s", "--source", required=True)
    predict.add_argument("-d", "--destination", required=True)
    predict.add_argument("--before-date", required=True)
    predict.add_argument("--max-date-diff-in-days", type=int, default=P.PREDICT_DAYS)
    predict.add_argument("-b", "--buffer", type=int, default=P.PREDICT_BUFFER_M)
    predict.add_argument("-f", "--filter", action="store_true")
    fordead = load.add_parser("S2-fordead")
    fordead.add_argument("-s", "--source", required=True)
    fordead.add_argument("-d", "--destination", required=True)
    fordead.add_argument("--before-date", required=True)
    fordead.add_argument("--date-diff-in-days", type=int, default=P.FORDEAD_DAYS)
    fordead.add_argument("-b", "--buffer", type=int, default=P.PREDICT_BUFFER_M)
    fordead.add_argument("-f", "--filter", action="store_true")
    fordead.add_argument("-t", "--threshold", type=float, default=P.FORDEAD_BLACK)
    for one in (train, predict, fordead):
        one.add_argument("--catalog", required=True, help="Parquet with image_id, ts, tile_id, cloud_pct and the box of each image")
        one.add_argument("--pixels", help="Parquet with image_id, i, j, scl, b1 ... b12: dark images are judged by it and the 24 channels are written")

    prepare = commands.add_parser("preprocess-data").add_subparsers(dest="sub", required=True)
    labelize = prepare.add_parser("labelize")
    labelize.add_argument("-s", "--source-folder", required=True)
    labelize.add_argument("-d", "--destination-folder", help="default: the source folder with the suffix")
    labelize.add_argument("-g", "--gdf-path", required=True)
    labelize.add_argument("-y", "--year", type=int, required=True)
    labelize.add_argument("-n", "--num-classes", type=int, required=True)
    labelize.add_argument("-i", "--insects", nargs="*", choices=INSECTS, default=list(INSECTS))
    labelize.add_argument("-suf", "--suffix", default="annotated")
    labelize.add_argument("--severity-map", required=True, help="Parquet with n_steps, severity, step")
    labelize.add_argument("--combinations", help="Parquet with tree, pest, combo; needed for 120 and 255 classes")
    labelize.add_argument("--frames", help="Parquet with image_id, x0, y0, pixel, height, width; needed for more than one image")
    cubify = prepare.add_parser("cubify")
    cubify.add_argument("-s", "--source-folder", required=True)
    cubify.add_argument("-d", "--destination-folder", help="default: beside the source")
    cubify.add_argument("-c", "--cube-size", type=int, default=256)
    cubify.add_argument("-f", "--filename", default="cubes")
    keep = prepare.add_parser("filter")
    keep.add_argument("-s", "--source-file", required=True)
    keep.add_argument("-d", "--destination-path", required=True)
    keep.add_argument("-t", "--threshold", type=float, default=0.8)
    keep.add_argument("--delete-original", action="store_true")

    show = commands.add_parser("visualize").add_subparsers(dest="sub", required=True)
    tif = show.add_parser("tif", help="write the stretched and shrunk values that a viewer shows")
    tif.add_argument("-s", "--source", required=True)
    tif.add_argument("-d", "--destination", required=True)
    tif.add_argument("-m", "--multiple", action="store_true", help="all images of a folder; else the source is one file")
    tif.add_argument("-c", "--compression", type=int, default=512)
    tif.add_argument("--colors", choices=("rgb", "nir"), default="rgb")
    tif.add_argument("--suffix", default=".tif")
    for one in (labelize, cubify, tif):
        one.add_argument("-r", "--recursive", action=argparse.BooleanOptionalAction, default=True)
    h5 = show.add_parser("h5-cubes", help="write the cubes with the page that each is shown on")
    h5.add_argument("-s", "--source-file", required=True)
    h5.add_argument("-d", "--destination", required=True)
    h5.add_argument("-n", "--nb-per-grid", type=int, default=9)
    h5.add_argument("-c", "--compression", type=int, help="shrink cubes of long pixels to this width by whole blocks")

    utils = commands.add_parser("utils").add_subparsers(dest="sub", required=True)
    for name in ("download-from-gcs", "upload-to-gcs"):
        one = utils.add_parser(name)
        one.add_argument("-p", "--gcs-project-name", help="the project that the storage connector uses")
        one.add_argument("-b", "--gcs-bucket-name", required=True)
        one.add_argument("-s", "--source-path", required=True)
        one.add_argument("-d", "--destination-path", required=True)
        one.add_argument("-e", "--extension", nargs="*", default=[])
    return top


def _acquire(spark: SparkSession, a: argparse.Namespace) -> None:
    """The three load-data commands: choose images, and write them (or with pixels their 24 channels) in the command's layout."""
    from pyspark.sql import functions as F

    from rasterweave.functions.bands import BANDS
    from rasterweave.functions.masks import masked
    from rasterweave.plans import pipelines
    from rasterweave.sources.files import LAYOUTS, write_layout

    images, areas = spark.read.parquet(a.catalog), spark.read.parquet(a.source)
    pixels = spark.read.parquet(a.pixels) if a.pixels else None
    where = getattr(a, "saving_location", "gcs" if a.destination.startswith("gs://") else "local")
    if (where == "gcs") != a.destination.startswith("gs://"):
        raise ValueError("a destination for 'gcs' begins with gs://, another one doesn't")
    if getattr(a, "filter", False) and pixels is None:
        raise ValueError("-f judges images by their pixels: give --pixels")
    judged = pixels.withColumn("b1", masked(F.col("b1"), F.col("scl"))) if pixels is not None else None
    if a.sub == "S2-train":
        request = P.TrainingRequest(a.source, a.custom_buffer, a.start_date, a.end_date, a.max_cloud_cover, a.step_cloud_cover, tuple(a.aoi_indices), where)
        chosen, layout = pipelines.select_for_training(images, areas, request), "train"
    elif a.sub == "S2-predict":
        chosen, layout = pipelines.select_for_prediction(images, areas, P.PredictionRequest(a.source, a.buffer, a.before_date, a.max_date_diff_in_days, a.filter), judged), "predict"
    else:
        chosen, layout = pipelines.select_for_fordead(images, areas, P.FordeadRequest(a.source, a.buffer, a.before_date, a.date_diff_in_days, a.filter, a.threshold), judged), "fordead"
    chosen = chosen.withColumnRenamed("label", "aoi").withColumn("date", F.to_date("ts"))
    if pixels is None:
        write_layout(chosen, a.destination, [c for c in LAYOUTS[layout] if c in chosen.columns])
        return
    channels = pipelines.acquired(pixels, chosen, ["image_id", "i", "j"])
    if layout == "predict":
        channels = channels.join(chosen.select("image_id", "aoi").distinct(), "image_id")
    if layout == "fordead":
        names = [f"{b.lower()}_norm" for b in BANDS]
        channels = channels.unpivot(["image_id", "tile_id", "date", "i", "j", "cloud"], names, "band", "value")
    write_layout(channels, a.destination, LAYOUTS[layout])


def _labelize(spark: SparkSession, a: argparse.Namespace) -> None:
    from pyspark.sql import functions as F

    from rasterweave.plans import pipelines
    from rasterweave.sources.files import write_layout

    steps_of = pipelines.COMBINED_STEPS.get(a.num_classes, a.num_classes)
    rows = spark.read.parquet(a.severity_map).filter(F.col("n_steps") == steps_of)
    steps = {r["severity"]: r["step"] for r in rows.collect()}  # the caller's table of a few steps
    pixels = spark.read.option("recursiveFileLookup", str(a.recursive).lower()).parquet(a.source_folder)
    read = lambda path: spark.read.parquet(path) if path else None
    keys = ["image_id"] if "image_id" in pixels.columns else []
    if keys and not a.frames:
        if pixels.select("image_id").distinct().limit(2).count() > 1:
            raise ValueError("there are several images: give --frames, so that each gets its own annotations")
        keys = []
    out = pipelines.labelize(pixels, spark.read.parquet(a.gdf_path), a.year, a.num_classes, a.insects, steps, read(a.combinations), read(a.frames), keys)
    write_layout(out, a.destination_folder or f"{a.source_folder.rstrip('/')}_{a.suffix}", [])


def run(spark: SparkSession, argv: Sequence[str]) -> None:
    from pyspark.sql import functions as F

    from rasterweave.functions.bands import BANDS
    from rasterweave.operators import tiling
    from rasterweave.plans import pipelines
    from rasterweave.sources.files import chunk_pixels, delete_path, read_cubes, read_rasters, write_layout
    from rasterweave.sources.transfer import copy_files

    a = parser().parse_args(argv)
    if a.command == "load-data":
        _acquire(spark, a)
    elif a.command == "utils":
        bucket = lambda path: f"gs://{a.gcs_bucket_name}/{path.lstrip('/')}"
        down = a.sub == "download-from-gcs"
        if a.gcs_project_name:
            spark.sparkContext._jsc.hadoopConfiguration().set("fs.gs.project.id", a.gcs_project_name)
        copy_files(spark, bucket(a.source_path) if down else a.source_path, a.destination_path if down else bucket(a.destination_path), a.extension)
    elif a.sub == "tif":
        single = a.source.lower().endswith(a.suffix.lower())
        if single == a.multiple:
            raise ValueError("-m goes with a folder, a file without it" if single else "a folder of images needs -m")
        pixels = chunk_pixels(read_rasters(spark, a.source, a.suffix, a.recursive and not single))
        write_layout(pipelines.display_values(pixels, a.colors, a.compression), a.destination, [])
    elif a.sub == "h5-cubes":
        cubes = read_cubes(spark, a.source_file)
        if a.compression:
            shown = [c for c in cubes.columns if c not in ("cube_id", "r", "c", "i", "j", "ti", "tj", "cube_no", "label")]
            by = max(1, -(-((cubes.agg(F.max("c")).first()[0] or 0) + 1) // a.compression))
            cubes = tiling.shrink(cubes.select("cube_id", F.col("r").alias("i"), F.col("c").alias("j"), *shown), by, shown, ["cube_id"])
        write_layout(cubes.join(tiling.pages(cubes.select("cube_id").distinct(), ["cube_id"], a.nb_per_grid), "cube_id"), a.destination, [])
    elif a.sub == "labelize":
        _labelize(spark, a)
    elif a.sub == "cubify":
        pixels = spark.read.option("recursiveFileLookup", str(a.recursive).lower()).parquet(a.source_folder)
        # An image is known by its id or, without one, by its folder.
        scene = "image_id" if "image_id" in pixels.columns else "path"
        named = pixels if scene in pixels.columns else pixels.select("*", F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("path"))
        out = tiling.cubify(tiling.with_extents(named, [scene]), F.col("height"), F.col("width"), a.cube_size).drop("height", "width")
        if scene == "image_id":  # cubes of many images; one name for each
            out = out.withColumn("cube_id", F.xxhash64(scene, "cube_no"))
        write_layout(out, f"{(a.destination_folder or a.source_folder.rstrip('/') + '_cubes').rstrip('/')}/{a.filename}", [])
    else:
        pixels = read_cubes(spark, a.source_file)
        write_layout(pixels.join(tiling.good_cubes(pixels, [b.lower() for b in BANDS], a.threshold).select("cube_id"), "cube_id", "left_semi"), a.destination_path, [])
        if a.delete_original and a.source_file.rstrip("/") != a.destination_path.rstrip("/"):
            delete_path(spark, a.source_file)


def main() -> None:
    import sys

    run(SparkSession.builder.appName("rasterweave").getOrCreate(), sys.argv[1:])


if __name__ == "__main__":
    main()
