"""Batch inference with a caller's model, and prediction of whole scenes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.functions.masks import argmax, softmax
from rasterweave.operators.tiling import CUBE, OVERLAP, PADDING, crop_rim, is_whole, overlap_mean, overlap_means, overlap_tiles, with_extents

#: A model: an array (batch, channels) of pixel vectors to scores (batch, classes).
Model = Callable[[np.ndarray], np.ndarray]


class OnnxModel:
    """A model from an ONNX file that was sent to the executors; the session is made once per Python worker."""

    def __init__(self, file: str, dtype: str = "float32"):
        self.file, self.dtype = file, dtype

    def __call__(self, x: np.ndarray) -> np.ndarray:
        session = _session(SparkFiles.get(self.file))
        return session.run(None, {session.get_inputs()[0].name: np.asarray(x, dtype=self.dtype)})[0]


@lru_cache(maxsize=4)
def _session(path: str):
    import onnxruntime

    return onnxruntime.InferenceSession(path, providers=onnxruntime.get_available_providers())


def load_model(spark: SparkSession, path: str, dtype: str = "float32") -> OnnxModel:
    """A model for score_pixels (or, with tiles as input, score_tiles) from an ONNX file, its first input and first output.

    The file is shipped with the job; a missing one raises. Needs onnxruntime on the executors.
    """
    if "://" not in path and not Path(path).is_file():
        raise FileNotFoundError(path)
    spark.sparkContext.addFile(path)
    return OnnxModel(Path(path).name, dtype)


def score_pixels(pixels: DataFrame, bands: Sequence[str], model: Model) -> DataFrame:
    """pixels with `scores`, from a model of single pixels, in Arrow batches; null bands are 0."""
    schema = f"{pixels._jdf.schema().toDDL()}, scores array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[list(bands)].to_numpy(dtype=float, na_value=0.0) if len(batch) else np.zeros((0, len(bands)))
            yield batch.assign(scores=list(np.asarray(model(np.nan_to_num(x)), dtype=float)) if len(batch) else [])

    return pixels.mapInPandas(run, schema)


def score_tiles(tiled: DataFrame, bands: Sequence[str], model: Callable[[np.ndarray], np.ndarray], size: int = CUBE, keys: Sequence[str] = ()) -> DataFrame:
    """keys, oi, oj, r, c, scores: a model of whole tiles, (channels, size, size) to (classes, size, size); a tile is bounded."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(bands), size, size))
        for k, b in enumerate(bands):
            x[k, pdf["r"], pdf["c"]] = pdf[b].fillna(0)
        y = np.asarray(model(x), dtype=float)
        return pd.DataFrame({**{k: pdf[k] for k in keys}, "i": pdf["i"], "j": pdf["j"], "oi": pdf["oi"], "oj": pdf["oj"], "r": pdf["r"], "c": pdf["c"], "scores": [y[:, r, c] for r, c in zip(pdf["r"], pdf["c"], strict=True)]})

    scene = "".join(f"`{k}` {tiled.schema[k].dataType.simpleString()}, " for k in keys)
    return tiled.groupBy(*keys, "oi", "oj").applyInPandas(run, scene + "i int, j int, oi int, oj int, r int, c int, scores array<double>")


def classes(scored: DataFrame, scores: str = "scores") -> DataFrame:
    """scored with prob (softmax), pred (the first greatest) and best (its probability)."""
    return scored.withColumn("prob", softmax(F.col(scores))).withColumns({"pred": argmax(F.col("prob")), "best": F.array_max("prob")})


def merge_tiles(tiled: DataFrame, height: int | Column, width: int | Column, size: int = CUBE, padding: int = PADDING, classes: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """keys, i, j, pred, best from tiles with prob: rims cut off, probabilities averaged, the first greatest class.

    With the number of classes a pixel's probabilities stay together and there is one shuffle instead of two.
    """
    kept = crop_rim(tiled, height, width, size, padding)
    if classes:
        return overlap_means(kept, "prob", classes, keys).select(*keys, "i", "j", argmax(F.col("mean")).alias("pred"), F.array_max("mean").alias("best"))
    best = overlap_mean(kept, keys=keys).groupBy(*keys, "i", "j").agg(F.max(F.struct("p", (-F.col("k")).alias("_k"))).alias("_m"))
    return best.select(*keys, "i", "j", (-F.col("_m._k")).alias("pred"), F.col("_m.p").alias("best"))


def predict_scene(pixels: DataFrame, bands: Sequence[str], model: Model, height: int, width: int, size: int = CUBE, overlap: int = OVERLAP, padding: int = PADDING, classes: int | None = None) -> DataFrame:
    """i, j, pred, best of a scene: in one piece if it is small, else by overlapping tiles. Softmax is applied once."""
    scored = score_pixels(pixels, bands, model).withColumn("prob", softmax(F.col("scores")))
    if is_whole(height, width, size):
        return scored.select("i", "j", argmax(F.col("prob")).alias("pred"), F.array_max("prob").alias("best"))
    return merge_tiles(overlap_tiles(scored, height, width, size, overlap), height, width, size, padding, classes)


def predict_scenes(pixels: DataFrame, keys: Sequence[str], bands: Sequence[str], model: Model, size: int = CUBE, overlap: int = OVERLAP, padding: int = PADDING, *, classes: int) -> DataFrame:
    """keys, i, j, pred, best of many scenes in one plan, each of its own size; a small scene is one tile as a whole.

    Pixels are scored once, before they are copied into overlapping tiles.
    """
    sized = with_extents(score_pixels(pixels.select(*keys, "i", "j", *bands), bands, model).withColumn("prob", softmax(F.col("scores"))), keys)
    whole = (F.col("height") < 1.5 * size) & (F.col("width") < 1.5 * size)
    small = sized.filter(whole).select(*keys, "i", "j", argmax(F.col("prob")).alias("pred"), F.array_max("prob").alias("best"))
    h, w = F.col("height"), F.col("width")
    large = merge_tiles(overlap_tiles(sized.filter(~whole), h, w, size, overlap), h, w, size, padding, classes, keys)
    return small.unionByName(large)
