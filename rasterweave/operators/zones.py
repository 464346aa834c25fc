"""Overlapping square zones of pixels and their clustering."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterweave.session import cut_lineage

#: Values of all centres (clusters times positions) up to which they are broadcast.
BROADCAST_CENTRES = 1_000_000

#: Clusters of a block that meets another one in a task.
CENTRES_A_BLOCK = 1_000


def overlap_zones(pixels: DataFrame, z: int = 10) -> DataFrame:
    """Every pixel of every scene in its zone of the base grid (0) and, from (z/2, z/2) on, of the grid shifted by z/2 (1).

    Adds grid, zi, zj (the zone's first row and column). Arithmetic and an explode: no join, no shuffle.
    """
    h = z // 2
    base = F.struct(F.lit(0).alias("grid"), (F.floor(F.col("i") / z) * z).cast("int").alias("zi"), (F.floor(F.col("j") / z) * z).cast("int").alias("zj"))
    shifted = F.struct(F.lit(1).alias("grid"), (F.floor((F.col("i") - h) / z) * z + h).cast("int").alias("zi"), (F.floor((F.col("j") - h) / z) * z + h).cast("int").alias("zj"))
    both = F.when((F.col("i") >= h) & (F.col("j") >= h), F.array(base, shifted)).otherwise(F.array(base))
    return pixels.withColumn("_z", F.explode(both)).select(*pixels.columns, "_z.grid", "_z.zi", "_z.zj")


def zone_index(zoned: DataFrame, width: int, z: int = 10) -> DataFrame:
    """zoned with idx, the position of the pixel in its zone, row by row; zones are clipped at the image's width."""
    w = F.least(F.lit(z), F.lit(width) - F.col("zj"))
    return zoned.withColumn("idx", ((F.col("i") - F.col("zi")) * w + (F.col("j") - F.col("zj"))).cast("int"))


def zone_pixels(indexed: DataFrame, width: int, z: int = 10) -> DataFrame:
    """The way back from grid, zi, zj and idx to the pixel: adds pi, pj."""
    w = F.least(F.lit(z), F.lit(width) - F.col("zj"))
    return indexed.withColumns({"pi": (F.col("zi") + F.floor(F.col("idx") / w)).cast("int"), "pj": (F.col("zj") + F.pmod(F.col("idx"), w)).cast("int")})


def _plus_plus(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = [x[rng.integers(len(x))]]
    for _ in range(1, k):
        d = np.min(((x[:, None, :] - np.array(centres)[None]) ** 2).sum(-1), axis=1)
        centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    return np.array(centres)


def k_means(x: np.ndarray, k: int, seed: int = 42, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centres by Lloyd's rounds from a k-means++ start; an empty cluster keeps its centre."""
    centres = _plus_plus(x, k, np.random.default_rng(seed))
    labels = np.full(len(x), -1)
    for _ in range(rounds):
        new = ((x[:, None, :] - centres[None]) ** 2).sum(-1).argmin(1)
        if (new == labels).all():
            break
        labels = new
        for c in np.unique(labels):
            centres[c] = x[labels == c].mean(0)
    return labels, centres


def davies_bouldin_of(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean over clusters of the worst (S_i + S_j) / d_ij; infinite for fewer than two clusters."""
    names = np.unique(labels)
    if len(names) < 2:
        return float("inf")
    centres = np.array([x[labels == n].mean(0) for n in names])
    spread = np.array([np.sqrt(((x[labels == n] - m) ** 2).sum(1)).mean() for n, m in zip(names, centres, strict=True)])
    apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(-1))
    ratio = np.divide(spread[:, None] + spread[None], apart, out=np.zeros_like(apart), where=apart > 0)
    np.fill_diagonal(ratio, 0)
    return float(ratio.max(1).mean())


def settle_singletons(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Clusters of one pixel join the cluster with the nearest centre, if there is another one."""
    labels = labels.copy()
    for name in np.unique(labels):
        others = [n for n in np.unique(labels) if n != name]
        if (labels == name).sum() == 1 and others:
            at = x[labels == name][0]
            labels[labels == name] = min(others, key=lambda n: (((x[labels == n].mean(0) - at) ** 2).sum(), n))
    return labels


def cluster_zone(x: np.ndarray, k_max: int = 10, seed: int = 42) -> np.ndarray:
    """Labels with the k of 2 to k_max that has the least Davies-Bouldin score, the smallest k on a tie.

    Fewer than three pixels, or pixels that are all alike, are one cluster; k stays below the number of distinct pixels.
    """
    distinct = len(np.unique(x, axis=0))
    if len(x) < 3 or distinct < 2:
        return np.zeros(len(x), dtype=int)
    best, chosen = float("inf"), np.zeros(len(x), dtype=int)
    for k in range(2, min(k_max, distinct, len(x) - 1) + 1):
        labels, _ = k_means(x, k, seed)
        score = davies_bouldin_of(x, labels)
        if score < best:
            best, chosen = score, labels
    return np.unique(settle_singletons(x, chosen), return_inverse=True)[1]


def zone_partition(series: DataFrame, z: int = 10, k_max: int = 10, seed: int = 42, keys: Sequence[str] = ()) -> DataFrame:
    """keys, grid, cluster_id, i, j: the pixels of every zone clustered by their series, masked values as 0.

    A zone has z * z pixels at most, so a group is bounded; all zones are clustered at the same time.
    """
    pixels = series.groupBy(*keys, "i", "j").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "c", F.coalesce("v", F.lit(0.0)).alias("v")))), lambda s: s["v"]).alias("x"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "j"])
        labels = cluster_zone(np.array(pdf["x"].tolist(), dtype=float), k_max, seed)
        zone = (int(pdf["zi"].iloc[0]) << 32) + (int(pdf["zj"].iloc[0]) << 8)
        return pd.DataFrame({**{k: pdf[k] for k in keys}, "grid": pdf["grid"], "cluster_id": zone + labels, "i": pdf["i"], "j": pdf["j"]})

    scene = "".join(f"`{k}` {series.schema[k].dataType.simpleString()}, " for k in keys)
    return overlap_zones(pixels, z).groupBy(*keys, "grid", "zi", "zj").applyInPandas(run, f"{scene}grid int, cluster_id long, i int, j int")


def davies_bouldin(points: DataFrame, label: str, vector: str) -> DataFrame:
    """score: the Davies-Bouldin score of labelled vectors; null for fewer than two clusters.

    Centres are found by position and gathered to one array per cluster. A count proves them small enough to be
    broadcast; each cluster's centre then meets those of the others as one array of centres, so no key is shared by all
    pairs. With more, the pairs are dealt over blocks of clusters: a block meets a block in a task of its own.
    """
    rows = points.select(F.col(label).alias("k"), F.col(vector).cast("array<double>").alias("x"))
    long = rows.select("k", F.posexplode("x").alias("p", "v"))
    centres = long.groupBy("k", "p").agg(F.avg("v").alias("m")).groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("m"))
    centres = cut_lineage(centres)
    n, width = centres.agg(F.count(F.lit(1)), F.max(F.size("m"))).first()
    small = F.broadcast if n * (width or 1) <= BROADCAST_CENTRES else (lambda df: df)
    apart = lambda x, y: F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))
    spread = rows.join(small(centres), "k").groupBy("k").agg(F.avg(apart(F.col("x"), F.col("m"))).alias("s"))
    known = cut_lineage(centres.join(spread, "k"))
    blocks = max(1, n // CENTRES_A_BLOCK)
    block = F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    one = known.select("k", "m", "s", block.alias("_a"), every.alias("_b"))
    other = known.select(F.col("k").alias("k2"), F.col("m").alias("m2"), F.col("s").alias("s2"), block.alias("_b"), every.alias("_a"))
    ratio = one.join(other, ["_a", "_b"]).filter("k <> k2").groupBy("k").agg(F.max(F.try_divide(F.col("s") + F.col("s2"), apart(F.col("m"), F.col("m2")))).alias("r"))
    return ratio.agg(F.avg("r").alias("score"))


def label_image(pixels: DataFrame, partition: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, i, j, cluster_id of every pixel: the greatest of its clusters, -1 if it has none."""
    top = partition.groupBy(*keys, "i", "j").agg(F.max("cluster_id").alias("cluster_id"))
    return pixels.select(*keys, "i", "j").join(top, [*keys, "i", "j"], "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))


def cluster_borders(labels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, i, j, border: true if the label differs from that of the pixel above, below, left or right."""
    row, column = Window.partitionBy(*keys, "i").orderBy("j"), Window.partitionBy(*keys, "j").orderBy("i")
    differs = lambda other: F.coalesce(other != F.col("cluster_id"), F.lit(False))
    nxt = lambda f, w, key: F.when(f(key, 1).over(w) == F.col(key) + (1 if f is F.lead else -1), f("cluster_id", 1).over(w))
    return labels.select(*keys, "i", "j", (differs(nxt(F.lag, row, "j")) | differs(nxt(F.lead, row, "j")) | differs(nxt(F.lag, column, "i")) | differs(nxt(F.lead, column, "i"))).alias("border"))
