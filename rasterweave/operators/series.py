"""Pixel time series: cluster statistics, deviations and dieback.

A series is a long table i, j, t, c, v (and date), dense: a masked pixel has a row with a null v, never NaN.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterweave.operators.metrics import quantiles

#: Least threshold of a deviation.
LEAST_THRESHOLD = 0.05
GROUP = ["grid", "cluster_id"]


def historical_window(series: DataFrame, after: str | None = None, before: str | None = None, channels: Sequence[int] | None = None) -> DataFrame:
    """Rows with after <= date <= before (either may be None) of the given channels; a negative channel raises."""
    if channels is not None and any(c < 0 for c in channels):
        raise ValueError("channels must not be negative")
    if after is not None:
        series = series.filter(F.col("date") >= F.lit(after).cast("date"))
    if before is not None:
        series = series.filter(F.col("date") <= F.lit(before).cast("date"))
    return series.filter(F.col("c").isin(*channels)) if channels is not None else series


def clustered(series: DataFrame, partition: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every pixel's rows once for each cluster that it is in. keys, here and below: the columns of the scene."""
    return series.join(partition.select(*keys, *GROUP, "i", "j"), [*keys, "i", "j"])


def cluster_statistics(rows: DataFrame, keys: Sequence[str] = (), large: bool = False) -> DataFrame:
    """keys, grid, cluster_id, t, c, centroid (median) and spread (population deviation), masked pixels left out.

    The median of a group holds the group's distinct values in one buffer, which suits clusters within zones or tiles.
    large: find it by ranks instead (see quantiles), for clusters of any size; the same result.
    """
    group = [*keys, *GROUP, "t", "c"]
    if not large:
        return rows.groupBy(*group).agg(F.median("v").alias("centroid"), F.stddev_pop("v").alias("spread"))
    spreads = rows.groupBy(*group).agg(F.stddev_pop("v").alias("spread"))
    middle = quantiles(rows, group, "v", [0.5]).select(*group, F.col("q")[0].alias("centroid"))
    return spreads.join(middle, group, "left").select(*group, "centroid", "spread")


def thresholds(statistics: DataFrame, factor: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """keys, grid, cluster_id, c, threshold: factor times the largest spread, LEAST_THRESHOLD at least.

    A date on which the whole cluster is masked has no spread; the threshold of that channel is then null and never exceeded.
    """
    whole = F.count("spread") == F.count(F.lit(1))
    return statistics.groupBy(*keys, *GROUP, "c").agg(F.when(whole, F.greatest(F.lit(LEAST_THRESHOLD), F.lit(float(factor)) * F.max("spread"))).alias("threshold"))


def deviations(rows: DataFrame, statistics: DataFrame, limits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every row with its deviation from the centroid and its threshold."""
    bounds = statistics.select(*keys, *GROUP, "t", "c", "centroid").join(limits, [*keys, *GROUP, "c"])
    return rows.join(bounds, [*keys, *GROUP, "t", "c"]).withColumn("deviation", F.col("v") - F.col("centroid"))


def exceedances(deviated: DataFrame, side: str = "above", keys: Sequence[str] = ()) -> DataFrame:
    """keys, grid, cluster_id, i, j, t, hit: true if a channel exceeds its threshold; masked counts as false."""
    d = F.abs("deviation") if side == "both" else F.col("deviation")
    return deviated.groupBy(*keys, *GROUP, "i", "j", "t").agg(F.max(F.coalesce(d > F.col("threshold"), F.lit(False))).alias("hit"))


def sustained(hits: DataFrame, count: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """keys, grid, cluster_id, i, j of pixels with `count` hits in a row of dates; a date without a hit starts anew."""
    run = F.sum(F.col("hit").cast("int")).over(Window.partitionBy(*keys, *GROUP, "i", "j").orderBy("t").rowsBetween(1 - count, 0))
    return hits.withColumn("_run", run).groupBy(*keys, *GROUP, "i", "j").agg(F.max("_run").alias("_longest")).filter(F.col("_longest") >= count).drop("_longest")


def anomaly_degree(anomalies: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, i, j, n (grids in which the pixel is anomalous) and degree: 'detected' in one, 'flagged' in more."""
    n = anomalies.groupBy(*keys, "i", "j").agg(F.count_distinct("grid").alias("n"))
    return n.withColumn("degree", F.when(F.col("n") >= 2, "flagged").otherwise("detected"))


def predict_dieback(series: DataFrame, partition: DataFrame, before: str | None = None, days: int = 90, factor: float = 1.0, count: int = 3, side: str = "above", keys: Sequence[str] = (), large: bool = False) -> DataFrame:
    """Pixels that leave their cluster for `count` dates in a row within the `days` up to `before`; all dates if None."""
    if before is not None:
        series = series.filter(F.col("date").between(F.date_sub(F.lit(before).cast("date"), days), F.lit(before).cast("date")))
    rows = clustered(series, partition, keys)
    statistics = cluster_statistics(rows, keys, large)
    found = exceedances(deviations(rows, statistics, thresholds(statistics, factor, keys), keys), side, keys)
    return anomaly_degree(sustained(found, count, keys), keys)


def cluster_medians(series: DataFrame, partition: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, date, grid, cluster_id, c, median: what a plot of the clusters' series shows."""
    return clustered(series, partition, keys).groupBy(*keys, "date", *GROUP, "c").agg(F.median("v").alias("median"))
