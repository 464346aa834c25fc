"""Dieback on a stream of new dates: an extension of ours, there is none in the batch engine's model.

Centroids and thresholds come from a finished batch and are joined as a static side; what is kept per pixel is one
counter. A pixel's dates must arrive in order within its key's batches; within a batch they are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rasterweave.operators.series import GROUP


def stream_hits(values: DataFrame, partition: DataFrame, centroids: DataFrame, limits: DataFrame) -> DataFrame:
    """grid, cluster_id, i, j, t, hit of every incoming pixel and date. values: i, j, t, x (array of channels).

    A pixel's date is one row with all its channels, so no aggregation over the stream is needed. centroids: grid,
    cluster_id, x and limits: grid, cluster_id, thr, both arrays by channel.
    """
    joined = values.join(partition.select(*GROUP, "i", "j"), ["i", "j"]).join(centroids.select(*GROUP, F.col("x").alias("m")), GROUP).join(limits, GROUP)
    over = F.zip_with(F.zip_with("x", "m", lambda v, m: v - m), "thr", lambda d, t: F.coalesce(d > t, F.lit(False)))
    return joined.select(*GROUP, "i", "j", "t", F.exists(over, lambda h: h).alias("hit"))


def sustained_stream(hits: DataFrame, count: int = 3) -> DataFrame:
    """grid, cluster_id, i, j, t: the date on which a pixel has `count` hits in a row, once per run of hits."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("t")
        found = []
        for t, hit in zip(rows["t"], rows["hit"], strict=True):
            n = n + 1 if hit else 0
            if n == count:
                found.append((*key, t))
        state.update((n,))
        yield pd.DataFrame(found, columns=[*GROUP, "i", "j", "t"])

    return hits.groupBy(*GROUP, "i", "j").applyInPandasWithState(run, "grid int, cluster_id long, i int, j int, t int", "n int", "append", GroupStateTimeout.NoTimeout)
