"""Irregular readings onto a regular grid of periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterweave.session import cut_lineage

OBSERVED, CARRIED, MISSING = "observed", "carried", "missing"


def seconds_since(ts: Column, origin: str) -> Column:
    """Whole seconds from midnight of the date `origin` to ts, by the wall clock: no zone enters, for either timestamp type."""
    days = F.datediff(F.to_date(ts), F.lit(origin).cast("date")).cast("long")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))


def period_of(ts: Column, origin: str, width_s: int) -> Column:
    """Number of the period [origin + k * width, + width) that holds ts."""
    return F.floor(seconds_since(ts, origin) / F.lit(width_s)).cast("long")


def regular_grid(readings: DataFrame, source: str, ts: str, values: Sequence[str] = (), *, origin: str, width_s: int, start: str | None = None, end: str | None = None, max_gap: int = 0, chunk: int = 1024, tie: Sequence[str] = ()) -> DataFrame:
    """One row for each source and period from the source's first to its last period with a reading.

    Result: source, period_no, n_readings, status, from_period, and each of `values` as of the latest reading of
    from_period. status is 'observed' if the period has a reading, 'carried' if the last one is at most max_gap periods
    back, 'missing' otherwise (values and from_period are then null). A reading counts if its source is not null and
    start <= ts < end (either may be None). Ties: of several readings in a period the one with the latest ts counts,
    then the greatest `tie` columns and values. Repeated rows are counted in n_readings; make them single first. Null
    values are carried as nulls. An empty input gives an empty result with the same columns. Other columns are not
    read, so their names don't matter; a source or value called like a column of the result raises ValueError.

    Readings are first combined by (source, period), before the shuffle, and these buckets are written to the checkpoint
    folder; a source or a bucket with a third of all rows is thus no more than its periods. The sequence of a source is cut into chunks of `chunk` periods; each also
    sees the max_gap periods before it, so every chunk is filled on its own and no task ever holds a whole source.
    """
    if clash := {"period_no", "n_readings", "status", "from_period"} & {source, *values}:
        raise ValueError(f"names of the result's own columns: {sorted(clash)}")
    chunk = max(chunk, 8 * max_gap, 1)
    rows = readings.filter(F.col(source).isNotNull() & F.col(ts).isNotNull())
    if start is not None:
        rows = rows.filter(F.col(ts) >= F.lit(start).cast(readings.schema[ts].dataType))
    if end is not None:
        rows = rows.filter(F.col(ts) < F.lit(end).cast(readings.schema[ts].dataType))
    # The time alone is aggregated by hash; a struct needs a sort.
    state = F.struct(F.col(ts).alias("_t"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(tie)], *[F.col(c).alias(f"_v{i}") for i, c in enumerate(values)]) if values else F.col(ts)
    # Both the spans and the join need them; the readings are read once.
    buckets = cut_lineage(rows.select(F.col(source).alias("_source"), period_of(F.col(ts), origin, width_s).alias("_period"), state.alias("_state")).groupBy("_source", "_period").agg(F.count(F.lit(1)).alias("n_readings"), F.max("_state").alias("_state")))
    # The sequence of each source, chunk by chunk; a chunk's rows begin max_gap periods early.
    spans = buckets.groupBy("_source").agg(F.min("_period").alias("_first"), F.max("_period").alias("_last"))
    chunks = spans.withColumn("_chunk", F.explode(F.sequence(F.floor(F.col("_first") / chunk), F.floor(F.col("_last") / chunk))))
    low, high = F.greatest(F.col("_first"), F.col("_chunk") * chunk - max_gap), F.least(F.col("_last"), F.col("_chunk") * chunk + (chunk - 1))
    grid = chunks.repartition("_source", "_chunk").select("_source", "_chunk", F.explode(F.sequence(low, high)).alias("_period"))
    filled = grid.join(buckets, ["_source", "_period"], "left")
    back = Window.partitionBy("_source", "_chunk").orderBy("_period").rowsBetween(-max_gap, 0)
    seen = F.when(F.col("_state").isNotNull(), F.struct(F.col("_period").alias("p"), F.col("_state").alias("s")))
    out = filled.withColumn("_seen", F.last(seen, ignorenulls=True).over(back)).filter(F.floor(F.col("_period") / chunk) == F.col("_chunk"))
    return out.select(
        F.col("_source").alias(source),
        F.col("_period").alias("period_no"),
        F.coalesce(F.col("n_readings"), F.lit(0)).cast("long").alias("n_readings"),
        F.when(F.col("n_readings").isNotNull(), OBSERVED).when(F.col("_seen").isNotNull(), CARRIED).otherwise(MISSING).alias("status"),
        F.col("_seen.p").alias("from_period"),
        *[F.col(f"_seen.s._v{i}").alias(c) for i, c in enumerate(values)],
    )
