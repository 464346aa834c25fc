"""Containers of fixed capacity, filled with items of varying size."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.session import cut_lineage

#: Open windows of each partition and capacity; partitions whose leftovers are merged together.
OPEN_WINDOWS, PARTITIONS_MERGED = 64, 64

#: Containers of one partition are numbered below this.
PER_PARTITION = 1 << 36


class Windows:
    """The open windows of one capacity: bounded-space best fit."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.free: list[tuple[int, int]] = []  # (free space, number), in order
        self.held: dict[int, list[tuple]] = {}
        self.made = 0

    def place(self, item, size: int) -> list[tuple[int, list[tuple]]]:
        """Put one item; returns the containers that this closes. A row is (item, piece, start, size)."""
        closed, start, piece = [], 0, 0
        while size > self.capacity:
            closed.append((self._new(), [(item, piece, start, self.capacity)]))
            start, size, piece = start + self.capacity, size - self.capacity, piece + 1
        row = (item, piece, start, size)
        k = bisect_left(self.free, (size, -1))
        if k < len(self.free):
            left, number = self.free.pop(k)
        else:
            if len(self.free) >= self.limit:
                _, fullest = self.free.pop(0)
                closed.append((fullest, self.held.pop(fullest)))
            left, number = self.capacity, self._new()
            self.held[number] = []
        self.held[number].append(row)
        if left == size:
            closed.append((number, self.held.pop(number)))
        else:
            insort(self.free, (left - size, number))
        return closed

    def _new(self) -> int:
        self.made += 1
        return self.made - 1


def best_fit_decreasing(fills: list[int], capacity: int) -> list[int]:
    """For each fill the position of the one it is merged into (its own if it stays), largest first."""
    into = [0] * len(fills)
    free: list[tuple[int, int]] = []
    for k in sorted(range(len(fills)), key=lambda i: (-fills[i], i)):
        at = bisect_left(free, (fills[k], -1))
        left, home = free.pop(at) if at < len(free) else (capacity, k)
        into[k] = home
        insort(free, (left - fills[k], home))
    return into


def pack_items(items: DataFrame, id_col: str, size_col: str, capacities: dict[str, int], *, open_windows: int = OPEN_WINDOWS, partitions_merged: int = PARTITIONS_MERGED) -> DataFrame:
    """pack_name, container_id, id, piece_no, start, size: one row per piece of an item and capacity.

    No container holds more than its capacity and no item is divided unless it alone exceeds it; then all its pieces but
    the last fill a container each (start is where a piece begins). Items of null or no size take no place and have no
    row. Rows that repeat an id are items of their own. An empty input or no capacities give an empty result.

    Bounded-space best fit: each partition keeps open_windows windows per capacity, puts an item where the least space
    stays free, and when none fits emits the fullest. The windows left open at the end are merged, best fit
    decreasing, over partitions_merged partitions at a time: open_windows * partitions_merged sums in a task at most,
    however many items there are. The placement is written to the checkpoint folder once and read from there.
    """
    kind = items.schema[id_col].dataType.simpleString()
    sizes = {str(k): int(v) for k, v in capacities.items()}
    if any(v <= 0 for v in sizes.values()):
        raise ValueError("capacities must be positive")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() * PER_PARTITION
        windows = {name: Windows(capacity, open_windows) for name, capacity in sizes.items()}
        columns = ["pack_name", "container_id", "_open", id_col, "piece_no", "start", "size"]
        for batch in batches:
            rows = []
            for item, size in zip(batch[id_col], batch["_size"].tolist(), strict=True):
                for name, w in windows.items():
                    for number, held in w.place(item, int(size)):
                        rows += [(name, base + number, False, *r) for r in held]
            yield pd.DataFrame(rows, columns=columns)
        yield pd.DataFrame([(name, base + number, True, *r) for name, w in windows.items() for number, held in w.held.items() for r in held], columns=columns)

    measured = items.select(id_col, F.col(size_col).cast("long").alias("_size")).filter(F.col(id_col).isNotNull() & (F.col("_size") > 0))
    placed = cut_lineage(measured.mapInPandas(place, f"pack_name string, container_id long, _open boolean, `{id_col}` {kind}, piece_no int, start long, size long"))
    group = F.floor(F.col("container_id") / PER_PARTITION / partitions_merged).cast("long")
    leftover = placed.filter("_open").groupBy("pack_name", "container_id").agg(F.sum("size").alias("_fill")).withColumn("_group", group)

    def merge(windows: pd.DataFrame) -> pd.DataFrame:
        windows = windows.sort_values("container_id").reset_index(drop=True)
        into = best_fit_decreasing(windows["_fill"].tolist(), sizes[windows["pack_name"].iloc[0]])
        return pd.DataFrame({"pack_name": windows["pack_name"], "container_id": windows["container_id"], "_into": windows["container_id"].iloc[into].to_numpy()})

    merged = leftover.groupBy("pack_name", "_group").applyInPandas(merge, "pack_name string, container_id long, _into long")
    out = [F.col("pack_name"), F.col("container_id"), F.col(id_col), F.col("piece_no"), F.col("start"), F.col("size")]
    closed = placed.filter("NOT _open").select(*out)
    moved = placed.filter("_open").join(merged, ["pack_name", "container_id"]).withColumn("container_id", F.col("_into"))
    return closed.unionByName(moved.select(*out))


def pack_report(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """pack_name, n_containers, n_pieces, tokens and fill (the share of space used) of each capacity with a container."""
    capacity = F.create_map(*[F.lit(x) for pair in capacities.items() for x in pair])
    containers = packed.groupBy("pack_name", "container_id").agg(F.sum("size").alias("t"), F.count(F.lit(1)).alias("n"))
    totals = containers.groupBy("pack_name").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("t").alias("tokens"))
    return totals.withColumn("fill", F.col("tokens") / (F.col("n_containers") * capacity[F.col("pack_name")]))
