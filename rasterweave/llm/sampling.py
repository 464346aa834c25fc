"""Samples whose categories have given shares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterweave.operators.skew import ROWS_PER_TASK, salted_join
from rasterweave.session import cut_lineage

#: Rows of the target table up to which it is broadcast (about 100 bytes each).
BROADCAST_TARGETS = 200_000

#: Rows that a task takes in before it trims its reservoirs again.
TRIM_ROWS = 1 << 17

#: Slices of the priorities up to a category's expected last one; slices beyond it are numbered up to four times that.
SLICES = 1024

#: Priorities are below this.
PRIORITIES = 1 << 60


def category_key(c: Column) -> Column:
    """How categories are compared: as text, without regard to case and surrounding blanks; blank is null."""
    key = F.upper(F.trim(c.cast("string")))
    return F.when(key != "", key)


def required_rows(targets: DataFrame) -> Column:
    """The larger of min_rows and the share of the sample, rounded; null counts as 0."""
    share = F.round(F.coalesce(F.col("target_share"), F.lit(0.0)) * F.coalesce(F.col("sample_size"), F.lit(0)))
    return F.greatest(F.coalesce(F.col("min_rows"), F.lit(0)).cast("long"), share.cast("long"))


def priority(seed: int, *ids: Column) -> Column:
    """A number below PRIORITIES from the MD5 of seed and ids, which any engine can compute."""
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in ids])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


class Reservoirs:
    """Least-of-k reservoirs of one map task: `least` rows of each group, each group with its own k.

    Groups are numbered as they are met. Once a group is full, rows beyond its worst priority are left out at once.
    The state is at most sum(k) rows plus those since the last trim.
    """

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.names: list[tuple] = []
        self.quota, self.seen, self.worst = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.kept: list[pa.Table] = []
        self.held = 0

    def number(self, rows: pa.Table) -> np.ndarray:
        """The number of each row's group; new groups get the next ones. The work is by distinct group, not by row."""
        coded = pc.binary_join_element_wise(pc.cast(rows["draw_id"], pa.string()), rows["_key"], "\u0001").combine_chunks().dictionary_encode()
        codes = coded.indices.to_numpy()
        first = np.unique(codes, return_index=True)[1]
        one = rows.select(["draw_id", "_key", "required"]).take(pa.array(first)).to_pylist()
        for name, row in zip(coded.dictionary.to_pylist(), one, strict=True):
            if name not in self.numbers:
                self.numbers[name] = len(self.names)
                self.names.append((row["draw_id"], row["_key"]))
                self.quota = np.append(self.quota, row["required"])
        more = len(self.names) - len(self.seen)
        self.seen, self.worst = np.append(self.seen, np.zeros(more, np.int64)), np.append(self.worst, np.full(more, PRIORITIES))
        return np.array([self.numbers[n] for n in coded.dictionary.to_pylist()], dtype=np.int64)[codes]

    def add(self, rows: pa.Table) -> None:
        """rows: the group's columns draw_id and _key, its quota `required`, id and _priority."""
        group = self.number(rows)
        self.seen += np.bincount(group, minlength=len(self.seen))
        good = (rows["_priority"].to_numpy() <= self.worst[group]) & (self.quota[group] > 0)
        self.kept.append(rows.append_column("_g", pa.array(group)).filter(pa.array(good)))
        self.held += int(good.sum())
        if self.held > TRIM_ROWS:
            self.trim()

    def trim(self) -> None:
        """Keep the least rows of each group, in order of priority and id, and note the worst of the full ones."""
        if not self.kept:
            return
        rows = pa.concat_tables(self.kept).combine_chunks()
        rows = rows.take(pc.sort_indices(rows, [("_g", "ascending"), ("_priority", "ascending"), ("id", "ascending")]))
        group = rows["_g"].to_numpy()
        begins = np.searchsorted(group, np.arange(len(self.quota)))
        rank = np.arange(len(group)) - begins[group]
        keep = rank < self.quota[group]
        last = rank == self.quota[group] - 1
        self.worst[group[last]] = rows["_priority"].to_numpy()[last]
        rows = rows.filter(pa.array(keep))
        self.kept, self.held = [rows], len(rows)


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The reservoirs of a partition, and for each group a row with its number of rows and no id."""
    state, schema = Reservoirs(), None
    for batch in batches:
        schema = batch.schema
        if len(batch):
            state.add(pa.Table.from_batches([batch]))
    if schema is None or not state.names:
        return
    state.trim()
    schema = pa.schema([f.with_nullable(True) for f in [*schema, pa.field("_n", pa.int64())]])
    out = pa.concat_tables([t.drop_columns("_g") for t in state.kept])
    out = out.append_column("_n", pa.nulls(len(out), pa.int64())).cast(schema)
    n = len(state.names)
    draw, key = zip(*state.names, strict=True)
    counts = pa.table({"draw_id": pa.array(draw, schema.field("draw_id").type), "_key": pa.array(key, schema.field("_key").type), "required": pa.array(state.quota), "id": pa.nulls(n, schema.field("id").type), "_priority": pa.nulls(n, pa.int64()), "_n": pa.array(state.seen)}).cast(schema)
    yield from pa.concat_tables([out, counts]).to_batches()


class Draws:
    """Draws of a sample from strata of `records`, by category.

    records: one row per id (make them single first) and field: `id`, `stratum`, `field_name`, `category`. targets: one
    row per draw and category: draw_id, stratum, field_name, category, target_share, min_rows, sample_size. Records or
    targets with a null in stratum, field or category match nothing; such targets still get their row in the report.
    Records with a null id are ignored. Extra columns are not read.

    One pass: every map task fills a reservoir for each draw and category, the `required` rows with the least priority (a
    hash of seed, draw and id), and counts the rows. What leaves a task is at most its quotas, so a category with a third of
    all rows is shuffled as tasks * quota rows, whatever the quota is. Least-of-k reservoirs merge: counts are summed, and
    the union is trimmed to min(stock, required) rows of least priority, that is uniformly. To trim, the priorities up to
    the expected last one are cut into SLICES; slices before the one in which the quota ends are taken whole and only that
    one is ranked, so that no task sorts a large reservoir. The minimum of a category comes on top of the shares of the
    others. Priorities are a function of the ids alone, so a task run again draws the same rows; equal ones are ordered by id.
    """

    def __init__(self, records: DataFrame, targets: DataFrame, *, seed: int = 42, rows_per_task: int = ROWS_PER_TASK):
        self.targets = targets.select("draw_id", "stratum", "field_name", "category", "target_share", "min_rows", "sample_size")
        self.targets = self.targets.withColumn("required", required_rows(self.targets)).withColumn("_key", category_key(F.col("category")))
        goals = self.targets.select("draw_id", "stratum", "field_name", "_key", "required").filter(F.col("draw_id").isNotNull() & F.col("stratum").isNotNull() & F.col("field_name").isNotNull() & F.col("_key").isNotNull())
        goals = goals.groupBy("draw_id", "stratum", "field_name", "_key").agg(F.max("required").alias("required"))
        size = goals.count()
        # One row per draw and category: the count proves that stocks and cuts are as small as the targets.
        self.small = F.broadcast if size <= BROADCAST_TARGETS else (lambda df: df)
        keys = ["stratum", "field_name", "_key"]
        rows = records.select("id", "stratum", "field_name", category_key(F.col("category")).alias("_key")).filter(F.col("_key").isNotNull() & F.col("id").isNotNull())
        if size <= BROADCAST_TARGETS:
            matched = rows.join(F.broadcast(goals), keys)
        else:
            matched = salted_join(rows, goals, keys, F.col("id"), None, rows_per_task)
        self.matched = matched.select("draw_id", "_key", "required", "id", priority(seed, F.col("draw_id"), F.col("id")).alias("_priority"))
        kinds = {f.name: f.dataType.simpleString() for f in self.matched.schema}
        self.filled = self.matched.mapInArrow(_fill, ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", _n long")
        self._written: DataFrame | None = None

    def reservoirs(self) -> DataFrame:
        """The reservoirs of all map tasks and their counts (rows with _n), written once."""
        if self._written is None:
            self._written = cut_lineage(self.filled)
        return self._written

    def _stock(self) -> DataFrame:
        return self.reservoirs().filter("_n IS NOT NULL").groupBy("draw_id", "_key").agg(F.sum("_n").alias("stock"))

    def _rows(self) -> DataFrame:
        """The drawn rows, with their draw and category."""
        group = ["draw_id", "_key"]
        rows = self.reservoirs().filter("_n IS NULL").select(*group, "required", "id", "_priority").join(self.small(self._stock()), group)
        at = F.col("_priority") / F.lit(float(PRIORITIES)) * F.col("stock") / F.col("required") * SLICES
        rows = rows.withColumn("_slice", F.when(F.col("stock") > F.col("required"), F.least(F.floor(at), F.lit(4 * SLICES - 1))).cast("int"))
        # Only categories with more rows than their quota are trimmed: what comes before the slice in which the quota ends is in.
        sizes = rows.filter("_slice IS NOT NULL").groupBy(*group, "required", "_slice").agg(F.count(F.lit(1)).alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        cuts = sizes.withColumn("_upto", upto).filter(F.col("required").between(F.col("_upto") - F.col("_c") + 1, F.col("_upto"))).select(*group, F.col("_slice").alias("_cut"), (F.col("required") - F.col("_upto") + F.col("_c")).alias("_left"))
        rows = rows.join(self.small(cuts), group, "left")
        ranked = rows.filter("_slice = _cut").withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy("_priority", "id"))).filter("_rank <= _left")
        return rows.filter("_slice IS NULL OR _slice < _cut").select(*group, "id").unionByName(ranked.select(*group, "id"))

    def sample(self) -> DataFrame:
        """draw_id, category (as compared) and id of every drawn row."""
        return self._rows().select("draw_id", F.col("_key").alias("category"), "id")

    def report(self) -> DataFrame:
        """One row per row of targets: what was asked for, the stock, the rows drawn, the share reached and `short`."""
        drawn = self._rows().groupBy("draw_id", "_key").agg(F.count(F.lit(1)).alias("drawn"))
        totals = drawn.groupBy("draw_id").agg(F.sum("drawn").alias("_total"))
        out = self.targets.join(self._stock(), ["draw_id", "_key"], "left").join(drawn, ["draw_id", "_key"], "left").join(totals, ["draw_id"], "left")
        got = F.coalesce(F.col("drawn"), F.lit(0)).cast("long")
        return out.select("draw_id", "category", "target_share", "required", F.coalesce(F.col("stock"), F.lit(0)).cast("long").alias("stock"), got.alias("drawn"), F.try_divide(got, F.coalesce(F.col("_total"), F.lit(0))).alias("share"), (got < F.col("required")).alias("short"))
