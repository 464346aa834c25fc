"""Stratified and plain splits of cubes that need no shuffle of state and no chance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The shares of train and of train with val, and the classes that claim cubes, in order.
TRAIN, TRAIN_VAL, CLAIM_ORDER = 0.8, 0.9, (2, 3, 4, 5)


def hash_order(id_col: Column, seed: int = 42) -> Column:
    """A shuffled order that any engine can repeat: the MD5 of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")))


def stratified_split(cube_labels: DataFrame, order: Sequence[int] = CLAIM_ORDER, seed: int = 42) -> DataFrame:
    """cube_id, stratum, split from rows cube_id, label.

    The first class in `order` that a cube holds claims it; cubes with none of them are the stratum 0. Each stratum is
    split 80/10/10 in hash order, at floor(0.8 n) and floor(0.9 n); where a part would be empty, the last two cubes go to
    val and test.
    """
    rank = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("label").cast("int"))
    claimed = cube_labels.filter("cube_id IS NOT NULL").groupBy("cube_id").agg(F.min(F.when(rank > 0, rank)).alias("_r"))
    stratum = F.coalesce(F.element_at(F.array(*[F.lit(c) for c in order]), F.col("_r").cast("int")), F.lit(0))
    rows = claimed.select("cube_id", F.when(F.col("_r").isNotNull(), stratum).otherwise(0).cast("int").alias("stratum"))
    return ranked_split(rows, "cube_id", ["stratum"], seed)


def ranked_split(rows: DataFrame, id_col: str, per: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """rows with split: 80/10/10 of each `per` group by rank in hash order.

    A group may be the whole table, so it is ranked in 4,096 buckets by the beginning of the hash: rank within the
    bucket plus the rows of the buckets before. No task holds more of a group than a bucket.
    """
    hashed = rows.withColumn("_h", hash_order(F.col(id_col), seed)).withColumn("_b", F.substring("_h", 1, 3))
    group = Window.partitionBy(*per)
    sizes = hashed.groupBy(*per, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*[F.col(c).alias(f"_o_{c}") for c in per], F.col("_b").alias("_ob"), before.alias("_before"), F.sum("_c").over(group).alias("_n"))
    same = F.col("_b") == F.col("_ob")
    for c in per:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    within = F.row_number().over(Window.partitionBy(*per, "_b").orderBy("_h", id_col)) - 1
    ranked = hashed.withColumn("_k", within).join(offsets, same).withColumn("_k", F.col("_k") + F.col("_before"))
    a, b = F.floor(F.col("_n") * TRAIN), F.floor(F.col("_n") * TRAIN_VAL)
    empty = (a == 0) | (b == a) | (F.col("_n") == b)
    a, b = F.when(empty, F.col("_n") - 2).otherwise(a), F.when(empty, F.col("_n") - 1).otherwise(b)
    return ranked.select(*rows.columns, F.when(F.col("_k") < a, "train").when(F.col("_k") < b, "val").otherwise("test").alias("split"))


def hashed_split(rows: DataFrame, id_col: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """rows with split by a hash of the id alone: no shuffle, and a row's split never changes as others come."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    names, total, edge = list(shares), sum(shares.values()), 0.0
    choice, limits = F.lit(names[-1]), []
    for s in names:
        edge += shares[s] / total
        limits.append((s, edge))
    for s, limit in reversed(limits[:-1]):
        choice = F.when(u < limit, s).otherwise(choice)
    return rows.withColumn("split", choice)


def not_in(rows: DataFrame, taken: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id is in none of the taken ones."""
    return rows.join(taken.select(id_col), id_col, "left_anti")
