"""An equi-join that splits hot keys of both sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.session import cut_lineage

#: Rows of one key that a task may get from one side.
ROWS_PER_TASK = 100_000

#: Hot keys that are broadcast at most (some 50 bytes each). If there were more, rows_per_task would be doubled.
MAX_HOT_KEYS = 100_000


def hot_keys(many: DataFrame, few: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK, *, both: bool = True, max_keys: int = MAX_HOT_KEYS) -> tuple[DataFrame, int]:
    """Keys with more than rows_per_task rows on a side, in how many parts to cut each side, and their number.

    Counting combines before it shuffles. The keys stay a DataFrame (written to the checkpoint folder); while there are
    more than max_keys of them, rows_per_task is doubled, so that broadcasting them is safe for any input. both: look at the
    side of `few` as well, and only at keys that both sides have.
    """
    one = lambda df, m, f: df.select(*keys, F.lit(m).alias("_m"), F.lit(f).alias("_f"))
    sides = one(many, 1, 0).unionByName(one(few, 0, 1)) if both else one(many, 1, 0)
    counts = sides.groupBy(*keys).agg(F.sum("_m").alias("_m"), F.sum("_f").alias("_f"))
    hot = counts.filter(F.greatest("_m", "_f") > rows_per_task)
    for k in keys:
        hot = hot.filter(F.col(k).isNotNull())
    hot = cut_lineage(hot.filter("_m > 0 AND _f > 0") if both else hot)
    while (n := hot.count()) > max_keys:
        rows_per_task *= 2
        hot = hot.filter(F.greatest("_m", "_f") > rows_per_task)
    parts = lambda c: F.greatest(F.ceil(F.col(c) / rows_per_task), F.lit(1)).cast("int")
    return hot.select(*keys, parts("_m").alias("_mp"), parts("_f").alias("_fp")), n


def salted_join(many: DataFrame, few: DataFrame, keys: Sequence[str], spread: Column, condition=None, rows_per_task: int = ROWS_PER_TASK, how: str = "inner", few_spread: Column | None = None) -> DataFrame:
    """Join on keys (inner, or left from `many`) in which a hot key is dealt over several tasks.

    spread: an expression over `many` that varies within a key (its id); few_spread: the same over `few`, for keys that can
    be hot there (inner joins only). Each side of a hot key is cut into parts of about rows_per_task rows, and a part
    meets each part of the other side in a task of its own. Every other row stays single. condition: a further predicate
    of the join. Null keys join nothing. Only the key columns may be common to both sides.
    """
    keys = list(keys)
    if few_spread is not None and how != "inner":
        raise ValueError("only an inner join can cut both sides")
    hot, n = hot_keys(many, few, keys, rows_per_task, both=few_spread is not None)
    salts = ["_s", "_t"] if n else []
    if n:
        hot = F.broadcast(hot)
        part = lambda of, parts: F.coalesce(F.pmod(F.xxhash64(of), F.col(parts)).cast("int"), F.lit(0))
        each = lambda parts: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts) - 1, F.lit(0))))
        many = many.join(hot, keys, "left").withColumn("_s", part(spread, "_mp")).withColumn("_t", each("_fp") if few_spread is not None else F.lit(0)).drop("_mp", "_fp")
        few = few.join(hot, keys, "left").withColumn("_t", part(few_spread, "_fp") if few_spread is not None else F.lit(0)).withColumn("_s", each("_mp")).drop("_mp", "_fp")
    out = many.join(few, [*keys, *salts], how)
    return (out.filter(condition) if condition is not None else out).drop(*salts)
