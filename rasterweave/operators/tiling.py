"""Cutting rasters into cubes, putting overlapping tiles together, turning and shrinking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterweave.functions.masks import black
from rasterweave.session import cut_lineage

# Side of a cube, overlap of neighbouring tiles, and the rim that is cut off a predicted tile.
CUBE, OVERLAP, PADDING = 256, 90, 30


#: Scenes whose sizes are broadcast at most.
BROADCAST_SCENES = 200_000


def extents(pixels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, height, width of each scene: its greatest row and column, plus one."""
    return pixels.groupBy(*keys).agg((F.max("i") + 1).alias("height"), (F.max("j") + 1).alias("width"))


def with_extents(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """pixels with the height and width of their scene, for the operators that take them as columns."""
    sizes = cut_lineage(extents(pixels, keys))
    small = F.broadcast if sizes.count() <= BROADCAST_SCENES else (lambda df: df)
    return pixels.join(small(sizes), list(keys))


def _column(x: int | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def cubify(pixels: DataFrame, height: int | Column, width: int | Column, size: int = CUBE) -> DataFrame:
    """pixels with ti, tj, cube_no and r, c within the cube; pixels of incomplete edge tiles are left out.

    height and width may be columns, if the pixels are of many scenes (with_extents); a cube is then known by its
    scene and its number.
    """
    ti, tj = F.floor(F.col("i") / size).cast("int"), F.floor(F.col("j") / size).cast("int")
    kept = pixels.withColumns({"ti": ti, "tj": tj}).filter(((F.col("ti") + 1) * size <= _column(height)) & ((F.col("tj") + 1) * size <= _column(width)))
    return kept.withColumns({"cube_no": (F.col("ti") * F.floor(_column(width) / size) + F.col("tj")).cast("int"), "r": F.pmod("i", F.lit(size)), "c": F.pmod("j", F.lit(size))})


def origins(extent: int, size: int = CUBE, overlap: int = OVERLAP) -> list[int]:
    """First rows (or columns) of overlapping tiles; the last one ends at the border."""
    if extent <= size:
        return [0]
    starts = list(range(0, extent - size + 1, size - overlap))
    return starts if starts[-1] == extent - size else [*starts, extent - size]


def _origins_at(at: Column, extent: Column, size: int, overlap: int) -> Column:
    """The origins, as an array, of the tiles that hold a row (or column): multiples of the step that fit, and the last tile."""
    step = size - overlap
    last = F.greatest(extent - size, F.lit(0))
    first = F.greatest(F.ceil((at - (size - 1)) / step), F.lit(0))
    end = F.least(F.floor(at / step), F.floor(last / step))
    regular = F.when(first <= end, F.transform(F.sequence(first, end), lambda k: (k * step).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.concat(regular, F.when(at >= last, F.array(last.cast("int"))).otherwise(F.array().cast("array<int>"))))


def is_whole(height: int, width: int, size: int = CUBE) -> bool:
    """True if a scene is small enough to be predicted in one piece: both sides below 1.5 tiles."""
    return height < 1.5 * size and width < 1.5 * size


def overlap_tiles(pixels: DataFrame, height: int | Column, width: int | Column, size: int = CUBE, overlap: int = OVERLAP) -> DataFrame:
    """Every pixel in all tiles that hold it: adds oi, oj (the tile's origin), r, c. No join, no shuffle; sizes may be columns."""
    held = lambda at, extent: F.explode(_origins_at(F.col(at), _column(extent), size, overlap))
    out = pixels.withColumn("oi", held("i", height)).withColumn("oj", held("j", width))
    return out.withColumns({"r": F.col("i") - F.col("oi"), "c": F.col("j") - F.col("oj")})


def crop_rim(tiled: DataFrame, height: int | Column, width: int | Column, size: int = CUBE, padding: int = PADDING) -> DataFrame:
    """Without the rim of each tile, except where the rim is the scene's own border."""
    ok = lambda at, o, extent: ((at >= padding) | (F.col(o) == 0)) & ((at < size - padding) | (F.col(o) + size >= _column(extent)))
    return tiled.filter(ok(F.col("r"), "oi", height) & ok(F.col("c"), "oj", width))


def overlap_means(tiled: DataFrame, scores: str, classes: int, keys: Sequence[str] = ()) -> DataFrame:
    """keys, i, j, mean: the mean of each class over the tiles that cover a pixel, as an array; one shuffle, combined before it."""
    return tiled.groupBy(*keys, "i", "j").agg(F.array(*[F.avg(F.get(scores, F.lit(k))) for k in range(classes)]).alias("mean"))


def overlap_mean(tiled: DataFrame, scores: str = "prob", classes: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """keys, i, j, k, p: mean of each class over the tiles that cover a pixel. With the number of classes known, classes travel together."""
    if classes:
        return overlap_means(tiled, scores, classes, keys).select(*keys, "i", "j", F.posexplode("mean").alias("k", "p"))
    long = tiled.select(*keys, "i", "j", F.posexplode(scores).alias("k", "s"))
    return long.groupBy(*keys, "i", "j", "k").agg(F.avg("s").alias("p"))


def rotated(n: int, k: Column, r: Column, c: Column) -> tuple[Column, Column]:
    """Where (r, c) of an n x n cube lies after k quarter turns against the clock."""
    turn = F.pmod(k, F.lit(4))
    row = F.when(turn == 0, r).when(turn == 1, F.lit(n - 1) - c).when(turn == 2, F.lit(n - 1) - r).otherwise(c)
    col = F.when(turn == 0, c).when(turn == 1, r).when(turn == 2, F.lit(n - 1) - c).otherwise(F.lit(n - 1) - r)
    return row, col


def rotate_cubes(pixels: DataFrame, n: int, turns: Column | None = None, seed: int = 42) -> DataFrame:
    """pixels with r, c turned; the turns are a hash of cube_id and seed if not given, so a cube always turns alike."""
    k = F.pmod(F.xxhash64("cube_id", F.lit(seed)), F.lit(4)) if turns is None else turns
    row, col = rotated(n, k, F.col("r"), F.col("c"))
    return pixels.withColumns({"r": row.cast("int"), "c": col.cast("int")})


def good_cubes(pixels: DataFrame, bands: Sequence[str], max_black: float = 0.8, area: int | None = None, keys: Sequence[str] = ("cube_id",)) -> DataFrame:
    """keys, black_share of cubes whose share of black pixels is at most max_black.

    area: the pixels of a full cube; by default those present.
    """
    n_black = F.sum(black([F.col(b) for b in bands]).cast("int"))
    share = n_black / (F.lit(float(area)) if area else F.count(F.lit(1)))
    return pixels.groupBy(*keys).agg(share.alias("black_share")).filter(F.col("black_share") <= max_black)


def pages(rows: DataFrame, order: Sequence[str], n: int, per: Sequence[str] = ()) -> DataFrame:
    """rows with page, from 0: n rows a page in the given order, each row once, within each `per` group.

    Without `per` the table is sorted in ranges, numbered within each and shifted by the sizes of the ranges before.
    """
    if per:
        at = F.row_number().over(Window.partitionBy(*per).orderBy(*order)) - 1
        return rows.withColumn("page", F.floor(at / n).cast("int"))
    ranges = cut_lineage(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = ranges.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1 + F.col("_before")
    return ranges.join(F.broadcast(sizes.select("_p", before.alias("_before"))), "_p").select(*rows.columns, F.floor(at / n).cast("int").alias("page"))  # one row per range


def shrink(pixels: DataFrame, by: int, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """keys, i, j and the mean of each value over blocks of by x by pixels."""
    block = [F.floor(F.col(a) / by).cast("int").alias(a) for a in ("i", "j")]
    return pixels.groupBy(*keys, *block).agg(*[F.avg(v).alias(v) for v in values])


def batches(rows: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """rows with batch, from 0: n rows a batch in a shuffled order that the seed decides; the last batch may be short.

    The order is that of a hash, so an epoch is another seed and a task run again gives the same batches.
    """
    return pages(rows.withColumn("_h", F.xxhash64(F.lit(seed), F.col(id_col))), ["_h", id_col], n).drop("_h").withColumnRenamed("page", "batch")


def concat_sets(*sets: DataFrame) -> DataFrame:
    """All rows of the sets, columns by name; a column that a set lacks is null there."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out
