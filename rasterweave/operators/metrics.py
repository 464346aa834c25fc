"""Evaluation of segmentations, and statistics of cubes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterweave.functions.masks import BACKGROUND, binary_label, black
from rasterweave.session import cut_lineage

#: Groups whose few numbers (range, ranks) are broadcast at most.
BROADCAST_GROUPS = 200_000

# The smoothing terms of the class metrics and of the Dice loss, and the class weights of the cross entropy.
EPS, SMOOTH, CLASS_WEIGHTS = 1e-6, 0.1, (1.0, 10.0, 5.0, 3.0, 2.0)


def confusion(pixels: DataFrame) -> DataFrame:
    """label, pred, n without background: one aggregation that everything else is derived from."""
    return pixels.filter(F.col("label") != BACKGROUND).groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))


def class_metrics(pixels: DataFrame, classes: int) -> DataFrame:
    """class, tp, predicted, actual, iou, precision, recall, f1 for classes 0 to classes - 1; an absent class has IoU 1."""
    counts = confusion(pixels)
    sides = F.array(F.struct(F.col("label").cast("int").alias("k"), F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("a"), F.lit(0).cast("long").alias("p")), F.struct(F.col("pred").cast("int").alias("k"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("a"), F.col("n").alias("p")))
    sums = counts.select(F.explode(sides).alias("s")).groupBy(F.col("s.k").alias("class")).agg(F.sum("s.tp").alias("tp"), F.sum("s.p").alias("predicted"), F.sum("s.a").alias("actual"))
    every = pixels.sparkSession.range(classes).select(F.col("id").cast("int").alias("class"))
    out = every.join(sums, "class", "left").na.fill(0, ["tp", "predicted", "actual"])
    tp, p, a = F.col("tp"), F.col("predicted"), F.col("actual")
    out = out.withColumns({"iou": (tp + EPS) / (p + a - tp + EPS), "precision": (tp + EPS) / (p + EPS), "recall": (tp + EPS) / (a + EPS)})
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + EPS))


def overall_accuracy(pixels: DataFrame) -> DataFrame:
    """accuracy over all pixels, background included, and accuracy_fg without it."""
    same = (F.col("label") == F.col("pred")).cast("double")
    return pixels.agg(F.avg(same).alias("accuracy"), F.avg(F.when(F.col("label") != BACKGROUND, same)).alias("accuracy_fg"))


def dice_loss(scored: DataFrame, classes: int) -> DataFrame:
    """loss: 1 - mean over classes of the Dice coefficient of probabilities against labels, background masked."""
    rows = scored.filter(F.col("label") != BACKGROUND).select("label", F.posexplode("prob").alias("k", "p")).filter(F.col("k") < classes)
    y = (F.col("label") == F.col("k")).cast("double")
    per = rows.groupBy("k").agg(F.sum(F.col("p") * y).alias("both"), F.sum("p").alias("p"), F.sum(y).alias("y"))
    return per.agg((1 - F.avg((2 * F.col("both") + SMOOTH) / (F.col("p") + F.col("y") + SMOOTH))).alias("loss"))


def combined_loss(scored: DataFrame, classes: int, dice_weight: float = 0.4, ce_weight: float = 0.4, weights: Sequence[float] = CLASS_WEIGHTS) -> DataFrame:
    """dice, cross_entropy, false_positives and loss, their weighted sum.

    Cross entropy is weighted by class and ignores background. False positives: the mean over pixels and classes of the
    probability given to a wrong class; its weight is what the other two leave of 1.
    """
    kept = scored.filter(F.col("label") != BACKGROUND)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights[:classes]]), F.col("label").cast("int") + 1)
    p = F.element_at("prob", F.col("label").cast("int") + 1)
    wrong = F.aggregate("prob", F.lit(0.0), lambda a, x: a + x) - p
    one = kept.agg(F.try_divide(F.sum(-w * F.log(F.greatest(p, F.lit(1e-12)))), F.sum(w)).alias("cross_entropy"), (F.avg(wrong) / classes).alias("false_positives"))
    dice = dice_loss(scored, classes).scalar()
    rest = 1 - dice_weight - ce_weight
    out = one.withColumn("dice", dice)
    penalty = F.lit(rest) * F.col("false_positives") if rest > 1e-12 else F.lit(0.0)
    return out.withColumn("loss", F.lit(dice_weight) * F.col("dice") + F.lit(ce_weight) * F.col("cross_entropy") + penalty)


def label_counts(pixels: DataFrame) -> DataFrame:
    """cube_id, label, n."""
    return pixels.groupBy("cube_id", "label").agg(F.count(F.lit(1)).alias("n"))


def healthy_share(pixels: DataFrame) -> DataFrame:
    """n_cubes, n_healthy and share of cubes that hold only labels 0 and 1."""
    per = pixels.groupBy("cube_id").agg(F.bool_and(F.col("label") <= 1).alias("healthy"))
    return per.agg(F.count(F.lit(1)).alias("n_cubes"), F.sum(F.col("healthy").cast("int")).alias("n_healthy"), F.avg(F.col("healthy").cast("double")).alias("share"))


def position_accuracy(pixels: DataFrame, right: Column | None = None) -> DataFrame:
    """r, c, accuracy: right pixels (label = pred by default) over the cubes without background at that position; null where there is none."""
    same = (F.col("label") == F.col("pred")) if right is None else right
    return pixels.groupBy("r", "c").agg(F.try_divide(F.sum(same.cast("int")), F.sum((F.col("label") != BACKGROUND).cast("int"))).alias("accuracy"))


def binary_accuracy(pixels: DataFrame) -> DataFrame:
    """position_accuracy of healthy against damaged."""
    return position_accuracy(pixels, binary_label(F.col("label")) == binary_label(F.col("pred")))


def graded_accuracy(pixels: DataFrame) -> DataFrame:
    """r, c, accuracy: 1 for the right class down to 0 for the farthest; differences above 200 count as none."""
    d = F.abs(F.col("label").cast("int") - F.col("pred").cast("int"))
    worst = F.sum(F.when(d > 200, 0).otherwise(d))
    return pixels.groupBy("r", "c").agg(((4 - F.try_divide(worst, F.sum((F.col("label") != BACKGROUND).cast("int")))) / 4).alias("accuracy"))


def ring_zone(frame: Column, n: int, zones: int) -> Column:
    """The zone of a frame of an n x n cube, frames counted from the rim inwards.

    The frames up to and with the k-th hold 4 (k + 1)(n - 1 - k) cells, and a zone has n * n // zones of them, so the zone is
    how often that goes into the cells so far. It never passes frame + 1, as a frame begins one zone at most, nor the last.
    """
    upto = (frame + 1) * (F.lit(n - 1) - frame) * 4
    return F.least(F.floor(upto / F.lit(n * n // zones)), frame + 1, F.lit(zones - 1)).cast("int")


#: Two-sided quantiles of the normal distribution by confidence.
NORMAL_QUANTILE = {0.90: 1.6448536269514722, 0.95: 1.959963984540054, 0.99: 2.5758293035489004}


def ring_accuracy(pixels: DataFrame, n: int, zones: int = 15) -> DataFrame:
    """zone, n, accuracy, std over the pixels of each concentric zone that aren't background, the rim first."""
    frame = F.least(F.col("r"), F.col("c"), F.lit(n - 1) - F.col("r"), F.lit(n - 1) - F.col("c"))
    zone = ring_zone(frame.cast("int"), n, zones)
    right = (F.col("label") == F.col("pred")).cast("double")
    return pixels.filter(F.col("label") != BACKGROUND).groupBy(zone.alias("zone")).agg(F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy"), F.stddev_pop(right).alias("std"))


def ring_confidence(rings: DataFrame, confidence: float = 0.99) -> DataFrame:
    """rings with half_width = t * std / sqrt(n); t by its expansion about the normal quantile."""
    z = NORMAL_QUANTILE[confidence]
    v = F.greatest(F.col("n") - 1, F.lit(1)).cast("double")  # its cube leaves a bigint from 2.1 million pixels on
    t = F.lit(z) + F.lit((z**3 + z) / 4) / v + F.lit((5 * z**5 + 16 * z**3 + 3 * z) / 96) / (v * v) + F.lit((3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384) / (v * v * v)
    return rings.withColumn("half_width", t * F.col("std") / F.sqrt("n"))


def vote(votes: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys and value: the most frequent value, the largest on a tie, negative ones ignored; null if there is none."""
    counts = votes.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    good = F.when(F.col(value) >= 0, F.struct("_n", value))
    return counts.groupBy(*keys).agg(F.max(good).alias("_m")).select(*keys, F.col("_m")[value].alias(value))


#: Slices between the least and the greatest value of a group, in which quantiles are looked for.
SLICES = 4096


def quantiles(values: DataFrame, per: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """per, q: the exact interpolated quantiles of each group, as an array; nulls left out, groups without values have no row.

    A first pass counts the values by slice of the group's range, combined before the shuffle; it shows in which slices
    the wanted ranks lie. A second one ranks the distinct values of those slices only. So no buffer and no sort
    holds a group, be it a whole image; what is joined to the values are a few numbers per group.
    """
    v = F.col(value).cast("double")
    rows = values.select(*per, v.alias("_v")).filter("_v IS NOT NULL")
    key = list(per)
    span = rows.groupBy(*key).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    if not key:
        key, rows, span = ["_all"], rows.withColumn("_all", F.lit(0)), span.filter("_n > 0").withColumn("_all", F.lit(0))
    span = cut_lineage(span)
    few = F.broadcast if span.count() <= BROADCAST_GROUPS else (lambda df: df)
    width = F.col("_hi") - F.col("_lo")
    place = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width * SLICES), F.lit(SLICES - 1))).otherwise(0).cast("int")
    sliced = rows.join(few(span), key).withColumn("_s", place)
    counts = sliced.groupBy(*key, "_s").agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    upto = F.sum("_c").over(Window.partitionBy(*key).orderBy("_s").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # Rank r (from 0) lies in the slice with upto - c <= r < upto; an interpolated quantile needs two ranks.
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("_n") - 1) * p), F.ceil((F.col("_n") - 1) * p)) for p in map(float, shares)])))
    wanted = counts.withColumn("_upto", upto).withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_upto") - F.col("_c")) & (r < F.col("_upto")))).filter(F.size("_ranks") > 0)
    wanted = cut_lineage(wanted.select(*key, "_s", (F.col("_upto") - F.col("_c")).alias("_before"), "_ranks"))
    few_slices = F.broadcast if wanted.count() <= BROADCAST_GROUPS else (lambda df: df)
    near = sliced.join(few_slices(wanted), [*key, "_s"]).groupBy(*key, "_s", "_v").agg(F.count(F.lit(1)).alias("_c"), F.first("_before").alias("_before"), F.first("_ranks").alias("_ranks"))
    end = F.col("_before") + F.sum("_c").over(Window.partitionBy(*key, "_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hit = near.withColumn("_end", end).select(*key, "_v", F.explode(F.filter("_ranks", lambda r: (r >= F.col("_end") - F.col("_c")) & (r < F.col("_end")))).alias("_r"))
    found = hit.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_at"))  # two ranks per quantile at most
    out = found.join(few(span.select(*key, "_n")), key)

    def at(p: float) -> Column:
        x = (F.col("_n") - 1) * p
        low, high = F.element_at("_at", F.floor(x)), F.element_at("_at", F.ceil(x))
        return F.when(F.floor(x) == F.ceil(x), low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high)

    return out.select(*per, F.array(*[at(float(p)) for p in shares]).alias("q"))


def contrast_stretch(values: DataFrame, value: str, low: float = 0.02, high: float = 0.98, per: Sequence[str] = ()) -> DataFrame:
    """values with `stretched`: 0 at the low and 1 at the high percentile (interpolated), clipped; 0 where both agree.

    per: columns (such as the image and band) whose groups have their own percentiles, nulls being no group; without it,
    one row of percentiles is attached as a scalar subquery. No group is held in one buffer (see quantiles).
    """
    both = quantiles(values, per, value, [low, high]).withColumnRenamed("q", "_q")
    if per:
        out = values.join(both, list(per), "left")
    else:
        out = values.withColumn("_q", both.scalar())
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    stretched = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col(value) - lo, hi - lo), F.lit(0.0))))
    return out.withColumn("stretched", F.when(F.col(value).isNotNull(), stretched)).drop("_q")


def box_blur(image: DataFrame, value: str, height: int | Column, width: int | Column, k: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """keys, i, j, value: mean over k x k pixels, the edges mirrored; separable, so two window averages.

    height and width may be columns of the image (see tiling.extents). Columns are mirrored and averaged along the rows first, then rows along the columns. An even k reaches k / 2 back and k / 2 - 1 forward.
    Pixels that the image lacks count for nothing.
    """
    back, forward = k // 2, (k - 1) // 2

    def along(df: DataFrame, axis: str, other: str, extent: Column) -> DataFrame:
        at = F.col(axis)
        copies = F.array(at, F.when(at < back, -1 - at), F.when(at >= extent - forward, extent * 2 - 1 - at))
        mirrored = df.select(*keys, "_h", "_w", other, F.explode(F.filter(copies, lambda x: x.isNotNull())).alias(axis), value)
        mean = F.avg(value).over(Window.partitionBy(*keys, other).orderBy(axis).rangeBetween(-back, forward))
        return mirrored.withColumn(value, mean).filter((F.col(axis) >= 0) & (F.col(axis) < extent)).select(*keys, "_h", "_w", "i", "j", value)

    size = [x.alias(n) if isinstance(x, Column) else F.lit(x).alias(n) for x, n in ((height, "_h"), (width, "_w"))]
    rows = image.select(*keys, *size, "i", "j", value)
    return along(along(rows, "j", "i", F.col("_w")), "i", "j", F.col("_h")).select(*keys, "i", "j", value)


def channel_stats(pixels: DataFrame, bands: Sequence[str]) -> DataFrame:
    """band, mean, std over the pixels that aren't black, in one pass."""
    seen = pixels.filter(~black([F.col(b) for b in bands]))
    long = seen.unpivot([], list(bands), "band", "value")
    return long.groupBy("band").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def masked_batch_norm(pixels: DataFrame, bands: Sequence[str], eps: float = 1e-5) -> DataFrame:
    """band, mean, var, scale = 1 / sqrt(var + eps) over values that aren't 0."""
    long = pixels.unpivot([], list(bands), "band", "value").filter("value <> 0")
    return long.groupBy("band").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("var"), (1 / F.sqrt(F.var_pop("value") + eps)).alias("scale"))


def running_metrics(log: DataFrame, per: Sequence[str], step: str, value: str) -> DataFrame:
    """per, step, value, running_mean and best (the greatest so far) of a metric log, and is_best where a new best comes."""
    upto = Window.partitionBy(*per).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*per).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    out = log.select(*per, step, value, F.avg(value).over(upto).alias("running_mean"), F.max(value).over(upto).alias("best"), F.max(value).over(before).alias("_before"))
    return out.withColumn("is_best", F.col(value).isNotNull() & (F.col("_before").isNull() | (F.col(value) > F.col("_before")))).drop("_before")
