"""Pixel masks, class codes and small per-pixel expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scene classes kept as vegetation or bare soil, and those that count as cloud; the background label.
CLEAR_CLASSES, CLOUD_CLASSES, BACKGROUND = (4, 5), (3, 7, 8, 9, 10), 255
# Severities without damage.
HEALTHY_SEVERITIES = ("G", "H")


def clear(scl: Column) -> Column:
    """True for vegetation and bare soil, also false for a null class."""
    return F.coalesce(scl.isin(*CLEAR_CLASSES), F.lit(False))


def masked(value: Column, scl: Column) -> Column:
    """The value of a clear pixel, null otherwise."""
    return F.when(clear(scl), value)


def cloudy(scl: Column) -> Column:
    """1 for cloud and shadow, else 0."""
    return F.coalesce(scl.isin(*CLOUD_CLASSES), F.lit(False)).cast("int")


def black(bands: Sequence[Column]) -> Column:
    """True if all given bands are 0 (or null): nothing was recorded."""
    out = F.lit(True)
    for b in bands:
        out = out & (F.coalesce(b, F.lit(0)) == 0)
    return out


def black_array(bands: Column, n: int = 11) -> Column:
    """black() of the first n elements of an array."""
    return F.forall(F.slice(bands, 1, n), lambda b: F.coalesce(b == 0, F.lit(True)))


def unmask_black(bands: Column, n: int = 11) -> Column:
    """The bands of a pixel with its channels null where it is black."""
    return F.when(black_array(bands, n), F.transform(bands, lambda b: F.when(F.lit(False), b))).otherwise(bands)


def shift_label(label: Column) -> Column:
    """Label minus 1 within one byte: 0 becomes the background 255."""
    return F.pmod(label.cast("int") - 1, F.lit(256))


def binary_label(label: Column) -> Column:
    """0 healthy, 255 background, 2 anything else."""
    return F.when(label == 0, 0).when(label == BACKGROUND, BACKGROUND).when(label.isNotNull(), 2)


def severity_class(severity: Column, steps: dict[str, int]) -> Column:
    """Class of a severity code under a caller's step table: step + 2; null for an unknown code."""
    table = F.create_map(*[F.lit(x) for pair in steps.items() for x in pair]) if steps else F.lit(None).cast("map<string,int>")
    return F.try_element_at(table, severity) + 2


def multi_class_code(severity: Column, step: Column, combination: Column, n_steps: int) -> Column:
    """Class of severity and (tree, pest) combination.

    0 for a severity without damage, 2 + step for an unknown combination, 2 + n + combination * n + step else.
    """
    return F.when(severity.isin(*HEALTHY_SEVERITIES), F.lit(0)).when(combination.isNull(), step + 2).otherwise(F.lit(2 + n_steps) + combination * n_steps + step)


def edge_correction(weight: Column) -> Column:
    """A distance squared and clipped to [0, 1]."""
    return F.when(weight.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight * weight)))


def standardized(value: Column, mean: Column, std: Column) -> Column:
    """(value - mean) / std, without the division where std vanishes."""
    return F.when(std > 1e-10, (value - mean) / std).otherwise(value - mean)


def softmax(scores: Column) -> Column:
    """Softmax of an array, stable for large scores; null for null."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def argmax(scores: Column) -> Column:
    """Position from 0 of the first maximum; null for null or an empty array."""
    return F.when(F.size(scores) > 0, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def shown(value: Column, is_black: Column, fill: float) -> Column:
    """What a map shows: the value, or `fill` where nothing was recorded (a class of its own, or a probability or count)."""
    return F.when(is_black, F.lit(fill)).otherwise(value)


def overlay(colors: Sequence[Column], where: Column, color: Sequence[float], alpha: float = 1.0) -> list[Column]:
    """Color channels with `color` laid over them where the mask is true, mixed by alpha; null or false leaves them as they are."""
    return [F.when(where, c * (1 - alpha) + F.lit(float(x)) * alpha).otherwise(c) for c, x in zip(colors, color, strict=True)]
