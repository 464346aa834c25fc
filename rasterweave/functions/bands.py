"""Spectral bands and vegetation indices as Catalyst expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bands in channel order with the reflectances that map to 0 and 255.
BANDS: dict[str, tuple[int, int]] = {
    "B1": (0, 1200),
    "B2": (0, 1400),
    "B3": (0, 1600),
    "B4": (0, 1600),
    "B5": (200, 2000),
    "B6": (700, 3600),
    "B7": (900, 4400),
    "B8": (800, 4500),
    "B8A": (1000, 4700),
    "B11": (300, 3500),
    "B12": (100, 2700),
}

# Index formulas over raw bands, in channel order, with the values that map to 0 and 255.
INDICES: dict[str, tuple[str, float, float]] = {
    "NDWI": ("(B8A - B11) / (B8A + B11 + 1e-6)", -1, 1),
    "DWSI": ("(B8 + B3) / (B4 + B11 + 1e-6)", 0, 5),
    "NGRDI": ("(B3 - B4) / (B3 + B4 + 1e-6)", -1, 1),
    "RDI": ("B12 / (B8A + 1e-6)", 0, 2),
    "GLI": ("(2 * B3 - B2 - B4) / (2 * B3 + B2 + B4 + 1e-6)", -1, 1),
    "NDRE2": ("(B7 - B5) / (B7 + B5 + 1e-6)", -1, 1),
    "PBI": ("B8 / (B3 + 1e-6)", 0, 20),
    "NDVI": ("(B8A - B4) / (B8A + B4 + 1e-6)", -1, 1),
    "GNDVI": ("(B8A - B3) / (B8A + B3 + 1e-6)", -1, 1),
    "CIG": ("B8A / (B3 + 1e-6) - 1", 0, 20),
    "CVI": ("B8A * B5 / (B3 * B3 + 1e-6)", 0, 50),
    "NDRE3": ("(B8A - B7) / (B8A + B7 + 1e-6)", -1, 1),
    "DRS": ("sqrt(B4 * B4 + B12 * B12)", 100, 3300),
}

# Wavelengths in nm of the bands of the continuum removal, and its scale.
NIR_NM, SWIR1_NM, SWIR2_NM, CR_SCALE = 864, 1613, 2200, 90

_BAND = re.compile(r"\bB(\d{1,2}[A-Z]?)\b")


def clamp(c: Column, low: float, high: float) -> Column:
    """c within [low, high]; null stays null (greatest and least alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c.cast("double"))))


def normalize(c: Column, p1: float, p99: float) -> Column:
    """Reflectance to 0-255 between its 1st and 99th percentile."""
    return clamp(F.lit(255.0) * (c.cast("double") - F.lit(float(p1))) / F.lit(float(p99 - p1)), 0, 255)


def denormalize(c: Column, p1: float, p99: float, exact: bool = False) -> Column:
    """From 0-255 towards reflectance: truncated to an integer, times the spread, plus p1.

    By default without the division by 255, as stored products expect it; exact=True gives the inverse of normalize.
    """
    if exact:
        return c.cast("double") / 255.0 * F.lit(float(p99 - p1)) + F.lit(float(p1))
    return c.cast("int").cast("double") * F.lit(float(p99 - p1)) + F.lit(float(p1))


def register_index(name: str, formula: str, p1: float, p99: float) -> None:
    """Add an index or replace one. The formula is SQL over band names and goes into the plan, not into a UDF."""
    unknown = {f"B{m}" for m in _BAND.findall(formula)} - set(BANDS)
    if unknown:
        raise ValueError(f"unknown bands: {sorted(unknown)}")
    if p1 >= p99:
        raise ValueError("p1 must be below p99")
    INDICES[name] = (formula, p1, p99)


def expand_formula(formula: str, prefix: str = "") -> str:
    """Band names in a formula as double columns."""
    return _BAND.sub(lambda m: f"CAST(`{prefix}b{m.group(1).lower()}` AS DOUBLE)", formula)


def index_value(name: str, prefix: str = "") -> Column:
    """The raw value of an index."""
    return F.expr(expand_formula(INDICES[name][0], prefix))


def index_scaled(name: str, prefix: str = "", clamp_first: bool = True) -> Column:
    """An index stretched to its 0-255 scale.

    The stored form clamps the value to [0, 255] before it is stretched, so a negative index becomes 0 first and the
    result may leave 0-255. clamp_first=False stretches first and clamps the result.
    """
    _, p1, p99 = INDICES[name]
    k = 255.0 / (p99 - p1)
    value = index_value(name, prefix)
    if clamp_first:
        return F.lit(k) * clamp(value, 0, 255) - F.lit(p1 * k)
    return clamp(F.lit(k) * value - F.lit(p1 * k), 0, 255)


def with_indices(pixels: DataFrame, names: Sequence[str] | None = None, **how) -> DataFrame:
    """pixels with one column per index, in one projection."""
    return pixels.withColumns({n.lower(): index_scaled(n, **how) for n in (names or INDICES)})


def final_bands(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, the eleven normalised bands and the indices, in channel order."""
    bands = [normalize(F.col(b.lower()), *BANDS[b]).alias(f"{b.lower()}_norm") for b in BANDS]
    return pixels.select(*keys, *bands, *[index_scaled(n).alias(n.lower()) for n in INDICES])


def cr_swir(b8a: Column, b11: Column, b12: Column, exact: bool = False) -> Column:
    """Continuum removal in the short-wave infrared from normalised bands; null where the continuum is 0."""
    nir, swir1, swir2 = denormalize(b8a, *BANDS["B8A"], exact), denormalize(b11, *BANDS["B11"], exact), denormalize(b12, *BANDS["B12"], exact)
    line = nir + F.lit(float(SWIR1_NM - NIR_NM)) * (swir2 - nir) / F.lit(float(SWIR2_NM - NIR_NM))
    return F.try_divide(F.lit(float(CR_SCALE)) * swir1, line)


#: Bands that can be appended by name.
DERIVED = {"CR_SWIR": lambda: cr_swir(F.col("b8a_norm"), F.col("b11_norm"), F.col("b12_norm"))}


def append_bands(pixels: DataFrame, names: Sequence[str]) -> DataFrame:
    """pixels with the named derived bands; an unknown name raises NotImplementedError."""
    for n in names:
        if n not in DERIVED:
            raise NotImplementedError(f"no derived band {n}")
    return pixels.withColumns({n.lower(): DERIVED[n]() for n in names})


# The band shown in each color, for true color and for the near infrared.
COMPOSITES = {"rgb": {"red": "B4", "green": "B3", "blue": "B2"}, "nir": {"nir": "B8"}}


def composite(pixels: DataFrame, keys: Sequence[str], kinds: Sequence[str] = ("rgb",)) -> DataFrame:
    """keys and the colors of the named composites; an unknown one raises ValueError."""
    if unknown := set(kinds) - set(COMPOSITES):
        raise ValueError(f"unknown composites: {sorted(unknown)}")
    return pixels.select(*keys, *[F.col(b.lower()).alias(color) for k in kinds for color, b in COMPOSITES[k].items()])


def rescaled(c: Column, scale: float = 255.0) -> Column:
    """A stored 0-255 value as a share."""
    return c.cast("double") / F.lit(float(scale))
