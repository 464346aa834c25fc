import math

import pytest
from pyspark.sql import functions as F

from rasterweave.functions import bands as B
from rasterweave.functions import masks as M


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()


def test_worked_values(spark):
    ndvi = lambda v: B.INDICES["NDVI"] and (F.lit(127.5) * B.clamp(F.lit(v), 0, 255) + F.lit(127.5))
    assert one(spark, ndvi(-0.2), ndvi(0.6))[:] == (127.5, 204.0)
    row = {b.lower(): 0 for b in B.BANDS} | {"b4": 1200, "b12": 1600, "b8": 6000, "b3": 0, "b11": 0}
    df = spark.createDataFrame([row])
    assert df.select(B.index_scaled("DRS")).first()[0] == 12.3515625
    row |= {"b4": 500, "b11": 500, "b8": 6000}
    assert abs(spark.createDataFrame([row]).select(B.index_scaled("DWSI")).first()[0] - 306) < 1e-5
    assert one(spark, *[B.normalize(F.lit(v), *B.BANDS["B8A"]) for v in (2850, 500, 9000)])[:] == (127.5, 0.0, 255.0)


def test_null_stays_null_everywhere(spark):
    none = F.lit(None).cast("int")
    got = one(spark, B.normalize(none, 0, 1), B.denormalize(none, 0, 1), B.clamp(none, 0, 1), M.edge_correction(none.cast("double")), M.shift_label(none), M.binary_label(none), B.cr_swir(none, none, none), M.softmax(F.lit(None).cast("array<double>")), M.argmax(F.lit(None).cast("array<double>")))
    assert list(got) == [None] * len(got)


def test_clamping_after_the_stretch_stays_in_range(spark):
    row = {b.lower(): 4000 for b in B.BANDS} | {"b4": 1, "b11": 1}
    df = spark.createDataFrame([row])
    assert df.select(B.index_scaled("DWSI", clamp_first=False)).first()[0] == 255.0


def test_denormalize_is_the_inverse_only_if_exact(spark):
    back = one(spark, B.denormalize(F.lit(127.5), 1000, 4700, exact=True), B.denormalize(F.lit(127.9), 1000, 4700))
    assert back[:] == (2850.0, 127 * 3700 + 1000)


def test_registering_an_index(spark):
    B.register_index("TEST", "B8A / (B4 + 1)", 0, 2)
    try:
        df = spark.createDataFrame([{b.lower(): 3 for b in B.BANDS}])
        assert df.select(B.index_value("TEST")).first()[0] == 0.75
        for bad in (("X", "B99 + 1", 0, 1), ("X", "B1", 1, 1)):
            with pytest.raises(ValueError):
                B.register_index(*bad)
    finally:
        del B.INDICES["TEST"]


def test_derived_bands_by_name(spark):
    df = spark.createDataFrame([(100.0, 120.0, 90.0)], "b8a_norm double, b11_norm double, b12_norm double")
    x, y, z = 100 * 3700 + 1000, 120 * 3200 + 300, 90 * 2600 + 100
    want = 90 * y / (x + (1613 - 864) * (z - x) / (2200 - 864))
    assert math.isclose(B.append_bands(df, ["CR_SWIR"]).first()["cr_swir"], want)
    assert B.append_bands(df, []).columns == df.columns
    with pytest.raises(NotImplementedError):
        B.append_bands(df, ["OTHER"])


def test_masks_and_codes(spark):
    lit = F.lit
    assert [one(spark, M.clear(lit(v).cast("int")))[0] for v in (3, 4, 5, None)] == [False, True, True, False]
    assert [one(spark, M.cloudy(lit(v).cast("int")))[0] for v in (3, 4, 10, None)] == [1, 0, 1, 0]
    assert [one(spark, M.shift_label(lit(v)))[0] for v in (0, 1, 5)] == [255, 0, 4]
    assert [one(spark, M.binary_label(lit(v)))[0] for v in (0, 3, 255)] == [0, 2, 255]
    assert one(spark, M.black_array(F.array(*[lit(0)] * 11, lit(7))), M.black_array(F.array(*[lit(0)] * 10, lit(1))))[:] == (True, False)
    assert one(spark, M.severity_class(lit("C"), {"A": 0, "C": 2}), M.severity_class(lit("Z"), {"A": 0}))[:] == (4, None)
    none = lit(None).cast("int")
    code = lambda s, step, combo: one(spark, M.multi_class_code(lit(s), lit(step), none if combo is None else lit(combo), 4))[0]
    assert [code("G", 3, 7), code("B", 1, None), code("B", 1, 0), code("D", 3, 2)] == [0, 3, 7, 17]
    assert one(spark, M.standardized(lit(3.0), lit(1.0), lit(2.0)), M.standardized(lit(3.0), lit(1.0), lit(0.0)))[:] == (1.0, 2.0)


def test_softmax_and_first_maximum(spark):
    row = one(spark, M.softmax(F.array(F.lit(1000.0), F.lit(1000.0))), M.argmax(F.array(F.lit(1), F.lit(5), F.lit(5))), M.argmax(F.array().cast("array<int>")))
    assert row[0] == [0.5, 0.5] and row[1] == 1 and row[2] is None
