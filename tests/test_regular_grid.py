import datetime as dt
import random

from pyspark.sql import functions as F

from rasterweave.functions.tiles import one_row_per_id, standard_split, standard_tile
from rasterweave.operators.regular_grid import regular_grid

ORIGIN = dt.datetime(2016, 1, 1)
SCHEMA = "s string, ts timestamp_ntz, v double, status string"


def at(day, hour=0):
    return ORIGIN + dt.timedelta(days=day, hours=hour)


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    out = regular_grid(df, "s", "ts", ["v"], origin="2016-01-01", width_s=5 * 86400, **how).collect()
    return sorted(((r["s"], r["period_no"], r["n_readings"], r["status"], r["from_period"], r["v"]) for r in out), key=repr)


def brute(rows, max_gap):
    by = {}
    for s, ts, v, _ in rows:
        if s is not None and ts is not None:
            by.setdefault(s, {}).setdefault((ts - ORIGIN).days // 5, []).append((ts, v))
    out = []
    for s, periods in by.items():
        for p in range(min(periods), max(periods) + 1):
            back = next((q for q in range(p, p - max_gap - 1, -1) if q in periods), None)
            n = len(periods.get(p, []))
            status = "observed" if n else "carried" if back is not None else "missing"
            out.append((s, p, n, status, back, max(periods[back])[1] if back is not None else None))
    return sorted(out, key=repr)


def test_against_brute_force_over_chunk_borders(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), at(rng.randrange(-200, 900), rng.randrange(24)), float(k), "x") for k in range(150)]
    for gap in (0, 2, 5):
        df = spark.createDataFrame(rows, SCHEMA)
        got = regular_grid(df, "s", "ts", ["v"], origin="2016-01-01", width_s=5 * 86400, max_gap=gap, chunk=8).collect()
        assert sorted(((r["s"], r["period_no"], r["n_readings"], r["status"], r["from_period"], r["v"]) for r in got), key=repr) == brute(rows, gap)


def test_bounds_are_half_open_and_borders_belong_to_the_later_period(spark):
    rows = [("a", at(0), 1.0, None), ("a", at(5), 2.0, None), ("a", at(10), 3.0, None)]
    assert [r[1] for r in run(spark, rows, start="2016-01-01", end="2016-01-11")] == [0, 1]


def test_ties_repeats_nulls_and_the_empty_table(spark):
    rows = [("a", at(1), 1.0, None), ("a", at(1), 9.0, None), ("a", at(1), 9.0, None), ("a", None, 5.0, None), (None, at(2), 5.0, None), ("b", at(3), None, "x")]
    assert run(spark, rows) == [("a", 0, 3, "observed", 0, 9.0), ("b", 0, 1, "observed", 0, None)]
    assert run(spark, []) == []


def test_values_called_like_the_result_are_refused(spark):
    import pytest

    with pytest.raises(ValueError):
        regular_grid(spark.createDataFrame([], SCHEMA), "s", "ts", ["status"], origin="2016-01-01", width_s=60)


def test_a_source_far_apart_is_filled_in_chunks(spark):
    rows = [("a", at(0), 1.0, None), ("a", at(5 * 5000), 2.0, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = regular_grid(df, "s", "ts", [], origin="2016-01-01", width_s=5 * 86400, max_gap=3, chunk=64)
    assert {r["status"]: r["count"] for r in out.groupBy("status").count().collect()} == {"observed": 2, "carried": 3, "missing": 4996}


def test_standard_names(spark):
    tiles = [" t07szv ", "7SZV", "07-S/ZV", "07szv", "", " ", None, "T07SZV", "??", "12ABCD"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in tiles], "t string").select(standard_tile(F.col("t"))).collect()]
    assert got == ["07SZV", "07SZV", "07SZV", "07SZV", None, None, None, "07SZV", None, "12ABCD"]
    names = ["Train", " TRAINING", "Val ", "validation", "testing", "", None, "other"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in names], "t string").select(standard_split(F.col("t"))).collect()]
    assert got == ["train", "train", "val", "val", "test", None, None, None]


def test_one_row_per_id_is_the_least_row(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (None, "c", 3), (2, None, 4)], "id int, v string, n int")
    assert sorted(map(tuple, one_row_per_id(df, "id", "v").collect())) == [(1, "a"), (2, None)]
    assert sorted(map(tuple, one_row_per_id(df, "id").collect())) == [(1,), (2,)]
