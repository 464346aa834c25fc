import random
from collections import defaultdict

import pytest

from rasterweave.llm.packing import Windows, best_fit_decreasing, pack_items, pack_report

CAPACITIES = {"a": 10, "b": 64}


def check(items, rows, capacities):
    held, pieces = defaultdict(int), defaultdict(list)
    for r in rows:
        held[r["pack_name"], r["container_id"]] += r["size"]
        pieces[r["pack_name"], r["item"]].append((r["piece_no"], r["start"], r["size"]))
    assert all(v <= capacities[name] for (name, _), v in held.items())
    for name, capacity in capacities.items():
        for item, size in items.items():
            got = sorted(pieces[name, item])
            assert sum(p[2] for p in got) == size and [p[1] for p in got] == [k * capacity for k in range(len(got))]
            assert len(got) == (1 if size <= capacity else -(-size // capacity))
    return held


@pytest.mark.parametrize("windows", [1, 3, 64])
def test_every_item_is_placed_whole_and_nothing_overflows(spark, windows):
    rng = random.Random(windows)
    items = {k: rng.choice([1, 3, 7, 10, 11, 20, 64, 65, 130]) for k in range(500)}
    df = spark.createDataFrame([(k, v, 0) for k, v in items.items()], "item long, n int, container_id int").repartition(7)
    rows = pack_items(df, "item", "n", CAPACITIES, open_windows=windows, partitions_merged=2).collect()
    held = check(items, rows, CAPACITIES)
    fill = {r["pack_name"]: r["fill"] for r in pack_report(spark.createDataFrame(rows), CAPACITIES).collect()}
    total = sum(items.values())
    for name, capacity in CAPACITIES.items():
        n = sum(k[0] == name for k in held)
        assert abs(fill[name] - total / (n * capacity)) < 1e-12
    if windows == 64:
        assert fill["b"] > 0.97


def test_nulls_zeros_empties_and_repeats(spark):
    schema = "item long, n int"
    rows = pack_items(spark.createDataFrame([(1, None), (2, 0), (None, 4), (3, 4), (3, 4), (4, -1)], schema), "item", "n", {"a": 10}).collect()
    assert [(r["item"], r["size"]) for r in rows] == [(3, 4), (3, 4)]
    assert pack_items(spark.createDataFrame([], schema), "item", "n", {"a": 10}).collect() == []
    assert pack_items(spark.createDataFrame([(1, 2)], schema), "item", "n", {}).collect() == []
    with pytest.raises(ValueError):
        pack_items(spark.createDataFrame([], schema), "item", "n", {"a": 0})


def test_open_windows_stay_bounded_and_the_fullest_goes_first():
    w = Windows(10, 2)
    assert w.place("p", 6) == [] and w.place("q", 7) == []
    assert w.place("r", 8) == [(1, [("q", 0, 0, 7)])]
    assert len(w.held) == 2
    assert w.place("s", 4) == [(0, [("p", 0, 0, 6), ("s", 0, 0, 4)])]


def test_merge_is_best_fit_decreasing():
    assert best_fit_decreasing([5, 3, 7, 3], 10) == [0, 2, 2, 0]
    assert best_fit_decreasing([], 10) == []
