import random
import statistics

from rasterweave.operators import series as S

SERIES = "i int, j int, t int, c int, v double, date date"
PARTITION = "grid int, cluster_id long, i int, j int"


def oracle(series, partition, factor=1.0, count=3):
    """The definition, pixel by pixel."""
    at = {(i, j, t, c): v for i, j, t, c, v, _ in series}
    ts, cs = sorted({r[2] for r in series}), sorted({r[3] for r in series})
    clusters = {}
    for g, k, i, j in partition:
        clusters.setdefault((g, k), []).append((i, j))
    seen = {}
    for (g, _), pixels in clusters.items():
        thr, mid = {}, {}
        for c in cs:
            spreads = []
            for t in ts:
                v = [at[i, j, t, c] for i, j in pixels if at[i, j, t, c] is not None]
                mid[t, c] = statistics.median(v) if v else None
                spreads.append(statistics.pstdev(v) if v else None)
            thr[c] = None if None in spreads else max(0.05, factor * max(spreads))
        for p in pixels:
            run = 0
            for t in ts:
                hit = any(at[*p, t, c] is not None and thr[c] is not None and mid[t, c] is not None and at[*p, t, c] - mid[t, c] > thr[c] for c in cs)
                run = run + 1 if hit else 0
                if run >= count:
                    seen.setdefault(p, set()).add(g)
    return sorted((i, j, len(g), "flagged" if len(g) > 1 else "detected") for (i, j), g in seen.items())


def rows_of(values):
    """values[(i, j)] = list over t of lists over c."""
    return [(i, j, t, c, v, None) for (i, j), x in values.items() for t, cs in enumerate(x) for c, v in enumerate(cs)]


def test_random_series_against_the_definition(spark):
    rng = random.Random(4)
    values = {(i, j): [[None if rng.random() < 0.1 else rng.random() ** 3 for _ in range(2)] for _ in range(9)] for i in range(6) for j in range(5)}
    partition = [(0, (i * 5 + j) % 3, i, j) for i, j in values] + [(1, i % 2, i, j) for i, j in values]
    rows = rows_of(values)
    got = S.predict_dieback(spark.createDataFrame(rows, SERIES), spark.createDataFrame(partition, PARTITION), factor=0.8, count=2)
    want = oracle(rows, partition, 0.8, 2)
    assert sorted(tuple(r) for r in got.select("i", "j", "n", "degree").collect()) == want and want


def calm(n=6):
    return {(0, j): [[0.1] for _ in range(n)] for j in range(1, 30)}


def predict(spark, values, grids=(0,)):
    partition = [(g, 1, i, j) for i, j in values for g in grids]
    out = S.predict_dieback(spark.createDataFrame(rows_of(values), SERIES), spark.createDataFrame(partition, PARTITION))
    return sorted((r["i"], r["j"], r["degree"]) for r in out.collect())


def test_runs(spark):
    hit = lambda *x: [[0.1 if v == 0 else None if v is None else 2.0] for v in x]
    assert predict(spark, calm() | {(0, 0): hit(1, 1, 0, 1, 1, 0)}) == []
    assert predict(spark, calm() | {(0, 0): hit(1, 1, None, 1, 1, 1)}) == [(0, 0, "detected")]
    assert predict(spark, calm() | {(0, 0): hit(1, 1, None, 1, 1, None)}) == []
    assert predict(spark, calm() | {(0, 0): [[-5.0]] * 6}) == []
    assert predict(spark, calm() | {(0, 0): hit(1, 1, 1, 0, 0, 0)}, (0, 1)) == [(0, 0, "flagged")]


def test_a_date_masked_for_the_whole_cluster_disables_the_channel(spark):
    values = calm() | {(0, 0): [[2.0]] * 6}
    values = {k: [[None] if t == 2 else x for t, x in enumerate(v)] for k, v in values.items()}
    rows = S.clustered(spark.createDataFrame(rows_of(values), SERIES), spark.createDataFrame([(0, 1, i, j) for i, j in values], PARTITION))
    assert S.thresholds(S.cluster_statistics(rows)).first()["threshold"] is None
    assert predict(spark, values) == []


def test_windows_are_inclusive_and_checked(spark):
    import datetime as dt

    import pytest

    rows = [(0, 0, t, c, 1.0, dt.date(2022, 1, 1 + t)) for t in range(5) for c in range(3)]
    df = spark.createDataFrame(rows, SERIES)
    got = S.historical_window(df, "2022-01-02", "2022-01-04", [0, 2]).collect()
    assert {(r["t"], r["c"]) for r in got} == {(t, c) for t in (1, 2, 3) for c in (0, 2)}
    assert S.historical_window(df).count() == 15
    with pytest.raises(ValueError):
        S.historical_window(df, channels=[-1])


def test_both_sides(spark):
    values = calm() | {(0, 0): [[-5.0]] * 6}
    partition = spark.createDataFrame([(0, 1, i, j) for i, j in values], PARTITION)
    assert S.predict_dieback(spark.createDataFrame(rows_of(values), SERIES), partition, side="both").count() == 1


def test_empty(spark):
    assert S.predict_dieback(spark.createDataFrame([], SERIES), spark.createDataFrame([], PARTITION)).collect() == []
