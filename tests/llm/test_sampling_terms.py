import random
import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterweave.llm import sampling
from rasterweave.llm.sampling import Draws
from rasterweave.llm.terms import code_frequencies

RECORDS = "id long, stratum string, field_name string, category string, draw_id string"
TARGETS = "draw_id long, stratum string, field_name string, category string, target_share double, min_rows int, sample_size int, id string"


def draws(spark, monkeypatch=None):
    rows = [(k, "t", "f", "Ab" if k % 10 else "rare ", None) for k in range(200)] + [(500 + k, "t", "f", "other", None) for k in range(50)] + [(900, None, "f", "Ab", None), (901, "t", None, "Ab", None), (902, "t", "f", None, None), (903, "t", "f", " ", None)]
    targets = [(1, "t", "f", " aB", 0.5, None, 40, "x"), (1, "t", "f", "RARE", 0.1, 25, 40, "x"), (1, "t", "f", "none", 0.4, 0, 40, "x"), (2, "t", "f", "OTHER", 1.0, 2, 60, "x"), (3, None, "f", "Ab", 1.0, 2, 5, "x"), (4, "u", "f", "Ab", 0.0, None, 5, "x"), (5, "t", "f", None, None, None, None, "x")]
    return spark.createDataFrame(rows, RECORDS), spark.createDataFrame(targets, TARGETS)


@pytest.mark.parametrize("broadcast", [True, False])
def test_quotas_minimum_and_shortage(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(sampling, "BROADCAST_TARGETS", 0)
    d = Draws(*draws(spark), rows_per_task=20)
    got = {(r["draw_id"], r["category"]): (r["required"], r["stock"], r["drawn"], r["short"]) for r in d.report().collect()}
    assert got == {(1, " aB"): (20, 180, 20, False), (1, "RARE"): (25, 20, 20, True), (1, "none"): (16, 0, 0, True), (2, "OTHER"): (60, 50, 50, True), (3, "Ab"): (5, 0, 0, True), (4, "Ab"): (0, 0, 0, False), (5, None): (0, 0, 0, False)}
    sample = d.sample().collect()
    assert Counter((r["draw_id"], r["category"]) for r in sample) == {(1, "AB"): 20, (1, "RARE"): 20, (2, "OTHER"): 50}
    assert len({(r["draw_id"], r["id"]) for r in sample}) == len(sample)


def test_the_draw_does_not_depend_on_the_order_of_rows(spark):
    records, targets = draws(spark)
    one = {tuple(r) for r in Draws(records, targets).sample().collect()}
    assert one == {tuple(r) for r in Draws(records.repartition(5).orderBy("id", ascending=False), targets).sample().collect()}
    assert one != {tuple(r) for r in Draws(records, targets, seed=1).sample().collect()}


def test_the_draw_is_uniform(spark):
    records = spark.createDataFrame([(k, "t", "f", "a", None) for k in range(20)], RECORDS).repartition(2)
    targets = spark.createDataFrame([(d, "t", "f", "a", 1.0, None, 5, "x") for d in range(2000)], TARGETS)
    n = Counter(r["id"] for r in Draws(records, targets).sample().collect())
    assert sum(n.values()) == 10_000 and sum((v - 500) ** 2 / 375 for v in n.values()) < 45


@pytest.mark.parametrize("quota", [1000, 1001, 100_000])
def test_reservoirs_are_bounded_by_their_own_quota(spark, quota):
    """What leaves a map task is at most the quota of each category, small or large, and the draw is the least of all."""
    quotas = {"a": quota, "b": 3, "c": 0}
    n, tasks = (400_000, 3) if quota > 50_000 else (8000, 3)
    records = spark.range(n).selectExpr("id", "'t' AS stratum", "'f' AS field_name", "element_at(array('a', 'b', 'c', 'a'), cast(id % 4 + 1 AS int)) AS category", "'z' AS draw_id").repartition(tasks)
    d = Draws(records, spark.createDataFrame([(1, "t", "f", k, 0.0, q, 0, "x") for k, q in quotas.items()], TARGETS))
    left = Counter(r["_key"] for r in d.reservoirs().filter("_n IS NULL").select("_key").collect())
    assert left["A"] <= tasks * quota and left["B"] <= tasks * 3 and "C" not in left
    ranked = records.select("id", "category", sampling.priority(42, F.lit(1), F.col("id")).alias("p")).collect()
    want = {(1, k.upper(), r["id"]) for k, q in quotas.items() for r in sorted((r for r in ranked if r["category"] == k), key=lambda r: (r["p"], r["id"]))[:q]}
    assert len(want) == quota + 3 and {tuple(r) for r in d.sample().collect()} == want
    assert {r["category"]: r["drawn"] for r in d.report().collect()} == quotas


def test_one_task_trims_as_it_goes(monkeypatch):
    """Batches of one partition against a plain sort, with ties and a group that comes late."""
    monkeypatch.setattr(sampling, "TRIM_ROWS", 50)
    rng, rows, batches = random.Random(4), [], []
    for b in range(40):
        part = [(g, "K", 7 if g == 1 else 200, 100 * b + k, rng.randrange(300)) for k, g in enumerate(rng.choice([1, 1, 1, 2] if b < 30 else [1, 2, 3]) for _ in range(30))]
        rows += part
        batches.append(pa.table(list(map(list, zip(*part, strict=True))), names=["draw_id", "_key", "required", "id", "_priority"]).to_batches()[0])
    out = pa.Table.from_batches(list(sampling._fill(iter(batches)))).to_pylist()
    for g in (1, 2, 3):
        mine = sorted((r[4], r[3]) for r in rows if r[0] == g)
        assert [r["_n"] for r in out if r["draw_id"] == g and r["_n"] is not None] == [len(mine)]
        assert sorted((r["_priority"], r["id"]) for r in out if r["draw_id"] == g and r["_n"] is None) == mine[: 7 if g == 1 else 200]
    assert list(sampling._fill(iter([]))) == []


def test_empty_tables(spark):
    records, targets = draws(spark)
    assert Draws(records, targets.limit(0)).report().collect() == [] and Draws(records, targets.limit(0)).sample().collect() == []
    assert all(r["drawn"] == 0 for r in Draws(records.limit(0), targets).report().collect())


def test_codes_are_counted_by_occurrence_and_record(spark):
    rows = [(1, "ab, AB;c1", "x"), (2, " Ab ", None), (3, None, "?"), (4, "", "x-x"), (5, "Éa", "x")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "id long, f string, g string, term string")
    got = {(r["field_name"], r["term"]): (r["n_occurrences"], r["n_records"], r["mark"]) for r in code_frequencies(df, ["f", "g"], min_records=2, max_share=0.5).collect()}
    assert got == {("f", "AB"): (3, 2, None), ("f", "C1"): (1, 1, "rare"), ("f", "ÉA"): (1, 1, "rare"), ("g", "X"): (4, 3, "common")}
    plain = code_frequencies(df, ["f"]).collect()
    assert {r["mark"] for r in plain} == {None}
    assert code_frequencies(df.limit(0), ["f", "g"], min_records=2, max_share=0.5).collect() == []


def test_a_long_field_and_a_term_in_every_record(spark):
    df = spark.createDataFrame([(k, "hot " * 2000 + f"w{k}") for k in range(50)], "id long, f string")
    got = {r["term"]: (r["n_occurrences"], r["n_records"], r["mark"]) for r in code_frequencies(df, ["f"], min_records=5, max_share=0.1).collect()}
    assert got["HOT"] == (100_000, 50, "common") and got["W7"] == (1, 1, "rare") and len(got) == 51


def test_many_terms_in_a_record_take_no_quadratic_time(spark):
    rows = [(k, " ".join(f"w{(7 * i + k) % 12_000}" for i in range(16_000))) for k in range(4)]
    df = spark.createDataFrame(rows, "id long, f string")
    code_frequencies(df.limit(1), ["f"]).count()
    began = time.time()
    got = {r["term"]: (r["n_occurrences"], r["n_records"]) for r in code_frequencies(df, ["f"]).collect()}
    assert time.time() - began < 10 and len(got) == 12_000
    want = Counter(w.upper() for _, f in rows for w in f.split())
    assert {k: v[0] for k, v in got.items()} == want and all(v[1] == 4 for v in got.values())
