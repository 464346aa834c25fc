import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rasterweave.llm import splits
from rasterweave.llm.splits import components, related_records, split_components, split_related


def find(edges):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        root[top(a)] = top(b)
    return {x: top(x) for x in list(root)}


def groups(names):
    out = defaultdict(set)
    for k, v in names.items():
        out[v].add(k)
    return sorted(map(sorted, out.values()))


GRAPHS = {
    "chain": [(i, i + 1) for i in range(300)],
    "star": [(0, i) for i in range(1, 400)],
    "random": [(random.Random(k).randrange(200), random.Random(k + 999).randrange(200)) for k in range(150)],
    "cliques": [(10 * g + a, 10 * g + b) for g in range(12) for a in range(5) for b in range(5)],
    "pairs": [(2 * k, 2 * k + 1) for k in range(100)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_contraction_against_union_find(spark, name):
    edges = [e for e in GRAPHS[name] if e[0] != e[1]]
    got = {r["vertex"]: r["component"] for r in components(spark.createDataFrame(GRAPHS[name] + [(None, 5), (5, None)], "u long, v long")).collect()}
    assert groups(got) == groups(find(edges)) and all(c in g for g in groups(got) for c in {got[g[0]]})


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
    assert components(spark.createDataFrame([(3, 3)], "u long, v long")).collect() == []


def test_too_many_rounds_raise(spark):
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame(GRAPHS["chain"], "u long, v long"), max_rounds=1)


def records(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([f"a{rng.randrange(30)}", None, "hot"]), rng.choice([None, rng.randrange(40)]), "x") for k in range(300)]
    return rows, spark.createDataFrame(rows, "id long, author string, source int, _first string")


def test_records_are_related_through_any_key(spark):
    rows, df = records(spark)
    edges = [(("r", r[0]), ("a", r[1])) for r in rows if r[1] is not None] + [(("r", r[0]), ("s", r[2])) for r in rows if r[2] is not None]
    want = find(edges)
    expected = defaultdict(set)
    for r in rows:
        expected[want.get(("r", r[0]), ("alone", r[0]))].add(r[0])
    got = {r["id"]: r["component"] for r in related_records(df.withColumn("component", F.lit("old")), "id", [["author"], ["source"]]).collect()}
    assert set(related_records(df, "id", [["author"]]).columns) == {*df.columns, "component"}
    assert groups(got) == sorted(map(sorted, expected.values())) and len(got) == 300


def test_a_key_of_two_columns_needs_both(spark):
    df = spark.createDataFrame([(1, "t", 2020), (2, "t", 2021), (3, "t", 2020), (4, "t", None), (5, None, None), (6, None, None)], "id long, t string, y int")
    got = {r["id"]: r["component"] for r in related_records(df, "id", [["t", "y"]]).collect()}
    assert groups(got) == [[1, 3], [2], [4], [5], [6]]


def test_shares_are_met_and_components_stay_whole(spark):
    rng = random.Random(6)
    rows = [(k, min(int(rng.expovariate(0.02)), 400)) for k in range(6000)]
    out = split_related(spark.createDataFrame(rows, "id long, g int"), "id", [["g"]], {"train": 0.7, "val": 0.15, "test": 0.15}).collect()
    assert len(out) == 6000 and all(len(s) == 1 for s in _splits(out, "g").values())
    n = Counter(r["assigned_split"] for r in out)
    assert abs(n["train"] / 6000 - 0.7) < 0.02 and abs(n["val"] / 6000 - 0.15) < 0.02


def _splits(rows, key):
    out = defaultdict(set)
    for r in rows:
        out[r[key]].add(r["assigned_split"])
    return out


def test_one_group_with_a_third_of_all_rows(spark):
    rows = [(k, 0 if k < 500 else k) for k in range(1500)]
    out = split_related(spark.createDataFrame(rows, "id long, g int"), "id", [["g"]], {"train": 0.5, "test": 0.5}).collect()
    n = Counter(r["assigned_split"] for r in out)
    assert all(len(s) == 1 for s in _splits(out, "g").values()) and abs(n["train"] - 750) < 20
    again = split_related(spark.createDataFrame(rows[::-1], "id long, g int"), "id", [["g"]], {"train": 0.5, "test": 0.5}).collect()
    assert {r["id"]: r["assigned_split"] for r in out} == {r["id"]: r["assigned_split"] for r in again}


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, g int")
    assert split_related(df, "id", [["g"]], {"a": 0.5, "b": 0.5}).collect() == []
    assert split_components(df.withColumn("component", F.col("id")), "component", {"a": 1.0}).collect() == []


def test_older_columns_of_the_same_names_are_replaced_and_repeats_stay(spark):
    df = spark.createDataFrame([(1, 7, "x", "y", "z"), (1, 7, "x", "y", "z"), (2, None, None, None, None)], "id long, g int, component string, assigned_split string, w string")
    out = split_related(df, "id", [["g"]], {"a": 1.0}).collect()
    assert sorted((r["id"], r["assigned_split"]) for r in out) == [(1, "a"), (1, "a"), (2, "a")] and len({r["component"] for r in out}) == 2


def test_long_chains_and_stars_together_through_all_blocks_of_rounds(spark, monkeypatch):
    """A chain of 3,000, a star of 2,000 and a comb, none of it broadcast; more rounds than one block unwinds."""
    monkeypatch.setattr(splits, "BROADCAST_EDGES", 50)
    monkeypatch.setattr(splits, "ROUNDS_UNWOUND", 2)
    chain = [(i, i + 1) for i in range(3000)]
    star = [(10_000, 10_000 + i) for i in range(1, 2000)]
    comb = [(20_000 + i, 20_001 + i) for i in range(300)] + [(20_000 + i, 30_000 + i) for i in range(300)]
    edges = chain + star + comb
    random.Random(1).shuffle(edges)
    seen = []
    unwound = splits._unwound
    monkeypatch.setattr(splits, "_unwound", lambda c: seen.append(len(c)) or unwound(c))
    got = {r["vertex"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert groups(got) == groups(find(edges)) and 3 <= seen[0] < 40


def test_names_that_clash_under_every_seed_raise(spark, monkeypatch):
    monkeypatch.setattr(splits, "key_hash", lambda kind, *columns, seed=0: F.when(columns[0].isNotNull(), F.lit(1).cast("long")))
    with pytest.raises(RuntimeError):
        related_records(spark.createDataFrame([(1, 1), (2, 2)], "id long, g int"), "id", [["g"]])


def test_rows_that_only_tie_do_not_count(spark):
    rows = [(k, k, None) for k in range(40)] + [(None, k, k // 2) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, g int, h int")
    out = split_related(df, "id", [["g"], ["h"]], {"a": 0.5, "b": 0.5}, heavy_share=0.1, weighed=F.col("id").isNotNull()).collect()
    assert len(out) == 40 and all(len({r["assigned_split"] for r in out if r["id"] // 2 == k}) == 1 for k in range(20))


def test_report_counts_divided_groups(spark):
    df = spark.createDataFrame([(1, "x", "a"), (2, "x", "b"), (3, "y", "a"), (4, None, "a"), (5, None, "b")], "id long, g string, assigned_split string")
    got = {r["assigned_split"]: (r["n_records"], r["share"], r["target"], r["divided"]) for r in splits.split_report(df, {"a": 3, "b": 1, "c": 0}, [["g"]]).collect()}
    assert got == {"a": (3, 0.6, 0.75, 1), "b": (2, 0.4, 0.25, 1), "c": (0, 0.0, 0.0, 1)}
    assert {r["share"] for r in splits.split_report(df.limit(0), {"a": 1}, [["g"]]).collect()} == {None}


def test_buckets_grow_with_the_components(spark, monkeypatch):
    monkeypatch.setattr(splits, "COMPONENTS_A_BUCKET", 10)
    df = spark.range(3000).selectExpr("id AS component")
    n = Counter(r["split"] for r in split_components(df, "component", {"a": 0.7, "b": 0.3}).collect())
    assert n == {"a": 2100, "b": 900}
