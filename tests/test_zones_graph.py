import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from rasterweave.operators import pixel_graph as G
from rasterweave.operators import zones as Z
from rasterweave.session import cut_lineage


def grid(spark, h, w):
    return spark.createDataFrame([(i, j) for i in range(h) for j in range(w)], "i int, j int")


def test_zone_counts_and_round_trip(spark):
    z = Z.overlap_zones(grid(spark, 12, 12))
    assert {(r["grid"], r["zi"], r["zj"]) for r in z.filter("grid = 1").collect()} == {(1, 5, 5)}
    assert z.filter("grid = 0").select("zi", "zj").distinct().count() == 4
    back = Z.zone_pixels(Z.zone_index(Z.overlap_zones(grid(spark, 23, 17)), 17), 17)
    assert back.filter("pi <> i OR pj <> j").count() == 0
    assert back.groupBy("grid", "zi", "zj", "idx").count().filter("count > 1").count() == 0


def test_partition_covers_every_pixel_once_per_grid(spark):
    rng = random.Random(1)
    rows = [(i, j, t, 0, None if rng.random() < 0.1 else float((i // 5 + j // 5) % 2) + rng.random() / 10) for i in range(13) for j in range(11) for t in range(3)]
    part = Z.zone_partition(spark.createDataFrame(rows, "i int, j int, t int, c int, v double")).collect()
    assert Counter((r["grid"], r["i"], r["j"]) for r in part).most_common(1)[0][1] == 1
    assert sum(r["grid"] == 0 for r in part) == 143 and sum(r["grid"] == 1 for r in part) == 8 * 6
    again = Z.zone_partition(spark.createDataFrame(rows[::-1], "i int, j int, t int, c int, v double")).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, part))


def test_cluster_zone_degenerate_cases():
    assert Z.cluster_zone(np.zeros((1, 2))).tolist() == [0]
    assert Z.cluster_zone(np.zeros((2, 2))).tolist() == [0, 0]
    assert Z.cluster_zone(np.ones((50, 2))).tolist() == [0] * 50
    x = np.array([[0.0], [0.1], [0.05], [9.0], [9.1], [9.05]])
    labels = Z.cluster_zone(x)
    assert len(set(labels[:3])) == len(set(labels[3:])) == 1 and labels[0] != labels[3]


def test_singletons_join_the_nearest():
    x = np.array([[0.0], [0.2], [1.0], [9.0], [9.2]])
    assert Z.settle_singletons(x, np.array([0, 0, 1, 2, 2])).tolist() == [0, 0, 0, 2, 2]


def test_davies_bouldin_agrees_with_numpy(spark):
    rng = np.random.default_rng(3)
    x, labels = rng.random((60, 4)), rng.integers(0, 3, 60)
    df = spark.createDataFrame([(int(k), [float(v) for v in row]) for k, row in zip(labels, x, strict=True)], "k int, x array<double>")
    assert abs(Z.davies_bouldin(df, "k", "x").first()[0] - Z.davies_bouldin_of(x, labels)) < 1e-9


def test_neighbours_of_a_small_raster(spark):
    assert G.neighbours(grid(spark, 3, 3)).count() == 20


def test_edge_weights(spark):
    rows = [(0, 0, 0, 0, 0.5), (0, 1, 0, 0, 0.5), (0, 2, 0, 0, None), (1, 0, 0, 0, 0.9)]
    edges = {(r["i"], r["j"], r["i2"], r["j2"]): r["weight"] for r in G.pixel_graph(spark.createDataFrame(rows, "i int, j int, t int, c int, v double")).collect()}
    assert edges[0, 0, 0, 1] == 0 and len(edges) == 3 and not any((0, 2) in (k[:2], k[2:]) for k in edges)
    assert abs(edges[0, 0, 1, 0] - 0.16) < 1e-5


def test_merge_order():
    assert G.merge_order({1: 3, 2: 10, 3: 9}, {1: {2, 3}, 2: {1}, 3: {1}}, lambda a, b: 1.0, 8) == {1: 2, 2: 2, 3: 3}
    assert G.merge_order({1: 3}, {1: set()}, lambda a, b: 1.0, 8) == {1: 1}
    # 1 and 2 grow past the size together, so 2 stays.
    assert G.merge_order({1: 4, 2: 5, 3: 20}, {1: {2}, 2: {1, 3}, 3: {2}}, lambda a, b: abs(a - b), 8) == {1: 2, 2: 2, 3: 3}


def test_spectral_distance():
    a, b = np.array([[1.0, 0.0], [0.0, 2.0], [np.nan, 1.0]]), np.zeros((3, 2))
    assert G.spectral_distance(a, b) == 1.0
    assert G.spectral_distance(np.full((2, 2), np.nan), np.zeros((2, 2))) == float("inf")


def test_louvain_finds_two_cliques_and_is_repeatable():
    edges = [(a, b, 1.0) for g in (range(5), range(5, 10)) for a in g for b in g if a < b] + [(4, 5, 0.1)]
    labels = G.louvain(10, edges)
    assert len(set(labels[:5])) == 1 and len(set(labels[5:])) == 1 and labels[0] != labels[9]
    assert G.louvain(3, []).tolist() == [0, 1, 2]


def test_louvain_of_a_part_knows_the_whole():
    # Nodes 2 and 3 of a path, the rest outside: degrees and total are those of the path.
    assert G.louvain(2, [(0, 1, 1.0)], 2.0, outside=np.array([1.0, 1.0]), total=5.0).tolist() == [0, 0]
    assert G.louvain(2, [(0, 1, 1.0)], 3.0, outside=np.array([1.0, 1.0]), total=5.0).tolist() == [0, 1]
    assert G.louvain(2, [(0, 1, 1.0)], 1.0, loops=np.array([5.0, 5.0])).tolist() == [0, 1]


def test_communities_cross_the_borders_of_tiles(spark):
    """140 rows, so two tiles of 128; rows 110 to 139 hang together strongly and with the others hardly."""
    block = lambda i: i >= 110
    ends = [(i, j, i + a, j + b) for i in range(140) for j in range(4) for a, b in G.FORWARD_8 if i + a in range(140) and j + b in range(4)]
    rows = [(*e, 1.0 if block(e[0]) == block(e[2]) else 0.001) for e in ends]
    edges = spark.createDataFrame(rows, "i int, j int, i2 int, j2 int, weight double")
    found = {(r["i"], r["j"]): r["cluster_id"] for r in G.louvain_partition(edges, grid(spark, 140, 4), resolution=0.1).collect()}
    assert len(found) == 560
    own = {found[i, j] for i in range(110, 140) for j in range(4)}
    assert len(own) == 1 and not own & {found[i, j] for i in range(110) for j in range(4)}
    again = G.louvain_partition(spark.createDataFrame(rows[::-1], edges.schema).repartition(3), grid(spark, 140, 4), resolution=0.1)
    assert {(r["i"], r["j"]): r["cluster_id"] for r in again.collect()} == found


def flood(cells):
    name = {}
    for start in sorted(cells):
        if start in name:
            continue
        todo, name[start] = [start], start
        while todo:
            i, j = todo.pop()
            for n in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if n in cells and n not in name and cells[n] == cells[i, j]:
                    name[n] = start
                    todo.append(n)
    return name


def test_regions_against_flooding(spark):
    rng = random.Random(9)
    cells = {(i, j): rng.choice([1, 1, 2]) for i in range(25) for j in range(20) if rng.random() < 0.9}
    # a spiral needs many rounds
    cells |= {(100 + i, 100 + j): 5 for i in range(15) for j in range(15) if (min(i, j, 14 - i, 14 - j) % 2 == 0) or (i == min(i, j, 14 - i, 14 - j) and j == i + 1)}
    df = spark.createDataFrame([(i, j, k) for (i, j), k in cells.items()] + [(500, 500, None)], "i int, j int, k int")
    got = {(r["i"], r["j"]): r["region"] for r in G.regions(df, "k").collect()}
    want = flood(cells)
    groups = defaultdict(set)
    for p, r in got.items():
        groups[r].add(p)
    expected = defaultdict(set)
    for p, r in want.items():
        expected[r].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))
    assert all(r == min(i * 2**32 + j for i, j in g) for r, g in groups.items())


def test_small_clusters_are_merged(spark):
    rows = [(0, j, t, 0, 0.1 if j < 12 else 0.9) for j in range(24) for t in range(2)]
    series = spark.createDataFrame(rows, "i int, j int, t int, c int, v double")
    part = spark.createDataFrame([(0, 1 if j < 10 else 2 if j < 12 else 3, 0, j) for j in range(24)], "grid int, cluster_id long, i int, j int")
    centroids = spark.createDataFrame([(0, k, t, 0, v) for k, v in ((1, 0.1), (2, 0.1), (3, 0.9)) for t in range(2)], "grid int, cluster_id long, t int, c int, centroid double")
    out = G.merge_small_clusters(G.pixel_graph(series), part, centroids)
    assert Counter(r["cluster_id"] for r in out.collect()) == {1: 12, 3: 12}


def test_label_image_and_borders(spark):
    part = spark.createDataFrame([(0, 4, 0, 0), (1, 7, 0, 0), (0, 4, 0, 1)], "grid int, cluster_id long, i int, j int")
    image = Z.label_image(grid(spark, 1, 3), part)
    assert {(r["j"], r["cluster_id"]) for r in image.collect()} == {(0, 7), (1, 4), (2, -1)}
    gap = spark.createDataFrame([(0, 0, 1), (0, 2, 2)], "i int, j int, cluster_id long")
    assert Z.cluster_borders(gap).filter("border").count() == 0
    assert Z.cluster_borders(image).filter(F.col("border")).count() == 3


def test_broadcasts_of_linked_nodes_are_bounded(spark, monkeypatch):
    """300 pairs settle in the first round, a chain goes on with few links: what is broadcast then must not hold all nodes."""
    rng, sizes, broadcast = random.Random(2), [], F.broadcast
    monkeypatch.setattr(G, "TASK_LINKS", 60, raising=False)
    monkeypatch.setattr(F, "broadcast", lambda df: sizes.append(df.count()) or broadcast(df))
    chain = rng.sample(range(10_000, 20_000), 150)
    links = [(2 * k, 2 * k + 1) for k in range(300)] + list(zip(chain, chain[1:], strict=False))
    found = G._linked(spark.createDataFrame([p for a, b in links for p in ((a, b), (b, a))], "u long, v long"))
    assert {r["u"]: r["name"] for r in found.collect()} == {k: k - k % 2 for k in range(600)} | dict.fromkeys(chain, min(chain))
    assert max(sizes, default=0) <= 60


def test_regions_and_outlines_over_the_borders_of_tiles(spark, monkeypatch):
    """Tiles of 3 against one tile, with scenes, gaps, negative places and a neighbourhood of 8."""
    rng = random.Random(8)
    cells = spark.createDataFrame([(s, i, j, rng.randrange(2)) for s in (0, 1) for i in range(-4, 12) for j in range(-2, 9) if rng.random() < 0.95], "s int, i int, j int, k int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    both = []
    for tile, links in ((64, 200_000), (3, 8)):
        monkeypatch.setattr(G, "REGION_TILE", tile)
        monkeypatch.setattr(G, "TASK_LINKS", links)
        four, eight = G.regions(cells, "k", keys=["s"]), G.regions(cells, "k", G.FORWARD_8, keys=["s"])
        both.append([rows(four), rows(eight), rows(G.outlines(four, keys=["s"])), rows(G.outlines(cells, "k", ["s"], oriented=True))])
    assert both[0] == both[1] and all(both[0])


def test_rings_of_many_regions_at_once(spark):
    """As ring by ring, for regions that touch themselves in corners; and many small ones don't take a call each."""
    rng = random.Random(4)
    cells = spark.createDataFrame([(i, j, int(rng.random() < 0.4)) for i in range(40) for j in range(-9, 31)], "i int, j int, k int")
    found = cut_lineage(G.regions(cells, "k"))
    sides = defaultdict(list)
    for r in G.outlines(found, oriented=True).collect():
        sides[r["region"]].append((r["x1"], r["y1"], r["x2"], r["y2"]))
    got = {r["region"]: [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]] for r in G.region_polygons(found).collect()}
    assert got == {k: G.trace_rings(v) for k, v in sides.items()} and max(map(len, got.values())) > 3
    plan = G.region_polygons(found)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
