"""Operators over many scenes agree with the same operators scene by scene, and the larger graph operators with plain ones."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweave.operators import inference, metrics, tiling
from rasterweave.operators import pixel_graph as G
from rasterweave.operators import series as S
from rasterweave.operators import zones as Z

SIZES = {"a": (23, 17), "b": (9, 30)}


def scenes(spark, seed=1):
    rng = random.Random(seed)
    rows = [(s, i, j, float(rng.randrange(100)), rng.randrange(3)) for s, (h, w) in SIZES.items() for i in range(h) for j in range(w)]
    return spark.createDataFrame(rows, "scene string, i int, j int, v double, k int").repartition(3)


def per_scene(df, f):
    return {(s, *r) for s in SIZES for r in map(tuple, f(df.filter(F.col("scene") == s).drop("scene"), *SIZES[s]).collect())}


@pytest.mark.parametrize("keys", [["scene"]])
def test_tiling_merging_and_blurring(spark, keys):
    df = scenes(spark)
    sized = tiling.with_extents(df, keys)
    h, w = F.col("height"), F.col("width")
    assert {tuple(r) for r in tiling.extents(df, keys).collect()} == {(s, *x) for s, x in SIZES.items()}
    one = lambda p, x, y: tiling.cubify(p, x, y, 8).select("cube_no", "r", "c", "v")
    assert {tuple(r) for r in tiling.cubify(sized, h, w, 8).select("scene", "cube_no", "r", "c", "v").collect()} == per_scene(df, one)
    tiles = lambda p, x, y: tiling.overlap_tiles(p, x, y, 8, 3).select("i", "j", "oi", "oj", "r", "c")
    assert {tuple(r) for r in tiling.overlap_tiles(sized, h, w, 8, 3).select("scene", "i", "j", "oi", "oj", "r", "c").collect()} == per_scene(df, tiles)
    blur = lambda p, x, y: metrics.box_blur(p, "v", x, y, 5).select("i", "j", F.round("v", 9))
    assert {tuple(r) for r in metrics.box_blur(sized, "v", h, w, 5, keys).select("scene", "i", "j", F.round("v", 9)).collect()} == per_scene(df, blur)
    model = lambda x: np.stack([x[:, 0], 50 - x[:, 0]], 1)
    scene = lambda p, x, y: inference.predict_scene(p, ["v"], model, x, y, 8, 3, 1, 2).select("i", "j", "pred", F.round("best", 9))
    assert {tuple(r) for r in inference.predict_scenes(df, keys, ["v"], model, 8, 3, 1, classes=2).select("scene", "i", "j", "pred", F.round("best", 9)).collect()} == per_scene(df, scene)


def test_origins_of_every_size(spark):
    for extent in (1, 7, 8, 9, 13, 16, 23, 31):
        pixels = spark.range(extent).select(F.col("id").cast("int").alias("i"), F.lit(0).alias("j"))
        got = defaultdict(set)
        for r in tiling.overlap_tiles(pixels, extent, 1, 8, 3).collect():
            got[r["oi"]].add(r["i"])
        assert got == {o: {i for i in range(o, min(o + 8, extent))} for o in tiling.origins(extent, 8, 3)}


def test_regions_outlines_and_polygons(spark):
    df = scenes(spark)
    found = G.regions(df, "k", keys=["scene"])
    assert {tuple(r) for r in found.collect()} == per_scene(df, lambda p, *_: G.regions(p, "k"))
    area = lambda r: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:], strict=False))) / 2
    cells = Counter((r["scene"], r["region"]) for r in found.collect())
    for r in G.region_polygons(found, keys=["scene"]).collect():
        rings = [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]]
        assert all(ring[0] == ring[-1] and len(ring) >= 5 for ring in rings)
        assert area(rings[0]) - sum(map(area, rings[1:])) == cells[r["scene"], r["region"]]


def series(spark):
    rng = random.Random(3)
    rows = [(s, i, j, t, c, None if rng.random() < 0.05 else rng.random(), f"2022-01-{t + 1:02d}") for s, (h, w) in {"a": (12, 11), "b": (7, 13)}.items() for i in range(h) for j in range(w) for t in range(3) for c in range(2)]
    return spark.createDataFrame(rows, "scene string, i int, j int, t int, c int, v double, date string").withColumn("date", F.col("date").cast("date"))


def test_zones_graphs_and_dieback(spark):
    df = series(spark)
    sizes = {"a": (12, 11), "b": (7, 13)}
    each = lambda f: {(s, *r) for s in sizes for r in map(tuple, f(df.filter(F.col("scene") == s).drop("scene")).collect())}
    key = ["scene"]
    part = Z.zone_partition(df, keys=key)
    assert {tuple(r) for r in part.collect()} == each(Z.zone_partition)
    edges = G.pixel_graph(df, keys=key)
    assert {tuple(r) for r in edges.collect()} == each(G.pixel_graph)
    louvain = lambda e, p, k=(): G.louvain_partition(e, p, 3.0, tile=4, factor=2, keys=k)
    communities = louvain(edges, df.select("scene", "i", "j"), key)
    assert {tuple(r) for r in communities.collect()} == each(lambda p: louvain(G.pixel_graph(p), p.select("i", "j")))
    merge = lambda e, p, s, k=(): G.merge_small_clusters(e, p, S.cluster_statistics(S.clustered(s, p, k), k), keys=k)
    assert {tuple(r) for r in merge(edges, communities, df, key).collect()} == each(lambda p: merge(G.pixel_graph(p), louvain(G.pixel_graph(p), p.select("i", "j")), p))
    found = {large: {tuple(r) for r in S.predict_dieback(df, part, count=2, factor=0.5, keys=key, large=large).collect()} for large in (False, True)}
    assert found[False] == found[True] == each(lambda p: S.predict_dieback(p, Z.zone_partition(p), count=2, factor=0.5)) and found[True]
    assert {tuple(r) for r in Z.cluster_borders(Z.label_image(df.select("scene", "i", "j").distinct(), part, key), key).collect()} == each(lambda p: Z.cluster_borders(Z.label_image(p.select("i", "j").distinct(), Z.zone_partition(p))))


def test_communities_are_nearly_as_good_as_those_of_the_whole_graph(spark):
    """60 x 50 pixels. In tiles of 8 (three levels) most communities lie on a border, where pixels once joined stay; larger tiles lose less."""
    rng = np.random.default_rng(5)
    h, w = 60, 50
    ends = [(i, j, i + a, j + b) for i in range(h) for j in range(w) for a, b in G.FORWARD_8 if i + a < h and 0 <= i + a and j + b < w]
    weights = rng.random(len(ends))
    edges = spark.createDataFrame([(*e, float(x)) for e, x in zip(ends, weights, strict=True)], "i int, j int, i2 int, j2 int, weight double")
    pixels = spark.createDataFrame([(i, j) for i in range(h) for j in range(w)], "i int, j int")
    labels = G.louvain(h * w, [(i * w + j, a * w + b, float(x)) for (i, j, a, b), x in zip(ends, weights, strict=True)], 20.0)
    whole = spark.createDataFrame([(0, int(labels[i * w + j]), i, j) for i in range(h) for j in range(w)], "grid int, cluster_id long, i int, j int")
    best = G.modularity(edges, whole, 20.0).first()[0]
    share = {}
    for tile in (8, 32):
        part = G.louvain_partition(edges, pixels, 20.0, tile=tile, factor=2)
        assert part.count() == h * w
        share[tile] = G.modularity(edges, part, 20.0).first()[0] / best
    assert share[8] > 0.94 and share[32] > 0.98


def test_merging_in_groups_equals_merging_at_once(spark):
    rng = random.Random(8)
    cells = {(i, j): (i // 3) * 100 + j // rng.choice([2, 3]) for i in range(20) for j in range(20)}
    part = spark.createDataFrame([(0, k, i, j) for (i, j), k in cells.items()], "grid int, cluster_id long, i int, j int")
    value = {k: rng.random() for k in set(cells.values())}
    centroids = spark.createDataFrame([(0, k, t, 0, v) for k, v in value.items() for t in range(2)], "grid int, cluster_id long, t int, c int, centroid double")
    edges = G.neighbours(part.select("i", "j"))
    near = defaultdict(set)
    for r in edges.collect():
        a, b = cells[r["i"], r["j"]], cells[r["i2"], r["j2"]]
        if a != b:
            near[a].add(b)
            near[b].add(a)
    series = {k: np.full((2, 1), v) for k, v in value.items()}
    for by in ("size", "name"):
        home = G.merge_order(dict(Counter(cells.values())), near, lambda a, b: G.spectral_distance(series[a], series[b]), 8, by)
        got = {(r["i"], r["j"]): r["cluster_id"] for r in G.merge_small_clusters(edges, part, centroids, by=by).collect()}
        assert got == {p: home[k] for p, k in cells.items()}


def test_quantiles_against_numpy(spark):
    rng = random.Random(4)
    rows = [("flat", 2.0)] * 7 + [("one", 5.0)] + [("wide", rng.choice([-1e9, 1e9, 0.0, rng.random()])) for _ in range(300)] + [("ties", float(rng.randrange(4))) for _ in range(101)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["q"] for r in metrics.quantiles(df, ["g"], "v", [0.0, 0.02, 0.5, 0.98, 1.0]).collect()}
    for g in ("flat", "one", "wide", "ties"):
        assert np.allclose(got[g], np.quantile([v for k, v in rows if k == g], [0.0, 0.02, 0.5, 0.98, 1.0]))
    assert "none" not in got and metrics.quantiles(df.limit(0), [], "v", [0.5]).collect() == []
    assert np.isclose(metrics.quantiles(df, [], "v", [0.25]).first()["q"][0], np.quantile([v for _, v in rows if v is not None], 0.25))


def test_batches_sets_and_running_metrics(spark):
    b = tiling.batches(spark.range(30).withColumn("_x", F.lit(1)), "id", 7)
    assert sorted(Counter(r["batch"] for r in b.collect()).items()) == [(0, 7), (1, 7), (2, 7), (3, 7), (4, 2)]
    other = {r["id"]: r["batch"] for r in tiling.batches(spark.range(30), "id", 7, seed=1).collect()}
    assert other != {r["id"]: r["batch"] for r in b.collect()}
    both = tiling.concat_sets(spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(2,)], "a int"))
    assert sorted(map(tuple, both.collect())) == [(1, "x"), (2, None)]
    log = spark.createDataFrame([("r", 1, 2.0), ("r", 2, None), ("r", 3, 1.0), ("r", 4, 4.0)], "run string, step int, v double")
    got = [(r["running_mean"], r["best"], r["is_best"]) for r in metrics.running_metrics(log, ["run"], "step", "v").orderBy("step").collect()]
    assert got == [(2.0, 2.0, True), (2.0, 2.0, False), (1.5, 2.0, False), (7 / 3, 4.0, True)]


def onnx_matmul(w: np.ndarray) -> bytes:
    """An ONNX file for Y = X W, written field by field."""

    def field(n: int, value: int | bytes | str) -> bytes:
        def varint(v: int) -> bytes:
            out = b""
            while v > 127:
                out, v = out + bytes([v & 127 | 128]), v >> 7
            return out + bytes([v])

        if isinstance(value, int):
            return varint(n << 3) + varint(value)
        value = value.encode() if isinstance(value, str) else value
        return varint(n << 3 | 2) + varint(len(value)) + value

    def tensor(name: str, width: int) -> bytes:
        shape = field(1, field(2, "n")) + field(1, field(1, width))
        return field(1, name) + field(2, field(1, field(1, 1) + field(2, shape)))

    node = field(1, "X") + field(1, "W") + field(2, "Y") + field(4, "MatMul")
    weights = field(1, w.shape[0]) + field(1, w.shape[1]) + field(2, 1) + field(8, "W") + field(9, w.astype("<f4").tobytes())
    graph = field(1, node) + field(2, "g") + field(5, weights) + field(11, tensor("X", w.shape[0])) + field(12, tensor("Y", w.shape[1]))
    return field(1, 8) + field(8, field(1, "") + field(2, 13)) + field(7, graph)


def test_a_model_from_a_file(spark, tmp_path):
    w = np.array([[1.0, 0.0, 2.0], [0.0, 3.0, 1.0]])
    (tmp_path / "m.onnx").write_bytes(onnx_matmul(w))
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 1.0)], "id int, a double, b double")
    got = {r["id"]: r["scores"] for r in inference.score_pixels(df, ["a", "b"], inference.load_model(spark, str(tmp_path / "m.onnx"))).collect()}
    assert got == {1: [1.0, 6.0, 4.0], 2: [0.0, 3.0, 1.0]}
    with pytest.raises(FileNotFoundError):
        inference.load_model(spark, str(tmp_path / "none.onnx"))
