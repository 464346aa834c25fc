"""Graphs of neighbouring pixels: edges, communities, merging of small clusters, regions."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterweave.functions.masks import edge_correction
from rasterweave.session import broadcast_if_small, cut_lineage

# The four neighbours that give every pair of an 8-neighbourhood once, and those of a 4-neighbourhood.
FORWARD_8, FORWARD_4 = ((1, 0), (0, 1), (1, 1), (-1, 1)), ((1, 0), (0, 1))

#: Links (both directions counted) up to which the rest of the rounds is one task's (16 bytes per link).
TASK_LINKS = 200_000

#: Side of the tiles in which regions and outlines are found at once; what crosses a tile's border is joined afterwards.
REGION_TILE = 256


def pixel_vectors(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, i, j, x: the series of each pixel as an array of dates, each an array of channels. keys: the scene's columns."""
    dates = series.groupBy(*keys, "i", "j", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda s: s["v"]).alias("v"))
    return dates.groupBy(*keys, "i", "j").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda s: s["v"]).alias("x"))


def neighbours(pixels: DataFrame, payload: Sequence[str] = (), offsets=FORWARD_8, keys: Sequence[str] = ()) -> DataFrame:
    """keys, i, j, i2, j2 of every two neighbouring pixels of a scene, once, with the payload of both (the second's with suffix 2).

    Every pixel names its forward neighbours and an equi-join finds them.
    """
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets])
    asked = pixels.select(*keys, "i", "j", *payload, F.explode(steps).alias("_s")).select(*keys, "i", "j", *payload, (F.col("i") + F.col("_s.a")).alias("i2"), (F.col("j") + F.col("_s.b")).alias("j2"))
    other = pixels.select(*keys, F.col("i").alias("i2"), F.col("j").alias("j2"), *[F.col(p).alias(f"{p}2") for p in payload])
    return asked.join(other, [*keys, "i2", "j2"])


def series_distance(x: Column, y: Column) -> Column:
    """Euclidean distance over all dates and channels, per date on which every channel of both is valid; null if none.

    Values that one of the two lacks count as no difference.
    """
    squares = F.flatten(F.zip_with(x, y, lambda a, b: F.zip_with(a, b, lambda p, q: F.coalesce(F.pow(p - q, F.lit(2)), F.lit(0.0)))))
    total = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, d: s + d))
    valid = F.size(F.filter(F.zip_with(x, y, lambda a, b: F.forall(F.zip_with(a, b, lambda p, q: p.isNotNull() & q.isNotNull()), lambda ok: ok)), lambda ok: ok))
    return F.when(valid > 0, total / (valid + F.lit(1e-6)))


def pixel_graph(series: DataFrame, weight: str = "distance", keys: Sequence[str] = ()) -> DataFrame:
    """keys, i, j, i2, j2, weight: 8-neighbour edges weighted by the corrected distance of the two series.

    Pairs without a common valid date have no edge; equal pixels have weight 0. weight='similarity' gives 1 - that.
    """
    edges = neighbours(pixel_vectors(series, keys), ["x"], keys=keys).withColumn("weight", edge_correction(series_distance(F.col("x"), F.col("x2")))).filter("weight IS NOT NULL")
    if weight == "similarity":
        edges = edges.withColumn("weight", 1 - F.col("weight"))
    elif weight != "distance":
        raise ValueError("weight must be 'distance' or 'similarity'")
    return edges.select(*keys, "i", "j", "i2", "j2", "weight")


def cluster_adjacency(edges: DataFrame, partition: DataFrame, keys: Sequence[str] = (), also: Sequence[str] = ()) -> DataFrame:
    """keys, also, a, b with a < b: clusters that an edge connects. also: columns of the partition within which clusters meet (grid)."""
    one = partition.select(*keys, *also, "i", "j", F.col("cluster_id").alias("a"))
    two = partition.select(*keys, *also, F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("cluster_id").alias("b"))
    met = edges.join(one, [*keys, "i", "j"]).join(two, [*keys, *also, "i2", "j2"]).filter("a <> b")
    return met.select(*keys, *also, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def centroid_distances(centroids: DataFrame, pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, a, b, distance: of the centroids over the dates both have, per such date; null if there is none.

    centroids: keys, cluster_id, t, centroid of one channel; or of several, with the channel among the keys of both tables.
    """
    one = centroids.select(*keys, F.col("cluster_id").alias("a"), "t", F.col("centroid").alias("x"))
    two = centroids.select(*keys, F.col("cluster_id").alias("b"), "t", F.col("centroid").alias("y"))
    both = pairs.join(one, [*keys, "a"]).join(two, [*keys, "b", "t"])
    d = F.pow(F.col("x") - F.col("y"), F.lit(2))
    return both.groupBy(*keys, "a", "b").agg(F.try_divide(F.sqrt(F.sum(d)), F.count(d)).alias("distance"))


def spectral_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Largest singular value of the difference over the dates without a gap, per such date; infinite if there is none."""
    d = a - b
    d = d[~np.isnan(d).any(axis=1)]
    return float(np.linalg.norm(d, 2) / len(d)) if len(d) else float("inf")


def merge_order(sizes: dict, near: dict, distance, least: int, by: str = "size") -> dict:
    """Where each small cluster goes: by size, then name (or by name alone), each joins its nearest neighbour (the least name on a tie).

    A cluster that has grown to `least` in the meantime stays; one without neighbours stays. Centroids don't change.
    """
    home = {k: k for k in sizes}
    size, links = dict(sizes), {k: set(v) for k, v in near.items()}
    for k in sorted((k for k in sizes if sizes[k] < least), key=lambda k: (sizes[k] if by == "size" else 0, k)):
        if size[k] >= least or not links.get(k):
            continue
        to = min(links[k], key=lambda n: (distance(k, n), n))
        size[to] += size.pop(k)
        for n in links.pop(k):
            links[n].discard(k)
            if n != to:
                links[n].add(to)
                links[to].add(n)
        home[k] = to
    for k in home:
        path = [k]
        while home[path[-1]] != path[-1]:
            path.append(home[path[-1]])
        for p in path:
            home[p] = path[-1]
    return home


def _connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least one that it hangs together with by the links a, b."""
    name = np.arange(n)
    while True:
        x, y = name[a], name[b]
        apart = x != y
        if not apart.any():
            return name
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(name, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(to := name[name], name):
            name = to


def _linked_in_task(batches):
    """u, name of the links u, v of all batches."""
    links = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    u, v = links["u"].to_numpy(), links["v"].to_numpy()
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    name = _connected(len(nodes), at[: len(u)], at[len(u) :])
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[name])], ["u", "name"])


def _linked(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """u, name of every node of u, v links (bigint, in both directions): the least node that it hangs together with.

    In every round each node takes the least of itself and its neighbours and is followed to where that points; links
    between the names go on, without those within one name, so the tables of the rounds shrink. When the number of links
    proves that a task can hold them, one task does the rest. The names are put together from the last round to the first.
    """
    both = cut_lineage(links.select("u", "v").distinct())
    steps = []
    while (n := both.count()) > TASK_LINKS:
        if len(steps) == max_rounds:
            raise RuntimeError(f"names still change after {max_rounds} rounds")
        to = cut_lineage(both.groupBy("u").agg(F.least("u", F.min("v")).alias("name")))
        for _ in range(2):
            to = to.join(to.select(F.col("u").alias("name"), F.col("name").alias("next")), "name").select("u", F.col("next").alias("name"))
        steps.append(cut_lineage(to))
        end = lambda c: steps[-1].select(F.col("u").alias(c), F.col("name").alias("_" + c))
        both = cut_lineage(both.join(end("u"), "u").join(end("v"), "v").filter("_u <> _v").select(F.col("_u").alias("u"), F.col("_v").alias("v")).distinct())
    names = cut_lineage(both.repartition(1).mapInArrow(_linked_in_task, "u long, name long"))
    for step in reversed(steps):
        names = cut_lineage(step.join(names.select(F.col("u").alias("name"), F.col("name").alias("last")), "name", "left").select("u", F.coalesce("last", "name").alias("name")))
    return names


def merge_small_clusters(edges: DataFrame, partition: DataFrame, centroids: DataFrame, least: int = 8, by: str = "size", keys: Sequence[str] = ()) -> DataFrame:
    """partition with clusters of fewer than `least` pixels merged into an adjacent one, the nearest by centroid.

    The order of the merges matters (by size, or by='name': in the order of names), but only among small clusters that
    hang together through small ones: a large cluster never moves. So each such group of small clusters, with its
    neighbours, is one group of a grouped map, never a whole scene. Relabelling the pixels is a join.
    """
    if by not in ("size", "name"):
        raise ValueError("by must be 'size' or 'name'")
    scene = [*keys, "grid"]
    sizes = cut_lineage(partition.groupBy(*scene, "cluster_id").agg(F.count(F.lit(1)).alias("n")))
    per_grid = cluster_adjacency(edges, partition, keys, ["grid"])
    size_of = lambda c, n: sizes.select(*scene, F.col("cluster_id").alias(c), F.col("n").alias(n))
    pairs = per_grid.join(size_of("a", "na"), [*scene, "a"]).join(size_of("b", "nb"), [*scene, "b"])
    pairs = cut_lineage(pairs.filter(F.least("na", "nb") < least))
    node = lambda c: F.xxhash64(*[F.col(k) for k in scene], F.col(c))  # noqa: E731  two of one name are merely grouped together
    touching = pairs.filter(F.greatest("na", "nb") < least).select(node("a").alias("u"), node("b").alias("v"))
    group = _linked(touching.unionByName(touching.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    middle = centroids.groupBy(*scene, "cluster_id").agg(F.array_sort(F.collect_list(F.struct("t", "c", "centroid"))).alias("x"))
    ends = [pairs.select(*scene, F.col(a).alias("cluster_id"), F.col("n" + a).alias("n"), F.col(b).alias("other"), F.col("n" + b).alias("n2")) for a, b in (("a", "b"), ("b", "a"))]
    asked = ends[0].unionByName(ends[1]).filter(F.col("n") < least).withColumn("u", node("cluster_id")).join(group, "u", "left").withColumn("_group", F.coalesce("name", "u"))
    x_of = lambda c, x: middle.select(*scene, F.col("cluster_id").alias(c), F.col("x").alias(x))
    table = asked.join(x_of("cluster_id", "x"), [*scene, "cluster_id"], "left").join(x_of("other", "x2"), [*scene, "other"], "left").select("_group", *scene, "cluster_id", "n", "x", "other", "n2", "x2")

    def matrix(rows) -> np.ndarray:
        cells = {(r["t"], r["c"]): r["centroid"] for r in (rows if rows is not None else [])}
        ts, cs = sorted({t for t, _ in cells}), sorted({c for _, c in cells})
        return np.array([[np.nan if cells.get((t, c)) is None else cells[t, c] for c in cs] for t in ts], dtype=float)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes_, near, series, place = {}, defaultdict(set), {}, {}
        for r in pdf.to_dict("records"):
            of = tuple(r[k] for k in scene)
            a, b = (of, r["cluster_id"]), (of, r["other"])
            for name, n, x in ((a, r["n"], r["x"]), (b, r["n2"], r["x2"])):
                sizes_[name] = int(n)
                if name not in series:
                    series[name] = matrix(x)
            near[a].add(b)
            near[b].add(a)
            place[a] = of

        def distance(a, b) -> float:
            return spectral_distance(series[a], series[b]) if series[a].shape == series[b].shape and series[a].size else float("inf")

        home = merge_order(sizes_, near, distance, least, by)
        moved = [k for k in place if home[k] != k]
        return pd.DataFrame({**{c: [place[k][p] for k in moved] for p, c in enumerate(scene)}, "cluster_id": [k[1] for k in moved], "merged": [home[k][1] for k in moved]})

    kinds = ", ".join(f"`{k}` {partition.schema[k].dataType.simpleString()}" for k in [*scene, "cluster_id"])
    moves = table.groupBy("_group").applyInPandas(run, f"{kinds}, merged long")
    return partition.join(moves, [*scene, "cluster_id"], "left").select(*scene, F.coalesce("merged", "cluster_id").alias("cluster_id"), "i", "j")


def louvain(n: int, edges: list[tuple[int, int, float]], resolution: float = 1.0, rounds: int = 50, *, loops: np.ndarray | None = None, outside: np.ndarray | None = None, total: float | None = None) -> np.ndarray:
    """Communities by local moves and aggregation; nodes in order, the least community on a tie, so without chance.

    For a part of a graph or a contracted one: weights of the nodes' loops, of their edges to nodes outside, and of all
    edges of the whole graph.
    """
    community = np.arange(n)
    links = [defaultdict(float) for _ in range(n)]
    loops = np.zeros(n) if loops is None else loops
    outside = np.zeros(n) if outside is None else outside
    for a, b, w in edges:
        links[a][b] += w
        links[b][a] += w
    total = sum(w for _, _, w in edges) + loops.sum() if total is None else total
    while total > 0:
        k = np.array([sum(x.values()) for x in links]) + 2 * loops + outside
        own = np.arange(len(links))
        inside = k.copy()
        moved_any = False
        for _ in range(rounds):
            moved = False
            for v in range(len(links)):
                inside[own[v]] -= k[v]
                to: dict[int, float] = defaultdict(float)
                for u, w in links[v].items():
                    to[own[u]] += w
                gain = {c: w - resolution * k[v] * inside[c] / (2 * total) for c, w in to.items()}
                stay = gain.get(own[v], -resolution * k[v] * inside[own[v]] / (2 * total))
                best = min(gain, key=lambda c: (-gain[c], c), default=own[v])
                if best != own[v] and gain.get(best, stay) > stay + 1e-12:
                    own[v] = best
                    moved = moved_any = True
                inside[own[v]] += k[v]
            if not moved:
                break
        if not moved_any:
            break
        names, own = np.unique(own, return_inverse=True)
        community = own[community]
        merged = [defaultdict(float) for _ in names]
        new_loops, new_outside = np.zeros(len(names)), np.zeros(len(names))
        for v, x in enumerate(links):
            new_loops[own[v]] += loops[v]
            new_outside[own[v]] += outside[v]
            for u, w in x.items():
                if own[u] == own[v]:
                    new_loops[own[v]] += w / 2
                else:
                    merged[own[v]][own[u]] += w
        links, loops, outside = merged, new_loops, new_outside
    return np.unique(community, return_inverse=True)[1]


def _moves(columns: Sequence[str], resolution: float, whole: str):
    """A grouped map: rows a, b (an edge, or a loop if equal), or a alone with the weight of its edges to the outside."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        inner = pdf[pdf["b"].notna()]
        names = sorted({*pdf["a"].tolist(), *inner["b"].astype("int64").tolist()})
        at = {k: n for n, k in enumerate(names)}
        rows = sorted((at[a], at[b], w) for a, b, w in zip(inner["a"].tolist(), inner["b"].astype("int64").tolist(), inner["weight"].tolist(), strict=True))
        loops, outside = np.zeros(len(names)), np.zeros(len(names))
        for a, b, w in rows:
            loops[a] += w if a == b else 0.0
        alone = pdf[pdf["b"].isna()]
        for k, w in sorted((at[a], w) for a, w in zip(alone["a"].tolist(), alone["weight"].fillna(0.0).tolist(), strict=True)):
            outside[k] += w
        found = louvain(len(names), [r for r in rows if r[0] != r[1]], resolution, loops=loops, outside=outside, total=float(pdf[whole].iloc[0]))
        least: dict = {}
        for k, c in zip(names, found, strict=True):
            least.setdefault(c, k)
        joined = [least[c] for c in found]
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(names) for c in columns}, "cluster_id": names, "joined": joined})

    return run


def louvain_partition(edges: DataFrame, pixels: DataFrame, resolution: float = 1000.0, tile: int = 128, factor: int = 8, keys: Sequence[str] = ()) -> DataFrame:
    """keys, grid (0), cluster_id, i, j: communities of the whole pixel graph of each scene. Every pixel is in one, alone if it has no edge.

    First tile by tile: local moves and aggregation over a tile's pixels, with the degrees and the total of the whole graph.
    Each community is then one node, and level by level tiles are put together factor by factor: the communities that an
    edge between two of the smaller tiles touches move on, with the weights of all their edges, until one tile holds the
    scene. No edge is dropped. A task has a tile's pixels at most, or at a level the communities along the
    borders within one larger tile, which grow with its side and not with its area. A community is named after its first
    pixel, i * 2**32 + j, so the names say where it lies.
    """
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,18)")).cast("double")  # noqa: E731  the same in any order
    pixel = lambda i, j: F.col(i).cast("long") * (1 << 32) + F.col(j)
    place = lambda c, size, end: [F.floor(F.col(c) / (1 << 32) / size).cast("long").alias("t" + end), F.floor(F.pmod(F.col(c), F.lit(1 << 32)) / size).cast("long").alias("s" + end)]
    kept = edges.filter("weight IS NOT NULL").select(*keys, pixel("i", "j").alias("a"), pixel("i2", "j2").alias("b"), F.col("weight").cast("double").alias("weight"))
    graph = cut_lineage(kept)
    totals = graph.groupBy(*keys).agg(exact("weight").alias("_total")) if keys else graph.agg(exact("weight").alias("_total"))
    total = totals.first()[0] or 0.0 if not keys else None
    nodes = cut_lineage(pixels.select(*keys, pixel("i", "j").alias("cluster_id"), "i", "j").distinct())
    extent = nodes.agg(F.coalesce(F.greatest(F.max("i"), F.max("j")), F.lit(0))).first()[0] + 1
    none = F.lit(None).cast("long")
    kinds = "".join(f"`{k}` {pixels.schema[k].dataType.simpleString()}, " for k in keys) + "cluster_id long, joined long"
    names = nodes.withColumn("name", F.col("cluster_id"))
    size, smaller = tile, 0
    while True:
        tiled = graph.select("*", *place("a", size, "a"), *place("b", size, "b"))
        same = (F.col("ta") == F.col("tb")) & (F.col("sa") == F.col("sb"))
        if smaller:  # only what the borders between the smaller tiles touch goes on moving
            near = graph.select("*", *place("a", smaller, "a"), *place("b", smaller, "b")).filter("ta <> tb OR sa <> sb")
            touched = near.select(*keys, F.explode(F.array("a", "b")).alias("a")).distinct()
            active = lambda end: touched.select(*keys, F.col("a").alias(end), F.lit(True).alias("_on_" + end))
            tiled = tiled.join(active("a"), [*keys, "a"], "left").join(active("b"), [*keys, "b"], "left").filter("_on_a OR _on_b")
        else:
            tiled = tiled.withColumns({"_on_a": F.lit(True), "_on_b": F.lit(True)})
        tiled = cut_lineage(tiled)
        whole = tiled.filter(same & F.col("_on_a") & F.col("_on_b"))
        inner = whole.select(*keys, F.col("ta").alias("t"), F.col("sa").alias("s"), "a", "b", "weight")
        cross = tiled.filter(~(same & F.coalesce(F.col("_on_a"), F.lit(False)) & F.coalesce(F.col("_on_b"), F.lit(False))))
        one = lambda end: cross.filter("_on_" + end).select(*keys, F.col("t" + end).alias("t"), F.col("s" + end).alias("s"), F.col(end).alias("a"), none.alias("b"), "weight")
        parts = inner.unionByName(one("a")).unionByName(one("b"))
        parts = parts.join(F.broadcast(totals), list(keys)) if keys else parts.withColumn("_total", F.lit(total))  # one row per scene
        moves = parts.groupBy(*keys, "t", "s").applyInPandas(_moves(keys, resolution, "_total"), kinds).filter("cluster_id <> joined")
        moves = cut_lineage(moves)
        of = lambda c, to: moves.select(*keys, F.col("cluster_id").alias(c), F.col("joined").alias(to))
        names = cut_lineage(names.join(of("name", "_to"), [*keys, "name"], "left").withColumn("name", F.coalesce("_to", "name")).drop("_to"))
        if size >= extent:
            break
        renamed = graph.join(of("a", "_a"), [*keys, "a"], "left").join(of("b", "_b"), [*keys, "b"], "left").select(*keys, F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "weight")
        graph = cut_lineage(renamed.groupBy(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(exact("weight").alias("weight")))
        size, smaller = size * factor, size
    return names.select(*keys, F.lit(0).alias("grid"), F.col("name").alias("cluster_id"), "i", "j")


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal numbers for equal values, nulls included (-1)."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_floating(flat.type):
        flat = pc.add(flat, pa.scalar(0.0, flat.type))  # no minus zero
    return pc.fill_null(flat.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _places(table: pa.Table, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """i, j, one number per place in order of i and j, the distance of rows, the number of places; pad rows and columns stay free around."""
    i, j = (table[c].to_numpy().astype(np.int64) for c in ("i", "j"))
    wide = int(j.max() - j.min()) + 1 + 2 * pad
    return i, j, (i - i.min() + pad) * wide + j - j.min() + pad, wide, (int(i.max() - i.min()) + 1 + 2 * pad) * wide


def _found(places: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted ones are in the sorted places, and whether they are there."""
    at = np.minimum(np.searchsorted(places, wanted), len(places) - 1)
    return at, places[at] == wanted


def _regions_of_tile(offsets: Sequence[tuple[int, int]]):
    """The function that adds _run to a tile's cells: the least i * 2**32 + j of the region within the tile."""

    def run(table: pa.Table) -> pa.Table:
        pad = max(max(abs(a), abs(b)) for a, b in offsets)
        i, j, place, wide, places = _places(table, pad)
        nodes, row, node = np.unique(_codes(table["_v"]) * places + place, return_index=True, return_inverse=True)
        links = [(np.flatnonzero(there), at[there]) for at, there in (_found(nodes, nodes + a * wide + b) for a, b in offsets)]
        least = row[_connected(len(nodes), *(np.concatenate(x) for x in zip(*links, strict=True)))][node]
        return table.append_column("_run", pa.array(i[least] * (1 << 32) + j[least]))

    return run


def regions(cells: DataFrame, value: str, offsets=FORWARD_4, max_rounds: int = 60, keys: Sequence[str] = ()) -> DataFrame:
    """keys, i, j, value, region: connected cells of equal value in each scene; a region is named by its least i * 2**32 + j.

    Each tile's regions are found first, in a task, so links are between regions of two tiles, and only those with links
    take part in the rounds.
    """
    tile = lambda c: F.floor(c / REGION_TILE)
    rows = cells.filter(F.col(value).isNotNull()).select(*keys, "i", "j", F.col(value).alias("_v"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields) + "_run long"
    marked = cut_lineage(rows.groupBy(*keys, tile(F.col("i")), tile(F.col("j"))).applyInArrow(_regions_of_tile(offsets), kinds))
    moved = [tile(F.col(c) + F.lit(sign * o)) != tile(F.col(c)) for step in offsets for c, o in zip("ij", step, strict=True) if o for sign in (1, -1)]
    pairs = neighbours(marked.filter(reduce(or_, moved)), ["_v", "_run"], offsets, keys).filter("_v = _v2 AND _run <> _run2").select(*keys, F.col("_run").alias("a"), F.col("_run2").alias("b")).distinct()
    if keys:
        # Within the rounds a run of a scene is one number: scenes in order, runs as they are. A name is read back from it.
        linked = pairs.select(*keys, F.explode(F.array("a", "b")).alias("_run")).distinct()
        numbered = cut_lineage(linked.select(*keys, "_run", F.monotonically_increasing_id().alias("_id")))
        number = lambda end, to: numbered.select(*keys, F.col("_run").alias(end), F.col("_id").alias(to))
        pairs = pairs.join(number("a", "u"), [*keys, "a"]).join(number("b", "v"), [*keys, "b"]).select("u", "v")
        found = _linked(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))), max_rounds)
        named = numbered.join(found, F.col("_id") == F.col("u")).select(*keys, "_run", F.col("name").alias("_group"))
        least = named.groupBy("_group").agg(F.min("_run").alias("name"))
        names = named.join(least, "_group").drop("_group")
    else:
        pairs = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
        names = _linked(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))), max_rounds).withColumnRenamed("u", "_run")
    out = marked.join(broadcast_if_small(names, TASK_LINKS), [*keys, "_run"], "left")
    return out.select(*keys, "i", "j", F.col("_v").alias(value), F.coalesce("name", "_run").alias("region"))


#: The sides of a cell; n is a side's place here.
SIDES = ((-1, 0), (1, 0), (0, -1), (0, 1))


def _segments_of_tile(columns: Sequence[str], tile: int, whole: bool):
    """The function that gives the segments of a tile's own cells: those within the tile, or those that reach its border."""

    def run(table: pa.Table) -> pa.Table:
        i, j, place, wide, _ = _places(table, 1)
        code = _codes(table["_v"])
        own = (i // tile == table["_ti"].to_numpy()) & (j // tile == table["_tj"].to_numpy())
        order = np.argsort(place, kind="stable")
        i, j, place, code, own = i[order], j[order], place[order], code[order], own[order]
        rows, sides, lines, begins, ends = [], [], [], [], []
        for n, (a, b) in enumerate(SIDES):
            at, there = _found(place, place + a * wide + b)
            cut = np.flatnonzero(own & (np.where(there, code[at], -1) != code))
            line, along = (i, j) if a else (j, i)
            if b:
                cut = cut[np.lexsort((i[cut], j[cut]))]
            on, to, of = line[cut], along[cut], code[cut]
            new = np.ones(len(cut), bool)
            new[1:] = (on[1:] != on[:-1]) | (to[1:] != to[:-1] + 1) | (of[1:] != of[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(cut))[: len(first)] - 1
            inner = (to[first] % tile != 0) & ((to[last] + 1) % tile != 0)
            first, last = (x[inner if whole else ~inner] for x in (first, last))
            rows.append(order[cut[first]])
            sides.append(np.full(len(first), n))
            lines.append(on[first] + (a + b > 0))
            begins.append(to[first])
            ends.append(to[last] + 1)
        out = table.select(columns).take(pa.array(np.concatenate(rows)))
        for name, parts in (("n", sides), ("line", lines), ("a", begins), ("b", ends)):
            out = out.append_column(name, pa.array(np.concatenate(parts).astype(np.int64)))
        return out

    return run


def outlines(regions_of: DataFrame, value: str = "region", keys: Sequence[str] = (), oriented: bool = False) -> DataFrame:
    """keys, value, x1, y1, x2, y2: the straight segments of the outline of every region, holes included.

    Cell (i, j) is the unit square from (j, i). A side between two cells belongs to the outline of each if they differ;
    sides on a line are joined to segments tile by tile, with the cells next to the tile, and segments that reach a
    tile's border by gaps and islands. No region is gathered anywhere, however large it is.
    oriented: each segment runs so that the region lies to its right (rows count downwards).
    """
    tile = lambda c, by=0: F.floor((F.col(c) + by) / REGION_TILE)
    own = F.struct(tile("i").alias("_ti"), tile("j").alias("_tj"))
    beyond = [F.when((tile("i", a) != tile("i")) | (tile("j", b) != tile("j")), F.struct(tile("i", a).alias("_ti"), tile("j", b).alias("_tj"))) for a, b in SIDES]
    sent = regions_of.select(*keys, "i", "j", F.col(value).alias("_v")).withColumn("_to", F.explode(F.filter(F.array(own, *beyond), lambda t: t.isNotNull())))
    tiles = sent.select(*keys, "i", "j", "_v", "_to.*").groupBy(*keys, "_ti", "_tj")
    columns = [*keys, "_v"]
    kinds = "".join(f"`{c}` {sent.schema[c].dataType.simpleString()}, " for c in columns) + "n long, line long, a long, b long"
    ready, open_ended = (tiles.applyInArrow(_segments_of_tile(columns, REGION_TILE, whole), kinds) for whole in (True, False))
    along = Window.partitionBy(*columns, "n", "line").orderBy("a")
    marked = open_ended.withColumn("_g", F.when(F.lag("b").over(along) == F.col("a"), 0).otherwise(1))
    grouped = marked.withColumn("_g", F.sum("_g").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = ready.unionByName(grouped.groupBy(*columns, "n", "line", "_g").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_g"))
    number = "int" if all(regions_of.schema[c].dataType.simpleString() in ("tinyint", "smallint", "int") for c in "ij") else "bigint"
    level = F.col("n") < 2
    x = lambda end: F.when(level, F.col(end)).otherwise(F.col("line")).cast(number)
    y = lambda end: F.when(level, F.col("line")).otherwise(F.col(end)).cast(number)
    back = F.col("n").isin(1, 2) if oriented else F.lit(False)
    first, second = (F.when(back, F.col(p)).otherwise(F.col(q)) for p, q in (("b", "a"), ("a", "b")))
    joined = joined.withColumns({"_p": first, "_q": second})
    return joined.select(*keys, F.col("_v").alias(value), x("_p").alias("x1"), y("_p").alias("y1"), x("_q").alias("x2"), y("_q").alias("y2"))


def trace_rings(segments: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int]]]:
    """Closed rings (first vertex repeated) of oriented segments, the outer one first.

    Where two rings meet in a corner each keeps to its own cell, that is the sharpest turn to the right. Straight runs
    become one side. The outer ring encloses the others, so it has the greatest area.
    """
    out: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for x1, y1, x2, y2 in sorted(segments):
        out[x1, y1].append((x2, y2))
    rings = []
    for start in sorted(out):
        while out[start]:
            ring, at, went = [start], start, None
            while True:
                turns = out[at]
                if went is None or len(turns) == 1:
                    to = turns[0]
                else:  # rows count downwards, so a positive cross product is a turn to the right
                    to = max(turns, key=lambda p: went[0] * (p[1] - at[1]) - went[1] * (p[0] - at[0]))
                turns.remove(to)
                went = ((to[0] > at[0]) - (to[0] < at[0]), (to[1] > at[1]) - (to[1] < at[1]))
                at = to
                ring.append(at)
                if at == start:
                    break
            rings.append(ring)
    area = lambda r: abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(r, r[1:], strict=False)))
    return sorted(rings, key=area, reverse=True)


def _ring_lists(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, of: np.ndarray, n: int) -> pa.Array:
    """trace_rings of n regions at once: the segments' ends (whole numbers) and region (0 to n - 1); an array of lists of rings."""
    # A vertex is a place of a region; its number follows region, x and y.
    regions2, x, y = np.concatenate([of, of]), np.concatenate([x1, x2]), np.concatenate([y1, y2])
    ranked = lambda v: np.unique(v, return_inverse=True)[1]
    column, row = ranked(x), ranked(y)
    vertex = ranked(ranked(regions2 * (column.max() + 1) + column) * (row.max() + 1) + row)
    order = np.argsort(vertex[: len(x1)], kind="stable")
    x1, y1, x2, y2, of = x1[order], y1[order], x2[order], y2[order], of[order]
    begin, end = vertex[: len(order)][order], vertex[len(order) :][order]
    # One or two segments leave a vertex; of two the one to the right goes on (rows count downwards).
    first, last = np.searchsorted(begin, end), np.searchsorted(begin, end, side="right") - 1
    turn = lambda to: np.sign(x2 - x1) * (y2[to] - y1[to]) - np.sign(y2 - y1) * (x2[to] - x1[to])
    then = np.where(turn(last) > turn(first), last, first)
    # A ring is named after its first segment, by pointer jumping; then how far each segment is from the ring's last one.
    ring, to = np.arange(len(then)), then
    while not np.array_equal(ring, ring[then]):
        ring, to = np.minimum(ring, ring[to]), to[to]
    ends = then == ring
    left, to = (~ends).astype(np.int64), np.where(ends, np.arange(len(then)), then)
    while left[to].any():
        left, to = left + left[to], to[to]
    starts, name, size = np.unique(ring, return_inverse=True, return_counts=True)
    # Coordinates from the ring's first place, so that the area is exact.
    u1, v1, u2, v2 = x1 - x1[ring], y1 - y1[ring], x2 - x1[ring], y2 - y1[ring]
    area = np.zeros(len(starts), np.int64)
    np.add.at(area, name, u1 * v2 - u2 * v1)
    rank = np.lexsort((starts, -np.abs(area), of[starts]))
    place = np.empty_like(rank)
    place[rank] = np.arange(len(rank))
    bounds = np.concatenate([[0], np.cumsum(size[rank] + 1)])
    at = np.empty(bounds[-1], np.int64)
    at[bounds[place[name]] + size[name] - 1 - left] = np.arange(len(then))
    at[bounds[1:] - 1] = starts[rank]
    points = pa.StructArray.from_arrays([pa.array(c[at].astype(np.float64)) for c in (x1, y1)], ["x", "y"])
    rings = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), points)
    counts = np.bincount(of[starts], minlength=n)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), rings)


def _ring_batches(batches):
    """Replaces the last column, the segments of each row's region, by its rings."""
    for batch in batches:
        if batch.num_rows:
            sides = batch.column(batch.num_columns - 1)
            of = np.repeat(np.arange(batch.num_rows), pc.list_value_length(sides).to_numpy())
            ends = [sides.flatten().field(c).to_numpy().astype(np.int64) for c in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _ring_lists(*ends, of, batch.num_rows)], [*batch.schema.names[:-1], "rings"])


def region_polygons(regions_of: DataFrame, value: str = "region", keys: Sequence[str] = ()) -> DataFrame:
    """keys, value, rings: every region as one polygon, an array of closed rings of struct<x, y>, the outer one first, then its holes.

    A region's outline, never its cells, goes to one task and becomes one value, as the result asks. The rings of all
    regions of a batch are traced together.
    """
    segments = outlines(regions_of, value, keys, oriented=True)
    sides = segments.groupBy(*keys, value).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("rings"))
    kinds = ", ".join(f"`{k}` {regions_of.schema[k].dataType.simpleString()}" for k in [*keys, value])
    return sides.mapInArrow(_ring_batches, kinds + ", rings array<array<struct<x: double, y: double>>>")


def modularity(edges: DataFrame, partition: DataFrame, resolution: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """keys, modularity of a partition of the pixels of each scene."""
    one = partition.select(*keys, "i", "j", F.col("cluster_id").alias("a"))
    two = partition.select(*keys, F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("cluster_id").alias("b"))
    met = edges.join(one, [*keys, "i", "j"]).join(two, [*keys, "i2", "j2"])
    half = F.explode(F.array(*[F.struct(F.col(c).alias("k"), F.when(F.col("a") == F.col("b"), F.col("weight") / 2).otherwise(0.0).alias("own"), F.col("weight").alias("w")) for c in ("a", "b")]))
    per = met.select(*keys, half.alias("h")).groupBy(*keys, "h.k").agg(F.sum("h.own").alias("own"), F.sum("h.w").alias("w"))
    sums = per.groupBy(*keys).agg(F.sum("own").alias("own"), F.sum(F.col("w") * F.col("w")).alias("squares"), (F.sum("w") / 2).alias("total"))
    return sums.select(*keys, (F.try_divide(F.col("own"), F.col("total")) - resolution * F.try_divide(F.col("squares"), 4 * F.col("total") * F.col("total"))).alias("modularity"))
