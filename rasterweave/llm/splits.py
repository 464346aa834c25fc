"""Splits that keep related records together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterweave.operators.skew import salted_join
from rasterweave.session import cut_lineage

#: Edges up to which the degrees and the collapses of a round are broadcast (at most two rows of 16 bytes per edge).
BROADCAST_EDGES = 100_000

#: Rounds whose collapses are unwound in one plan.
ROUNDS_UNWOUND = 5

#: Components of a hash bucket within which the cumulative weight is summed by one task, and the buckets at least.
COMPONENTS_A_BUCKET, LEAST_BUCKETS = 50_000, 64


def _coin(vertex: str, degree: str, other_degree: str, seed: int) -> Column:
    """True for heads. A function of the vertex and the round: all edges of a vertex agree.

    A vertex with one edge to a larger one is always tails, so that stars go at once; others are heads the more
    likely the more neighbours they have, and for two neighbours or less the coin is fair.
    """
    d = F.col(degree)
    share = F.greatest(F.lit(0.5), d / (d + 2.0))
    toss = F.pmod(F.xxhash64(F.col(vertex), F.col("round"), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    return F.when((d == 1) & (F.col(other_degree) > 1), F.lit(False)).otherwise(toss < share)


def _distinct_edges(edges: DataFrame) -> DataFrame:
    low, high = F.least("u", "v"), F.greatest("u", "v")
    return edges.filter(F.col("u") != F.col("v")).select(low.alias("u"), high.alias("v"), "round").distinct()


def _unwound(collapses: list[tuple[DataFrame, int]]) -> DataFrame:
    """vertex, component of all tails, from the last rounds to the first.

    A head can only have collapsed in a later round than its tail. The last ROUNDS_UNWOUND rounds are resolved among
    themselves; then each block of earlier rounds is resolved among itself and joined once with what is resolved already.
    Rounds shrink by a constant share, so the work of all joins is a few times the vertices, and a plan never
    holds more than one block.
    """
    done: DataFrame | None = None
    rows = 0
    for end in range(len(collapses), 0, -ROUNDS_UNWOUND):
        block = collapses[max(0, end - ROUNDS_UNWOUND) : end]
        labels = block[0][0]
        for collapse, _ in block[1:]:
            labels = labels.unionByName(collapse)
        labels = labels.select(F.col("tail").alias("vertex"), F.col("head").alias("component"))
        later = [(c.select(F.col("tail").alias("component"), F.col("head").alias("_later")), n) for c, n in block[1:]]
        if done is not None:
            later.append((done.select(F.col("vertex").alias("component"), F.col("component").alias("_later")), rows))
        for names, n in later:
            labels = labels.join(F.broadcast(names) if n <= BROADCAST_EDGES else names, "component", "left").select("vertex", F.coalesce("_later", "component").alias("component"))
        done = cut_lineage(labels if done is None else labels.unionByName(done))
        rows += sum(n for _, n in block)
    return done


def components(edges: DataFrame, *, seed: int = 42, max_rounds: int = 200) -> DataFrame:
    """vertex, component of every vertex of an undirected graph with edges u, v (bigint), by random-mate contraction.

    In each round every vertex tosses a coin that is a hash of its id; a tail with a head among its neighbours
    collapses into the least such head, the edges are renamed by joins and loops and repeats vanish. A constant share
    of the vertices goes in each round, so the rounds are logarithmic whatever the shape: long chains and huge stars
    alike. When no edge is left, the collapses are unwound backwards: a vertex collapsed in one round takes the name that
    its head gets in a later one. The component's name is the id of one of its vertices. Edges with a null end and loops are
    ignored (a vertex with loops only has no row).

    Edges and collapses are written to the checkpoint folder each round; coins depend on ids alone, so recomputed tasks
    agree. A round's tables are broadcast only if the number of its edges proves them small. The round is a
    column, not a constant, so all rounds run the same generated code.
    """
    edges = cut_lineage(_distinct_edges(edges.filter("u IS NOT NULL AND v IS NOT NULL").select("u", "v", F.lit(0).alias("round"))))
    collapses: list[tuple[DataFrame, int]] = []
    while n := edges.count():
        if len(collapses) == max_rounds:
            raise RuntimeError(f"edges are left after {max_rounds} rounds")
        small = F.broadcast if n <= BROADCAST_EDGES else (lambda df: df)
        ends = edges.select(F.explode(F.array("u", "v")).alias("x"))
        degrees = small(ends.groupBy("x").agg(F.count(F.lit(1)).alias("d")))
        rich = edges.join(degrees.select(F.col("x").alias("u"), F.col("d").alias("du")), "u").join(degrees.select(F.col("x").alias("v"), F.col("d").alias("dv")), "v")
        tossed = rich.select("u", "v", _coin("u", "du", "dv", seed).alias("hu"), _coin("v", "dv", "du", seed).alias("hv")).filter(F.col("hu") != F.col("hv"))
        tails = tossed.select(F.when(F.col("hu"), F.col("v")).otherwise(F.col("u")).alias("tail"), F.when(F.col("hu"), F.col("u")).otherwise(F.col("v")).alias("head"))
        collapse = cut_lineage(tails.groupBy("tail").agg(F.min("head").alias("head")))
        collapses.append((collapse, n))  # at most one tail for each edge
        for end in ("u", "v"):
            edges = edges.join(small(collapse).select(F.col("tail").alias(end), F.col("head").alias(f"_{end}")), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
        edges = cut_lineage(_distinct_edges(edges.withColumn("round", F.col("round") + 1)))
    if not collapses:
        return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    labels = _unwound(collapses)
    return labels.unionByName(labels.select(F.col("component").alias("vertex"), "component").distinct())


def key_hash(kind: int, *columns: Column, seed: int = 0) -> Column:
    """A 64-bit name of a key's value, null if one of its columns is null."""
    return F.when(~_any_null(columns), F.xxhash64(F.lit(kind), F.lit(seed), *columns))


def _any_null(columns: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c.isNull()
    return out


def related_records(records: DataFrame, id_col: str, keys: Sequence[Sequence[str]]) -> DataFrame:
    """records with `component`: equal for records that share the value of one of the keys, directly or through others.

    A key is one or more columns; a null in one of them makes it no key of that record. A record without any key is a
    component of its own. One row per id is expected (repeated rows stay, in the same component); other columns are
    kept, whatever their names, but an older `component` is replaced.

    Each record ties its keys together (an edge from its first key to each other one), so vertices are key values and
    a key with a third of all records is one vertex, whose edges are made distinct before they are shuffled. Key values have 64-bit
    names; names given to two different values are looked for and the naming is repeated with another seed.
    """
    records = cut_lineage(records.drop("component"))
    for seed in range(8):
        names = [key_hash(k, *[F.col(c) for c in cols], seed=seed) for k, cols in enumerate(keys)]
        named = [F.struct(n.alias("name"), F.concat_ws("\u0001", F.lit(str(k)), *[F.col(c).cast("string") for c in cols]).alias("value")) for k, (n, cols) in enumerate(zip(names, keys, strict=True))]
        values = records.select(F.explode(F.array(*named)).alias("x")).filter("x.name IS NOT NULL").select("x.*")
        if values.groupBy("name").agg(F.min(F.xxhash64("value")).alias("a"), F.max(F.xxhash64("value")).alias("b")).filter("a <> b").isEmpty():
            break
    else:
        raise RuntimeError("two values of keys have the same 64-bit name under every seed")
    first = F.coalesce(*names)
    ties = F.filter(F.array(*names), lambda n: n.isNotNull() & (n != first))
    edges = records.select(first.alias("u"), F.explode(ties).alias("v"))
    found = components(edges)
    own = F.xxhash64(F.lit("alone"), F.col(f"_r.{id_col}"))
    # The records' own columns travel as one struct, so none of them can clash with a helper column.
    keyed = records.select(F.struct(*records.columns).alias("_r"), first.alias("_first"))
    labels = salted_join(keyed.filter("_first IS NOT NULL"), found.withColumnRenamed("vertex", "_first"), ["_first"], F.col(f"_r.{id_col}"), how="left")
    alone = keyed.filter("_first IS NULL").withColumn("component", F.lit(None).cast("long"))
    return labels.unionByName(alone).select("_r.*", F.coalesce("component", "_first", own).alias("component"))


def split_components(records: DataFrame, component: str, shares: dict[str, float], *, seed: int = 42, heavy_share: float = 0.005) -> DataFrame:
    """component, split: every component goes to one split as a whole, and the splits' shares of records come near `shares`.

    Components above heavy_share of all records, at most 1 / heavy_share of them, are placed one by one, the largest
    first, where most is missing. The others follow in the order of a hash: by cumulative weight over what is still
    missing of each split. The cumulative weight is summed per hash bucket first, and the buckets grow with the number of
    components, so no task sorts more than about COMPONENTS_A_BUCKET of them. No split is off by more than about
    heavy_share of the records, unless a single component makes that impossible. A null component is one component.
    """
    weights = cut_lineage(records.groupBy(F.col(component).alias("component")).agg(F.count(F.lit(1)).alias("w")))
    total, n = weights.agg(F.coalesce(F.sum("w"), F.lit(0)), F.count(F.lit(1))).first()
    names = list(shares)
    missing = {s: shares[s] / sum(shares.values()) * total for s in names}
    placed = []
    for row in weights.filter(F.col("w") > heavy_share * total).orderBy(F.desc("w"), "component").collect():  # at most 1 / heavy_share rows
        best = max(names, key=lambda s: missing[s])
        missing[best] -= row["w"]
        placed.append((row["component"], best))
    spark = records.sparkSession
    kind = weights.schema["component"].dataType.simpleString()
    heavy = spark.createDataFrame(placed, f"component {kind}, split string")
    buckets = max(LEAST_BUCKETS, n // COMPONENTS_A_BUCKET)
    light = weights.filter(F.col("w") <= heavy_share * total).withColumn("_h", F.xxhash64(F.lit(seed), "component")).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    sums = light.groupBy("_b").agg(F.sum("w").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sums.select("_b", before.alias("_before")))  # one row per bucket
    within = F.sum("w").over(Window.partitionBy("_b").orderBy("_h", "component").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    middle = light.join(starts, "_b").select("component", (F.col("_before") + within - F.col("w") / 2).alias("_m"))
    # What is missing in all, dealt in proportion to what each split still lacks.
    scale, rest = sum(max(0.0, x) for x in missing.values()), sum(missing.values())
    edge, limits = 0.0, []
    for s in names:
        edge += max(0.0, missing[s]) * (rest / scale if scale else 0.0)
        limits.append((s, edge))
    choice = F.lit(names[-1])
    for s, limit in reversed(limits[:-1]):
        choice = F.when(F.col("_m") < limit, s).otherwise(choice)
    return middle.select("component", choice.alias("split")).unionByName(heavy)


def split_related(records: DataFrame, id_col: str, keys: Sequence[Sequence[str]], shares: dict[str, float], *, seed: int = 42, heavy_share: float = 0.005, weighed: Column | None = None) -> DataFrame:
    """records with component and assigned_split (older columns of these names are replaced); see related_records and split_components.

    weighed: which rows count and come out; others only tie components together.
    """
    tied = related_records(records.drop("assigned_split"), id_col, keys)
    tied = cut_lineage(tied.filter(weighed) if weighed is not None else tied)
    chosen = split_components(tied, "component", shares, seed=seed, heavy_share=heavy_share).withColumnRenamed("split", "assigned_split")
    return salted_join(tied, chosen, ["component"], F.col(id_col))


def split_report(split: DataFrame, shares: dict[str, float], groups: Sequence[Sequence[str]]) -> DataFrame:
    """assigned_split, n_records, share, target and divided: the groups (equal values in all columns, none null) that lie in several splits.

    split: the result of split_related. One row for each split, also for an empty one; divided is the same in all rows.
    """
    spark = split.sparkSession
    targets = spark.createDataFrame([(s, float(v) / sum(shares.values())) for s, v in shares.items()], "assigned_split string, target double")
    counts = split.groupBy("assigned_split").agg(F.count(F.lit(1)).alias("n_records"))
    total = split.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = targets.join(F.broadcast(counts), "assigned_split", "left").withColumn("n_records", F.coalesce("n_records", F.lit(0)).cast("long"))  # one row per split
    divided = F.lit(0).cast("long")
    for columns in groups:
        known = split.dropna(subset=list(columns))
        divided = divided + known.groupBy(*columns).agg(F.min("assigned_split").alias("a"), F.max("assigned_split").alias("b")).filter("a <> b").agg(F.count(F.lit(1)).alias("n")).scalar()
    return out.select("assigned_split", "n_records", F.try_divide(F.col("n_records"), total).alias("share"), "target", divided.alias("divided"))
