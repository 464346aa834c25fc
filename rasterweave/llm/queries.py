"""The queries of the text and training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterweave.functions.tiles import one_row_per_id, standard_split, standard_tile
from rasterweave.llm import looks, packing, sampling, splits, terms, tokens
from rasterweave.operators.skew import salted_join
from rasterweave.session import cut_lineage

#: Cubes belong together if they share tile and year; those without a tile go with their image in that year.
CUBE_KEYS = [["tile_id", "capture_year"], ["image_id", "capture_year"]]
CODE_FIELDS = ["pest_species_code", "tree_species_code", "pest_severity_code"]


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _draws(spark: SparkSession, d: str) -> sampling.Draws:
    rows = one_row_per_id(_read(spark, d, "annotations"), "poly_seq", "tile_id", "pest_severity_code", "labels")
    fields = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("c")) for f in ("pest_severity_code", "labels")])
    records = rows.select(F.col("poly_seq").alias("id"), standard_tile(F.col("tile_id")).alias("stratum"), F.explode(fields).alias("x")).select("id", "stratum", F.col("x.f").alias("field_name"), F.col("x.c").alias("category")).filter(F.col("stratum").isNotNull() & F.col("category").isNotNull())
    return sampling.Draws(records, _read(spark, d, "sample_targets").withColumnRenamed("tile_id", "stratum"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _draws(spark, d).report().filter("short").select("draw_id", "category")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return _draws(spark, d).report().select("draw_id", "category", "required", "stock", "drawn", F.round("share", 6).alias("share"), "short")


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return _draws(spark, d).sample().withColumnRenamed("id", "poly_seq")


def _terms(spark: SparkSession, d: str) -> DataFrame:
    records = one_row_per_id(_read(spark, d, "annotations"), "poly_seq", *CODE_FIELDS)
    return terms.code_frequencies(records, CODE_FIELDS, min_records=5, max_share=0.1).withColumnRenamed("term", "code")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).filter(F.col("mark").isNotNull()).select("field_name", "code", "mark")


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d)


def _cubes(spark: SparkSession, d: str) -> DataFrame:
    """Cubes once each, and the links that tie images to tiles.

    A cube with a tile belongs to its (tile, year). One without belongs to its (image, year), and a link, a row without a
    cube made from the catalog, ties that to the image's (tile, year): which cubes belong together is then found by the
    contraction, over as many hops as it takes.
    """
    cubes = one_row_per_id(_read(spark, d, "cubes"), "cube_id", "image_id", "tile_id", "capture_year", "split")
    cubes = cubes.select("cube_id", standard_tile(F.col("tile_id")).alias("tile_id"), "capture_year", "image_id", standard_split(F.col("split")).alias("delivered")).withColumn("image_id", F.when(F.col("tile_id").isNull(), F.col("image_id")))
    cubes = cut_lineage(cubes)
    asked = cubes.filter("image_id IS NOT NULL AND capture_year IS NOT NULL").select("image_id", "capture_year").distinct()
    # Few cubes lack a tile, so it is the catalog that is filtered, by the images these cubes name.
    images = _read(spark, d, "image_catalog").select("image_id", standard_tile(F.col("tile_id")).alias("tile_id")).filter(F.col("tile_id").isNotNull())
    links = images.join(asked.select("image_id").distinct(), "image_id", "left_semi").groupBy("image_id").agg(F.min("tile_id").alias("tile_id")).join(asked, "image_id")
    return cubes.unionByName(links, allowMissingColumns=True)


def _shares(spark: SparkSession, d: str) -> dict[str, float]:
    return {r["split"]: r["target_share"] for r in _read(spark, d, "split_targets").select("split", "target_share").collect()}  # one row per split


def _split(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_related(_cubes(spark, d), "cube_id", CUBE_KEYS, _shares(spark, d), weighed=F.col("cube_id").isNotNull())


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    # A component is one tile and year with all that is tied to it; links bring the tile, cubes the splits.
    tied = splits.related_records(_cubes(spark, d), "cube_id", CUBE_KEYS)
    known = tied.groupBy("component").agg(F.max("tile_id").alias("tile_id"), F.max("capture_year").alias("capture_year"), F.min("delivered").alias("a"), F.max("delivered").alias("b"))
    return known.filter("tile_id IS NOT NULL AND capture_year IS NOT NULL AND a <> b").select("tile_id", "capture_year")


def p5_split(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).select("cube_id", "tile_id", "capture_year", "component", "assigned_split")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Per split: the cubes in it, whether its share is within a percent of the target, and groups that are divided."""
    report = splits.split_report(_split(spark, d), _shares(spark, d), CUBE_KEYS)
    return report.select("assigned_split", F.sum("n_records").over(Window.partitionBy()).alias("n_cubes"), (F.abs(F.col("share") - F.col("target")) <= 0.01).alias("near"), "divided")  # one row per split


#: Documents are related if they come from one bitext or repeat one of its sides.
DOCUMENT_KEYS = [["bitext"], ["source_side"], ["target_side"]]


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hang together through bitexts and repeated sides: the least doc_id and the size of each group."""
    side = lambda c: F.when(F.trim(c) != "", F.md5(c))
    docs = _read(spark, d, "documents").select("doc_id", F.when(F.trim("bitext_id") != "", F.col("bitext_id")).alias("bitext"), side("text").alias("source_side"), side("tgt_text").alias("target_side"))
    tied = cut_lineage(splits.related_records(docs, "doc_id", DOCUMENT_KEYS).select("doc_id", "component"))
    sizes = tied.groupBy("component").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_docs"))
    return salted_join(tied, sizes, ["component"], F.col("doc_id")).select("doc_id", "first_doc", "n_docs")


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(_read(spark, d, "documents"), "doc_id", "text")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return _ids(spark, d)


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    return _ids(spark, d).select("doc_id", tokens.decode(F.col("ids")).alias("text"))


def p7_packs(spark: SparkSession, d: str) -> DataFrame:
    capacities = {r["pack_name"]: r["capacity"] for r in _read(spark, d, "pack_sizes").collect()}  # one row per capacity
    sized = tokens.token_sizes(_read(spark, d, "documents").filter(F.col("text") != ""), "doc_id", "text")
    return packing.pack_items(sized, "doc_id", "size", capacities)


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity: the texts placed, containers above it, texts divided without need, and whether nine tenths of the space are used."""
    capacities = {r["pack_name"]: r["capacity"] for r in _read(spark, d, "pack_sizes").collect()}  # one row per capacity
    packed = cut_lineage(p7_packs(spark, d))
    capacity = F.create_map(*[F.lit(x) for pair in capacities.items() for x in pair])[F.col("pack_name")]
    items = packed.groupBy("pack_name", "doc_id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("pieces"))
    placed = items.groupBy("pack_name").agg(F.count(F.lit(1)).alias("n_items"), F.sum((F.col("pieces") != F.ceil(F.col("size") / capacity)).cast("int")).alias("divided"))
    held = packed.groupBy("pack_name", "container_id").agg(F.sum("size").alias("size")).groupBy("pack_name").agg(F.sum((F.col("size") > capacity).cast("int")).alias("overfull"))
    filled = packing.pack_report(packed, capacities).select("pack_name", (F.col("fill") > 0.9).alias("filled"))
    return placed.join(held, "pack_name").join(filled, "pack_name").select("pack_name", "n_items", "divided", "overfull", "filled")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return looks.same_look(_read(spark, d, "documents"), "doc_id", "text")


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    return looks.look_classes(_read(spark, d, "documents"), "doc_id", "text")


def p8_canonical(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select("doc_id", looks.canonical(F.col("text")).alias("text"))


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p2_sample, p3_found, p3_terms, p5_found, p5_split, p5_report, p5_groups, p6_ids, p6_decoded, p7_packs, p7_report, p8_found, p8_classes, p8_canonical)}
