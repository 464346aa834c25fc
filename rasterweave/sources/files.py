"""Reading rasters, cubes, vectors and series from files, and where outputs go."""

from __future__ import annotations

import io
import json
import os
import re
import struct
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: One row of a chunked raster: a block of one channel.
CHUNK_SCHEMA = "path string, channel int, ci int, cj int, height int, width int, v array<double>"
CHUNK = 256


def list_files(spark: SparkSession, folder: str, suffix: str = "", recursive: bool = False) -> DataFrame:
    """path, length, modified of the files with a suffix, in order of path; a folder that doesn't exist raises.

    The listing is Spark's own, so it works on any Hadoop file system; the contents are not read.
    """
    if "://" not in folder and not Path(folder).is_dir():
        raise NotADirectoryError(folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", f"*{suffix}").load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified")).orderBy("path")


def date_of(path: Column) -> Column:
    """The date that a file's name begins with (YYYY-MM-DD); null if it doesn't."""
    return F.to_date(F.nullif(F.regexp_extract(path, r"/?(\d{4}-\d{2}-\d{2})[^/]*$", 1), F.lit("")))


def _blocks(path: str, array: np.ndarray, chunk: int, mask_bands: int | None = None) -> Iterator[pa.RecordBatch]:
    """A (channels, height, width) array as record batches, one per block of all channels; the values stay NumPy buffers.

    NaN becomes null. mask_bands: a pixel whose first so many channels are all 0 is null in every channel.
    """
    if array.ndim == 2:
        array = array[None]
    if array.ndim != 3:
        raise ValueError(f"{path}: {array.ndim} dimensions instead of 2 or 3")
    n, h, w = array.shape
    for ci in range(0, h, chunk):
        for cj in range(0, w, chunk):
            block = array[:, ci : ci + chunk, cj : cj + chunk].astype(float)
            empty = np.isnan(block)
            if mask_bands:
                empty |= (np.nan_to_num(block[:mask_bands]) == 0).all(axis=0)[None]
            rows, columns = block.shape[1:]
            values = pa.array(block.ravel(), mask=empty.ravel())
            v = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (rows * columns)), values)
            same = lambda x: pa.array(np.full(n, x, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(n, dtype=np.int32)), same(ci), same(cj), same(rows), same(columns), v], names=["path", "channel", "ci", "cj", "height", "width", "v"])


def _decoder(kind: str, chunk: int, mask_bands: int | None = None):
    def decode(path: str, content: bytes) -> np.ndarray:
        if kind == "npy":
            return np.load(io.BytesIO(content), allow_pickle=False)
        if kind == "tif":
            from rasterio.io import MemoryFile

            with MemoryFile(content) as f, f.open() as src:
                return src.read()
        import h5py

        with h5py.File(io.BytesIO(content), "r") as f:
            cubes = f["cubes"][:]
        return cubes.reshape(-1, *cubes.shape[-2:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, path in enumerate(batch.column("path").to_pylist()):
                yield from _blocks(path, decode(path, batch.column("content")[k].as_py()), chunk, mask_bands)

    return run


#: Suffix to decoder. Pickle is left out: reading it runs code.
READERS = {".npy": "npy", ".tif": "tif", ".tiff": "tif", ".h5": "h5"}


def read_rasters(spark: SparkSession, folder: str, suffix: str = ".npy", recursive: bool = False, chunk: int = CHUNK, mask_bands: int | None = None) -> DataFrame:
    """Rasters of a folder in blocks of chunk x chunk values, a file to a task; NaN becomes null.

    mask_bands: pixels whose first so many channels are all 0 become null in every channel, where the file is read.

    .npy is read with NumPy; .tif and .h5 need rasterio and h5py on the executors. Anything else raises ValueError.
    """
    if suffix not in READERS:
        raise ValueError(f"no reader for {suffix!r}; known: {sorted(READERS)}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", f"*{suffix}").load(folder)
    return files.select("path", "content").mapInArrow(_decoder(READERS[suffix], chunk, mask_bands), CHUNK_SCHEMA)


def read_cubes(spark: SparkSession, path: str) -> DataFrame:
    """Cubes by the path's suffix: Parquet (or a folder of it) as it is, arrays as blocks; pickle raises ValueError."""
    suffix = Path(path.rstrip("/")).suffix.lower()
    if suffix in (".pkl", ".pickle"):
        raise ValueError("pickle is not read: it can run code")
    if suffix in ("", ".parquet"):
        return spark.read.parquet(path)
    if suffix not in READERS:
        raise ValueError(f"no reader for {suffix!r}")
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_decoder(READERS[suffix], CHUNK), CHUNK_SCHEMA)


def chunk_pixels(chunks: DataFrame) -> DataFrame:
    """path, channel, i, j, v from blocks: one explode, no shuffle."""
    at = chunks.select("path", "channel", "ci", "cj", "width", F.posexplode("v").alias("_k", "v"))
    return at.select("path", "channel", (F.col("ci") + F.floor(F.col("_k") / F.col("width"))).cast("int").alias("i"), (F.col("cj") + F.pmod("_k", "width")).cast("int").alias("j"), "v")


def read_series(spark: SparkSession, folder: str, suffix: str = ".npy", recursive: bool = False, n_bands: int = 11, scale: float = 255.0) -> DataFrame:
    """i, j, t, c, v, date of the dated rasters of a folder: t counts the dates in order, v is divided by scale.

    A pixel whose first n_bands channels are all 0 on a date is masked, where its file is decoded: all its values of that date
    are null. Nothing is shuffled.
    """
    listed = list_files(spark, folder, suffix, recursive).select(date_of(F.col("path")).alias("date")).distinct()
    dates = [r["date"] for r in listed.orderBy(F.col("date").asc_nulls_first()).collect()]  # one per file of a series
    if None in dates:
        raise ValueError("a file's name does not begin with a date")
    order = F.create_map(*[F.lit(x) for k, d in enumerate(dates) for x in (d, k)]) if dates else F.lit(None).cast("map<date,int>")
    pixels = chunk_pixels(read_rasters(spark, folder, suffix, recursive, mask_bands=n_bands)).withColumn("date", date_of(F.col("path")))
    return pixels.select("i", "j", order[F.col("date")].alias("t"), F.col("channel").alias("c"), (F.col("v") / scale).alias("v"), "date")


def _shp_records(content: bytes) -> Iterator[tuple[int, str, list[list[tuple[float, float]]]]]:
    """Record number, kind and rings of the main file of a shapefile: points and polygons (also with z and m, which are not read)."""
    if len(content) < 100 or struct.unpack(">i", content[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    at = 100
    while at + 12 <= len(content):
        number, words = struct.unpack(">ii", content[at : at + 8])
        body = content[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        kind = struct.unpack("<i", body[:4])[0]
        if kind == 0:
            yield number, "Null", []
        elif kind in (1, 11, 21):
            yield number, "Point", [[struct.unpack("<2d", body[4:20])]]
        elif kind in (5, 15, 25):
            parts, points = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            xy = np.frombuffer(body, dtype="<f8", count=2 * points, offset=44 + 4 * parts).reshape(-1, 2).tolist()
            yield number, "Polygon", [[tuple(p) for p in xy[a:b]] for a, b in zip(starts, starts[1:], strict=False)]
        else:
            raise ValueError(f"unsupported shape type {kind}")


def _dbf_rows(content: bytes) -> list[dict[str, str | None]]:
    """The attributes of a shapefile, as text without blanks around it; an empty field is null."""
    n, head, width = struct.unpack("<IHH", content[4:12])
    fields, at = [], 32
    while content[at] != 0x0D:
        fields.append((content[at : at + 11].split(b"\0")[0].decode("latin-1"), content[at + 16]))
        at += 32
    out = []
    for k in range(n):
        row, pos = content[head + k * width : head + (k + 1) * width], 1
        values = {}
        for name, size in fields:
            values[name] = row[pos : pos + size].decode("utf-8", errors="replace").strip(" \0") or None
            pos += size
        out.append(values)
    return out


VECTOR_SCHEMA = "geometry array<struct<x: double, y: double>>, holes array<array<struct<x: double, y: double>>>, kind string, properties map<string, string>"


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """path, number, geometry, holes, kind, properties of the features of shapefiles (a file, a folder or a pattern of .shp).

    Outer rings run clockwise; a feature of several has a row for each, and a hole goes with the outer ring that contains
    its first vertex. Attributes come from the .dbf beside each .shp, by position, as text. Points have one vertex, null
    shapes no geometry. Another shape type, a broken file or a missing one raises. A file is read by one task.
    """
    glob = {} if path.endswith(".shp") else {"pathGlobFilter": "*.shp"}
    shapes = spark.read.format("binaryFile").options(**glob).load(path).select("path", "content")
    folder = path.rsplit("/", 1)[0] if path.endswith(".shp") else path
    tables = spark.read.format("binaryFile").option("pathGlobFilter", "*.dbf").load(folder).select(F.regexp_replace("path", r"\.dbf$", ".shp").alias("path"), F.col("content").alias("dbf"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vertex = lambda ring: [{"x": x, "y": y} for x, y in ring]
        area = lambda ring: sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True))
        for batch in batches:
            for name, content, dbf in zip(batch["path"], batch["content"], batch["dbf"], strict=True):
                attributes = _dbf_rows(dbf) if dbf is not None else []
                rows = []
                for k, (number, kind, rings) in enumerate(_shp_records(content)):
                    outer = [r for r in rings if kind != "Polygon" or area(r) < 0] or rings[:1]
                    holes = [[h for h in rings if h not in outer and (len(outer) == 1 or _inside(h[0], o))] for o in outer]
                    known = attributes[k] if k < len(attributes) else {}
                    rows += [(name, number, vertex(o), [vertex(h) for h in hs], kind, known) for o, hs in zip(outer, holes, strict=True)] or [(name, number, None, [], kind, known)]
                yield pd.DataFrame(rows, columns=["path", "number", "geometry", "holes", "kind", "properties"])

    return shapes.join(tables, "path", "left").mapInPandas(run, f"path string, number int, {VECTOR_SCHEMA}")


def _inside(p: tuple[float, float], ring: list[tuple[float, float]]) -> bool:
    """True if an odd number of sides lies to the right of p."""
    x, y = p
    return sum((y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True)) % 2 == 1


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per feature of GeoJSON files: geometry (outer ring, or the point, as array<struct<x, y>>), holes (inner rings), kind, properties.

    lines: each line is a collection of its own, so that large files can be split. Only Polygon and Point are accepted; another type raises when the rows are read. A missing file raises.
    """
    schema = "features array<struct<geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>"
    files = spark.read.option("multiLine", str(not lines).lower()).schema(schema).json(path)
    rows = files.select(F.explode("features").alias("f")).select("f.geometry.type", "f.geometry.coordinates", "f.properties")
    vertex = lambda v: F.struct(v[0].alias("x"), v[1].alias("y"))
    rings = F.from_json("coordinates", "array<array<array<double>>>")
    ring = F.transform(rings[0], vertex)
    holes = F.when(F.col("type") == "Polygon", F.transform(F.slice(rings, 2, F.greatest(F.size(rings), F.lit(1))), lambda r: F.transform(r, vertex)))
    point = F.array(vertex(F.from_json("coordinates", "array<double>")))
    wrong = F.raise_error(F.concat(F.lit("unsupported geometry: "), F.coalesce("type", F.lit("none"))))
    shape = F.when(F.col("type") == "Polygon", ring).when(F.col("type") == "Point", point).otherwise(wrong)
    return rows.select(shape.alias("geometry"), holes.alias("holes"), F.col("type").alias("kind"), "properties")


def destination(source: str, target: str, suffix: str | None = None, root: str | None = None) -> str:
    """Where the result of a source file goes: target itself if it is a file, else target and the source's place below root.

    suffix replaces the source's; the tree of folders is kept from the first part in which source and root differ.
    """
    src, out = Path(source), Path(target)
    if out.suffix:
        return str(out)
    parts = src.parts
    if root is not None:
        base = Path(root).parts
        same = next((k for k, (a, b) in enumerate(zip(parts, base, strict=False)) if a != b), min(len(parts), len(base)))
        parts = parts[same:]
    else:
        parts = parts[-1:]
    place = out.joinpath(*parts)
    return str(place.with_suffix(suffix) if suffix else place)


def write_layout(df: DataFrame, path: str, by: Sequence[str], mode: str = "error", records: int | None = None) -> None:
    """Parquet under folders of the `by` columns; records: most rows of a file.

    Rows are clustered by folder with the rebalance hint, which lets Spark cut a folder with a third of all rows into
    several files and put small ones together.
    """
    writer = (df.hint("rebalance", *by) if by else df).write.mode(mode)
    writer = writer.partitionBy(*by) if by else writer
    if records:
        writer = writer.option("maxRecordsPerFile", records)
    writer.parquet(path)


#: Folder columns of the three acquisition layouts.
LAYOUTS = {"predict": ("aoi", "tile_id", "date"), "fordead": ("tile_id", "date", "band"), "train": ("tile_id", "date")}


def save(df: DataFrame, path: str, layout: str, where: str = "local", mode: str = "error") -> None:
    """Write in one of LAYOUTS; where is 'local' or 'gcs' (then path must be a gs:// URI), anything else raises ValueError."""
    if where not in ("local", "gcs") or layout not in LAYOUTS:
        raise ValueError("where must be 'local' or 'gcs' and layout one of " + ", ".join(LAYOUTS))
    if (where == "gcs") != path.startswith("gs://"):
        raise ValueError("a path for 'gcs' begins with gs://, another one doesn't")
    write_layout(df, path, LAYOUTS[layout], mode)


def parse_day(text: str) -> str:
    """A date as YYYY-MM-DD, checked as a whole."""
    import datetime

    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise ValueError(f"not a date: {text!r}")
    return datetime.date.fromisoformat(text).isoformat()


def describe(spark: SparkSession, path: str, **what) -> None:
    """A run's description, one JSON file in the folder `path` on any file system."""
    text = json.dumps(what, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def log_metrics(metrics: DataFrame, path: str, run: str, step: int) -> None:
    """Append numeric columns of a metrics table as rows run, step, name, value, labels to a Parquet log.

    Other columns than numbers are kept as text in labels, so a class or a band can be told apart later.
    """
    numbers = [f.name for f in metrics.schema if isinstance(f.dataType, NumericType)]
    texts = [c for c in metrics.columns if c not in numbers]
    labels = F.create_map(*[x for c in texts for x in (F.lit(c), F.col(c).cast("string"))]) if texts else F.lit(None).cast("map<string,string>")
    rows = metrics.select(labels.alias("labels"), *[F.col(c).cast("double").alias(c) for c in numbers]).unpivot(["labels"], numbers, "name", "value")
    rows.select(F.lit(run).alias("run"), F.lit(step).cast("long").alias("step"), "name", "value", "labels").write.mode("append").parquet(path)


def write_npy(pixels: DataFrame, folder: str, scene: str, value: str = "v", dtype: str = "float32") -> list[str]:
    """One .npy file (channels, height, width) for each scene of long pixels (scene, channel, i, j, value); returns the paths.

    A scene is put together in one task, from the blocks of its rows, and has to fit there as an array; nulls are NaN (0 for whole numbers).
    Files are named after the scene and written under another name first, so a task that runs again leaves no half file.
    folder has to be mounted on all executors.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = re.sub(r"[^\w.-]", "_", str(pdf[scene].iloc[0]))
        shape = tuple(int(pdf[a].max()) + 1 for a in ("channel", "i", "j"))
        whole = np.issubdtype(np.dtype(dtype), np.integer)
        array = np.full(shape, 0 if whole else np.nan, dtype=dtype)
        good = pdf[value].notna()
        array[pdf["channel"][good], pdf["i"][good], pdf["j"][good]] = pdf[value][good]
        path = Path(folder, f"{name}.npy")
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_name(f".{path.name}.{os.getpid()}")
        with part.open("wb") as f:
            np.save(f, array, allow_pickle=False)
        part.replace(path)
        return pd.DataFrame({"path": [str(path)]})

    done = pixels.select(scene, "channel", "i", "j", F.col(value).cast("double").alias(value)).groupBy(scene).applyInPandas(run, "path string")
    return sorted(r["path"] for r in done.collect())  # one row per file


def write_geojson(polygons: DataFrame, path: str, geometry: str, properties: Sequence[str], mode: str = "error") -> None:
    """Polygons (an array of rings, the outer one first, each an array of struct<x, y>) as lines of GeoJSON features."""
    point = lambda v: F.array(v["x"].cast("double"), v["y"].cast("double"))
    rings = F.transform(geometry, lambda ring: F.transform(ring, point))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties"))
    polygons.select(F.to_json(feature).alias("value")).write.mode(mode).text(path)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder on any Hadoop file system; False if there was none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
