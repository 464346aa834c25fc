"""Session set-up and the few cluster facts the operators need."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, CalendarIntervalType, DataType, MapType, NullType, StructType


#: Bytes of code up to which the JVM compiles a method. Wide projections (24 channels) exceed it as one fused method and
#: would be interpreted; told of the limit, Spark splits them instead (3.3 s became 0.27 s for final_bands at sf0.1).
JIT_LIMIT = 8000


def local_session(cores: int | None = None, app: str = "rasterweave", **conf: str) -> SparkSession:
    """A local session for tests and benches; clusters bring their own session."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("RW_DRIVER_MEMORY", "8g"))
        .config("spark.sql.codegen.hugeMethodLimit", str(JIT_LIMIT))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. A temporary one is made only for a local master; a cluster has to name its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="rasterweave-"))
    return sc.getCheckpointDir()


def _storable(kind: DataType) -> bool:
    """False if Parquet cannot hold a type."""
    if isinstance(kind, StructType):
        return all(_storable(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _storable(kind.elementType)
    if isinstance(kind, MapType):
        return _storable(kind.keyType) and _storable(kind.valueType)
    return not isinstance(kind, NullType | CalendarIntervalType)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder, as Parquet, and go on from there.

    Any executor can be lost afterwards. Reading back gives Spark the true sizes, where a checkpointed plan would keep the
    product of all join sizes before it, a number that doubles its digits with each round of an iteration.
    """
    folder = shared_folder(df.sparkSession)
    if len(set(map(str.lower, df.columns))) < len(df.columns) or not _storable(df.schema):
        return df.checkpoint(eager=True)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark df for broadcast if a count proves that it has max_rows rows at most; df itself otherwise."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def prepare(spark: SparkSession) -> None:
    """What a session needs before the operators run on it: the package on the executors and the JIT limit."""
    ship_package(spark)
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(JIT_LIMIT))


def ship_package(spark: SparkSession) -> None:
    """Let the Python workers of all executors import this package, as --py-files would; once per session."""
    sc = spark.sparkContext
    if getattr(sc, "_rasterweave_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="rasterweave-"), "rasterweave-src.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(archive))
    sc._rasterweave_shipped = True
