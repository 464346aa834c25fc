from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from rasterweave.session import broadcast_if_small, cut_lineage, shared_folder


def fake(master, named=None, current=None):
    sc = SimpleNamespace(master=master, getCheckpointDir=lambda: sc.now, getConf=lambda: {"spark.checkpoint.dir": named} if named else {})
    sc.now = current
    sc.setCheckpointDir = lambda d: setattr(sc, "now", d)
    return SimpleNamespace(sparkContext=sc)


def test_a_cluster_has_to_name_its_shared_folder():
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            shared_folder(fake(master))
        assert shared_folder(fake(master, "/shared")) == "/shared"
    assert shared_folder(fake("yarn", current="/set")) == "/set"
    assert shared_folder(fake("local[4]")) and shared_folder(fake("local"))


def test_lineage_is_cut_and_rows_types_and_odd_columns_stay(spark):
    df = spark.range(5).select("id", F.lit(None).cast("int").alias("none"), F.array(F.struct(F.lit(1).alias("a b"))).alias("odd name"), F.expr("timestamp_ntz'2020-01-01 00:00:00'").alias("ts"))
    out = cut_lineage(df)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect())) and [t for _, t in out.dtypes] == [t for _, t in df.dtypes]
    assert "Range" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert cut_lineage(df.limit(0)).collect() == []
    for other in (df.withColumn("v", F.lit(None)), df.select("id", F.col("id").alias("ID")), df.withColumn("i", F.make_interval())):
        assert cut_lineage(other).count() == 5


def test_only_a_count_makes_a_broadcast(spark):
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in plan(broadcast_if_small(spark.range(10), 10)) and "ResolvedHint" not in plan(broadcast_if_small(spark.range(11), 10))
