from rasterweave.streaming.sustained import stream_hits, sustained_stream


def test_a_run_that_spans_batches_is_found_once(spark, tmp_path):
    schema = "i int, j int, t int, x array<double>"
    seen = [(0, 0, t, [v]) for t, v in enumerate([9.0, 9.0, 9.0, 9.0, 0.0, 9.0])] + [(0, 1, t, [v]) for t, v in enumerate([9.0, 0.0, 9.0, None, 9.0, 9.0])]
    src = tmp_path / "in"
    for t in range(6):
        spark.createDataFrame([r for r in seen if r[2] == t], schema).coalesce(1).write.mode("append").parquet(str(src))
    partition = spark.createDataFrame([(0, 1, 0, 0), (0, 1, 0, 1)], "grid int, cluster_id long, i int, j int")
    centroids = spark.createDataFrame([(0, 1, [1.0])], "grid int, cluster_id long, x array<double>")
    limits = spark.createDataFrame([(0, 1, [2.0])], "grid int, cluster_id long, thr array<double>")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = sustained_stream(stream_hits(stream, partition, centroids, limits)).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["i"], r["j"]) for r in spark.table("found").collect()] == [(0, 0)]
