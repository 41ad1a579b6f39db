from tidemark.streaming import incremental


def test_activity_stream_matches_batch(spark, tmp_path):
    rows = [(u, f"2024-01-0{d} 0{h}:00:00", t) for u in (1, 2) for d in (1, 2, 9) for h, t in ((1, "view"), (2, "click"))]
    spark.createDataFrame(rows, "user_id long, ts string, event_type string").selectExpr("user_id", "cast(ts as timestamp) ts", "event_type").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    incremental.run_available(incremental.activity_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r["user_id"], r["starts"].day, tuple(r["requires"]), r["n"]) for r in got} == {(u, d, ("click", "view"), 2) for u in (1, 2) for d in (1, 2)}


def test_inventory_stream(spark, tmp_path):
    spark.createDataFrame([("r", "Makefile", "build: x\n", 1)], "repo string, rel string, text string, walk_ord int").write.parquet(str(tmp_path / "files"))
    incremental.inventory_stream(spark, str(tmp_path / "files"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["make-build"]
