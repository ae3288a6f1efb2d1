"""Run events out of order: the stream ends with what a batch finds, stalled runs are told, forgotten ones leave."""

from pyspark.sql import functions as F

from sitequarry.streaming import jobs, progress

AT = "2026-01-01 {:02d}:{:02d}:00"


def test_run_progress(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    progress.use_state_store(spark)
    try:
        files = [
            [("a", AT.format(10, 5), 5, 10, "running"), ("b", AT.format(10, 0), 1, 4, "running"), ("a", AT.format(10, 1), 1, 10, "running")],
            [("a", AT.format(10, 3), 3, 10, "running"), ("b", AT.format(10, 0), 1, 4, "running"), (None, AT.format(10, 2), None, None, None)],
            [("a", AT.format(10, 9), 10, 10, "completed"), ("a", AT.format(10, 9), 9, 10, "running"), ("c", AT.format(12, 30), 0, 1, "running")],
            [("d", AT.format(12, 31), 0, 1, "running"), ("b", AT.format(9, 0), 9, 9, "too late")],
            [("e", AT.format(23, 0), 0, 1, "running")],
        ]
        for i, rows in enumerate(files):
            df = spark.createDataFrame(rows, "run string, ts string, done long, total long, status string").withColumn("ts", F.col("ts").cast("timestamp"))
            df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{i}"))
        stream = spark.readStream.schema(jobs.EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        out = progress.run_progress(stream, "1 hour", 600, 3 * 3600)
        q = out.writeStream.format("memory").queryName("progress").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        rows = spark.table("progress").collect()
        last = {}
        for r in rows:
            if r["kind"] == "event" and (r["run"] not in last or (r["ts"], r["done"] or 0) > (last[r["run"]]["ts"], last[r["run"]]["done"] or 0)):
                last[r["run"]] = r
        batch = jobs.latest_event(spark.read.schema(jobs.EVENT).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")).filter("status is null or status <> 'too late'"))
        want = {r["run"]: r["ts"] for r in batch.collect()}
        assert {k: r["ts"] for k, r in last.items()} == want
        assert last["a"]["status"] == "completed" and last["a"]["done"] == 10
        stalled = {r["run"] for r in rows if r["kind"] == "stalled"}
        assert "b" in stalled and "c" in stalled and "a" not in stalled and "e" not in stalled
        state = q.lastProgress["stateOperators"][0] if q.lastProgress else None
        assert state is None or state["numRowsTotal"] < 40
    finally:
        spark.conf.set(provider, before)
