import pandas as pd

from rotorlake.streaming import progress


def test_counters_fill_as_the_sweep_runs(spark):
    status = spark.createDataFrame([(0, 5.0, True), (1, 7.0, False)], "k int, freq_hz double, converged boolean")
    out, seen = progress.observed(status)
    assert out.count() == 2 and seen.get == {"modes": 2, "min_hz": 5.0, "max_hz": 7.0, "converged": False}


def test_crossings_of_a_live_stream(spark, tmp_path):
    schema, folder = "track long, ts double, value double", tmp_path / "in"
    folder.mkdir()
    batches = [[(1, 0.0, 1.0), (1, 1.0, -1.0), (2, 0.0, 0.01)], [(1, 2.0, 0.02), (1, 3.0, 2.0), (2, 1.0, 5.0), (2, 2.0, -5.0)]]
    spark.conf.set("spark.sql.streaming.schemaInference", "false")
    stream = progress.live_crossings(spark.readStream.schema(schema).parquet(str(folder)), 0.1)
    query = stream.writeStream.format("memory").queryName("live").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for i, rows in enumerate(batches):
            pd.DataFrame(rows, columns=["track", "ts", "value"]).to_parquet(folder / f"{i}.parquet")
            query.processAllAvailable()
    finally:
        query.stop()
    found = spark.table("live").groupBy("track").max("crossings").collect()
    assert {r[0]: r[1] for r in found} == {1: 2, 2: 1}
