from pyspark.sql import functions as F

from waymark.operators import elevation, ingestion, temporal
from waymark.plans import binding
from waymark.streaming import labels


def test_stream_gives_the_batch_labels(spark, sf_dir, tmp_path):
    pts = ingestion.accepted(binding.raw_points(spark, sf_dir)).select("track_id", "gpx_index", "ele", "ele_absent", "time_absent", "time_ms")
    pts = pts.persist()
    for k, (lo, hi) in enumerate(((0, 20), (20, 45), (45, 10**6))):  # each batch goes on where the last one ended
        pts.filter((F.col("gpx_index") >= lo) & (F.col("gpx_index") < hi)).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    for k in range(3):
        spark.read.parquet(str(tmp_path / f"in{k}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "stream"))
    stream = spark.readStream.schema(pts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "stream"))
    query = labels.labels(stream).writeStream.format("memory").queryName("labels").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    want = elevation.labels(temporal.labels(ingestion.accepted(binding.raw_points(spark, sf_dir))))
    columns = [c.split()[0] for c in labels.OUT.split(", ")]
    assert sorted(map(tuple, spark.table("labels").select(columns).fillna(-1).collect())) == sorted(map(tuple, want.select(columns).fillna(-1).collect()))
