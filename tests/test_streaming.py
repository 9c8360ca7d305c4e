from pyspark.sql import functions as F

from spindlestat.operators import charts
from spindlestat.streaming import limits

DIR = "/root/testdata/sf0.001"


def run(df, spark, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def source(spark, tmp_path):
    batch = spark.read.parquet(f"{DIR}/events.parquet").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    batch.repartition(1).write.parquet(str(tmp_path / "in"))
    return batch, spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))


def test_frozen_limits_flag_as_in_batch(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    points = charts.imr_points(batch, "value", ["event_id"], ["event_type"])
    lines = charts.imr_limits(charts.moving_range(batch, "value", ["event_id"], ["event_type"]), "value", ["event_type"])
    got = run(limits.flagged(stream, lines, "value", ["event_type"]), spark, "flags")
    assert got.filter("reason IS NOT NULL").count() == points.filter("reason IS NOT NULL").count()


def test_moving_ranges_equal_batch(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    got = run(limits.moving_ranges(stream, "event_type", "event_id", "value"), spark, "ranges")
    want = charts.moving_range(batch, "value", ["event_id"], ["event_type"])
    pairs = lambda d: sorted((r.event_id, None if r.mr is None or r.mr != r.mr else round(r.mr, 9)) for r in d.collect())
    assert pairs(got) == pairs(want)


def test_window_counts(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    got = run(limits.window_counts(stream, "ts", "event_type = 'error'"), spark, "windows", "complete")
    assert got.agg(F.sum("n")).first()[0] == batch.count()
