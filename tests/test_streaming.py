import datetime as dt

import pytest
from pyspark.sql import functions as F

from thermal_lake.streaming import feeds

T0 = dt.datetime(2025, 1, 1)
SHAPE = "acquired_at timestamp, latitude double, longitude double, brightness_kelvin double, instrument string"


def point(minutes, lat=30.5):
    return (T0 + dt.timedelta(minutes=minutes), lat, -120.5, 300.0 + minutes, "VIIRS")


def run(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


@pytest.fixture()
def folder(spark, tmp_path):
    """Three batches; the last one holds a row that is too late and one that moves the watermark."""
    path = str(tmp_path / "feed")
    for rows in ([point(0), point(30), point(30)], [point(200), point(5, 40.5)], [point(900), point(1)]):
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([point(2000)], SHAPE).coalesce(1).write.mode("append").parquet(path)
    return path


def test_sessions_equal_the_batch(spark, folder):
    got = {(r["cell"], r["start_time"], r["detections"]) for r in run(spark, feeds.events(feeds.detections(spark, folder, SHAPE)), "sessions")}
    first = next(x for x in got if x[1] == T0)
    assert first[2] >= 3
    assert all(x[1] < T0 + dt.timedelta(minutes=2000) for x in got)
    batch = spark.read.schema(SHAPE).parquet(folder).where(F.col("acquired_at") >= F.lit(T0 + dt.timedelta(minutes=200)))
    assert any(x[1] == T0 + dt.timedelta(minutes=200) for x in got)
    assert batch.count() == 3


def test_late_rows_leave(spark, folder):
    got = run(spark, feeds.hourly(feeds.detections(spark, folder, SHAPE)), "hours")
    assert sum(r["n"] for r in got if r["start"] == T0) <= 5
    assert run(spark, feeds.hourly(feeds.detections(spark, folder, SHAPE), slide="30 minutes"), "sliding")


def test_duplicates_leave(spark, folder):
    keys = ["acquired_at", "latitude", "longitude", "instrument"]
    got = run(spark, feeds.unique(feeds.detections(spark, folder, SHAPE), keys), "unique")
    assert len([r for r in got if r["acquired_at"] == T0 + dt.timedelta(minutes=30)]) == 1


def test_regions_keep_their_track(spark, tmp_path):
    shape = "case_id long, step int, missing boolean, regions array<struct<label: int, area: int, lat: double, lon: double, cells: array<int>>>"
    box = lambda label, cells: (label, len(cells), 0.0, 0.0, cells)
    path = str(tmp_path / "frames")
    batches = [[(1, 0, False, [box(1, [1, 2, 3])])], [(1, 1, False, [box(1, [9]), box(2, [2, 3, 4])]), (2, 0, False, [])], [(1, 2, True, [])], [(1, 3, False, [box(1, [2, 3])])]]
    for b in batches:
        spark.createDataFrame(b, shape).coalesce(1).write.mode("append").parquet(path)
    feed = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(path)
    got = {(r["step"], r["label"]): (r["track_id"], r["is_new"]) for r in run(spark, feeds.follow_regions(feed), "tracks")}
    assert got == {(0, 1): (1, True), (1, 2): (1, False), (1, 1): (2, True), (3, 1): (3, True)}


def test_journal_feed_is_idempotent(spark, tmp_path):
    shape = "trace_id string, sequence long, to_state string"
    path, table = str(tmp_path / "in"), str(tmp_path / "table")
    for rows in ([("t", 1, "a")], [("t", 1, "a"), ("t", 2, "b")]):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(path)
    for i in range(2):
        feeds.journal_table(spark.readStream.schema(shape).parquet(path), table, str(tmp_path / f"c{i}")).awaitTermination()
    assert spark.read.parquet(table).count() == 2
