"""Streams over several batches that come out of order."""

import datetime as dt
import os

from pyspark.sql import functions as F

from veilspark.sources.sinks import new_path
from veilspark.streaming import scan_stream as st

START = dt.datetime(2024, 1, 1)


def files_in_order(spark, batches, schema):
    """One file for each batch, its time of change telling the order."""
    path = new_path(spark, "arrivals")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path):
            full = f"{path}/{name}"
            if os.stat(full).st_mtime > 1_000_000:
                os.utime(full, (1000 + k, 1000 + k))
    return path


def test_late_first_sights_are_kept(spark):
    hours = [range(150, 200), range(0, 50), range(100, 150), range(50, 100)]
    rows = [[(h, START + dt.timedelta(hours=h), f"text {h % 190}") for h in some] for some in hours]
    schema = "doc_id long, arrived_at timestamp, text string"
    path, out = files_in_order(spark, rows, schema), new_path(spark, "dedup")
    stream = st.arriving(spark, path, schema, files_per_trigger=1)
    st.dedup_content(stream, out, new_path(spark, "checkpoint")).awaitTermination()
    got = [(r["doc_id"], r["text"]) for r in spark.read.parquet(out).collect()]
    # 190 to 199 came first and share their texts with 0 to 9
    assert sorted(got) == sorted((h, f"text {h % 190}") for h in range(10, 200))


def test_every_document_is_counted_once(spark):
    days = [[0, 1, 2], [9, 10], [1, 2, 10], [12], [0, 12, 30]]
    rows = [[(START + dt.timedelta(days=d, minutes=m), "LOW") for d in some for m in range(3)] for some in days]
    schema = "arrived_at timestamp, threat_level string"
    path, out = files_in_order(spark, rows, schema), new_path(spark, "trend")
    checkpoint = new_path(spark, "checkpoint")
    scanned = st.arriving(spark, path, schema, files_per_trigger=1)
    st.write_trend(scanned, out, checkpoint, delay="1 day").awaitTermination()
    trend = {(r["window_start"] - START).days: (r["files"], r["late_files"], r["closed"]) for r in st.threat_trend(st.trend_updates(spark, out), "1 day").collect()}
    assert trend == {0: (3, 3, True), 1: (3, 3, True), 2: (3, 3, True), 9: (3, 0, True), 10: (6, 0, True), 12: (6, 0, True), 30: (3, 0, False)}
    # a batch that is run again replaces what it wrote
    again = st.trend_updates(spark, out).where("batch = 2").drop("batch").collect()
    spark.createDataFrame(again, st.trend_updates(spark, out).drop("batch").schema).write.mode("overwrite").parquet(f"{out}/batch=2")
    assert st.threat_trend(st.trend_updates(spark, out), "1 day").agg(F.sum(F.col("files") + F.col("late_files"))).head()[0] == sum(map(len, rows))


def test_a_content_is_forgotten_after_its_time(spark):
    schema = "doc_id long, arrived_at timestamp, file_hash string"
    path = files_in_order(spark, [[(1, START, "a")]], schema)
    out, checkpoint = new_path(spark, "dedup"), new_path(spark, "checkpoint")

    def run():
        st.dedup_content(st.arriving(spark, path, schema), out, checkpoint, keep="1 millisecond").awaitTermination()

    run()
    for k in (2, 3):
        spark.createDataFrame([(k, START, "ab"[k % 2 == 0])], schema).write.mode("append").parquet(path)
        run()
    assert sorted(r["doc_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]
