"""Incremental scanning of arriving documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType, TimestampType

from veilspark.plans.scan import scan_corpus


def arriving(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1_000) -> DataFrame:
    """Parquet files as they arrive; the schema is declared, never inferred."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def dedup_content(docs: DataFrame, path: str, checkpoint: str, ts: str = "arrived_at", order: str = "doc_id",
                  keep: str | None = None, interval: str | None = None) -> StreamingQuery:
    """Write the first sight of each content to ``path``, however late and out of order documents come.

    Hashes are merged with those already written, not with a state that a watermark clears, so an
    old arrival time makes no document late. In a batch the earliest row by (``ts``, ``order``) of a
    content is taken by a partial aggregate, so very many copies do not meet in one task. Each batch
    writes a folder of its own number; a repeated batch replaces it. With ``keep`` a content counts
    as new again when its last first sight was written longer ago than that, by the clock; without,
    never. Give only the columns that are wanted.
    """
    spark = docs.sparkSession
    hashed = docs if "file_hash" in docs.columns else docs.withColumn("file_hash", F.sha2(F.col("text").cast("binary"), 256))
    columns = hashed.columns

    def write(rows: DataFrame, batch: int) -> None:
        first = rows.groupBy("file_hash").agg(F.min_by(F.struct(*columns), F.struct(ts, order)).alias("r")).select("r.*")
        seen = first_sights(spark, path, hashed.schema).where(F.col("batch") < batch)
        if keep is not None:
            seen = seen.where(F.col("written_at") >= F.current_timestamp() - F.expr(f"INTERVAL {keep}"))
        fresh = first.join(seen.select("file_hash"), "file_hash", "left_anti").select(*columns, F.current_timestamp().alias("written_at"))
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return _by_batch(hashed, write, checkpoint, interval)


def first_sights(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What ``dedup_content`` has written so far."""
    return _written(spark, path, StructType([*schema.fields, StructField("written_at", TimestampType()), StructField("batch", IntegerType())]))


def scan_stream(docs: DataFrame) -> DataFrame:
    """The batch scan, unchanged; it is stateless, so no watermark is needed."""
    return scan_corpus(docs)


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append",
                 interval: str | None = None) -> StreamingQuery:
    """Start the job; without an interval it takes what is there and stops."""
    writer = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start(path)


def write_trend(scanned: DataFrame, path: str, checkpoint: str, ts: str = "arrived_at", width: str = "1 day",
                delay: str = "10 minutes", interval: str | None = None) -> StreamingQuery:
    """Documents per window and level, batch by batch; no document goes uncounted.

    A window closes when an earlier batch has seen a time of ``delay`` after its end. What comes for it
    later is counted as late, next to the closed figure and not in it. Each batch writes the groups it
    adds to a folder of its own number; a repeated batch replaces its folder, so nothing counts twice.
    The only thing a batch asks of those before it is the latest time they saw.
    """
    spark = scanned.sparkSession

    def write(rows: DataFrame, batch: int) -> None:
        seen = trend_updates(spark, path).where(F.col("batch") < batch).agg(F.max("latest")).head()[0]
        closed = F.lit(False) if seen is None else F.col("window_end") <= F.lit(seen) - F.expr(f"INTERVAL {delay}")
        groups = rows.select(F.window(ts, width).alias("w"), "threat_level", ts).select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "threat_level", ts)
        groups = groups.groupBy("window_start", "window_end", "threat_level").agg(F.count("*").alias("files"), F.max(ts).alias("latest"))
        groups.withColumn("late", closed).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return _by_batch(scanned, write, checkpoint, interval)


TREND = "window_start timestamp, window_end timestamp, threat_level string, files long, latest timestamp, late boolean, batch int"


def trend_updates(spark: SparkSession, path: str) -> DataFrame:
    """The groups of all batches so far."""
    return _written(spark, path, TREND)


def _by_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def _written(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Folders of batches; no rows before the first."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def threat_trend(updates: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Windows by level: documents in time, documents that came after the window had closed, and whether it has closed."""
    last = updates.agg(F.max("latest").alias("seen"))
    windows = updates.groupBy("window_start", "window_end", "threat_level").agg(
        F.sum(F.when(~F.col("late"), F.col("files")).otherwise(0)).alias("files"), F.sum(F.when(F.col("late"), F.col("files")).otherwise(0)).alias("late_files"))
    closed = F.col("window_end") <= F.col("seen") - F.expr(f"INTERVAL {delay}")
    return windows.join(F.broadcast(last)).select("window_start", "threat_level", "files", "late_files", closed.alias("closed"))
