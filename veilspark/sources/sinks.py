"""Writers and the shared folder they use by default."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    A local folder is only made up on a local master, where driver and executors
    are one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="veilspark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_sanitized(docs: DataFrame, path: str) -> None:
    """Sanitised copies, one row per document, laid out by file type."""
    docs.write.mode("errorifexists").partitionBy("file_type").parquet(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_records(tables: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Write documents, sanitised texts, pii_records, threat_reports and audit rows as Parquet.

    ``pii_records`` is laid out by entity type; the others by nothing, since
    their readers look up documents.
    """
    layout = {"pii_records": ["entity_type"], "documents": ["threat_level"]}
    written = {}
    for name, df in tables.items():
        written[name] = f"{path}/{name}"
        write_table(df, written[name], layout.get(name))
    return written


# ---- publishing -------------------------------------------------------------

def begin(path: str) -> str:
    """A folder of its own for the tables of one scan."""
    return f"{path.rstrip('/')}/scans/{uuid.uuid4().hex}"


def publish(spark: SparkSession, path: str, written: dict[str, str]) -> None:
    """Show a finished scan to readers: its tables are named in one file, which Spark's commit makes visible as a whole.

    A write that ends before this leaves folders that no manifest names, so nobody reads them.
    """
    rows = [(uuid.uuid4().hex, name, folder) for name, folder in written.items()]
    manifest = spark.createDataFrame(rows, "scan string, table_name string, folder string").coalesce(1)
    manifest.write.mode("append").json(f"{path.rstrip('/')}/manifest")


def published(spark: SparkSession, path: str, table: str, schema: str | None = None) -> DataFrame:
    """A table of all published scans. The manifest has a few rows for each scan; the driver reads it as it reads a file listing."""
    from pyspark.errors import AnalysisException

    try:
        manifest = spark.read.schema("scan string, table_name string, folder string").json(f"{path.rstrip('/')}/manifest")
        folders = [r["folder"] for r in manifest.where(F.col("table_name") == table).collect()]
    except AnalysisException:
        folders = []
    if not folders:
        raise LookupError(f"no published scan has a table {table} in {path}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    parts = [reader.parquet(folder) for folder in folders]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a result once and go on from the files.

    Needed where rows must not be recomputed (random nonces) or a costly scan
    feeds several outputs; files survive the loss of an executor.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
