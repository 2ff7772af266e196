"""Role-limited views, dashboards and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark import config as C

ADMIN_COLUMNS = [
    "doc_id", "filename", "threat_level", "entity_type", "confidence", "masked_value",
    "encrypted_value", "encryption_nonce", "encryption_tag", "fpe_value",
    "encryption_method", "char_start", "char_end",
]
ANALYST_COLUMNS = [
    "doc_id", "filename", "threat_level", "entity_type", "confidence", "masked_value",
    "char_start", "char_end",
]
VIEWER_COLUMNS = [
    "doc_id", "filename", "file_type", "uploaded_at", "threat_level", "risk_score", "status",
]


def admin_view(docs: DataFrame, records: DataFrame) -> DataFrame:
    return docs.select("doc_id", "filename", "threat_level").join(records, "doc_id").select(ADMIN_COLUMNS)


def analyst_view(docs: DataFrame, records: DataFrame) -> DataFrame:
    """No ciphertext column is read: the projection reaches the scan."""
    return docs.select("doc_id", "filename", "threat_level").join(records, "doc_id").select(ANALYST_COLUMNS)


def viewer_view(docs: DataFrame) -> DataFrame:
    return docs.select(VIEWER_COLUMNS)


def role_projection(role: str, docs: DataFrame, records: DataFrame) -> DataFrame:
    """The view a role may see; unknown roles are refused."""
    if role == "admin":
        return admin_view(docs, records)
    if role == "analyst":
        return analyst_view(docs, records)
    if role == "viewer":
        return viewer_view(docs)
    raise ValueError(f"unknown role: {role}")


# ---- dashboards -------------------------------------------------------------

def totals(docs: DataFrame) -> DataFrame:
    """Files and entities per threat level."""
    return docs.groupBy("threat_level").agg(
        F.count("*").alias("files"), F.sum("entity_count").alias("entities"))


def entity_distribution(entities: DataFrame) -> DataFrame:
    return entities.groupBy("entity_type").agg(F.count("*").alias("entities"))


def threat_trend(docs: DataFrame, ts: str = "uploaded_at") -> DataFrame:
    """Files per day and level."""
    return docs.groupBy(F.window(ts, "1 day").alias("w"), "threat_level").agg(
        F.count("*").alias("files")
    ).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "threat_level", "files")


def user_stats(docs: DataFrame) -> DataFrame:
    """Files, entities and files per level of each uploader.

    Conditional counts instead of a pivot: one aggregate, one shuffle.
    """
    levels = [name for name, _ in C.LEVEL_BOUNDS] + [C.TOP_LEVEL]
    per_level = [F.count_if(F.col("threat_level") == lv).alias(lv.lower()) for lv in levels]
    return docs.groupBy("uploaded_by").agg(
        F.count("*").alias("files"), F.sum("entity_count").alias("entities"), *per_level)


def search_files(docs: DataFrame, entities: DataFrame | None = None, name: str | None = None,
                 since: str | None = None, until: str | None = None,
                 entity_type: str | None = None) -> DataFrame:
    """Files by name part, upload range and contained entity type."""
    if name is not None:
        docs = docs.where(F.contains(F.lower("filename"), F.lit(name.lower())))
    if since is not None:
        docs = docs.where(F.col("uploaded_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        docs = docs.where(F.col("uploaded_at") < F.lit(until).cast("timestamp"))
    if entity_type is not None:
        if entities is None:
            raise ValueError("searching by entity type needs the entity table")
        holding = entities.where(F.col("entity_type") == entity_type).select("doc_id")
        docs = docs.join(holding, "doc_id", "left_semi")
    return docs


def audit_viewer(log: DataFrame, user: str | None = None, action: str | None = None,
                 since: Column | None = None, limit: int = 100) -> DataFrame:
    """Newest audit rows first; sort and limit become a per-task top-k."""
    if user is not None:
        log = log.where(F.col("user") == user)
    if action is not None:
        log = log.where(F.col("action") == action)
    if since is not None:
        log = log.where(F.col("timestamp") >= since)
    return log.orderBy(F.desc("timestamp"), F.desc("seq"), F.asc("chain_id")).limit(limit)


# ---- lifecycle --------------------------------------------------------------

def latest_status(docs: DataFrame, log: DataFrame, key: str = "doc_id") -> DataFrame:
    """Current state per document; documents without a log row are processing.

    ``max_by`` keeps one row per document and task before the shuffle.
    """
    newest = log.groupBy(key).agg(F.max_by("status", F.struct("ts", "ord")).alias("_status"))
    return docs.select(key).join(newest, key, "left").select(
        key, F.coalesce("_status", F.lit("processing")).alias("status"))


STUCK_MESSAGE = "Scan was interrupted; upload the file again"


def reset_stuck(docs: DataFrame) -> DataFrame:
    """Documents left in processing become failed, with a message."""
    stuck = F.col("status") == "processing"
    return docs.withColumn("error_message", F.when(stuck, F.lit(STUCK_MESSAGE))).withColumn(
        "status", F.when(stuck, F.lit("failed")).otherwise(F.col("status")))


def stuck_count(docs: DataFrame) -> DataFrame:
    """How many documents a reset changes."""
    return docs.agg(F.count_if(F.col("status") == "processing").alias("reset"))
