"""End-to-end scans over tables of documents or messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark import config as C
from veilspark.operators.audit import scan_trail
from veilspark.operators.dumps import sanitize_dump
from veilspark.operators.gazetteer import place_recognizer
from veilspark.operators.patterns import Recognizer, register
from veilspark.operators.risk import report_json, score_docs, threat_report
from veilspark.operators.sanitize import dual_state, masked_text, records_of, scan_spans
from veilspark.operators.spans import explode_spans, no_spans
from veilspark.operators.tables import is_ascii_table, process_table
from veilspark.sources import sinks
from veilspark.sources.files import route_by_type, truncate_guard

#: Files whose text may be a drawn table, and what a scan says of a file's risk.
TABLE_FILES = [".txt", ".csv", ".sql"]
SCORES = ["entity_count", "risk_score", "threat_level"]


def scan_corpus(docs: DataFrame, text: str = "text", profile: str = "default", capped: bool = False,
                bank: list[Recognizer] | None = None, places: DataFrame | None = None) -> DataFrame:
    """Spans, masked text, count, risk and level next to each document.

    One narrow pass: nothing is shuffled, whatever the number of documents.
    ``capped`` applies the parity caps; by default whole texts are scanned.
    ``places(name)`` are names to find as LOCATION, in the same pass.
    """
    recognizer = None if places is None else place_recognizer(places)
    if recognizer is not None:
        bank = register(recognizer, bank)
    if capped:
        docs = docs.withColumn(text, truncate_guard(F.col(text)))
    scanned = scan_spans(docs, text, profile, bank)
    if profile != "default":
        redacted = F.filter(F.col("spans"), lambda s: s["entity_type"].isin(C.REDACT_TYPES))
        scanned = scanned.withColumn("spans", redacted)
    return score_docs(masked_text(scanned, text))


def scan_messages(messages: DataFrame, **options) -> DataFrame:
    """The same for chat turns; one row per message in, one row out."""
    return scan_corpus(messages, **options)


def path_of(text: str = "text") -> Column:
    """Which sanitiser a routed file goes to: its table lines, its INSERT literals, its text, or none."""
    drawn = F.col("file_type").isin(TABLE_FILES) & is_ascii_table(F.coalesce(F.col(text), F.lit("")))
    return F.when(F.col("route").isNull(), "rejected").when(drawn, "table").when(F.col("route") == "dump", "dump").otherwise("text")


def scan_files(files: DataFrame, text: str = "text") -> DataFrame:
    """Files of all kinds by one plan: each route has its own sanitiser and score bar, all give one schema.

    ``files`` holds ``doc_id, filename`` and the text. Text files keep their spans and masked text.
    Dumps are judged by a scan of their whole text; of their text only literals of INSERTs change.
    Drawn tables are rewritten cell by cell at the lower bar for tables, names included, and count
    as ``LOW`` without spans. Unsupported files come back with an error and no text.
    """
    routed = route_by_type(files.select("doc_id", "filename", F.col(text).alias("text"))).withColumn("path", path_of())
    own = {p: routed.where(F.col("path") == p) for p in ("text", "dump", "table", "rejected")}
    seen = ["doc_id", "filename", "file_type", "path", F.length("text").alias("text_length"), "spans"]
    texts = score_docs(dual_state(scan_spans(own["text"]))).select(*seen, "masked_text", *SCORES, "error_message")
    # A dump's literals and a table's cells travel without the rest of the row.
    dumps = score_docs(scan_spans(own["dump"])).select(*seen, *SCORES, "error_message").join(
        sanitize_dump(own["dump"].select("doc_id", "text")).withColumnRenamed("sanitized", "masked_text"), "doc_id")
    plain = [no_spans().alias("spans"), *(F.lit(v).alias(n) for n, v in zip(SCORES, (0, 0.0, "LOW"), strict=True))]
    tables = own["table"].select(*seen[:-1], *plain, "error_message").join(
        process_table(own["table"].select("doc_id", "text")).withColumnRenamed("sanitized", "masked_text"), "doc_id")
    refused = own["rejected"].select(*seen[:-1], *plain, F.lit(None).cast("string").alias("masked_text"), "error_message")
    return texts.unionByName(dumps).unionByName(tables).unionByName(refused)


def store_scan(docs: DataFrame, path: str, aes_key: str, fpe_key: str, fpe_tweak: str) -> dict[str, str]:
    """Scan files once, write everything that follows from the scan, and publish it in one step.

    ``docs`` holds ``doc_id, filename, text``. The scan is written first; records, reports and
    audit rows are derived from the written files, so the texts are read and searched a single
    time and nonces stay fixed. Readers use ``sinks.published`` and see all tables or none.
    """
    spark = docs.sparkSession
    scan = sinks.begin(path)
    scanned_path = f"{scan}/scanned"
    sinks.write_table(scan_files(docs), scanned_path, ["threat_level"])
    scanned = spark.read.parquet(scanned_path)
    accepted = scanned.where(F.col("path") != "rejected")
    entities = explode_spans(accepted, ["doc_id"]).withColumn("ord", F.col("start_pos"))
    report = threat_report(entities, accepted.select("doc_id", "filename", "text_length"))
    status = F.when(F.col("path") == "rejected", "failed").otherwise("completed")
    tables = {
        "documents": scanned.select("doc_id", "filename", "file_type", "path", "text_length", "entity_count",
                                    "risk_score", "threat_level", status.alias("status"), "error_message"),
        "sanitized": accepted.select("doc_id", "file_type", "masked_text"),
        "pii_records": records_of(accepted, aes_key, fpe_key, fpe_tweak),
        "threat_reports": report_json(report),
        "audit_logs": scan_trail(accepted),
    }
    written = {"scanned": scanned_path, **sinks.write_records(tables, scan)}
    sinks.publish(spark, path, written)
    return written


def scan_errors(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split routed files into accepted ones and a dead-letter table."""
    bad = F.col("error_message").isNotNull()
    rejected = files.where(bad).select("doc_id", "filename", F.lit("failed").alias("status"), "error_message")
    return files.where(~bad), rejected
