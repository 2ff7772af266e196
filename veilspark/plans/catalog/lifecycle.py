"""Whole scans, status handling and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.operators import views as v
from veilspark.plans import fixtures as fx
from veilspark.plans import oracles as o
from veilspark.plans.catalog.registry import query
from veilspark.plans.catalog.sources import ROUTED
from veilspark.plans.scan import scan_corpus as run_scan
from veilspark.plans.scan import scan_errors as split_errors
from veilspark.plans.scan import scan_messages as run_messages
from veilspark.sources import sinks
from veilspark.sources.files import route_by_type
from veilspark.streaming import scan_stream as st

SCANNED = ["doc_id", "masked_text", "entity_count", "risk_score", "threat_level"]


def _scan_sql(src: str, keys: str = "doc_id") -> str:
    return f"""{o.scan(src, o.DOC_TYPES, scan_of=o.DOC_SCAN)}, r AS (SELECT doc_id, count(*) AS n, {o.RISK} AS risk FROM fin GROUP BY doc_id),
 m AS ({o.stitched(src, 'fin', o.MASK, 'masked_text')}),
 res AS (SELECT doc_id, masked_text, coalesce(n, 0) AS entity_count, coalesce(risk, 0) AS risk_score,
 {o.level('coalesce(risk, 0)')} AS threat_level FROM m LEFT JOIN r USING (doc_id))"""


@query("scan_corpus", f"WITH {_scan_sql('documents')} SELECT * FROM res")
def scan_corpus(spark, sf_dir):
    return run_scan(fx.documents(spark, sf_dir)).select(SCANNED)


_SENT = f"concat(text, ' sent to ', n_name, CASE WHEN doc_id % 3 = 0 THEN ', the {o.LONG_PLACE}' ELSE ' EASTWARD MIDDLE EASTERN MIDDLE EAST' END)"
_SENT_CTE = f"{o.KYC_CTE}, sent AS (SELECT doc_id, {_SENT} AS text FROM kyc)"
_PLACES_SQL = _scan_sql("sent").replace(o.scan("sent", o.DOC_TYPES, scan_of=o.DOC_SCAN), o.scan("sent", [*o.DEFAULT, "LOCATION"]))


@query("scan_corpus_places", f"WITH {_SENT_CTE}, {_PLACES_SQL} SELECT * FROM res")
def scan_corpus_places(spark, sf_dir):
    """A scan that looks for all types, places by their names in the same pass."""
    names = [fx.load(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), fx.load(spark, sf_dir, "region").select(F.col("r_name").alias("name"))]
    places = names[0].union(names[1]).union(spark.range(1).select(F.lit(o.LONG_PLACE).alias("name")))
    return run_scan(fx.kyc(spark, sf_dir).select("doc_id", F.expr(_SENT).alias("text")), places=places).select(SCANNED)


_CHAT = """chat AS (SELECT conv_id * 1000 + turn AS doc_id,
 concat(text, ' write to user', conv_id, '@mail.example.com or call +1 (555) 010-', lpad(CAST(turn AS VARCHAR), 4, '0')) AS text FROM conversations)"""


@query("scan_messages", f"WITH {_CHAT}, {_scan_sql('chat')} SELECT * FROM res")
def scan_messages(spark, sf_dir):
    """Chat turns, each with an address and a number appended."""
    chat = fx.load(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"),
        F.concat("text", F.lit(" write to user"), F.col("conv_id").cast("string"),
                 F.lit("@mail.example.com or call +1 (555) 010-"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("text"))
    return run_messages(chat).select(SCANNED)


_LINKAGE = f"""found AS MATERIALIZED ({o.spans('kyc', o.EVERY)}), l2 AS MATERIALIZED ({o.linked('found')['phone']}),
 l3 AS MATERIALIZED ({o.linked('l2')['aadhaar']}), l6 AS MATERIALIZED ({o.linked('l3')['profile']}), kept AS ({o.ruled('l6')}),
 allfin AS ({o.resolved('kept')}), fin AS (SELECT * FROM allfin WHERE entity_type <> 'PERSON')"""


@query("scan_corpus_linkage", f"""WITH {o.KYC_CTE}, {_LINKAGE}, r AS (SELECT doc_id, count(*) AS n, {o.RISK} AS risk FROM fin GROUP BY doc_id),
 m AS ({o.stitched('kyc', 'fin', o.MASK, 'masked_text')}) SELECT doc_id, masked_text, coalesce(n, 0) AS entity_count,
 coalesce(risk, 0) AS risk_score, {o.level('coalesce(risk, 0)')} AS threat_level FROM m LEFT JOIN r USING (doc_id)""")
def scan_corpus_linkage(spark, sf_dir):
    """Names take part as anchors of the linkage rules; they are not redacted."""
    return run_scan(fx.kyc(spark, sf_dir), profile="linkage").select(SCANNED)


_LOG = "log AS (SELECT user_id * 7 AS doc_id, ts, event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'processing' ELSE 'completed' END AS status FROM events)"


@query("latest_status", f"""WITH {o.FILES_CTE}, {_LOG}, l AS (SELECT doc_id, arg_max(status, event_id) AS status FROM log GROUP BY 1)
 SELECT f.doc_id, coalesce(l.status, 'processing') AS status FROM files f LEFT JOIN l USING (doc_id)""")
def latest_status(spark, sf_dir):
    """Events as a status log of every seventh document."""
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "processing")
    log = fx.load(spark, sf_dir, "events").select(
        (F.col("user_id") * 7).alias("doc_id"), "ts", F.col("event_id").alias("ord"),
        kind.otherwise("completed").alias("status"))
    return v.latest_status(fx.files(spark, sf_dir), log)


@query("reset_stuck", f"""WITH {o.FILES_CTE} SELECT doc_id, CASE status WHEN 'processing' THEN 'failed' ELSE status END AS status,
 CASE status WHEN 'processing' THEN '{v.STUCK_MESSAGE}' END AS error_message FROM files""")
def reset_stuck(spark, sf_dir):
    return v.reset_stuck(fx.files(spark, sf_dir)).select("doc_id", "status", "error_message")


@query("reset_stuck_count", f"WITH {o.FILES_CTE} SELECT count(*) FILTER (status = 'processing') AS reset FROM files")
def reset_stuck_count(spark, sf_dir):
    return v.stuck_count(fx.files(spark, sf_dir))


@query("scan_errors", f"""WITH {ROUTED} SELECT doc_id, filename, 'failed' AS status, error_message FROM routed WHERE error_message IS NOT NULL""")
def scan_errors(spark, sf_dir):
    return split_errors(route_by_type(fx.files(spark, sf_dir).select("doc_id", "filename")))[1]


def _arrivals(spark, sf_dir):
    """Documents written out with an arrival time, an hour apart, as a stream source of four batches.

    Documents are dealt to files by their hash, so batches come out of order over the whole span of time.
    A batch has at least a file for each core, as a file of one row group is read by one task.
    """
    path, per_batch = sinks.new_path(spark, "arrivals"), max(2, spark.sparkContext.defaultParallelism)
    when = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 3600)
    fx.documents(spark, sf_dir).withColumn("arrived_at", when).repartition(4 * per_batch, F.xxhash64("doc_id")).write.parquet(path)
    return st.arriving(spark, path, "doc_id long, text string, arrived_at timestamp", files_per_trigger=per_batch)


def _drain(spark, stream, name: str, schema: str):
    """Run a stream over what has arrived and read its output."""
    path = sinks.new_path(spark, name)
    st.write_stream(stream, path, sinks.new_path(spark, f"{name}-checkpoint")).awaitTermination()
    return spark.read.schema(schema).parquet(path)


@query("scan_stream", f"WITH {_scan_sql('documents')} SELECT * FROM res")
def scan_stream(spark, sf_dir):
    stream = st.scan_stream(_arrivals(spark, sf_dir)).select(SCANNED)
    return _drain(spark, stream, "stream", "doc_id long, masked_text string, entity_count int, risk_score double, threat_level string")


@query("stream_dedup", "SELECT DISTINCT sha256(text) AS file_hash FROM documents")
def stream_dedup(spark, sf_dir):
    """Each content once, in several batches that come out of order."""
    hashed = _arrivals(spark, sf_dir).select("doc_id", "arrived_at", F.sha2("text", 256).alias("file_hash"))
    path = sinks.new_path(spark, "dedup")
    st.dedup_content(hashed, path, sinks.new_path(spark, "dedup-checkpoint")).awaitTermination()
    return st.first_sights(spark, path, hashed.schema).select("file_hash")


@query("stream_threat_trend", f"""WITH {_scan_sql('documents')} SELECT (1700000000 + doc_id * 3600) // 86400 * 86400 AS window_start, threat_level, count(*) AS files FROM res GROUP BY ALL""")
def stream_threat_trend(spark, sf_dir):
    """Documents by day and level, in several batches out of order; those in time and those that came late together."""
    scanned = st.scan_stream(_arrivals(spark, sf_dir)).select("arrived_at", "threat_level")
    path = sinks.new_path(spark, "trend")
    st.write_trend(scanned, path, sinks.new_path(spark, "trend-checkpoint"), delay="1 day").awaitTermination()
    trend = st.threat_trend(st.trend_updates(spark, path), "1 day")
    return trend.select(F.col("window_start").cast("long").alias("window_start"), "threat_level", (F.col("files") + F.col("late_files")).alias("files"))
