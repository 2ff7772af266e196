"""Role views, dashboards and search over files and their spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.operators import views as v
from veilspark.operators.risk import contribution, level_of
from veilspark.plans import fixtures as fx
from veilspark.plans import oracles as o
from veilspark.plans.catalog.registry import query
from veilspark.sources.files import extension


def scored_files(spark, sf_dir):
    """Files with entity count, risk and level from their spans."""
    per_doc = fx.entities(spark, sf_dir).groupBy("doc_id").agg(
        F.count("*").alias("n"),
        F.round(F.sum(contribution(F.col("entity_type"), F.col("score"))), 2).cast("double").alias("r"))
    docs = fx.files(spark, sf_dir).join(per_doc, "doc_id", "left")
    score = F.coalesce("r", F.lit(0.0))
    return docs.select(
        "doc_id", "filename", extension(F.col("filename")).alias("file_type"), "uploaded_by", "uploaded_at", "status",
        F.coalesce("n", F.lit(0)).alias("entity_count"), score.alias("risk_score"), level_of(score).alias("threat_level"))


def records(spark, sf_dir):
    """Spans in the stored form; hashes stand in for ciphertext."""
    ent = fx.entities(spark, sf_dir)
    mark = F.concat_ws("|", F.col("doc_id").cast("string"), F.col("ord").cast("string"), F.col("start_pos").cast("string"))
    return ent.select(
        "doc_id", "entity_type", F.col("score").alias("confidence"), F.lit("[REDACTED]").alias("masked_value"),
        F.sha2(mark, 256).alias("encrypted_value"), F.left(F.sha2(mark, 256), F.lit(16)).alias("encryption_nonce"),
        F.right(F.sha2(mark, 256), F.lit(24)).alias("encryption_tag"), F.lit(None).cast("string").alias("fpe_value"),
        F.lit("AES-256-GCM").alias("encryption_method"), F.col("start_pos").alias("char_start"), F.col("end_pos").alias("char_end"))


SCORED = f"""{o.ENT_CTE}, {o.FILES_CTE}, rs AS (SELECT doc_id, count(*) AS n, {o.RISK} AS r FROM ent GROUP BY doc_id),
 docs AS (SELECT doc_id, filename, lower(regexp_extract(filename, '\\.[^.]+$')) AS file_type, uploaded_by, uploaded_at, status,
 coalesce(n, 0) AS entity_count, coalesce(r, 0) AS risk_score, {o.level('coalesce(r, 0)')} AS threat_level FROM files LEFT JOIN rs USING (doc_id))"""
_MARK = "sha256(concat_ws('|', doc_id, ord, start_pos))"
_RECORDS = f"""rec AS (SELECT doc_id, entity_type, score AS confidence, '[REDACTED]' AS masked_value, {_MARK} AS encrypted_value,
 left({_MARK}, 16) AS encryption_nonce, right({_MARK}, 24) AS encryption_tag, NULL::VARCHAR AS fpe_value, 'AES-256-GCM' AS encryption_method,
 start_pos AS char_start, end_pos AS char_end FROM ent)"""
_ADMIN = f"WITH {SCORED}, {_RECORDS} SELECT {', '.join(v.ADMIN_COLUMNS)} FROM docs JOIN rec USING (doc_id)"
_ANALYST = f"WITH {SCORED}, {_RECORDS} SELECT {', '.join(v.ANALYST_COLUMNS)} FROM docs JOIN rec USING (doc_id)"
_VIEWER_COLS = ", ".join(c if c != "uploaded_at" else "strftime(uploaded_at, '%Y-%m-%d') AS uploaded_at" for c in v.VIEWER_COLUMNS)


@query("admin_view", _ADMIN)
def admin_view(spark, sf_dir):
    return v.admin_view(scored_files(spark, sf_dir), records(spark, sf_dir))


@query("analyst_view", _ANALYST)
def analyst_view(spark, sf_dir):
    return v.analyst_view(scored_files(spark, sf_dir), records(spark, sf_dir))


def _day(df):
    return df.withColumn("uploaded_at", F.date_format("uploaded_at", "yyyy-MM-dd"))


@query("viewer_view", f"WITH {SCORED} SELECT {_VIEWER_COLS} FROM docs")
def viewer_view(spark, sf_dir):
    return _day(v.viewer_view(scored_files(spark, sf_dir)))


@query("role_projection", _ANALYST)
def role_projection(spark, sf_dir):
    return v.role_projection("analyst", scored_files(spark, sf_dir), records(spark, sf_dir))


@query("dash_totals", f"WITH {SCORED} SELECT threat_level, count(*) AS files, sum(entity_count) AS entities FROM docs GROUP BY 1")
def dash_totals(spark, sf_dir):
    return v.totals(scored_files(spark, sf_dir))


@query("dash_entity_distribution", f"WITH {o.ENT_CTE} SELECT entity_type, count(*) AS entities FROM ent GROUP BY 1")
def dash_entity_distribution(spark, sf_dir):
    return v.entity_distribution(fx.entities(spark, sf_dir))


@query("dash_threat_trend", f"WITH {SCORED} SELECT strftime(uploaded_at, '%Y-%m-%d') AS day, threat_level, count(*) AS files FROM docs GROUP BY 1, 2")
def dash_threat_trend(spark, sf_dir):
    return v.threat_trend(scored_files(spark, sf_dir))


@query("dash_user_stats", f"""WITH {SCORED} SELECT uploaded_by, count(*) AS files, sum(entity_count) AS entities,
 count(*) FILTER (threat_level = 'LOW') AS low, count(*) FILTER (threat_level = 'MEDIUM') AS medium,
 count(*) FILTER (threat_level = 'HIGH') AS high, count(*) FILTER (threat_level = 'CRITICAL') AS critical FROM docs GROUP BY 1""")
def dash_user_stats(spark, sf_dir):
    return v.user_stats(scored_files(spark, sf_dir))


@query("search_files", f"""WITH {o.ENT_CTE}, {o.FILES_CTE} SELECT doc_id, filename FROM files WHERE contains(lower(filename), '1.txt')
 AND uploaded_at >= TIMESTAMP '1996-01-01' AND uploaded_at < TIMESTAMP '1999-01-01'
 AND doc_id IN (SELECT doc_id FROM ent WHERE entity_type = 'IN_AADHAAR')""")
def search_files(spark, sf_dir):
    found = v.search_files(fx.files(spark, sf_dir), fx.entities(spark, sf_dir), "1.TXT",
                           "1996-01-01", "1999-01-01", "IN_AADHAAR")
    return found.select("doc_id", "filename")


@query("audit_viewer", """SELECT user_id AS chain_id, event_id AS seq, event_type AS action FROM events
 WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC, user_id LIMIT 100""")
def audit_viewer(spark, sf_dir):
    log = fx.load(spark, sf_dir, "events").select(
        F.col("user_id").alias("chain_id"), F.col("event_id").alias("seq"), F.col("ts").alias("timestamp"),
        F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("action"))
    return v.audit_viewer(log, action="error").select("chain_id", "seq", "action")
