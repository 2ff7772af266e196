"""Audit chains over events, one per user."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark import config as C
from veilspark.operators import audit as a
from veilspark.plans import fixtures as fx
from veilspark.plans import oracles as o
from veilspark.plans.catalog.registry import query
from veilspark.sources import sinks

_LANE = f"concat(strftime(ts, '%Y-%m-%d'), '/', event_id % {C.AUDIT_LANES})"
_CHAIN = f"""chain AS (SELECT * FROM (WITH RECURSIVE e AS (SELECT user_id AS chain_id, {_LANE} AS lane, event_id, event_type,
 row_number() OVER (PARTITION BY user_id, {_LANE} ORDER BY ts, event_id) - 1 AS seq FROM events),
 c AS (SELECT chain_id, lane, seq, event_id, event_type, repeat('0', 64) AS prev_hash,
  sha256(concat_ws('|', event_id, chain_id, event_type, 'd', repeat('0', 64))) AS entry_hash FROM e WHERE seq = 0
  UNION ALL SELECT e.chain_id, e.lane, e.seq, e.event_id, e.event_type, c.entry_hash,
  sha256(concat_ws('|', e.event_id, e.chain_id, e.event_type, 'd', c.entry_hash))
  FROM c JOIN e ON e.chain_id = c.chain_id AND e.lane = c.lane AND e.seq = c.seq + 1)
 SELECT * FROM c))"""
_TAMPERED = "t AS (SELECT * REPLACE (CASE WHEN event_id % 997 = 0 THEN 'X' ELSE event_type END AS event_type) FROM chain)"
# What is left after the last entry of every eleventh user's lanes was cut off, too.
_CUT = """u AS (SELECT * FROM t WHERE NOT (chain_id % 11 = 3 AND seq = (SELECT max(seq) FROM chain x WHERE x.chain_id = t.chain_id AND x.lane = t.lane)))"""
_BAD = """bad AS (SELECT chain_id, lane, seq, 'hash' AS failure FROM u WHERE event_id % 997 = 0
 UNION ALL SELECT chain_id, lane, max(seq), 'anchor' FROM chain WHERE chain_id % 11 = 3 GROUP BY 1, 2)"""


def _chain(spark, sf_dir):
    return a.append(fx.audit_log(spark, sf_dir))


def _damaged(spark, sf_dir):
    """The chain, stored once, with some actions changed and some lanes cut short, and its anchors."""
    chain = sinks.settle(_chain(spark, sf_dir).drop("ord"), "audit-chain")
    cut = F.coalesce(F.col("chain_id") % 11 == 3, F.lit(False))
    last = a.tails(chain.where(cut)).select("chain_id", "lane", (F.col("entries") - 1).alias("seq"))
    changed = F.col("timestamp").cast("long") % 997 == 0
    edited = chain.withColumn("action", F.when(changed, F.lit("X")).otherwise(F.col("action")))
    left = edited.where(~cut).unionByName(edited.where(cut).join(last, ["chain_id", "lane", "seq"], "left_anti"))
    return left, a.anchors(chain)


@query("audit_hash", """SELECT event_id, sha256(concat_ws('|', event_id, user_id, event_type, 'd', repeat('0', 64))) AS entry_hash FROM events""")
def audit_hash(spark, sf_dir):
    log = fx.audit_log(spark, sf_dir)
    digest = a.entry_hash(F.col("timestamp"), F.col("user"), F.col("action"), F.col("details"), F.lit("0" * 64))
    return log.select(F.col("timestamp").cast("long").alias("event_id"), digest.alias("entry_hash"))


@query("audit_append", f"WITH {_CHAIN} SELECT chain_id, lane, seq, event_id, event_type AS action, prev_hash, entry_hash FROM chain")
def audit_append(spark, sf_dir):
    """Chains of all events; those of each morning are continued in the afternoon."""
    log = fx.audit_log(spark, sf_dir)
    early = a.append(log.where(F.hour("ord.ts") < 12))
    chain = early.unionByName(a.append(log.where(F.hour("ord.ts") >= 12), a.tails(early)))
    return chain.select("chain_id", "lane", "seq", F.col("timestamp").cast("long").alias("event_id"), "action", "prev_hash", "entry_hash")


@query("audit_verify", f"""WITH {_CHAIN}, {_TAMPERED}, {_CUT}, {_BAD} SELECT c.chain_id, coalesce(any_value(u.n), 0) AS entries, count(b.chain_id) = 0 AS is_valid
 FROM (SELECT DISTINCT chain_id FROM chain) c LEFT JOIN (SELECT chain_id, count(*) AS n FROM u GROUP BY 1) u USING (chain_id) LEFT JOIN bad b USING (chain_id) GROUP BY 1""")
def audit_verify(spark, sf_dir):
    return a.verify(*_damaged(spark, sf_dir))


@query("audit_first_break", f"""WITH {_CHAIN}, {_TAMPERED}, {_CUT}, {_BAD} SELECT chain_id, lane, seq, failure FROM (
 SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY lane, seq, failure) AS r FROM bad) WHERE r = 1""")
def audit_first_break(spark, sf_dir):
    return a.first_break(*_damaged(spark, sf_dir))


@query("audit_entries", f"""WITH {_CHAIN} SELECT CAST(event_id AS VARCHAR) AS timestamp, CAST(chain_id AS VARCHAR) AS user, event_type AS action,
 'd' AS details, prev_hash, entry_hash FROM chain""")
def audit_entries(spark, sf_dir):
    return _chain(spark, sf_dir).select("timestamp", "user", "action", "details", "prev_hash", "entry_hash")


@query("audit_count", "SELECT user_id AS chain_id, count(*) AS entries FROM events GROUP BY 1")
def audit_count(spark, sf_dir):
    return fx.audit_log(spark, sf_dir).groupBy("chain_id").agg(F.count("*").alias("entries"))


@query("audit_load", "SELECT user_id AS chain_id, count(*) AS entries, true AS is_valid FROM events GROUP BY 1")
def audit_load(spark, sf_dir):
    """Write chains and anchors as JSON, read them back with a declared schema, verify."""
    path, anchor_path = sinks.new_path(spark, "audit"), sinks.new_path(spark, "anchors")
    _chain(spark, sf_dir).drop("ord").write.json(path)
    a.anchors(a.load_chain(spark, path)).drop("ord").write.json(anchor_path)
    return a.verify(a.load_chain(spark, path), a.load_chain(spark, anchor_path))


@query("audit_trail_for_scan", f"""WITH {o.ENT_CTE}, {o.FILES_CTE}, r AS (SELECT doc_id, count(*) AS n, {o.RISK} AS risk FROM ent GROUP BY doc_id),
 s AS (SELECT doc_id, filename, lower(regexp_extract(filename, '\\.[^.]+$')) AS ft, coalesce(n, 0) AS n, coalesce(risk, 0) AS risk,
 {o.level('coalesce(risk, 0)')} AS lv FROM files LEFT JOIN r USING (doc_id))
 SELECT doc_id, 1 AS step, 'UPLOAD' AS action, concat('File uploaded: ', filename) AS details FROM s WHERE ft <> '.exe'
 UNION ALL SELECT doc_id, 1, 'INPUT', concat('Direct text input: ', filename, ' (', length(filename), ' chars)') FROM s WHERE ft = '.exe'
 UNION ALL SELECT doc_id, 2, 'ANALYZE', concat('Text analysis complete: ', n, ' entities, threat=', lv) FROM s WHERE ft = '.exe'
 UNION ALL SELECT doc_id, 2, 'SQL_SANITIZE', concat('Sanitized SQL dump: ', filename) FROM s WHERE ft = '.sql'
 UNION ALL SELECT doc_id, 3, 'REPORT', concat('SQL threat level: ', lv) FROM s WHERE ft = '.sql'
 UNION ALL SELECT doc_id, 2, 'EXTRACT', concat('Extracted ', length(filename), ' chars from ', filename) FROM s WHERE ft NOT IN ('.sql', '.exe')
 UNION ALL SELECT doc_id, 3, 'ANALYZE', concat('Detected ', n, ' PII entities in ', filename) FROM s WHERE ft NOT IN ('.sql', '.exe')
 UNION ALL SELECT doc_id, 4, 'ENCRYPT', concat('Generated dual-state record for ', filename) FROM s WHERE ft NOT IN ('.sql', '.exe')
 UNION ALL SELECT doc_id, 5, 'REPORT', concat('Threat level: ', lv, ' (score: ', printf('%.2f', risk), ')') FROM s WHERE ft NOT IN ('.sql', '.exe')""")
def audit_trail_for_scan(spark, sf_dir):
    """Files scored by their spans; unsupported ones stand for direct input."""
    from veilspark.operators.risk import level_of
    from veilspark.plans.catalog.views import scored_files

    docs = scored_files(spark, sf_dir)
    kind = F.when(F.col("file_type") == ".exe", F.lit("text")).otherwise(F.col("file_type"))
    return a.scan_trail(docs.withColumn("file_type", kind).withColumn("text_length", F.length("filename"))
                        .withColumn("threat_level", level_of(F.col("risk_score"))))
