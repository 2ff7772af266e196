"""SQL dumps."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.operators import dumps as d
from veilspark.operators.risk import score_docs
from veilspark.operators.sanitize import scan_spans
from veilspark.plans import fixtures as fx
from veilspark.plans import oracles as o
from veilspark.plans.catalog.registry import query

# In the generated dumps every INSERT is one line.
_INSERT = r"INSERT INTO customers VALUES \([^\n]*\);"
_FOUND = f"ins AS (SELECT *, start_pos + 29 AS values_start, substr(value, 30, length(value) - 30) AS values_section FROM ({o.matches('dumps', _INSERT)}))"


@query("extract_inserts", f"""WITH {o.DUMPS_CTE}, {_FOUND} SELECT doc_id, start_pos, end_pos, 'customers' AS table_name, values_start, values_section FROM ins""")
def extract_inserts(spark, sf_dir):
    return d.extract_inserts(fx.sql_dumps(spark, sf_dir))


@query("extract_literals", f"""WITH {o.DUMPS_CTE}, {_FOUND}, v AS (SELECT doc_id * 10000000 + start_pos AS doc_id, values_section AS text FROM ins),
 m AS ({o.matches('v', "''[^'']*''")}) SELECT CAST(floor(doc_id / 10000000) AS BIGINT) AS doc_id, doc_id % 10000000 AS insert_start, 'customers' AS table_name,
 doc_id % 10000000 + 29 AS values_start, substr(value, 2, length(value) - 2) AS value, start_pos AS literal_start, end_pos AS literal_end FROM m""")
def extract_literals(spark, sf_dir):
    return d.extract_literals(fx.sql_dumps(spark, sf_dir))


@query("sanitize_dump", f"""WITH {o.KYC_CTE}, p AS (SELECT doc_id AS k, CAST(floor(doc_id / 60) AS BIGINT) AS doc_id, fn, ln,
 CASE WHEN {o.pan_ok('pan')} THEN '[REDACTED_PAN]' ELSE pan END AS pan FROM kyc)
 SELECT doc_id, concat('CREATE TABLE customers (id INT, name VARCHAR(50), email VARCHAR(80), note TEXT);', chr(10),
 string_agg(concat('INSERT INTO customers VALUES (', k, ', ''', fn, ' ', ln, ''', ''[REDACTED_EMAIL]'', ''contact (phone [REDACTED_PHONE]) PAN ', pan, ''');'), chr(10) ORDER BY k),
 chr(10), 'ALTER TABLE customers ADD COLUMN dept VARCHAR(10);') AS sanitized FROM p GROUP BY doc_id""")
def sanitize_dump(spark, sf_dir):
    return d.sanitize_dump(fx.sql_dumps(spark, sf_dir))


@query("dump_tables_touched", "SELECT 'customers' AS table_name, count(*) AS statements_changed FROM customer")
def dump_tables_touched(spark, sf_dir):
    return d.dump_tables_touched(fx.sql_dumps(spark, sf_dir))


_DUMP_SCAN = o.scan("dumps", ["EMAIL_ADDRESS", "PHONE_NUMBER", "IN_PAN"])


@query("dump_report", f"""WITH {o.DUMPS_CTE}, {_DUMP_SCAN}, r AS (SELECT doc_id, count(*) AS entity_count, {o.RISK} AS risk_score FROM fin GROUP BY doc_id),
 s AS ({o.stitched('dumps', 'fin', o.TAG, 'clean')}) SELECT doc_id, coalesce(entity_count, 0) AS entity_count, coalesce(risk_score, 0) AS risk_score,
 {o.level('coalesce(risk_score, 0)')} AS threat_level, CASE WHEN length(clean) > 500 THEN concat(left(clean, 500), '...') ELSE clean END AS preview
 FROM s LEFT JOIN r USING (doc_id)""")
def dump_report(spark, sf_dir):
    """Risk of the whole dump text, and the head of its sanitised form."""
    dumps = fx.sql_dumps(spark, sf_dir)
    scored = score_docs(scan_spans(dumps)).select("doc_id", "entity_count", "risk_score", "threat_level")
    clean = d.sanitize_dump(dumps)
    head = F.when(F.length("sanitized") > 500, F.concat(F.left("sanitized", F.lit(500)), F.lit("...")))
    return scored.join(clean, "doc_id").select(
        "doc_id", "entity_count", "risk_score", "threat_level", F.coalesce(head, "sanitized").alias("preview"))
