"""Context rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark import config as C
from veilspark.operators import rules as r
from veilspark.operators.patterns import unvalidated
from veilspark.operators.spans import dedup_entities, detect, explode_spans
from veilspark.plans import fixtures as fx
from veilspark.plans import oracles as o
from veilspark.plans.catalog.registry import query

SCORED = ["doc_id", "ord", "entity_type", "start_pos", "end_pos", "score"]
SCORED_SQL = ", ".join(SCORED)
SPAN = ["doc_id", "entity_type", "start_pos", "end_pos", "score"]
SPAN_SQL = ", ".join(SPAN)

# Thirty-two orders form one document, so that windows hold many spans.
_DENSE = "dense AS (SELECT * REPLACE (CAST(floor(doc_id / 32) AS BIGINT) AS doc_id) FROM ent)"


def _dense(spark, sf_dir):
    ent = fx.entities(spark, sf_dir)
    return ent.withColumn("doc_id", F.floor(F.col("doc_id") / 32).cast("long"))


@query("rule_name_phone", f"WITH {o.ENT_CTE}, {_DENSE} SELECT {SCORED_SQL} FROM ({o.linked('dense')['phone']})")
def rule_name_phone(spark, sf_dir):
    return r.table_name_phone(_dense(spark, sf_dir)).select(SCORED)


@query("rule_name_aadhaar", f"WITH {o.ENT_CTE}, {_DENSE} SELECT {SCORED_SQL} FROM ({o.linked('dense')['aadhaar']})")
def rule_name_aadhaar(spark, sf_dir):
    return r.table_name_aadhaar(_dense(spark, sf_dir)).select(SCORED)


@query("rule_profile_escalation", f"WITH {o.ENT_CTE} SELECT {SCORED_SQL} FROM ({o.linked('ent')['profile']})")
def rule_profile_escalation(spark, sf_dir):
    return r.table_profile_escalation(fx.entities(spark, sf_dir)).select(SCORED)


_ORDERS = "concat(text, chr(10), repeat('- ', doc_id % 50), 'order ', CAST(6000000000 + doc_id * 7919 AS VARCHAR(10)))"


@query("rule_number_suppression", f"""WITH {o.KYC_CTE}, src AS (SELECT doc_id, {_ORDERS} AS text FROM kyc),
 found AS (SELECT * FROM ({o.spans('src', ['PHONE_NUMBER', 'IN_AADHAAR'])})) SELECT {SPAN_SQL} FROM found WHERE NOT {o.SUPPRESSED}""")
def rule_number_suppression(spark, sf_dir):
    """Order numbers look like mobiles and are taken out again."""
    repeated = _ORDERS.replace("doc_id % 50", "CAST(doc_id % 50 AS INT)")
    src = fx.kyc(spark, sf_dir).select("doc_id", F.expr(repeated).alias("text"))
    found = detect(src, types=["PHONE_NUMBER", "IN_AADHAAR"])
    return explode_spans(r.row_number_suppression(found), ["doc_id"]).select(SPAN)


@query("rule_luhn", f"""WITH {o.KYC_CTE} SELECT doc_id, 'CREDIT_CARD' AS entity_type, start_pos, end_pos, CAST(0.5 AS DOUBLE) AS score
 FROM ({o.matches('kyc', o.DETECTORS['CREDIT_CARD'][0][0])}) WHERE {o.luhn('value')}""")
def rule_luhn(spark, sf_dir):
    candidates = detect(fx.kyc(spark, sf_dir), types=["CREDIT_CARD"], bank=unvalidated("CREDIT_CARD", 0.5))
    return explode_spans(r.row_luhn(candidates), ["doc_id"]).select(SPAN)


@query("rule_date_words", f"""WITH {o.KYC_CTE} SELECT {SPAN_SQL} FROM ({o.spans('kyc', ['DATE_TIME'])}) WHERE NOT {o.FREQUENCY}""")
def rule_date_words(spark, sf_dir):
    return explode_spans(r.row_date_words(detect(fx.kyc(spark, sf_dir), types=["DATE_TIME"])), ["doc_id"]).select(SPAN)


@query("apply_context_rules", f"""WITH {o.KYC_CTE}, found AS MATERIALIZED ({o.spans('kyc', o.EVERY)}),
 l2 AS MATERIALIZED ({o.linked('found')['phone']}), l3 AS MATERIALIZED ({o.linked('l2')['aadhaar']}),
 l6 AS MATERIALIZED ({o.linked('l3')['profile']}) SELECT {SPAN_SQL} FROM ({o.ruled('l6')})""")
def apply_context_rules(spark, sf_dir):
    found = detect(fx.kyc(spark, sf_dir), types=C.DETECT_TYPES["linkage"])
    return explode_spans(r.apply_context_rules(found, profile="linkage"), ["doc_id"]).select(SPAN)


@query("dedup_overlaps", f"WITH {o.ENT_CTE}, {_DENSE} SELECT {SPAN_SQL} FROM ({o.resolved('dense')})")
def dedup_overlaps(spark, sf_dir):
    return dedup_entities(_dense(spark, sf_dir)).select(SPAN)
