"""Detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark import config as C
from veilspark.functions.checksums import verhoeff_valid
from veilspark.operators.gazetteer import detect_places
from veilspark.operators.patterns import (
    Recognizer, aadhaar_digits, aadhaar_valid, constant, guarded, has, register)
from veilspark.operators.spans import detect, explode_spans
from veilspark.plans import fixtures as fx
from veilspark.plans import oracles as o
from veilspark.plans.catalog.registry import query

COLS = ["doc_id", "entity_type", "start_pos", "end_pos", "score", "value"]
COL_SQL = ", ".join(COLS)


def _on_kyc(name: str, entity_type: str) -> None:
    """One detector over the kyc texts."""
    @query(name, f"WITH {o.KYC_CTE} SELECT {COL_SQL} FROM ({o.spans('kyc', [entity_type])})")
    def _(spark, sf_dir):
        return explode_spans(detect(fx.kyc(spark, sf_dir), types=[entity_type]), ["doc_id"]).select(COLS)


for _name, _type in [
    ("detect_aadhaar", "IN_AADHAAR"), ("detect_pan", "IN_PAN"), ("detect_person_gazetteer", "PERSON"),
    ("detect_biometric", "BIOMETRIC_HASH"), ("detect_ssn", "US_SSN"), ("detect_date", "DATE_TIME"),
]:
    _on_kyc(_name, _type)


def _on_documents(name: str, entity_type: str) -> None:
    @query(name, f"SELECT {COL_SQL} FROM ({o.spans('documents', [entity_type], scan_of=o.DOC_SCAN)})")
    def _(spark, sf_dir):
        return explode_spans(detect(fx.documents(spark, sf_dir), types=[entity_type]), ["doc_id"]).select(COLS)


for _name, _type in [
    ("detect_email", "EMAIL_ADDRESS"), ("detect_credit_card", "CREDIT_CARD"),
    ("detect_phone", "PHONE_NUMBER"), ("detect_ip", "IP_ADDRESS"),
]:
    _on_documents(_name, _type)


@query("detect_spans", f"SELECT {COL_SQL} FROM ({o.spans('documents', o.DOC_TYPES, scan_of=o.DOC_SCAN)})")
def detect_spans(spark, sf_dir):
    return explode_spans(detect(fx.documents(spark, sf_dir), types=o.DOC_TYPES), ["doc_id"]).select(COLS)


@query("detect_url", f"""WITH src AS (SELECT page_id AS doc_id, concat(url, chr(10), html) AS text FROM pages)
 SELECT {COL_SQL} FROM ({o.spans('src', ['URL'])})""")
def detect_url(spark, sf_dir):
    """Addresses and whole sources of pages."""
    pages = fx.load(spark, sf_dir, "pages").select(
        F.col("page_id").alias("doc_id"), F.concat("url", F.lit("\n"), "html").alias("text"))
    return explode_spans(detect(pages, types=["URL"]), ["doc_id"]).select(COLS)


@query("register_recognizer", f"""WITH {o.KYC_CTE} SELECT doc_id, 'ACCOUNT_REF' AS entity_type, start_pos, end_pos,
 CAST(0.5 AS DOUBLE) AS score, value FROM ({o.matches('kyc', chr(92) + 'bcust[0-9]+' + chr(92) + 'b')})""")
def register_recognizer(spark, sf_dir):
    extra = Recognizer("ACCOUNT_REF", guarded("cust[0-9]+"), constant(0.5), has("cust"))
    found = detect(fx.kyc(spark, sf_dir), types=["ACCOUNT_REF"], bank=register(extra))
    return explode_spans(found, ["doc_id"]).select(COLS)


@query("verhoeff_valid", f"""WITH {o.KYC_CTE} SELECT doc_id, replace(aad, ' ', '') AS digits,
 {o.verhoeff("replace(aad, ' ', '')")} AS is_valid FROM kyc""")
def verhoeff(spark, sf_dir):
    digits = aadhaar_digits(F.col("aad"))
    return fx.kyc(spark, sf_dir).select("doc_id", digits.alias("digits"), verhoeff_valid(digits).alias("is_valid"))


_CANDIDATE = ("CASE doc_id % 7 WHEN 0 THEN '222222222222' WHEN 1 THEN '234567890123' "
              "WHEN 2 THEN concat('1', substr(aad, 2)) WHEN 3 THEN '2234 5678 9018' WHEN 4 THEN '334567890126' ELSE aad END")


@query("aadhaar_rules", f"""WITH {o.KYC_CTE}, v AS (SELECT doc_id, {_CANDIDATE} AS value FROM kyc)
 SELECT doc_id, value, {o.aadhaar_ok('value')} AS is_valid FROM v""")
def aadhaar_rules(spark, sf_dir):
    values = fx.kyc(spark, sf_dir).select("doc_id", F.expr(_CANDIDATE).alias("value"))
    return values.withColumn("is_valid", aadhaar_valid(F.col("value")))


@query("detect_location_gazetteer", f"""WITH {o.KYC_CTE}, places AS (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region)
 SELECT doc_id, 'LOCATION' AS entity_type, CAST(strpos(text, name) - 1 AS INT) AS start_pos, CAST(strpos(text, name) - 1 + length(name) AS INT) AS end_pos,
 CAST(0.6 AS DOUBLE) AS score, name AS value FROM kyc JOIN places ON regexp_matches(text, concat('\\b', name, '\\b'))""")
def detect_location(spark, sf_dir):
    places = fx.load(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(
        fx.load(spark, sf_dir, "region").select("r_name"))
    return detect_places(fx.kyc(spark, sf_dir), places).select(COLS)


_BOOSTED = ["PHONE_NUMBER", "IP_ADDRESS", "URL", "DATE_TIME", "US_SSN", "PERSON"]


@query("context_boost", f"""WITH {o.KYC_CTE}, a AS ({o.spans('kyc', _BOOSTED, boost=False)}), b AS ({o.spans('kyc', _BOOSTED)})
 SELECT a.doc_id, a.entity_type, a.start_pos, a.score AS base_score, b.score AS score
 FROM a JOIN b ON a.doc_id = b.doc_id AND a.start_pos = b.start_pos AND a.end_pos = b.end_pos AND a.entity_type = b.entity_type""")
def context_boost(spark, sf_dir):
    docs = detect(fx.kyc(spark, sf_dir), types=_BOOSTED, boost=False, out="plain")
    docs = detect(docs, types=_BOOSTED)
    pairs = docs.select("doc_id", F.explode(F.arrays_zip("plain", "spans")).alias("p"))
    return pairs.select("doc_id", "p.spans.entity_type", "p.spans.start_pos",
                        F.col("p.plain.score").alias("base_score"), F.col("p.spans.score").alias("score"))


@query("score_threshold", f"WITH {o.ENT_CTE} SELECT * FROM ent WHERE score >= 0.6")
def score_threshold(spark, sf_dir):
    return fx.entities(spark, sf_dir).where(F.col("score") >= 0.6)


_WANTED = ["IN_AADHAAR", "IN_PAN", "CREDIT_CARD"]


@query("entity_type_filter", f"WITH {o.ENT_CTE} SELECT * FROM ent WHERE entity_type IN ({', '.join(repr(t) for t in _WANTED)})")
def entity_type_filter(spark, sf_dir):
    return fx.entities(spark, sf_dir).where(F.col("entity_type").isin(_WANTED))
