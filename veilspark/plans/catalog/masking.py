"""Masks, anonymisers and text rewriting."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.functions import masking as m
from veilspark.operators import sanitize as s
from veilspark.operators.spans import explode_spans
from veilspark.plans import fixtures as fx
from veilspark.plans import oracles as o
from veilspark.plans.catalog.registry import query

KYC_SCAN = f"{o.KYC_CTE}, {o.scan('kyc', o.DEFAULT)}"


@query("anonymize_replace", f"WITH {KYC_SCAN} SELECT doc_id, entity_type, start_pos, {o.TAG} AS replacement FROM fin")
def anonymize_replace(spark, sf_dir):
    found = explode_spans(s.scan_spans(fx.kyc(spark, sf_dir)), ["doc_id"])
    return found.select("doc_id", "entity_type", "start_pos",
                        m.anonymize(F.col("entity_type"), F.col("value")).alias("replacement"))


@query("anonymize_mask", f"""WITH {o.KYC_CTE} SELECT doc_id, concat(repeat('X', 12), substr(cc, 13)) AS card,
 concat(repeat('X', 8), substr(aad, 9)) AS aadhaar, repeat('*', length(em)) AS email,
 concat(left(ph, length(ph) - 6), repeat('#', 6)) AS phone FROM kyc""")
def anonymize_mask(spark, sf_dir):
    return fx.kyc(spark, sf_dir).select(
        "doc_id", m.mask_chars(F.col("cc"), "X", 12).alias("card"),
        m.mask_chars(F.col("aad"), "X", 8).alias("aadhaar"),
        m.mask_chars(F.col("em"), "*", 100, from_end=True).alias("email"),
        m.mask_chars(F.col("ph"), "#", 6, from_end=True).alias("phone"))


@query("anonymize_hash", f"WITH {o.KYC_CTE} SELECT doc_id, sha256(em) AS plain, sha256(concat('s1', em)) AS salted FROM kyc")
def anonymize_hash(spark, sf_dir):
    return fx.kyc(spark, sf_dir).select(
        "doc_id", m.Anonymizer("hash").apply(F.col("em")).alias("plain"),
        m.Anonymizer("hash", salt="s1").apply(F.col("em")).alias("salted"))


@query("anonymize_keep", f"WITH {o.KYC_CTE} SELECT doc_id, aad AS value FROM kyc")
def anonymize_keep(spark, sf_dir):
    return fx.kyc(spark, sf_dir).select("doc_id", m.Anonymizer("keep").apply(F.col("aad")).alias("value"))


@query("operator_profile", f"""WITH {o.KYC_CTE}, n AS (SELECT *, concat(fn, ' ', ln) AS nm FROM kyc) SELECT doc_id,
 concat(repeat('X', 8), substr(aad, 9)) AS aadhaar_mask_last_4, repeat('X', length(aad)) AS aadhaar_full_mask,
 '[REDACTED_AADHAAR]' AS aadhaar_redact, aad AS aadhaar_ignore, '[REDACTED_NAME]' AS name_redact,
 repeat('*', length(nm)) AS name_mask_first, sha256(nm) AS name_hash,
 concat('XXXXXX', substr(ph, 7)) AS phone, concat('*******', substr(pan, 8)) AS pan, '[REDACTED]' AS other FROM n""")
def operator_profile(spark, sf_dir):
    name = F.concat("fn", F.lit(" "), "ln")

    def run(kind, value, **modes):
        return m.anonymize(F.lit(kind), value, m.operator_profile(**modes))

    twelve = ["mask_last_4", "full_mask", "redact", "ignore"]
    names = ["redact", "mask_first", "hash"]
    return fx.kyc(spark, sf_dir).select(
        "doc_id",
        *[run("IN_AADHAAR", F.col("aad"), twelve_digit_mode=t).alias(f"aadhaar_{t}") for t in twelve],
        *[run("PERSON", name, name_mode=n).alias(f"name_{n}") for n in names],
        run("PHONE_NUMBER", F.col("ph")).alias("phone"), run("IN_PAN", F.col("pan")).alias("pan"),
        run("IP_ADDRESS", F.col("ip")).alias("other"))


def _masked(name: str, kind: str, value: str) -> None:
    """One typed mask over values made from kyc fields."""
    @query(name, f"""WITH {o.KYC_CTE}, v AS (SELECT doc_id, {value} AS value, '{kind}' AS entity_type FROM kyc)
 SELECT doc_id, value, {o.MASK} AS masked FROM v""")
    def _(spark, sf_dir):
        values = fx.kyc(spark, sf_dir).select("doc_id", F.expr(value).alias("value"))
        return values.withColumn("masked", m.mask_value(F.lit(kind), F.col("value")))


_masked("mask_email", "EMAIL_ADDRESS", "CASE doc_id % 3 WHEN 0 THEN em WHEN 1 THEN concat('x@', em) ELSE concat('no at ', fn) END")
_masked("mask_phone", "PHONE_NUMBER", "ph")
_masked("mask_card", "CREDIT_CARD",
        "CASE doc_id % 2 WHEN 0 THEN cc ELSE concat(substr(cc,1,4), '-', substr(cc,5,4), '-', substr(cc,9,4), '-', substr(cc,13,4)) END")
_masked("mask_aadhaar", "IN_AADHAAR", "CASE doc_id % 2 WHEN 0 THEN aad ELSE replace(aad, ' ', '') END")
_masked("mask_pan", "IN_PAN", "pan")


@query("mask_fixed", f"""WITH {o.KYC_CTE}, v AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'US_SSN'
 WHEN 2 THEN 'URL' ELSE 'DATE_TIME' END AS entity_type, ssn AS value FROM kyc) SELECT doc_id, entity_type, {o.MASK} AS masked FROM v""")
def mask_fixed(spark, sf_dir):
    kinds = F.expr("CASE doc_id % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'US_SSN' WHEN 2 THEN 'URL' ELSE 'DATE_TIME' END")
    return fx.kyc(spark, sf_dir).select("doc_id", kinds.alias("entity_type")).withColumn(
        "masked", m.mask_fixed(F.col("entity_type")))


@query("apply_spans", f"WITH {KYC_SCAN} {o.stitched('kyc', 'fin', o.MASK, 'masked_text')}")
def apply_spans(spark, sf_dir):
    return s.masked_text(s.scan_spans(fx.kyc(spark, sf_dir))).select("doc_id", "masked_text")


@query("dual_state", f"""WITH {KYC_SCAN}, masked AS ({o.stitched('kyc', 'fin', o.MASK, 'masked_text')}),
 listed AS (SELECT doc_id, count(*) AS n, string_agg(concat_ws('|', entity_type, {o.MASK}, start_pos, end_pos), ';' ORDER BY start_pos) AS entities
 FROM fin GROUP BY doc_id) SELECT k.doc_id, length(k.text) AS original_length, masked_text, coalesce(n, 0) AS entity_count,
 coalesce(entities, '') AS entities FROM kyc k JOIN masked USING (doc_id) LEFT JOIN listed USING (doc_id)""")
def dual_state(spark, sf_dir):
    state = s.dual_state(s.scan_spans(fx.kyc(spark, sf_dir)))
    listed = F.transform("entities", lambda e: F.concat_ws(
        "|", e["entity_type"], e["masked"], e["start_pos"].cast("string"), e["end_pos"].cast("string")))
    return state.select("doc_id", "original_length", "masked_text", "entity_count",
                        F.array_join(listed, ";").alias("entities"))


SANITIZED = o.stitched("kyc", "fin", o.TAG, "sanitized")


@query("sanitize_text", f"WITH {KYC_SCAN} {SANITIZED}")
def sanitize_text(spark, sf_dir):
    return s.sanitize_text(fx.kyc(spark, sf_dir)).select("doc_id", "sanitized")


@query("change_count", f"""WITH {KYC_SCAN}, z AS (SELECT k.doc_id, text, sanitized,
 regexp_split_to_array(text, '\\s+') AS a, regexp_split_to_array(sanitized, '\\s+') AS b FROM kyc k JOIN ({SANITIZED}) USING (doc_id))
 SELECT doc_id, CASE WHEN text = sanitized THEN 0 ELSE greatest(1, len(list_filter(range(1, least(len(a), len(b)) + 1),
 lambda i: a[i] <> b[i]))) END AS changes FROM z""")
def change_count(spark, sf_dir):
    done = s.sanitize_text(fx.kyc(spark, sf_dir))
    return done.select("doc_id", s.change_count(F.col("text"), F.col("sanitized")).alias("changes"))
