"""Detect, check and rewrite in one go; masked views; stored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark import config as C
from veilspark.functions.crypto import (
    encrypt_gcm, entity_aad, fpe_digits, fpe_encrypt, value_format)
from veilspark.functions.masking import Profile, anonymize, mask_value
from veilspark.operators.patterns import BANK, Recognizer
from veilspark.operators.rules import apply_context_rules
from veilspark.operators.spans import dedup, detect, explode_spans, stitch


def scan_spans(docs: DataFrame, text: str = "text", profile: str = "default",
               bank: list[Recognizer] | None = None, out: str = "spans") -> DataFrame:
    """Detected, rule-checked and disjoint spans next to their text."""
    useful = [r for r in (BANK if bank is None else bank) if not r.ruled_out]
    found = detect(docs, text, C.DETECT_TYPES[profile], bank=useful, out=out)
    return dedup(apply_context_rules(found, text, profile, out), out)


def sanitize_text(docs: DataFrame, text: str = "text", out: str = "sanitized",
                  profile: str = "default", operators: Profile | None = None,
                  bank: list[Recognizer] | None = None) -> DataFrame:
    """Text with every redactable span anonymised; unchanged without spans."""
    scanned = scan_spans(docs, text, profile, bank, "_found")
    scanned = scanned.withColumn(
        "_found", F.filter(F.col("_found"), lambda s: s["entity_type"].isin(C.REDACT_TYPES)))
    rewritten = stitch(F.col(text), F.col("_found"),
                       lambda s: anonymize(s["entity_type"], s["value"], operators))
    return scanned.withColumn(out, rewritten).drop("_found")


def masked_text(docs: DataFrame, text: str = "text", spans: str = "spans",
                out: str = "masked_text") -> DataFrame:
    """Masked view: every span replaced by its readable mask."""
    return docs.withColumn(
        out, stitch(F.col(text), F.col(spans), lambda s: mask_value(s["entity_type"], s["value"])))


def dual_state(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Masked text, entity list and count per document; nothing is shuffled."""
    entities = F.transform(
        F.col(spans),
        lambda s: F.struct(
            s["entity_type"].alias("entity_type"),
            mask_value(s["entity_type"], s["value"]).alias("masked"),
            s["score"].alias("confidence"), s["start_pos"].alias("start_pos"),
            s["end_pos"].alias("end_pos")),
    )
    return (
        masked_text(docs, text, spans)
        .withColumn("original_length", F.length(text))
        .withColumn("entities", entities)
        .withColumn("entity_count", F.size(spans))
    )


def pii_records(entities: DataFrame, aes_key: str, fpe_key: str, fpe_tweak: str,
                key: str = "doc_id") -> DataFrame:
    """Stored form of a span table: masked and encrypted, never the plain value.

    Nonces are fresh on every evaluation, so write the result once and read it
    back instead of recomputing it.
    """
    value, kind = F.col("value"), F.col("entity_type")
    staged = entities.withColumn("_digits", fpe_digits(kind, value))
    staged = fpe_encrypt(staged, "_digits", "fpe_value", fpe_key, fpe_tweak)
    aad = entity_aad(F.col(key), kind, F.col("start_pos"))
    sealed = F.when(F.col("fpe_value").isNull(), encrypt_gcm(value, aes_key, aad))
    staged = staged.withColumn("_sealed", sealed)
    return staged.select(
        F.sha2(F.concat_ws("|", F.col(key).cast("string"), kind, F.col("start_pos").cast("string"),
                           F.col("end_pos").cast("string")), 256).alias("record_id"),
        key, "entity_type",
        F.col("start_pos").alias("char_start"), F.col("end_pos").alias("char_end"),
        F.col("score").alias("confidence"),
        F.col("_sealed.ciphertext").alias("encrypted_value"),
        F.col("_sealed.nonce").alias("encryption_nonce"),
        F.col("_sealed.tag").alias("encryption_tag"),
        "fpe_value",
        F.when(F.col("fpe_value").isNotNull(), value_format(value)).alias("value_format"),
        F.when(F.col("fpe_value").isNotNull(), F.lit(C.METHOD_FPE))
        .otherwise(F.lit(C.METHOD_AES)).alias("encryption_method"),
        mask_value(kind, value).alias("masked_value"),
    )


def records_of(docs: DataFrame, aes_key: str, fpe_key: str, fpe_tweak: str,
               key: str = "doc_id", spans: str = "spans") -> DataFrame:
    return pii_records(explode_spans(docs, [key], spans), aes_key, fpe_key, fpe_tweak, key)


def change_count(original: Column, sanitized: Column) -> Column:
    """Words that differ position by position; at least one if the text changed."""
    words = lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != "")
    differs = F.zip_with(words(original), words(sanitized), lambda a, b: a != b)
    n = F.size(F.filter(differs, lambda d: d))
    return F.when(original == sanitized, F.lit(0)).otherwise(F.greatest(n, F.lit(1)))
