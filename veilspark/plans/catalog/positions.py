"""Positioned and timed words."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.operators import positions as p
from veilspark.operators.sanitize import scan_spans
from veilspark.operators.spans import explode_spans
from veilspark.plans import fixtures as fx
from veilspark.plans import oracles as o
from veilspark.plans.catalog.registry import query

KEYS = ["doc_id", "page"]
_WORDS = """w0 AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n]+')) AS word,
 generate_subscripts(regexp_split_to_array(text, '[ \\n]+'), 1) - 1 AS word_no FROM kyc),
 w AS (SELECT doc_id, 0 AS page, word_no, word, CAST(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY word_no) - length(word) - 1 AS INT) AS char_start FROM w0),
 pt AS (SELECT doc_id, string_agg(word, ' ' ORDER BY word_no) AS text FROM w GROUP BY doc_id)"""
_HIT = "EXISTS (SELECT 1 FROM fin e WHERE e.doc_id = w.doc_id AND w.char_start < e.end_pos AND w.char_start + length(w.word) > e.start_pos)"
_SCAN = f"{o.KYC_CTE}, {_WORDS}, {o.scan('pt', o.DEFAULT)}"


@query("word_offsets", f"WITH {o.KYC_CTE}, {_WORDS} SELECT doc_id, page, word_no, word, char_start, char_start + length(word) AS char_end FROM w")
def word_offsets(spark, sf_dir):
    return p.word_offsets(fx.words(spark, sf_dir), KEYS).select(*KEYS, "word_no", "word", "char_start", "char_end")


def _covered(spark, sf_dir):
    words = fx.words(spark, sf_dir)
    spans = explode_spans(scan_spans(p.page_text(words, KEYS)), KEYS)
    return p.word_offsets(words, KEYS), spans


@query("redaction_boxes", f"""WITH {_SCAN} SELECT doc_id, page, word_no, 10 * (word_no % 12) AS x0, 14 * (word_no // 12) AS y0,
 10 * (word_no % 12) + 9 AS x1, 14 * (word_no // 12) + 12 AS y1 FROM w WHERE {_HIT}""")
def redaction_boxes(spark, sf_dir):
    return p.redaction_boxes(*_covered(spark, sf_dir), KEYS)


@query("mute_intervals", f"""WITH {_SCAN} SELECT DISTINCT doc_id, page, 400 * word_no AS start_ms,
 greatest(400 * word_no + 30 + 10 * (word_no % 40), 400 * word_no + 50) AS end_ms FROM w WHERE {_HIT}""")
def mute_intervals(spark, sf_dir):
    return p.mute_intervals(*_covered(spark, sf_dir), KEYS)
