"""Pipe-drawn tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark import config as C
from veilspark.operators import tables as t
from veilspark.plans import fixtures as fx
from veilspark.plans import oracles as o
from veilspark.plans.catalog.registry import query

_LINES = ("lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, "
          "generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM {src})")
_TAB_LINES = _LINES.format(src="tabs")


def _lines(docs):
    return docs.select("doc_id", F.posexplode_outer(t.lines_of(F.col("text"))).alias("line_no", "line"))


@query("is_ascii_table", f"""WITH {o.TABLES_CTE}, u AS (SELECT doc_id, 'table' AS kind, text FROM tabs UNION ALL SELECT doc_id, 'text', text FROM kyc)
 SELECT doc_id, kind, kind = 'table' AS is_table FROM u""")
def is_ascii_table(spark, sf_dir):
    both = fx.pipe_tables(spark, sf_dir).select("doc_id", F.lit("table").alias("kind"), "text").unionByName(
        fx.kyc(spark, sf_dir).select("doc_id", F.lit("text").alias("kind"), "text"))
    return both.select("doc_id", "kind", t.is_ascii_table(F.col("text")).alias("is_table"))


@query("is_divider_line", f"""WITH {o.TABLES_CTE}, {_TAB_LINES} SELECT doc_id, line_no,
 regexp_matches(line, '[-=]') AND NOT regexp_matches(line, '[a-zA-Z0-9]') AS is_divider FROM lines""")
def is_divider_line(spark, sf_dir):
    return _lines(fx.pipe_tables(spark, sf_dir)).select(
        "doc_id", "line_no", t.is_divider_line(F.col("line")).alias("is_divider"))


@query("parse_row", f"""WITH {o.TABLES_CTE}, {_TAB_LINES}, s AS (SELECT doc_id, line_no, string_split(substr(line, 2, length(line) - 2), '|') AS c FROM lines)
 SELECT doc_id, line_no, generate_subscripts(c, 1) - 1 AS col_idx, trim(unnest(c)) AS value FROM s""")
def parse_row(spark, sf_dir):
    return _lines(fx.pipe_tables(spark, sf_dir)).select(
        "doc_id", "line_no", F.posexplode_outer(t.parse_row(F.col("line"))).alias("col_idx", "value"))


@query("column_widths", f"""WITH {o.TABLES_CTE}, {_TAB_LINES}, s AS (SELECT doc_id, string_split(line, '|')[2:5] AS c FROM lines WHERE line_no <> 1),
 e AS (SELECT doc_id, generate_subscripts(c, 1) - 1 AS col_idx, length(unnest(c)) AS w FROM s) SELECT doc_id, col_idx, max(w) AS width FROM e GROUP BY ALL""")
def column_widths(spark, sf_dir):
    widths = t.column_widths(t.lines_of(F.col("text")))
    return fx.pipe_tables(spark, sf_dir).select("doc_id", F.posexplode_outer(widths).alias("col_idx", "width"))


_HEADERS = ["Aadhaar Number", "UID code", "Company PAN", "Serial", "12-Digit Number", "First name", "E-mail",
            "Mobile", "Credit Card", "Home Address", "DOB", "Notes", "Transaction ID", "SSN", "Roll", "Contact Number"]
_HEADER = "CASE doc_id % 16 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_HEADERS)) + " END"


@query("classify_column", f"""WITH {o.KYC_CTE}, h AS (SELECT doc_id, {_HEADER} AS header FROM kyc) SELECT doc_id, header,
 CASE WHEN pos IS NOT NULL THEN true ELSE NOT regexp_matches(lower(header), '{"|".join(C.NON_PII_HEADERS)}') END AS is_pii,
 [{", ".join(repr(e) for _, e in C.COLUMN_KEYWORDS)}][pos] AS entity_type, [{", ".join(repr(k) for k, _ in C.COLUMN_KEYWORDS)}][pos] AS context
 FROM (SELECT *, list_min(list_filter(range(1, {len(C.COLUMN_KEYWORDS) + 1}),
 lambda i: contains(lower(header), [{", ".join(repr(k) for k, _ in C.COLUMN_KEYWORDS)}][i]))) AS pos FROM h)""")
def classify_column(spark, sf_dir):
    heads = fx.kyc(spark, sf_dir).select("doc_id", F.expr(_HEADER).alias("header"))
    return heads.withColumn("c", t.classify_column(F.col("header"))).select("doc_id", "header", "c.*")


@query("table_header", f"""WITH {o.TABLES_CTE}, {_TAB_LINES} SELECT doc_id, 0 AS header_line, line AS header_text FROM lines WHERE line_no = 0""")
def table_header(spark, sf_dir):
    return t.table_header(fx.pipe_tables(spark, sf_dir)).select("doc_id", "header_line", "header_text")


# Cells of the generated tables, rebuilt from the fields behind them.
CELLS = f"""cells AS (SELECT CAST(floor(doc_id / 60) AS BIGINT) AS doc_id, doc_id AS k,
 CAST(row_number() OVER (PARTITION BY floor(doc_id / 60) ORDER BY doc_id) + 1 AS INT) AS line_no, '[REDACTED_NAME]' AS c0,
 CASE WHEN {o.aadhaar_ok('aad')} THEN concat('XXXXXXXX', substr(aad, 9)) ELSE aad END AS c1, repeat('*', length(em)) AS c2, txn AS c3 FROM kyc)"""


@query("sanitize_cell", f"""WITH {o.KYC_CTE}, {CELLS} SELECT doc_id, line_no, col_idx, sanitized FROM (
 SELECT doc_id, line_no, 0 AS col_idx, c0 AS sanitized FROM cells UNION ALL SELECT doc_id, line_no, 1, c1 FROM cells
 UNION ALL SELECT doc_id, line_no, 2, c2 FROM cells UNION ALL SELECT doc_id, line_no, 3, c3 FROM cells)""")
def sanitize_cell(spark, sf_dir):
    cells = t.table_cells(fx.pipe_tables(spark, sf_dir)).where(F.col("kind") == "cell")
    return t.sanitize_cells(cells).select("doc_id", "line_no", "col_idx", "sanitized")


@query("pad_cell", f"""WITH {o.KYC_CTE}, v AS (SELECT doc_id, concat(fn, ' ', ln) AS value, 8 + doc_id % 20 AS width FROM kyc),
 c AS (SELECT doc_id, width - 2 AS room, CASE WHEN length(value) > width - 2 THEN concat(left(value, width - 3), '…') ELSE value END AS s FROM v),
 p AS (SELECT *, room - length(s) AS pad FROM c)
 SELECT doc_id, concat(' ', s, repeat(' ', pad), ' ') AS to_left, concat(' ', repeat(' ', pad), s, ' ') AS to_right,
 concat(' ', repeat(' ', pad // 2 + (pad & room & 1)), s, repeat(' ', pad - pad // 2 - (pad & room & 1)), ' ') AS centered FROM p""")
def pad_cell(spark, sf_dir):
    name, width = F.concat("fn", F.lit(" "), "ln"), (F.col("doc_id") % 20 + 8).cast("int")
    return fx.kyc(spark, sf_dir).select(
        "doc_id", t.pad_cell(name, width).alias("to_left"), t.pad_cell(name, width, "right").alias("to_right"),
        t.pad_cell(name, width, "center").alias("centered"))


@query("process_table", f"""WITH {o.TABLES_CTE}, {CELLS} SELECT tabs.doc_id, concat(string_split(text, chr(10))[1], chr(10), string_split(text, chr(10))[2], chr(10),
 (SELECT string_agg(concat('| ', rpad(c0, 16, ' '), ' | ', rpad(c1, 14, ' '), ' | ', rpad(c2, 23, ' '), ' | ', rpad(c3, 10, ' '), ' |'), chr(10) ORDER BY k)
  FROM cells WHERE cells.doc_id = tabs.doc_id)) AS sanitized FROM tabs""")
def process_table(spark, sf_dir):
    return t.process_table(fx.pipe_tables(spark, sf_dir))


_KYC_LINES = f"""{_LINES.format(src='kyc')}, l AS (SELECT doc_id * 100 + line_no AS doc_id, line AS text FROM lines)"""


@query("process_lines", f"""WITH {o.KYC_CTE}, {_KYC_LINES}, found AS ({o.spans('l', o.EVERY, min_score=C.TABLE_MIN_SCORE)}),
 fin AS ({o.resolved('found')}), s AS ({o.stitched('l', 'fin', o.TABLE_TAG, 'clean')})
 SELECT CAST(floor(doc_id / 100) AS BIGINT) AS doc_id, string_agg(clean, chr(10) ORDER BY doc_id) AS sanitized FROM s GROUP BY 1""")
def process_lines(spark, sf_dir):
    return t.process_lines(fx.kyc(spark, sf_dir))


@query("sanitize_columns", f"""WITH {o.KYC_CTE}, p AS (SELECT doc_id, concat(fn, ' ', ln) AS name, em, ph, pan, txn FROM kyc) SELECT doc_id, name,
 '[REDACTED_EMAIL]' AS email, '[REDACTED_PHONE]' AS phone_number, CASE WHEN {o.pan_ok('pan')} THEN '[REDACTED_PAN]' ELSE pan END AS pan_card,
 txn AS serial FROM p""")
def sanitize_columns(spark, sf_dir):
    people = fx.kyc(spark, sf_dir).select(
        "doc_id", F.concat("fn", F.lit(" "), "ln").alias("name"), F.col("em").alias("email"),
        F.col("ph").alias("phone_number"), F.col("pan").alias("pan_card"), F.col("txn").alias("serial"))
    return t.sanitize_columns(people)
