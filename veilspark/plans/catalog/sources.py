"""Reading, routing, assembling and writing."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.operators.dumps import extract_literals, sanitize_parts
from veilspark.operators.sanitize import sanitize_text
from veilspark.operators.spans import explode_spans
from veilspark.operators.tables import sanitize_columns
from veilspark.plans import fixtures as fx
from veilspark.plans import oracles as o
from veilspark.plans.catalog.masking import KYC_SCAN, SANITIZED
from veilspark.plans.catalog.registry import query
from veilspark.sources import files as f
from veilspark.sources import sinks
from veilspark.sources.dump_files import scan_dump
from veilspark.sources.text_files import scan_pieces, text_pieces


def _text_files(spark, docs, name: str, per_file: int) -> str:
    """Write texts as plain files of bounded size; returns their folder."""
    path = sinks.new_path(spark, name)
    docs.select("text").write.option("maxRecordsPerFile", per_file).text(path)
    return path


@query("scan_text", "SELECT sum(length(text) + 1) AS chars, sum(strlen(text) + 1) AS bytes FROM documents")
def scan_text(spark, sf_dir):
    """Documents written as text files and read back; every character counts."""
    path = _text_files(spark, fx.documents(spark, sf_dir), "texts", 1_000)
    return f.scan_text(spark, path).agg(
        F.sum(F.length("text")).alias("chars"), F.sum("file_size_bytes").alias("bytes"))


# Lines between the texts of one file, more than any rule looks across.
_GAP = "repeat(concat('- - - - - - - -', chr(10)), 80)"


@query("scan_text_pieces", f"""WITH {KYC_SCAN}, laid AS (SELECT doc_id, sum(length(text) + length({_GAP}) + 1) OVER (ORDER BY doc_id) - length(text) - length({_GAP}) - 1 AS begins FROM kyc)
 SELECT CAST(begins + start_pos AS BIGINT) AS start_pos, CAST(begins + end_pos AS BIGINT) AS end_pos, entity_type, score, value FROM fin JOIN laid USING (doc_id)""")
def scan_text_pieces(spark, sf_dir):
    """All customers' texts in one file, read in byte ranges and scanned in pieces."""
    path = sinks.new_path(spark, "long-text")
    # One task writes the file; texts are made before it, and the lines between them after its sort.
    texts = fx.kyc(spark, sf_dir).select("doc_id", "text").repartition(1).sortWithinPartitions("doc_id")
    texts.select(F.concat("text", F.expr(_GAP)).alias("text")).write.text(path)
    return explode_spans(scan_pieces(text_pieces(spark, path)), ["file"]).drop("file")


@query("scan_csv", f"""WITH {o.KYC_CTE} SELECT doc_id, concat(fn, ' ', ln) AS name, '[REDACTED_EMAIL]' AS email,
 '[REDACTED_PHONE]' AS phone, txn AS serial FROM kyc""")
def scan_csv(spark, sf_dir):
    path = sinks.new_path(spark, "csv")
    fx.kyc(spark, sf_dir).select(
        "doc_id", F.concat("fn", F.lit(" "), "ln").alias("name"), F.col("em").alias("email"),
        F.col("ph").alias("phone"), F.col("txn").alias("serial")).write.option("header", True).csv(path)
    schema = "doc_id long, name string, email string, phone string, serial string"
    return sanitize_columns(f.scan_csv_cells(spark, path, schema))


# One dump file of all customers: an INSERT of many lines for every ten, literals of several lines, comments with quotes.
_DUMP_ROW = """concat('(', CAST(doc_id AS VARCHAR(9)), ', ', chr(39), fn, chr(39), ', ', chr(39), <mail>, chr(39), ', ', chr(39), 'phone; note', chr(10), '(', <phone>, ') PAN ', <pan>, chr(39), ')')"""
_FILE_DUMPS = """SELECT CAST(floor(doc_id / 10) AS BIGINT) AS k, concat('-- customers', chr(39), ' rows; part ', CAST(CAST(floor(doc_id / 10) AS BIGINT) AS VARCHAR(9)), chr(10),
 'INSERT INTO ', chr(96), 'customers', chr(96), ' (id, name, email, note)', chr(10), 'VALUES ', string_agg(<row>, concat(',', chr(10))<by>), ';') AS text FROM <kyc> GROUP BY CAST(floor(doc_id / 10) AS BIGINT)"""
_RAW = {"<mail>": "em", "<phone>": "ph", "<pan>": "pan"}
_CLEAN = {"<mail>": "'[REDACTED_EMAIL]'", "<phone>": "'[REDACTED_PHONE]'", "<pan>": f"CASE WHEN {o.pan_ok('pan')} THEN '[REDACTED_PAN]' ELSE pan END"}


def _file_dumps(values: dict[str, str], by: str) -> str:
    row = _DUMP_ROW
    for name, value in values.items():
        row = row.replace(name, value)
    return _FILE_DUMPS.replace("<row>", row).replace("<by>", by)


_BY = " ORDER BY doc_id"


@query("scan_sql_dump", f"""WITH {o.KYC_CTE}, raw AS ({_file_dumps(_RAW, _BY).replace('<kyc>', 'kyc')}), clean AS ({_file_dumps(_CLEAN, _BY).replace('<kyc>', 'kyc')}),
 n AS (SELECT CAST(floor(doc_id / 10) AS BIGINT) AS k, count(*) * 3 AS literals FROM kyc GROUP BY 1)
 SELECT 'customers' AS table_name, literals, sha256(substr(raw.text, instr(raw.text, 'VALUES ') + 7)) AS values_sha256, sha256(substr(clean.text, instr(clean.text, 'VALUES ') + 7)) AS sanitized_sha256
 FROM raw JOIN clean USING (k) JOIN n USING (k)""")
def scan_sql_dump(spark, sf_dir):
    """All customers in one dump file, read in byte ranges; the values of every statement as they were and sanitised."""
    path = sinks.new_path(spark, "dumps")
    texts = spark.sql(_file_dumps(_RAW, ") WITHIN GROUP (ORDER BY doc_id").replace("<kyc>", "{kyc}"), kyc=fx.kyc(spark, sf_dir))
    texts.coalesce(1).select("text").write.text(path)
    found = scan_dump(spark, path, "*.txt").where("since IS NOT NULL")
    clean = sanitize_parts(found, key="file")

    def whole(parts, text):
        first = F.greatest(F.col("values_at") - F.col("offset"), F.lit(0)).cast("int")
        own = F.struct("offset", F.substring(F.col(text), first + 1, F.length(text)).alias("t"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda p: p["t"]), "")
        return parts.groupBy("file", "insert_at").agg(F.first("table_name").alias("table_name"), F.sha2(joined, 256).alias("sha"))

    literals = extract_literals(found, key="file").groupBy("file", F.col("insert_start").alias("insert_at")).agg(F.count("*").alias("literals"))
    raw = whole(found, "text").withColumnRenamed("sha", "values_sha256")
    done = whole(clean, "sanitized").withColumnRenamed("sha", "sanitized_sha256").drop("table_name")
    return raw.join(done, ["file", "insert_at"]).join(literals, ["file", "insert_at"]).select("table_name", "literals", "values_sha256", "sanitized_sha256")


@query("scan_sheets", """WITH r AS (SELECT CAST(floor(c_custkey / 100) AS BIGINT) AS workbook, c_mktsegment AS sheet, c_custkey,
 concat(CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END, ' ', c_nationkey) AS line FROM customer),
 s AS (SELECT workbook, sheet, string_agg(line, chr(10) ORDER BY c_custkey) AS t FROM r GROUP BY 1, 2)
 SELECT workbook, string_agg(t, chr(10) || chr(10) ORDER BY sheet) AS text FROM s GROUP BY 1""")
def scan_sheets(spark, sf_dir):
    rows = fx.load(spark, sf_dir, "customer").select(
        F.floor(F.col("c_custkey") / 100).cast("long").alias("workbook"), F.col("c_mktsegment").alias("sheet"),
        "c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("name"), "c_nationkey")
    return f.sheets_to_text(rows, "workbook", "sheet", "c_custkey", ["name", "c_nationkey"])


ROUTED = f"""{o.FILES_CTE}, x AS (SELECT *, lower(regexp_extract(filename, '\\.[^.]+$')) AS file_type FROM files),
 routed AS (SELECT *, CASE file_type WHEN '.txt' THEN 'text' WHEN '.csv' THEN 'text' WHEN '.sql' THEN 'dump' WHEN '.pdf' THEN 'pages'
 WHEN '.docx' THEN 'segments' WHEN '.png' THEN 'image' END AS route,
 CASE WHEN file_type = '.exe' THEN 'Unsupported file format: .exe' END AS error_message FROM x)"""


@query("route_by_type", f"WITH {ROUTED} SELECT doc_id, filename, file_type, route, error_message FROM routed")
def route_by_type(spark, sf_dir):
    return f.route_by_type(fx.files(spark, sf_dir).select("doc_id", "filename"))


@query("file_fingerprint", "SELECT doc_id, sha256(text) AS file_hash_sha256, strlen(text) AS file_size_bytes FROM documents")
def file_fingerprint(spark, sf_dir):
    docs = fx.documents(spark, sf_dir).select("doc_id", F.col("text").cast("binary").alias("content"))
    return f.fingerprint(docs).select("doc_id", "file_hash_sha256", "file_size_bytes")


_PARTS = """parts AS (SELECT doc_id, n, CASE WHEN n % 3 = 2 THEN '  ' ELSE line END AS line FROM (SELECT doc_id,
 generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n, unnest(string_split(text, chr(10))) AS line FROM kyc))"""


def _parts(spark, sf_dir):
    lines = fx.kyc(spark, sf_dir).select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("n", "line"))
    return lines.withColumn("line", F.when(F.col("n") % 3 == 2, F.lit("  ")).otherwise(F.col("line")))


@query("join_pages", f"""WITH {o.KYC_CTE}, {_PARTS} SELECT doc_id, string_agg(line, chr(10) || chr(10) ORDER BY n) AS text
 FROM parts WHERE trim(line) <> '' GROUP BY doc_id""")
def join_pages(spark, sf_dir):
    return f.join_pages(_parts(spark, sf_dir).select("doc_id", F.col("n").alias("page_no"), F.col("line").alias("page_text")))


@query("join_segments", f"""WITH {o.KYC_CTE}, {_PARTS} SELECT doc_id, string_agg(line, chr(10) ORDER BY n % 2, n) AS text
 FROM parts WHERE trim(line) <> '' GROUP BY doc_id""")
def join_segments(spark, sf_dir):
    return f.join_segments(_parts(spark, sf_dir).select(
        "doc_id", (F.col("n") % 2).alias("kind"), F.col("n").alias("ord"), F.col("line").alias("segment")))


@query("truncate_guard", """SELECT doc_id, length(t) AS chars, sha256(t) AS digest FROM (SELECT doc_id, CASE WHEN length(text) <= 50000
 THEN array_to_string(string_split(text, chr(10))[1:500], chr(10)) ELSE left(text, 50000) END AS t FROM documents)""")
def truncate_guard(spark, sf_dir):
    docs = fx.documents(spark, sf_dir).select("doc_id", f.truncate_guard(F.col("text")).alias("t"))
    return docs.select("doc_id", F.length("t").alias("chars"), F.sha2("t", 256).alias("digest"))


@query("sheet_row_cap", """WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS row_no,
 count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, event_id, row_no, n > 1000 AS truncated FROM r WHERE row_no <= 1000""")
def sheet_row_cap(spark, sf_dir):
    rows = fx.load(spark, sf_dir, "events").select("event_type", "event_id")
    return f.sheet_row_cap(rows, "event_type", "event_id")


@query("preview_caps", """SELECT doc_id, sha256(left(text, 3000)) AS short, sha256(left(text, 500000)) AS medium, sha256(left(text, 900000)) AS long FROM documents""")
def preview_caps(spark, sf_dir):
    cut = lambda n, name: F.sha2(f.preview(F.col("text"), n), 256).alias(name)
    return fx.documents(spark, sf_dir).select("doc_id", cut(3_000, "short"), cut(500_000, "medium"), cut(900_000, "long"))


@query("preview_caps_entities", f"""WITH {o.ENT_CTE}, d AS (SELECT *, CAST(floor(doc_id / 32) AS BIGINT) AS file_id FROM ent)
 SELECT file_id, shown_no, doc_id, ord, start_pos FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY doc_id, ord, start_pos) AS shown_no FROM d) WHERE shown_no <= 50""")
def preview_caps_entities(spark, sf_dir):
    ent = fx.entities(spark, sf_dir).select(
        F.floor(F.col("doc_id") / 32).cast("long").alias("file_id"), "doc_id", "ord", "start_pos")
    return f.first_entities(ent, "file_id", ["doc_id", "ord", "start_pos"])


_KIND = "CASE doc_id % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.csv' ELSE '.sql' END"


@query("write_sanitized", f"""WITH {KYC_SCAN}, s AS ({SANITIZED}) SELECT doc_id, {_KIND} AS file_type,
 concat(doc_id, '_sanitized', {_KIND}) AS sanitized_name, sanitized FROM s""")
def write_sanitized(spark, sf_dir):
    path = sinks.new_path(spark, "sanitized")
    done = sanitize_text(fx.kyc(spark, sf_dir)).select("doc_id", F.expr(_KIND).alias("file_type"), "sanitized")
    named = done.withColumn("sanitized_name", f.sanitized_name(F.col("doc_id"), F.col("file_type")))
    sinks.write_sanitized(named, path)
    schema = "doc_id long, sanitized string, sanitized_name string, file_type string"
    return spark.read.schema(schema).parquet(path)
