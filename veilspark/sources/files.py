"""Reading files, routing them by type and assembling their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark import config as C
from veilspark.functions.text import decode_text

# Route per extension.
ROUTES = {
    ".txt": "text", ".csv": "text", ".sql": "dump", ".xlsx": "sheets",
    ".pdf": "pages", ".docx": "segments",
    ".png": "image", ".jpg": "image", ".jpeg": "image", ".bmp": "image", ".tiff": "image",
    ".mp3": "audio", ".wav": "audio",
}


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"\.[^.]+$", 0))


def route_of(filename: Column) -> Column:
    ext = extension(filename)
    chain = None
    for route in dict.fromkeys(ROUTES.values()):
        cond = ext.isin([e for e, r in ROUTES.items() if r == route])
        chain = F.when(cond, route) if chain is None else chain.when(cond, route)
    return chain


def route_by_type(files: DataFrame, filename: str = "filename") -> DataFrame:
    """Add extension, route and, for unsupported files, an error text."""
    ext = extension(F.col(filename))
    routed = files.withColumn("file_type", ext).withColumn("route", route_of(F.col(filename)))
    return routed.withColumn(
        "error_message",
        F.when(F.col("route").isNull(), F.concat(F.lit("Unsupported file format: "), F.col("file_type"))))


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files as text with name, size and content hash; UTF-8, else Latin-1.

    ``binaryFile`` splits work by file. Files it can see but not decode as
    UTF-8 still come through, so no file is lost.
    """
    reader = spark.read.format("binaryFile")
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.load(path)
    return raw.select(
        F.regexp_extract("path", r"[^/]+$", 0).alias("filename"),
        F.col("length").alias("file_size_bytes"),
        F.sha2("content", 256).alias("file_hash_sha256"),
        decode_text(F.col("content")).alias("text"),
    )


def scan_text(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, "*.txt")


def scan_csv_cells(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Delimited files as rows, with a declared schema (no inference pass)."""
    return spark.read.schema(schema).option("header", True).option("pathGlobFilter", "*.csv").csv(path)


def fingerprint(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("file_hash_sha256", F.sha2(F.col(content), 256)).withColumn(
        "file_size_bytes", F.octet_length(content).cast("long"))


def join_ordered(parts: DataFrame, key: str, order: list[str], part: str, sep: str,
                 out: str = "text", drop_blank: bool = True) -> DataFrame:
    """Parts of each document in order, joined; blank parts left out."""
    if drop_blank:
        parts = parts.where(F.col(part).rlike(r"\S"))
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(part).alias("_part"))))
    return parts.groupBy(key).agg(
        F.array_join(F.transform(rows, lambda r: r["_part"]), sep).alias(out))


def join_pages(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    return join_ordered(pages, key, ["page_no"], "page_text", "\n\n")


def join_segments(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """Paragraphs (kind 0) before table cells (kind 1)."""
    return join_ordered(segments, key, ["kind", "ord"], "segment", "\n")


def sheets_to_text(rows: DataFrame, key: str, sheet: str, order: str, columns: list[str]) -> DataFrame:
    """Rows of several sheets as one text per workbook; NULL cells as ''."""
    line = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    lines = rows.select(key, sheet, order, line.alias("line"))
    per_sheet = lines.groupBy(key, sheet).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))),
                                 lambda r: r["line"]), "\n").alias("sheet_text"))
    return join_ordered(per_sheet, key, [sheet], "sheet_text", "\n\n", drop_blank=False)


def truncate_guard(text: Column) -> Column:
    """Parity profile only: 500 lines of short texts, 50,000 characters of long ones."""
    lines = F.array_join(F.slice(F.split(text, "\n", -1), 1, C.MAX_LINES), "\n")
    return F.when(F.length(text) <= C.MAX_CHARS, lines).otherwise(F.left(text, F.lit(C.MAX_CHARS)))


def sheet_row_cap(rows: DataFrame, sheet: str, order: str, limit: int = C.MAX_SHEET_ROWS) -> DataFrame:
    """First rows of each sheet and whether some were cut.

    One row more than the limit is ranked, so the rank filter can prune every
    task before the shuffle and still tell that a sheet was longer.
    """
    ranked = Window.partitionBy(sheet).orderBy(order)
    top = rows.withColumn("row_no", F.row_number().over(ranked)).where(F.col("row_no") <= limit + 1)
    longer = F.max("row_no").over(Window.partitionBy(sheet)) > limit
    return top.withColumn("truncated", longer).where(F.col("row_no") <= limit)


def preview(text: Column, chars: int) -> Column:
    return F.left(text, F.lit(chars))


def first_entities(entities: DataFrame, key: str, order: list[str], limit: int = C.MAX_SHOWN_ENTITIES) -> DataFrame:
    ranked = Window.partitionBy(key).orderBy(*order)
    return entities.withColumn("shown_no", F.row_number().over(ranked)).where(F.col("shown_no") <= limit)


def sanitized_name(doc_id: Column, file_type: Column) -> Column:
    return F.concat(doc_id.cast("string"), F.lit("_sanitized"), file_type)
