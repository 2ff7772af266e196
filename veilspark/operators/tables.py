"""Pipe-drawn tables inside text, and column-wise sanitising of DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark import config as C
from veilspark.functions.masking import Profile, anonymize, operator_profile
from veilspark.functions.text import GAP
from veilspark.operators.sanitize import sanitize_text
from veilspark.operators.spans import dedup, detect, make_span, stitch

BLANKS = " \t\r\n\x0b\x0c"
CLASS = "struct<is_pii:boolean,entity_type:string,context:string>"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def has_pipe(line: Column) -> Column:
    return F.contains(line, F.lit("|"))


def is_ascii_table(text: Column) -> Column:
    """Three or more lines with pipes, in at most two different numbers."""
    counts = F.transform(
        F.filter(lines_of(strip(text)), has_pipe),
        lambda line: F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))),
    )
    return (F.size(counts) >= 3) & (F.size(F.array_distinct(counts)) <= 2)


def is_divider_line(line: Column) -> Column:
    return line.rlike("[-=]") & ~line.rlike("[a-zA-Z0-9]")


def parse_row(line: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(strip(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"\|", -1), strip)


def pipe_gaps(line: Column) -> Column:
    """Characters between neighbouring pipes; empty with fewer than two pipes."""
    parts = F.split(line, r"\|", -1)
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), F.length)


def column_widths(lines: Column) -> Column:
    """Widest gap per column over the rows of a table."""
    rows = F.filter(lines, lambda line: has_pipe(line) & ~is_divider_line(line))
    return F.aggregate(
        rows,
        F.array().cast("array<int>"),
        lambda acc, line: F.zip_with(acc, pipe_gaps(line), lambda a, b: F.greatest(a, b)),
    )


def classify_column(header: Column) -> Column:
    """Personal-data type a header announces; unknown headers count as personal."""
    name = F.lower(strip(header))

    def verdict(is_pii: bool, entity_type: str | None, context: str | None) -> Column:
        return F.struct(
            F.lit(is_pii).alias("is_pii"),
            F.lit(entity_type).cast("string").alias("entity_type"),
            F.lit(context).cast("string").alias("context"),
        )

    chain = None
    for word, entity_type in C.COLUMN_KEYWORDS:
        cond, res = F.contains(name, F.lit(word)), verdict(True, entity_type, word)
        chain = F.when(cond, res) if chain is None else chain.when(cond, res)
    for word in C.NON_PII_HEADERS:
        chain = chain.when(F.contains(name, F.lit(word)), verdict(False, None, None))
    return chain.otherwise(verdict(True, None, None))


def pad_cell(value: Column, width: Column, alignment: str = "left") -> Column:
    """Fit a value into a column with one blank on each side."""
    room = width - 2
    n = F.length(value)
    head = F.when(room >= 1, room - 1).otherwise(F.greatest(n + room - 1, F.lit(0)))
    cut = F.when(n > room, F.concat(F.substring(value, F.lit(1), head), F.lit("…"))).otherwise(value)
    spare = F.greatest(room - F.length(cut), F.lit(0))
    blank = lambda k: F.repeat(F.lit(" "), k.cast("int"))
    if alignment == "right":
        body = F.concat(blank(spare), cut)
    elif alignment == "center":
        before = F.floor(spare / 2) + spare.bitwiseAND(room).bitwiseAND(F.lit(1))
        body = F.concat(blank(before), cut, blank(spare - before))
    else:
        body = F.concat(cut, blank(spare))
    return F.concat(F.lit(" "), body, F.lit(" "))


def sanitize_cells(cells: DataFrame, profile: Profile | None = None,
                   min_score: float = C.TABLE_MIN_SCORE, value: str = "value",
                   column_class: str = "column_class", out: str = "sanitized") -> DataFrame:
    """Sanitise cell values, with the column's keyword in front as context."""
    profile = operator_profile() if profile is None else profile
    cls, val = F.col(column_class), F.col(value)
    skip = (strip(val) == "") | ~F.coalesce(cls["is_pii"], F.lit(True))
    prefix = F.coalesce(F.concat(cls["context"], F.lit(" ")), F.lit(""))
    staged = (
        cells.withColumn("_shift", F.length(prefix))
        .withColumn("_text", F.when(skip, F.lit("")).otherwise(F.concat(prefix, val)))
    )
    found = dedup(detect(staged, "_text", C.ALL_TYPES, min_score, out="_found"), "_found")
    shift, size = F.col("_shift"), F.length(val)

    def moved(s: Column) -> Column:
        start = F.greatest(s["start_pos"], shift) - shift
        end = F.least(s["end_pos"], shift + size) - shift
        return make_span(start, end, s["entity_type"], s["score"],
                         F.substring(val, start + 1, F.greatest(end - start, F.lit(0))))

    inside = F.filter(F.transform(F.col("_found"), moved), lambda s: s["start_pos"] < s["end_pos"])
    found = found.withColumn("_found", inside)
    rewritten = stitch(val, F.col("_found"), lambda s: anonymize(s["entity_type"], s["value"], profile))
    return found.withColumn(out, rewritten).drop("_shift", "_text", "_found")


def table_header(docs: DataFrame, text: str = "text") -> DataFrame:
    """Lines, header position, column classes and widths, read inside the row."""
    rows = F.transform(
        lines_of(F.col(text)),
        lambda line, i: F.struct(i.alias("line_no"), line.alias("line")),
    )
    first = F.get(F.filter(rows, lambda r: has_pipe(r["line"]) & ~is_divider_line(r["line"])), F.lit(0))
    return (
        docs.withColumn("_first", first)
        .withColumn("header_line", F.col("_first.line_no"))
        .withColumn("header_text", F.col("_first.line"))
        .withColumn("classes", F.transform(
            F.coalesce(parse_row(F.col("header_text")), F.array().cast("array<string>")), classify_column))
        .withColumn("widths", column_widths(lines_of(F.col(text))))
        .drop("_first")
    )


def table_cells(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per cell; lines outside the table and kept lines are one cell each.

    Rows are spread by (document, line) before cells are scanned, so one long
    table does not stay in the task that read it.
    """
    described = table_header(docs, text)
    lines = described.select(
        key, "header_line", "classes", "widths",
        F.posexplode_outer(lines_of(F.col(text))).alias("line_no", "line"),
    )
    lines = lines.repartition(F.col(key), F.col("line_no"))
    is_table = F.size("widths") > 0
    kind = (
        F.when(~is_table, "text")
        .when(is_divider_line(F.col("line")), "keep")
        .when(~has_pipe(F.col("line")), "text")
        .when(F.col("line_no") == F.col("header_line"), "keep")
        .otherwise("cell")
    )
    lines = lines.withColumn("kind", kind)
    pieces = F.when(F.col("kind") == "cell", parse_row(F.col("line"))).otherwise(F.array("line"))
    cells = lines.select(
        key, "line_no", "kind", "classes", "widths", F.posexplode_outer(pieces).alias("col_idx", "value"))
    plain = F.struct(
        (F.col("kind") == "text").alias("is_pii"), F.lit(None).cast("string").alias("entity_type"),
        F.lit(None).cast("string").alias("context"))
    in_cell = F.col("kind") == "cell"
    return cells.select(
        key, "line_no", "col_idx", "kind", "value",
        F.when(in_cell, F.get("classes", F.col("col_idx"))).otherwise(plain).alias("column_class"),
        F.when(in_cell, F.coalesce(F.get("widths", F.col("col_idx")), F.length("value") + 2)).alias("width"),
    )


def process_table(docs: DataFrame, text: str = "text", key: str = "doc_id",
                  profile: Profile | None = None, min_score: float = C.TABLE_MIN_SCORE) -> DataFrame:
    """Rewrite every table cell by cell and keep the columns aligned."""
    done = sanitize_cells(table_cells(docs, text, key), profile, min_score)
    shown = F.when(F.col("kind") == "cell", pad_cell(F.col("sanitized"), F.col("width"))).otherwise(
        F.col("sanitized"))
    cells = done.select(key, "line_no", "kind", F.struct("col_idx", shown.alias("shown")).alias("cell"))
    by_line = cells.groupBy(key, "line_no").agg(
        F.first("kind").alias("kind"), F.array_sort(F.collect_list("cell")).alias("cells"))
    joined = F.array_join(F.transform("cells", lambda c: c["shown"]), "|")
    line = F.when(F.col("kind") == "cell", F.concat(F.lit("|"), joined, F.lit("|"))).otherwise(joined)
    by_doc = by_line.select(key, F.struct("line_no", line.alias("line")).alias("row")).groupBy(key).agg(
        F.array_sort(F.collect_list("row")).alias("rows"))
    return by_doc.select(key, F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("sanitized"))


def process_lines(docs: DataFrame, text: str = "text", key: str = "doc_id",
                  profile: Profile | None = None, min_score: float = C.TABLE_MIN_SCORE) -> DataFrame:
    """Sanitise line by line, for text without a table in it."""
    lines = docs.select(key, F.posexplode_outer(lines_of(F.col(text))).alias("line_no", "value"))
    lines = lines.repartition(F.col(key), F.col("line_no")).withColumn(
        "column_class", F.lit(None).cast(CLASS))
    done = sanitize_cells(lines, profile, min_score)
    by_doc = done.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("line_no", "sanitized"))).alias("rows"))
    return by_doc.select(
        key, F.array_join(F.transform("rows", lambda r: r["sanitized"]), "\n").alias("sanitized"))


def column_class_of(name: str) -> str | None:
    """Class of a DataFrame column by its name: a type, "any" or None (leave)."""
    lowered = name.strip().lower()
    for word, entity_type in C.COLUMN_KEYWORDS:
        if word in lowered:
            return entity_type
    return None if any(w in lowered for w in C.NON_PII_HEADERS) else "any"


def column_context(name: str) -> str:
    """The keyword that tells a column's class, as context in front of its values."""
    lowered = name.strip().lower()
    return next((f"{word} " for word, _ in C.COLUMN_KEYWORDS if word in lowered), "")


#: Between the cells of a row: words that mean nothing, more than any rule looks across.
CELL_GAP = "\n" + f"{GAP} " * (C.WIDE_WINDOW // 2 + 10) + "\n"


def sanitize_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Sanitise the string columns whose names may hold personal data.

    The cells of a row are scanned as one text, each behind the keyword of its column, and cut
    apart again: one bank is planned, whatever the number of columns, and a row stays where it is.
    Gaps of marker characters keep cells out of each other's context. Other columns are passed
    through untouched and need not even be read by the job that writes the result.
    """
    wanted = [
        f.name for f in df.schema.fields
        if f.dataType.simpleString() == "string"
        and (f.name in columns if columns is not None else column_class_of(f.name) is not None)
    ]
    if not wanted:
        return df
    cells = [F.concat(F.lit(column_context(n)), F.coalesce(F.col(f"`{n}`"), F.lit(""))) for n in wanted]
    done = sanitize_text(df.withColumn("_cells", F.concat_ws(CELL_GAP, *cells)), "_cells", "_clean")
    # An array column, not an expression repeated for every column.
    done = done.withColumn("_parts", F.split("_clean", rf"\Q{CELL_GAP}\E", -1))

    def cell(k: int, name: str) -> Column:
        own = F.get(F.col("_parts"), F.lit(k))
        return F.when(F.col(f"`{name}`").isNotNull(), F.substring(own, F.lit(len(column_context(name)) + 1), F.length(own)))

    place = {n: k for k, n in enumerate(wanted)}
    return done.select(*[cell(place[n], n).alias(n) if n in place else F.col(f"`{n}`") for n in df.columns])
