"""From character spans to positioned or timed words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 64
MIN_MUTE_MS = 50


def word_offsets(words: DataFrame, keys: list[str]) -> DataFrame:
    """Offsets of each word in the page text (words joined by one blank)."""
    before = Window.partitionBy(*keys).orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0)).cast("int")
    return words.withColumn("char_start", start).withColumn("char_end", start + F.length("word"))


def page_text(words: DataFrame, keys: list[str]) -> DataFrame:
    """The text of every page; its size is that of the page itself."""
    return words.groupBy(*keys).agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("word_no", "word"))), lambda w: w["word"]), " "
        ).alias("text"))


def _buckets(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / BUCKET), F.floor((end - 1) / BUCKET)))


def covered_words(words: DataFrame, entities: DataFrame, keys: list[str]) -> DataFrame:
    """Words that overlap any span, each once.

    Words and spans meet in 64-character buckets of one page, so a page with
    many of both is neither paired off completely nor left to one task.
    """
    placed = words.where(F.length("word") > 0).withColumn("_b", _buckets(F.col("char_start"), F.col("char_end")))
    spans = entities.select(
        *keys, F.col("start_pos").alias("_s"), F.col("end_pos").alias("_e"),
        _buckets(F.col("start_pos"), F.col("end_pos")).alias("_b")).distinct()
    w, e = placed.alias("w"), spans.alias("e")
    same = [F.col(f"w.{k}") == F.col(f"e.{k}") for k in [*keys, "_b"]]
    overlap = (F.col("w.char_start") < F.col("e._e")) & (F.col("w.char_end") > F.col("e._s"))
    cond = overlap
    for c in same:
        cond = cond & c
    return w.join(e, cond, "left_semi").drop("_b").dropDuplicates([*keys, "word_no"])


def redaction_boxes(words: DataFrame, entities: DataFrame, keys: list[str]) -> DataFrame:
    return covered_words(words, entities, keys).select(*keys, "word_no", "x0", "y0", "x1", "y1")


def mute_intervals(words: DataFrame, entities: DataFrame, keys: list[str]) -> DataFrame:
    """Stretches of audio to silence, at least 50 ms long, without repeats."""
    return covered_words(words, entities, keys).select(
        *keys, "start_ms",
        F.greatest(F.col("end_ms"), F.col("start_ms") + MIN_MUTE_MS).alias("end_ms"),
    ).distinct()
