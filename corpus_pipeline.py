"""From raw documents to token ids: quality rules, line dedup, near duplicates, benchmark passages, BPE.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. ``run``
writes each stage's result to the shared folder and reads it back for the next. All stages
but the last return the columns of ``documents``, with ``text`` and ``n_chars`` renewed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import bpe, decontaminate, jaccard, quality_rules, templates
from veilspark.llm.blocks import restored, split_by, store
from veilspark.llm.queries import vocabulary_text

#: Near duplicates share 80 percent of their five-word shingles; a document with more than this percent of its words in test items goes.
SHINGLE_WORDS, SIMILAR_PERCENT, MAX_COVERED = 5, 80, 50


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their failed lines."""
    found = quality_rules.clean(docs, carry=True).where("kept")
    return restored(found, docs, "text", "clean_text")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of recurring templates."""
    return restored(templates.drop_recurring_lines(docs, carry=True), docs, "text", "clean_text")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group; of rows with equal id and text one. Rows without an id stay."""
    found = store(jaccard.similar(docs, words=SHINGLE_WORDS, percent=SIMILAR_PERCENT), "similar")
    rows = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count_if(F.expr("doc_id = component_id")).alias("rows")).withColumnRenamed("doc_id", "other_id")
    others = store(rows.where("rows <> 1"), "others")  # few: the documents that go, and those of repeated rows
    marked, rest = split_by(docs, F.col("doc_id"), F.col("other_id"), others)
    own = F.col("d.doc_id") == F.col("k.other_id")  # aliases: the documents may have a column of that name
    single = marked.alias("d").join(others.alias("k"), own, "left_anti")
    repeated = marked.alias("d").join(others.where("rows > 1").alias("k"), own, "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.unionByName(single).unionByName(repeated)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of test items; those that are mostly such passages go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(docs, benchmark, with_text=True, carry=True)
    return restored(found.where(F.col("n_hit") * 100 <= F.col("n_words") * MAX_COVERED), docs, "text", "clean_text")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a hash of the text they decode to."""
    return bpe.encode(docs, vocabulary_text(), with_decoded=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe_encoding", encoding_stage),
]

#: SQL cannot merge byte pairs; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
