"""Labelled rows for training: who may be learnt from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import rows_of

#: Rows whose crc32(id as text) mod FOLDS is HELD_OUT are never learnt from.
FOLDS, HELD_OUT = 3, 1


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % FOLDS == HELD_OUT


def sample(docs: DataFrame, labels: DataFrame, target: str, rows: int, id_col: str, text_col: str) -> DataFrame:
    """About ``rows`` labelled documents that are not held out, as ``id``, ``text``, ``label`` and ``turn``.

    All are taken if there are no more; else those with the smallest hashes of their id, by a
    threshold from the count, so the expected number is ``rows`` and the choice is the same at
    every partitioning. Null labels and ids are left out; an id with several labels counts
    with the largest. ``turn`` is the order in which to learn.
    """
    known = labels.where(F.col(target).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(f"`{id_col}`").alias("id")).agg((F.max(target) > 0).cast("int").alias("label")).withColumn("turn", F.xxhash64("id"))
    share = min(1.0, rows / max(1, known.count()))
    known = known.where(F.shiftright("turn", 11) < F.lit(int(share * 2**53) - 2**52))
    return rows_of(docs, id_col, text_col).join(F.broadcast(known), "id")
