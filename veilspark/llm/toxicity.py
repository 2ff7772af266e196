"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, word stems (the first bytes of longer words, so
that inflected forms meet), word pairs and pairs with one word between, hashed to ``BUCKETS``. Every coordinate has its own learning rate, and the L1 term leaves
most weights at zero, so the weights that go to the tasks are few and at most BUCKETS.

The model is fitted on a bounded sample (``SAMPLE_ROWS`` labelled rows) whose features are
hashed in parallel; only the passes over the sample run in one task. Scoring is a narrow
map over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import LOWER, NON_ALNUM, Block, U, cut, hash_spans, id_type, mix, rows_of, spans
from .labels import held_out, sample

BUCKETS, SAMPLE_ROWS, EPOCHS = 1 << 18, 12_000, 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.1
STEMS = (4, 5, 6)
THRESHOLD = 0.7


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and pairs of a block, and the document of each (not distinct)."""
    begin, end = spans(block.buf, block.starts, NON_ALNUM)
    at = np.searchsorted(begin, block.starts)
    owner = np.repeat(np.arange(len(block)), np.diff(at))
    words = hash_spans(block.buf, begin, end, LOWER)
    keys, owners = [words], [owner]
    for size in STEMS:
        longer = np.flatnonzero(end - begin > size)
        keys.append(mix(hash_spans(block.buf, begin[longer], begin[longer] + size, LOWER) + U(size)))
        owners.append(owner[longer])
    for gap in (1, 2):
        if len(words) > gap:
            same = owner[:-gap] == owner[gap:]
            keys.append(mix(words[:-gap] * U(2 * gap + 1) + words[gap:])[same])
            owners.append(owner[:-gap][same])
    return (np.concatenate(keys) & U(BUCKETS - 1)).astype(np.int64), np.concatenate(owners)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the buckets and the bias, learnt from rows of distinct buckets in their order."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[at]) > L1, (np.sign(z[at]) * L1 - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    rows = [np.append(r, BUCKETS) for r in rows]
    for _ in range(EPOCHS):
        for r, y in zip(rows, labels.tolist(), strict=True):
            w = weights(r)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            before = n[r]
            after = before + g * g
            z[r] += g - (np.sqrt(after) - np.sqrt(before)) / ALPHA * w
            n[r] = after
    w = weights(slice(None))
    return w[:-1], float(w[-1])


def score(block: Block, weights: np.ndarray, bias: float) -> np.ndarray:
    buckets, owner = features(block)
    value = weights[buckets]
    some = np.flatnonzero(value)
    distinct = np.unique(owner[some] * BUCKETS + buckets[some])
    total = np.bincount(distinct // BUCKETS, weights=weights[distinct % BUCKETS], minlength=len(block)) + bias
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> tuple[dict[int, float], float]:
    """Nonzero weights by bucket, and the bias. Without labelled rows: no weights, bias 0."""
    chosen = sample(docs, labels, target, rows, id_col, text_col).select("turn", "text", "label")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in cut(batches):
            buckets, owner = features(block)
            keys = np.unique(owner * BUCKETS + buckets)
            edges = np.searchsorted(keys, np.arange(len(block) + 1) * BUCKETS)
            rows = [(keys[a:b] % BUCKETS).astype("<i4").tobytes() for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([block.ids, pa.array(rows, pa.binary()), block.rest[0]], ["turn", "features", "label"])

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn", kind="stable")
        weights, bias = fit([np.frombuffer(x, "<i4").astype(np.int64) for x in pdf.features], pdf.label.to_numpy())
        some = np.flatnonzero(weights)
        return pd.DataFrame({"bucket": np.append(some, -1), "weight": np.append(weights[some], bias)})

    learnt = chosen.mapInArrow(hashed, "turn long, features binary, label int").groupBy().applyInPandas(learn, "bucket long, weight double").collect()
    model = {r["bucket"]: r["weight"] for r in learnt}
    return {k: v for k, v in model.items() if k >= 0}, model.get(-1, 0.0)


def toxicity(docs: DataFrame, model: tuple[dict[int, float], float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` from 0 to 1, ``predicted``.

    Null and empty texts score the bias alone. Repeated rows give repeated results. A null id is not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, bias = shared.value
        weights = np.zeros(BUCKETS)
        weights[np.fromiter(some.keys(), np.int64, len(some))] = np.fromiter(some.values(), float, len(some))
        for block in cut(batches):
            yield pa.RecordBatch.from_arrays([block.ids, pa.array(score(block, weights, bias))], [id_col, "score"])

    scored = rows_of(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type(docs, id_col)}, score double")
    return scored.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
