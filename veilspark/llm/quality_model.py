"""Quality classifier: supervised subword embeddings with a softmax output.

A text is the mean of the vectors of its n-grams: its words, its pairs of words and the
runs of 3 and 5 bytes inside its text, hashed to ``BUCKETS`` vectors of ``DIM`` numbers. Vectors and the output
layer are learnt together by stochastic gradient descent in numpy, on a bounded sample
(``SAMPLE_ROWS`` labelled rows) in one task, after the n-grams were hashed in parallel.

With two classes the softmax of a mean of vectors is the logistic of a mean of numbers, one
for each bucket. So the tasks get one number per bucket, and scoring is a narrow map.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import SPACE, Block, U, cut, hash_spans, id_type, mix, rows_of, spans
from .labels import held_out, sample

BUCKETS, DIM, SAMPLE_ROWS, EPOCHS, RATE = 1 << 17, 8, 5_000, 3, 2.0
BYTE_GRAMS = (3, 5)
THRESHOLD = 0.5


def grams(block: Block) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each kind of n-gram: the buckets, and each document's range of them."""
    buf, starts = block.buf, block.starts
    begin, end = spans(buf, starts, SPACE)
    at = np.searchsorted(begin, starts)
    words = hash_spans(buf, begin, end)
    kinds, bounds = [words], [at]
    if len(words) > 1:
        owner = np.repeat(np.arange(len(block)), np.diff(at))
        same = np.flatnonzero(owner[:-1] == owner[1:])
        kinds.append(mix(words[:-1] * U(3) + words[1:])[same])
        bounds.append(np.searchsorted(same, at))
    wide = buf.astype(U) + U(1)
    for n in BYTE_GRAMS:
        if len(buf) >= n:
            key = np.zeros(len(buf) - n + 1, U)
            for j in range(n):
                key = key * U(0x100000001B3) + wide[j:len(buf) - n + 1 + j]
            size = np.diff(starts)
            ok = np.arange(len(key)) + n <= np.repeat(starts[1:], size)[:len(key)]
            where = np.flatnonzero(ok)
            kinds.append(mix(key[where] + U(n)))
            bounds.append(np.searchsorted(where, starts))
    return [(k & U(BUCKETS - 1)).astype(np.int64) for k in kinds], bounds


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 1) -> tuple[np.ndarray, float]:
    """One number per bucket and the bias, from rows of (distinct buckets, their shares)."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    output, bias = np.zeros((2, DIM)), np.zeros(2)
    balance = len(labels) / np.maximum(1, 2 * np.bincount(labels, minlength=2))
    steps, done = max(1, EPOCHS * len(rows)), 0
    for _ in range(EPOCHS):
        for (buckets, share), y in zip(rows, labels.tolist(), strict=True):
            rate = RATE * (1 - done / steps) * balance[y]
            done += 1
            mean = share @ vectors[buckets]
            logits = output @ mean + bias
            p = np.exp(logits - logits.max())
            g = p / p.sum()
            g[y] -= 1
            back = g @ output
            output -= rate * np.outer(g, mean)
            bias -= rate * g
            vectors[buckets] -= rate * np.outer(share * len(share) ** 0.5, back)
    return vectors @ (output[1] - output[0]), float(bias[1] - bias[0])


def score(block: Block, weights: np.ndarray, bias: float) -> np.ndarray:
    total, count = np.zeros(len(block)), np.zeros(len(block))
    for buckets, bounds in zip(*grams(block), strict=True):
        sums = np.concatenate([[0.0], np.cumsum(weights[buckets])])
        total += np.diff(sums[bounds])
        count += np.diff(bounds)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(1, count) + bias, -35, 35)))


def _row(kinds: list[np.ndarray], bounds: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.concatenate([x[b[k]:b[k + 1]] for x, b in zip(kinds, bounds, strict=True)])
    return np.unique(own, return_counts=True)


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """A number per bucket, and the bias. Without labelled rows all are 0."""
    chosen = sample(docs, labels, target, rows, id_col, text_col).select("turn", "text", "label")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in cut(batches):
            kinds, bounds = grams(block)
            rows = [_row(kinds, bounds, k) for k in range(len(block))]
            packed = [pa.array([r[k].astype("<i4").tobytes() for r in rows], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([block.ids, *packed, block.rest[0]], ["turn", "buckets", "counts", "label"])

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn", kind="stable")
        counts = [np.frombuffer(x, "<i4") for x in pdf["counts"]]
        weights, bias = fit([(np.frombuffer(x, "<i4").astype(np.int64), c / max(1, c.sum())) for x, c in zip(pdf.buckets, counts, strict=True)], pdf.label.to_numpy())
        return pd.DataFrame({"weights": [weights.astype("<f4").tobytes()], "bias": [bias]})

    learnt = chosen.mapInArrow(hashed, "turn long, buckets binary, counts binary, label int").groupBy().applyInPandas(learn, "weights binary, bias double").collect()
    return (np.frombuffer(bytes(learnt[0]["weights"]), "<f4"), learnt[0]["bias"]) if learnt else (np.zeros(BUCKETS, "<f4"), 0.0)


def quality(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` from 0 to 1, ``predicted``.

    Null and empty texts score the bias alone; white space has its runs of bytes. Repeated rows give repeated results. A null id is not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        weights = weights.astype(float)
        for block in cut(batches):
            yield pa.RecordBatch.from_arrays([block.ids, pa.array(score(block, weights, bias))], [id_col, "score"])

    scored = rows_of(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type(docs, id_col)}, score double")
    return scored.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
