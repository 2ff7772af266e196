"""Nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors. A vector is represented by its ``near`` closest
pivots in order of distance. Vectors are dealt into blocks; in a task each block posts its
rows in one inverted file per pivot, with the pivot's place in the row's order. A query walks
the files of its own pivots and sums, for each row met, what a shared pivot saves of the
footrule distance (places of absent pivots count as ``near``), so only rows that share a pivot
are touched. The rows of smallest footrule distance, ``share`` of the block and ``least`` more,
are compared exactly, and the best of all blocks are merged.

Blocks meet blocks of queries: traffic is (rows x query blocks + queries x row blocks), no row
meets a query outside such a task, and both sides of a task are bounded. Equal vectors have
equal orders, so copies would crowd out other candidates: of each distinct vector only the
k + 1 smallest ids are indexed, which is exact because a query has no use for more, and equal
queries are searched once.

Null ids, null vectors, vectors of zeros or with null or non-finite components take no part,
nor do vectors of another length than the commonest (ties: the shorter). Rows with one id and
one vector count once; each vector of a query's id is asked for. A row is no neighbour of a query with its own id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import store

#: Vectors taken as pivots, at most, and how many of them stand for a vector.
PIVOTS, NEAR = 1024, 64
#: Candidates that are compared exactly in a block: this share of its rows and so many more.
SHARE, LEAST = 0.08, 256
#: Rows of a block: at most, at least, and blocks wanted in between. Queries of a block, at most.
MOST_ROWS, FEWEST_ROWS, BLOCKS, MOST_QUERIES = 65_536, 512, 32, 16_384


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id``, ``v`` and a 128-bit hash ``h``, ``g`` of v, for the rows that take part."""
    kind = vectors.schema[vec_col].dataType.elementType.simpleString()
    kind = "float" if kind == "float" else "double"
    found = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast(f"array<{kind}>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    found = found.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    found = found.withColumn("v", F.transform("v", lambda x: (x + F.lit(0).cast(kind)).cast(kind)))  # no negative zeros
    sizes = found.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").head()
    return found.where(F.size("v") == (sizes["n"] if sizes else 0)).withColumn("h", F.xxhash64("v")).withColumn("g", F.xxhash64(F.lit(7), "v"))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def with_orders(points: DataFrame, pivots: np.ndarray, near: int) -> DataFrame:
    """Add ``p``, the numbers of the nearest pivots of each row as little-endian 16-bit integers (ties: smaller number)."""
    near = min(near, len(pivots))

    def orders(batches):
        lengths = (pivots * pivots).sum(1)
        for batch in batches:
            v = _matrix(batch.column(batch.schema.get_field_index("v")))
            first = np.argsort(lengths[None] - 2 * (v @ pivots.T), axis=1, kind="stable")[:, :near].astype("<u2") if len(v) else np.zeros((0, near), "<u2")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in first], pa.binary())], [*batch.schema.names, "p"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInArrow(orders, f"{fields}, p binary")


def _search(rows: pa.Table, queries: pa.Table, near: int, k: int, share: float, least: int) -> pa.Table:
    """The k nearest rows of one block for each query of another, by footrule distance and then exactly."""
    rows = rows.sort_by("id")
    ids, v = rows["id"].to_numpy(), np.ascontiguousarray(_matrix(rows["v"]).T)
    order, asked = (np.frombuffer(b"".join(t["p"].to_pylist()), "<u2").reshape(t.num_rows, near) for t in (rows, queries))
    n, q = len(ids), _matrix(queries["v"])
    posted = np.argsort(order, axis=None, kind="stable")
    at = np.searchsorted(order.ravel()[posted], np.arange(int(max(order.max(), asked.max())) + 2))
    owner, saved = posted // near, (near - posted % near).astype(np.int64)
    take = min(n, int(n * share) + least)
    lower_first = np.arange(n)[::-1]
    out = ([], [], [])
    for i in range(len(q)):
        total = np.zeros(n, np.int64)
        for place, pivot in enumerate(asked[i]):
            run = slice(at[pivot], at[pivot + 1])
            total[owner[run]] += np.minimum(near - place, saved[run])
        best = np.argpartition(total * n + lower_first, n - take)[n - take:]
        gap = np.take(v, best, axis=1) - q[i][:, None]
        apart = np.sqrt((gap * gap).sum(axis=0))  # components are added in their order
        first = np.lexsort((ids[best], apart))[:k]
        out[0].append(np.full(len(first), i))
        out[1].append(ids[best][first])
        out[2].append(apart[first])
    which = np.concatenate(out[0])
    return pa.table({"h": queries["h"].to_numpy()[which], "g": queries["g"].to_numpy()[which], "vec_id": np.concatenate(out[1]), "score": np.concatenate(out[2])})


def neighbours(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, near: int = NEAR,
               share: float = SHARE, least: int = LEAST, most_rows: int = MOST_ROWS, fewest_rows: int = FEWEST_ROWS, most_queries: int = MOST_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose id is divisible by ``every``.

    ``score`` is the Euclidean distance in double precision; ties go to the smaller vec_id.
    """
    spark = vectors.sparkSession
    shape = "query_id long, rank int, vec_id long, score double"
    clean = usable(vectors, id_col, vec_col)
    same = Window.partitionBy("h", "g").orderBy("id")
    points = clean.withColumn("r", F.dense_rank().over(same)).where(F.col("r") <= k + 1)
    points = store(points.withColumn("was", F.lag("id").over(same)).where("was IS NULL OR was <> id").drop("was"), "points")
    chosen = points.where("r = 1").orderBy("h", "g").limit(pivots).select("v").collect()
    if not chosen:
        return spark.createDataFrame([], shape)
    sample = np.array([r["v"] for r in chosen], np.float64)
    near = min(near, len(sample))
    index = store(with_orders(points.drop("r"), sample, near), "permutations")
    asking = clean.where(F.col("id") % every == 0)
    asked = store(with_orders(asking.groupBy("h", "g").agg(F.any_value("v").alias("v")), sample, near), "asked")
    rows, questions = index.count(), asked.count()
    n_blocks = max(math.ceil(rows / most_rows), min(BLOCKS, math.ceil(rows / fewest_rows)))
    n_parts = max(1, math.ceil(questions / most_queries))
    left = index.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    right = asked.withColumn("part", F.pmod("h", F.lit(n_parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"h": pa.array([], pa.int64()), "g": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return _search(a, b, near, k + 1, share, least)

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(search, "h long, g long, vec_id long, score double")
    best = Window.partitionBy("h", "g").orderBy("score", "vec_id")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    answers = found.groupBy("h", "g").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    salts = 16  # equal queries may be a third of all
    answers = answers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    members = asking.select("id", "h", "g").distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    joined = members.join(answers, ["h", "g", "salt"])
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("id")), 1, k)
    ranked = joined.select("id", F.posexplode(others).alias("at", "x")).select(
        F.col("id").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
    return ranked
