"""Permutation index against comparison with every vector."""

import math

import numpy as np
import pytest

from veilspark.llm import permutations
from veilspark.llm.queries import QUERIES


def plain_neighbours(rows, k=10, every=100):
    """Every query against every other usable row; equal rows count once."""
    good = {(i, tuple(map(float, v))) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    sizes = {}
    for _, v in good:
        sizes[len(v)] = sizes.get(len(v), 0) + 1
    size = min(sizes, key=lambda n: (-sizes[n], n)) if sizes else 0
    good = [(i, np.array(v)) for i, v in sorted(good) if len(v) == size]
    out = {}
    for i, q in good:
        if i % every == 0:
            near = sorted((math.sqrt(sum((q - v) ** 2)), j) for j, v in good if j != i)[:k]
            out[i] = [(j, d) for d, j in near]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def rows_of(df):
    return [(r["vec_id"], r["embedding"]) for r in df.collect()]


def same(got, want):
    assert {i: [j for j, _ in n] for i, n in got.items()} == {i: [j for j, _ in n] for i, n in want.items() if n}
    assert all(abs(a[1] - b[1]) < 1e-12 for i in got for a, b in zip(got[i], want[i]))


def test_registered_query_finds_the_nearest(spark):
    sf = "/root/testdata/sf0.1"
    got, want = answers(QUERIES["op11_permutation_index"](spark, sf)), plain_neighbours(rows_of(spark.read.parquet(f"{sf}/embeddings.parquet")))
    found = sum(len(set(got[i]) & set(want[i])) for i in want) / sum(map(len, want.values()))
    assert set(got) == set(want) and found >= 0.98, found


def test_recall_of_the_share_alone(spark):
    """Without the extra candidates, in blocks of a thousand and two blocks of queries."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = answers(permutations.neighbours(df, every=20, least=16, most_rows=1000, fewest_rows=1000, most_queries=60))
    want = plain_neighbours(rows_of(df), every=20)
    found = sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want) / sum(map(len, want.values()))
    assert found >= 0.8, found


def test_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=5).astype("float32").tolist()) for i in range(-40, 260)]
    copy = rows[0][1]
    rows += [(i, copy) for i in range(300, 900)] + rows[:30] + [(5, rng.normal(size=5).astype("float32").tolist())]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 5), (1003, [-0.0] * 5), (1004, [1.0, None, 1.0, 1.0, 1.0]), (1005, [float("nan")] * 5), (1006, [float("inf")] + [1.0] * 4),
             (1100, [1.0, 2.0]), (None, [1.0] * 5), (1200, [0.0, 1.0, 0.0, 0.0, 0.0]), (1300, [-0.0, 1.0, 0.0, 0.0, 0.0])]
    schema = "vec_id long, embedding array<float>, h long, v string, id int, score double"
    df = spark.createDataFrame([(*r, 1, "x", 2, 0.5) for r in rows], schema).repartition(7)
    for k in (3, 10):
        same(answers(permutations.neighbours(df, k=k, every=20, least=2000)), plain_neighbours(rows, k, 20))
    doubles = df.selectExpr("vec_id", "cast(embedding as array<double>) embedding")
    same(answers(permutations.neighbours(doubles, every=20, least=2000, fewest_rows=10)), plain_neighbours(rows, 10, 20))


@pytest.mark.parametrize("rows", [[], [(0, None)], [(0, [1.0])], [(1, [1.0]), (2, [2.0])], [(0, [1.0]), (100, [2.0])]])
def test_few_vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    same(answers(permutations.neighbours(df)), plain_neighbours(rows))
