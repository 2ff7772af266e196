"""Text files in ranges and pieces of any size, against the same text as a whole."""

import os
import random

import pytest

from veilspark.operators.sanitize import scan_spans
from veilspark.operators.spans import explode_spans
from veilspark.sources.sinks import new_path
from veilspark.sources.text_files import scan_pieces, text_pieces

LINES = ["mail ann@example.com now", "", "call +91 98765 43210", "Aadhaar 2234 5678", "9018 is hers", "order reference only:", "9876543210", "é" * 70, "card 3056 930902 5904", "ssn 123-45-6789", "x " * 40]


def text_of(seed, n):
    rnd = random.Random(seed)
    return "\n".join(rnd.choice(LINES) for _ in range(n)) + rnd.choice(["", "\n"])


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "900", "spark.sql.files.openCostInBytes": "1"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


def test_pieces_give_the_spans_of_the_whole(spark, small_ranges):
    texts = [text_of(k, n) for k, n in enumerate((400, 90, 1, 30, 0))] + ["a" * 5000 + " b@c.org\n" + text_of(9, 50)]
    path = new_path(spark, "texts")
    os.makedirs(path)
    for k, text in enumerate(texts):
        with open(f"{path}/{k}.txt", "wb") as f:
            f.write(text.encode("utf-8"))
    with open(f"{path}/latin.txt", "wb") as f:
        f.write("café ann@example.com\n".encode("latin-1") * 100)
    pieces = text_pieces(spark, path, piece=700, around=300)
    assert pieces.rdd.getNumPartitions() > 20
    names = lambda r: os.path.basename(r["file"])
    cores = sorted((names(r), r["offset"], r["core"], r["lead"], r["follow"]) for r in pieces.collect())
    every = {f"{k}.txt": t for k, t in enumerate(texts) if t} | {"latin.txt": "café ann@example.com\n" * 100}
    assert {n: "".join(c for m, _, c, _, _ in cores if m == n) for n in every} == every
    for n, at, core, lead, follow in cores:
        assert every[n][at:at + len(core)] == core and lead == every[n][max(0, at - 300):at] and every[n][at + len(core):].startswith(follow)
        assert len(follow) == min(300, len(every[n]) - at - len(core))
    got = sorted((names(r), r["start_pos"], r["end_pos"], r["entity_type"], r["score"]) for r in explode_spans(scan_pieces(pieces), ["file"]).collect())
    docs = spark.createDataFrame(list(every.items()), "file string, text string")
    want = sorted((r["file"], r["start_pos"], r["end_pos"], r["entity_type"], r["score"]) for r in explode_spans(scan_spans(docs), ["file"]).collect())
    assert got == want and len(want) > 200
