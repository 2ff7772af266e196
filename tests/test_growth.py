"""Work that must not grow faster than the input: what is read, moved and tested how often."""

import glob
import random
import re

import pytest
from pyspark.sql import functions as F

from veilspark.operators import audit
from veilspark.operators.patterns import BANK
from veilspark.plans.catalog import lifecycle
from veilspark.functions.crypto import _remainder, fpe_encrypt
from veilspark.functions.text import find_all, part_of, stretches
from veilspark.sources.text_files import scan_pieces, text_pieces


@pytest.mark.parametrize("rec", [r for r in BANK if r.entity_type != "EMAIL_ADDRESS"], ids=lambda r: f"{r.entity_type}-{r.regex[:12]}")
def test_first_characters_are_tested_first_and_change_no_match(spark, rec):
    flags, first, rest = re.fullmatch(r"(\(\?i\))?(\(\?=(?:\[[^\]]*\]|\w)\))(.*)", rec.regex, re.S).groups()
    assert first
    texts = [
        "call +91 98765 43210, (555) 010-4444 or 098-7654321; SSN 123-45-6789 at 10.0.0.1 and fe80::1:2 on 2024-01-31 or 3 Mar 2020, May 5, 2021",
        "https://a.example/x?y PAN ABCPE1234F aadhaar 2345 6789 0124 234567890124 card 4111 1111 1111 1111 fp_hash_00ffaa12 iris_hash_abcdef Quarterly SEMI-ANNUAL nightly",
        "Priya Sharma éPriya Sharma x1.2.3.4 +915551234567 Overnight Sept 1 2020 12/12/2012 1.2.2020 voice_hash_123456 retina_hash_123456 bio_hash_abcdef face_tmp_abcdef", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    every = lambda regex: F.regexp_extract_all("text", F.lit(f"({regex})"), F.lit(1))
    got = rows.select(every(rec.regex).alias("with"), every((flags or "") + rest).alias("without")).collect()
    assert all(r["with"] == r["without"] for r in got)
    assert any(r["with"] for r in got)


def test_text_files_are_cut_in_one_pass(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one line\n" * 50)
    pieces = text_pieces(spark, str(tmp_path))
    assert pieces._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert [r["core"] for r in pieces.collect()] == ["one line\n" * 50]


def test_windows_of_a_long_text_are_taken_from_its_stretches(spark):
    texts = ["", "a\nb", "x" * 1024, "é𝔘\r\n漢字 " * 700, "y" * 1023 + "\u2028" + "z" * 2000]
    places = [(0, 0), (0, 5), (1000, 60), (1023, 2), (1024, 1), (2040, 3000), (2500, 9)]
    df = spark.createDataFrame([(t, a, n) for t in texts for a, n in places], "text string, a int, n int")
    cut = df.select("text", "a", "n", stretches(F.col("text")).alias("cut"))
    for r in cut.select("*", part_of(F.col("cut"), F.col("a"), F.col("n")).alias("part")).collect():
        assert r["part"] == r["text"][r["a"]:r["a"] + r["n"]]
        assert "".join(r["cut"]) == r["text"] and all(len(s) == 1024 for s in r["cut"][:-1])


def test_a_piece_is_measured_once_not_for_each_span(spark):
    """A walk over the piece for each of its spans makes the time grow with their product."""
    pieces = spark.createDataFrame([("f", 70, "ab é\n", "mail ann@example.com\n" * 3, "phone +91 98765 43210")], "file string, offset long, lead string, core string, follow string")
    found = scan_pieces(pieces)
    moved = found._jdf.queryExecution().analyzed().toString().splitlines()[1]
    assert "length(lead" in moved and "length(" not in moved[moved.index("lambdafunction("):]
    assert [(s["start_pos"], s["end_pos"]) for s in found.first()["spans"]] == [(75 + 21 * k, 90 + 21 * k) for k in range(3)]


def test_pieces_between_matches_are_measured_once(spark):
    df = spark.createDataFrame([("12 a 34 b",), ("none",), ("",), ("7",)], "text string")
    found = df.select(find_all("text", "[0-9]+").alias("m"))
    assert [[tuple(m) for m in r["m"]] for r in found.collect()] == [[(0, 2, "12"), (5, 7, "34")], [], [], [(0, 1, "7")]]
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("instr(") == 0 and plan.count("regexp_replace(") == 1


def test_remainders_of_sixteen_bytes_need_no_decimals(spark):
    rnd = random.Random(3)
    numbers = [0, 1, (1 << 128) - 1, 1 << 127, (1 << 64) - 1, 1 << 64, *(rnd.getrandbits(128) for _ in range(200))]
    rows = [(n.to_bytes(16, "little").hex().upper() + "FF" * 16, 10 ** (k % 8 + 3), n % 10 ** (k % 8 + 3)) for k, n in enumerate(numbers * 8)]
    df = spark.createDataFrame(rows, "h string, m long, want long")
    assert df.where(_remainder(F.col("h"), F.col("m")) != F.col("want")).count() == 0
    sealed = fpe_encrypt(spark.createDataFrame([("1234567890",)], "d string"), "d", "e", "00" * 32, "00" * 7)
    assert "decimal" not in sealed._jdf.queryExecution().analyzed().toString()


def test_entries_are_hashed_before_their_links_are_joined(spark):
    log = spark.createDataFrame([(1, "l", n, str(n), "u", "a", "d") for n in range(4)], "chain_id long, lane string, ord long, timestamp string, user string, action string, details string")
    chain = audit.append(log).withColumn("action", F.when(F.col("seq") == 2, "X").otherwise(F.col("action")))
    found = audit.checked(chain).select("chain_id", "lane", "seq", "failure")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("sha2(")
    assert sorted((r["seq"], r["failure"]) for r in found.collect()) == [(0, None), (1, None), (2, "hash"), (3, None)]


def test_a_batch_of_the_stream_has_a_file_for_each_core(spark, tmp_path):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    folder = lifecycle.sinks.shared_folder(spark)
    before = set(glob.glob(f"{folder}/arrivals-*"))
    lifecycle._arrivals(spark, str(tmp_path))
    (own,) = set(glob.glob(f"{folder}/arrivals-*")) - before
    assert len(glob.glob(f"{own}/*.parquet")) == 4 * spark.sparkContext.defaultParallelism
    assert spark.read.parquet(own).count() == 2000
