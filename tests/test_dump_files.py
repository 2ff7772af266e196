"""Dump files read in byte ranges of any size, against the same dump as one text."""

import random

import pytest
from pyspark.sql import functions as F

from veilspark.functions.dump_lexer import Place, line_map, parts, state_after
from veilspark.operators import dumps
from veilspark.sources import dump_files
from veilspark.sources.sinks import new_path

STATEMENTS = [
    "CREATE TABLE t (a INT DEFAULT 'x;y');", "-- don't; INSERT nothing\n", "/* it's\n over; lines */", "INSERT INTO `a b` VALUES ('no');", "UPDATE t SET a = 'p@q.org';",
    "INSERT INTO users (id, mail)\nVALUES -- c\n  \n (1, 'ann@example.com'),\n(2, 'two\nlines; bob@example.com');", "insert into t values('it''s', \"o'k\", 'c\\'d @');", "INSERT INTO t SELECT 'x@y.org';",
    "INSERT INTO\nlong\n(a,\n b)\n VALUES\n" + ",\n".join(f"({i}, 'é{i}@x.org\n{'z' * (i % 40)}', `q'`)" for i in range(60)) + ";", "# plain, don't\n", "\n\n", "-- INSERT INTO old VALUES ('c@d.org');\n", "INSERT INTO t VALUES ('open"]


def dump(seed, n=40):
    rnd = random.Random(seed)
    return "".join(rnd.choice(STATEMENTS[:-1]) + rnd.choice(["", " ", "\n", "\r\n"]) for _ in range(n)) + rnd.choice(["", "\n", STATEMENTS[-1]])


def write(spark, texts):
    """Files named by number, in a folder of the shared one."""
    import os

    path = new_path(spark, "dump-files")
    os.makedirs(path)
    for k, text in enumerate(texts):
        with open(f"{path}/{k}.sql", "w", newline="", encoding="utf-8") as f:
            f.write(text)
    return path


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


def numbered(df):
    return df.withColumn("doc_id", F.regexp_extract("file", r"(\d+)\.sql$", 1).cast("long")).drop("file")


def test_ranges_give_what_the_whole_text_gives(spark, small_ranges):
    texts = [dump(seed) for seed in range(12)] + ["", "x", "INSERT INTO t VALUES ('" + "a\n" * 2000 + "e@f.org');\nSELECT 1;", "a;\n" * 3]
    path = write(spark, texts)
    found = numbered(dump_files.scan_dump(spark, path))
    assert found.rdd.getNumPartitions() > 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = spark.createDataFrame(found.toArrow())
    joined = {r["doc_id"]: r["t"] for r in whole.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "text"))), lambda p: p["text"]), "").alias("t")).collect()}
    assert joined == {k: t for k, t in enumerate(texts) if t}
    for f in (dumps.extract_inserts, dumps.extract_literals):
        columns = sorted(set(f(docs).columns))
        assert sorted(map(tuple, f(whole).select(columns).collect())) == sorted(map(tuple, f(docs).select(columns).collect()))
    clean = {r["doc_id"]: r["t"] for r in dumps.sanitize_parts(whole).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "sanitized"))), lambda p: p["sanitized"]), "").alias("t")).collect()}
    want = {r["doc_id"]: r["sanitized"] for r in dumps.sanitize_dump(docs).collect()}
    assert clean == {k: t for k, t in want.items() if t}
    assert all("@x.org" not in t and "ann@" not in t and "bob@" not in t and "c@d.org" not in t for t in clean.values())


def test_one_insert_spreads_over_tasks(spark, small_ranges):
    rows = ",\n".join(f"({i}, 'u{i}@x.org', 'it''s', NULL)" for i in range(2_000))
    path = write(spark, [f"INSERT INTO t VALUES {rows};\n"])
    literals = dumps.extract_literals(dump_files.scan_dump(spark, path), key="file")
    tasks = literals.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 20 and sum(r["count"] for r in tasks) == 6_000
    plan = literals._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_line_maps_agree_with_single_states(spark):
    lines = sorted({line for seed in range(20) for line in dump(seed).split("\n")} | {"*/ ' /*", "a\\", "'\\", "`'", '"`', "/* -- */ '", "-- '", "it's -- 'x", "/", "-", "*/"})
    maps = spark.createDataFrame([(x,) for x in lines], "line string").select("line", line_map(F.col("line"))).collect()
    assert {r[0]: r[1] for r in maps} == {x: "".join(state_after(s, x) for s in "01234") for x in lines}


def test_heads_may_come_in_pieces():
    head = "UPDATE x /* a */ insert  into `Users` (a, b) -- c\n values  ("
    for cut in range(1, len(head)):
        if head[cut - 1].isspace() or head[cut].isspace():  # pieces are whole lines
            assert Place(7).read(head[:cut]).read(head[cut:]) == Place(24, "", 24, "Users", 6 + len(head))
    for other in ("INSERTED x", "INSERT INTO t SELECT", "INSERT INTO a.b VALUES", "INTO", "'INSERT INTO t VALUES'", "VALUES"):
        assert Place().read(other + " ") == Place(len(other) + 1)
    assert "".join(p.text for p in parts(Place(), 0, dump(3))[1]) == dump(3)
