"""The pipeline on sf0.001: each stage against its operator's plain version, and the whole."""

from collections import Counter

import corpus_pipeline
from veilspark.llm.blocks import store

from test_operators import bytes_shuffled, plain_components, plain_hits, plain_quality, texts

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_and_change_what_they_should(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "benchmark_decontamination", "bpe_encoding"]
    quality, lines, near, leaks, encode = (f for _, f in corpus_pipeline.STAGES)

    one = store(quality(spark, docs, SMALL), "one")
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == {i for i, t in texts(docs) if plain_quality(t)[6]}
    two = store(lines(spark, one, SMALL), "two")
    assert two.columns == docs.columns and two.count() == one.count()
    three = store(near(spark, two, SMALL), "three")
    assert Counter(i for i, _ in texts(three)) == Counter(i for i, _, c in plain_components(texts(two), 5, 80) if i == c)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    four = store(leaks(spark, three, SMALL), "four")
    assert {r["doc_id"] for r in four.collect()} == {i for i, n, hit, _ in plain_hits(texts(three), items, 10) if 100 * hit <= 50 * n}
    assert all(not hit for _, _, hit, _ in plain_hits(texts(four), items, 10))
    assert all(r["n_chars"] == len(r["text"]) for r in four.collect())
    five = encode(spark, four, SMALL)
    whole = corpus_pipeline.run(spark, SMALL)
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded_sha256"]) for r in five.collect()) == Counter((r["doc_id"], tuple(r["ids"]), r["decoded_sha256"]) for r in whole.collect())


def test_stages_on_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string"
    good = "A sentence that no rule rejects, since it has words enough and says them only once in all its length of twenty or more."
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (3, good, "en", "s", 1, "x"), (3, good, "en", "s", 1, "x"), (None, good + " Yes.", None, None, None, None), (4, good.upper(), "en", "s", 2, "y")]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SMALL)
            assert docs.columns == table.columns
        kept = sorted((r["doc_id"] or 0, r["n_chars"]) for r in docs.collect())
        assert kept in ([(0, len(good) + 5), (3, len(good))], [])
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == len(kept)


def test_texts_that_stay_are_not_shuffled(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(300))
    rows = [(k, text(k // 2 if k < 20 else k)) for k in range(400)] + [(None, text(500)), (399, text(399)), (398, text(600))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, SMALL)
    assert Counter(tuple(r) for r in kept.collect()) == Counter([r for r in rows[:400] if r[0] >= 20 or r[0] % 2 == 0] + [rows[400], rows[402]])
    assert bytes_shuffled(kept) < 0.4 * sum(len(t) for _, t in rows)
