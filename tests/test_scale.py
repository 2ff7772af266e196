"""Plans and hot keys: what must hold when the data is a thousand times larger."""

import random

from pyspark.sql import functions as F

from veilspark.operators import rules as r
from veilspark.operators.spans import SPANS, dedup, dedup_entities, explode_spans
from veilspark.plans import fixtures as fx
from veilspark.plans.scan import scan_corpus

SF_DIR = "/root/testdata/sf0.001"
TYPES = ["PERSON", "PHONE_NUMBER", "EMAIL_ADDRESS", "IN_AADHAAR", "URL"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_does_not_shuffle_text(spark):
    docs = fx.load(spark, SF_DIR, "documents").select("doc_id", "text")
    plan = plan_of(scan_corpus(docs))
    assert "Exchange" not in plan and "Python" not in plan


def test_scan_reads_only_its_columns(spark):
    plan = plan_of(scan_corpus(fx.load(spark, SF_DIR, "documents").select("doc_id", "text")))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_detection_is_planned_once(spark):
    docs = fx.load(spark, SF_DIR, "documents").select("doc_id", "text")
    plan = docs.transform(scan_corpus).select("doc_id", "masked_text", "risk_score", F.explode_outer("spans"))
    assert plan_of(plan).count("fp_hash|face_tmp|face_template|fingerprint|iris_hash") == 1


def hot_spans(spark, seed):
    """A third of all spans in one document, many at the same places."""
    rnd = random.Random(seed)
    rows = []
    for i in range(3_000):
        doc = 0 if rnd.random() < 0.34 else rnd.randrange(1, 60)
        start = rnd.randrange(0, 60_000 if doc == 0 else 6_000)
        rows.append((doc, i, rnd.choice(TYPES), start, start + rnd.randrange(5, 40), rnd.randrange(40, 100) / 100))
    return spark.createDataFrame(rows, "doc_id long, ord int, entity_type string, start_pos int, end_pos int, score double"), rows


def rescored(df):
    return {x.ord: x.score for x in df.collect()}


def test_linkage_rules_match_brute_force(spark):
    for seed in range(3):
        df, rows = hot_spans(spark, seed)
        for target, below, window, floor, fn in [
            ("PHONE_NUMBER", 0.7, 300, 0.85, r.table_name_phone),
            ("IN_AADHAAR", 0.8, 500, 0.95, r.table_name_aadhaar),
        ]:
            people = [x for x in rows if x[2] == "PERSON"]
            want = {}
            for d, i, t, s, e, score in rows:
                near = any(p[0] == d and (abs(s - p[4]) < window or abs(p[3] - e) < window) for p in people)
                want[i] = max(score, floor) if t == target and score < below and near else score
            assert rescored(fn(df)) == want


def test_profile_rule_matches_brute_force(spark):
    for seed in range(3):
        df, rows = hot_spans(spark, seed)
        windows = []
        for d, _, t, s, e, _ in rows:
            if t == "PERSON":
                inside = {x[2] for x in rows if x[0] == d and s - 200 <= x[3] <= e + 1000}
                if "IN_AADHAAR" in inside or {"PHONE_NUMBER", "EMAIL_ADDRESS"} <= inside:
                    windows.append((d, s - 200, e + 1000))
        want = {i: 0.95 if score < 0.9 and any(w[0] == d and w[1] <= s <= w[2] for w in windows) else score
                for d, i, t, s, e, score in rows}
        assert rescored(r.table_profile_escalation(df)) == want


def test_row_and_table_forms_agree(spark):
    df, _ = hot_spans(spark, 7)
    span = F.struct("start_pos", "end_pos", "entity_type", "score", F.col("ord").cast("string").alias("value"))
    packed = df.groupBy("doc_id").agg(F.array_sort(F.collect_list(span)).cast(SPANS).alias("spans"))
    for row_form, table_form in [(r.row_name_phone, r.table_name_phone), (r.row_name_aadhaar, r.table_name_aadhaar),
                                 (r.row_profile_escalation, r.table_profile_escalation)]:
        a = {x.value: x.score for x in explode_spans(row_form(packed), ["doc_id"]).collect()}
        b = {str(k): v for k, v in rescored(table_form(df)).items()}
        assert a == b
    cols = ["doc_id", "start_pos", "end_pos", "entity_type", "score"]
    a = explode_spans(dedup(packed), ["doc_id"]).select(cols).collect()
    b = dedup_entities(df).select(cols).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def one_document(spark, n, seed=1):
    rnd = random.Random(seed)
    rows = [(k, rnd.choice(TYPES), s, s + rnd.randrange(5, 40), rnd.randrange(40, 100) / 100) for k, s in enumerate(sorted(rnd.randrange(0, n * 60) for _ in range(n)))]
    flat = spark.createDataFrame([(0, *x) for x in rows], "doc_id long, ord int, entity_type string, start_pos int, end_pos int, score double")
    spans = F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "entity_type", "score", F.col("ord").cast("string").alias("value")))).cast(SPANS)
    return flat, flat.groupBy("doc_id").agg(spans.alias("spans"))


def test_row_linkage_equals_the_table_form(spark):
    for n in (1, 2, 7, 900):
        flat, nested = one_document(spark, n, n)
        for in_row, in_table in ((r.row_name_phone, r.table_name_phone), (r.row_name_aadhaar, r.table_name_aadhaar), (r.row_profile_escalation, r.table_profile_escalation)):
            got = {int(x.value): x.score for x in explode_spans(in_row(nested), ["doc_id"]).collect()}
            assert got == rescored(in_table(flat))


def test_row_linkage_is_linear(spark):
    import time

    took = []
    for n in (1_000, 10_000, 40_000):
        nested = one_document(spark, n)[1].repartition(1)
        nested.persist().count()
        start = time.perf_counter()
        r.row_profile_escalation(r.row_name_phone(nested)).select(F.sum(F.aggregate("spans", F.lit(0.0), lambda a, s: a + s["score"]))).collect()
        took.append(time.perf_counter() - start)
        nested.unpersist()
    assert took[2] < 8 * took[1] + 2, took


def test_a_hundred_columns_are_planned_at_once(spark):
    import time

    from veilspark.operators.sanitize import sanitize_text
    from veilspark.operators.tables import sanitize_columns

    values = ["ann@example.com", "+91 98765 43210", "ABCPK1234F", "plain", None, "", "4111 1111 1111 1111", "note 2345678"]
    names = [["email", "phone", "pan", "city", "mobile", "remark", "credit card", "contact"][k % 8] + f"_{k}" for k in range(100)]
    df = spark.createDataFrame([tuple(values[(k + r) % 8] for k in range(100)) for r in range(8)], ", ".join(f"`{n}` string" for n in names))
    clean = sanitize_columns(df, names)
    start = time.perf_counter()
    plan_of(clean)
    assert time.perf_counter() - start < 5
    # each cell as it would be alone, behind its column's keyword
    words = {n: next((w + " " for w in ("email", "phone", "pan", "mobile", "credit card") if w in n), "") for n in names}
    alone = sorted({(words[n], v) for n in names for v in values if v})
    single = spark.createDataFrame([(w, v, w + v) for w, v in alone], "word string, value string, text string")
    want = {(r["word"], r["value"]): r["sanitized"][len(r["word"]):] for r in sanitize_text(single).collect()}
    for before, after in zip(df.collect(), clean.collect(), strict=True):
        assert list(after) == [want[words[n], v] if v else v for n, v in zip(names, before, strict=True)]
    assert sum(v != w for (_, v), w in want.items()) > 10
