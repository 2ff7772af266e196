"""Single values with known answers."""

import pytest
from pyspark.sql import functions as F

from veilspark.functions import crypto as c
from veilspark.functions import masking as m
from veilspark.functions.checksums import luhn_valid, verhoeff_valid
from veilspark.functions.text import decode_text
from veilspark.operators.audit import anchors, append, first_break, load_chain, tails, verify
from veilspark.operators.gazetteer import detect_places, place_recognizer
from veilspark.operators.dumps import extract_inserts, extract_literals, sanitize_dump
from veilspark.operators.patterns import aadhaar_valid, ipv6_valid, pan_valid
from veilspark.operators.risk import actions_of, level_of, risk_score
from veilspark.operators.rules import apply_context_rules
from veilspark.operators.sanitize import dual_state, masked_text, sanitize_text, scan_spans
from veilspark.operators.spans import dedup, detect, explode_spans
from veilspark.operators.tables import process_lines, process_table
from veilspark.operators.views import role_projection

AES = "00112233445566778899aabbccddeeff" * 2
FF3_KEY, FF31_KEY = "EF4359D8D580AA4F7F036D6F04FC6A94", "2DE79D232DF5585D68CE47882AE256D6"


def values(spark, items, expr, schema="v string"):
    rows = spark.createDataFrame([(i,) for i in items], schema).select(expr(F.col("v")).alias("r")).collect()
    return [r.r for r in rows]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def found(spark, text, **kw):
    rows = explode_spans(detect(docs(spark, text), **kw), ["doc_id"]).collect()
    return [(r.entity_type, text[r.start_pos:r.end_pos]) for r in rows]


@pytest.mark.parametrize("text, hidden", [
    ("Credit Card: 4111111111111111 123", ["4111111111111111"]), ("4111 1111 1111 1111 12/26", ["4111 1111 1111 1111"]),
    ("amex 3782 822463 10005 1234", ["3782 822463 10005"]), ("Call her at 9876543210", ["9876543210"]), ("mobile 98765 43210", ["98765 43210"]),
    ("ring +91 98765 43210 now", ["+91 98765 43210"]), ("phone 044-28273456", ["044-28273456"]), ("Transaction ID: 9876543210", []),
    ("born 15.03.1990 or 2024/05/06", ["15.03.1990", "2024/05/06"]), ("on March 15, 1990 and 1 Jan 2020", ["March 15, 1990", "1 Jan 2020"]),
    ("3056 930902 5904.", ["3056 930902 5904"]), ("6304 0000 0000 0000 000", ["6304 0000 0000 0000 000"]), ("6759 64982 64384 53", ["6759 64982 64384 53"]),
    ("5018 0000 0009 and 501800000000000009 or 67596498264384533", ["501800000000000009", "67596498264384533"]), ("4111 1111 1111 1111 5500 0000 0000 0004", ["4111 1111 1111 1111", "5500 0000 0000 0004"]),
    ("order 71111111111111110, stamp 1700000000004", []), ("a4111111111111111 4111111111111111b", []),
    ("4111111111111112 fails its check digit", [])])
def test_formats_that_people_write(spark, text, hidden):
    rows = explode_spans(apply_context_rules(dedup(detect(docs(spark, text)))), ["doc_id"]).collect()
    assert sorted(r.value for r in rows) == sorted(hidden)


def test_many_matches_in_one_text(spark):
    """Offsets, choice and rewriting stay right over many blocks, and far from quadratic."""
    import time

    took = []
    for n in (5_000, 20_000):
        text = " ".join(f"u{k}@mail.example.org é" for k in range(n))
        start = time.perf_counter()
        clean = sanitize_text(docs(spark, text)).collect()[0]
        took.append(time.perf_counter() - start)
        assert clean.sanitized == " ".join(["[REDACTED_EMAIL] é"] * n)
    assert took[1] < 8 * took[0] + 2


def test_verhoeff(spark):
    good = ["223456789018", "334567890126", "445678901233"]
    bad = ["234567890123", "482173916625", "794266183450", "665248119073", "861044237815", "", "12a"]
    assert values(spark, good + bad, verhoeff_valid) == [True] * 3 + [False] * len(bad)


def test_aadhaar_rules(spark):
    good = ["2234 5678 9018", "223456789018"]
    bad = ["023456789012", "123456789012", "222222222222", "2345678901", "ABCD12345678", "234567890123"]
    assert values(spark, good + bad, aadhaar_valid) == [True] * 2 + [False] * len(bad)


def test_pan_rules(spark):
    items = ["ABCPK1234F", "AAACR5678M", "ABCQK1234F", "EMPPA1234B", "ABCPK1234", "ABCPK1234FF"]
    assert values(spark, items, pan_valid) == [True, True, False, False, False, False]


def test_luhn(spark):
    items = ["4111111111111111", "5425-2334-3010-9903", "5500000000000004", "4532-1234-5678-9012",
             "4111222233334444", "6011000000000000", "0"]
    assert values(spark, items, luhn_valid) == [True, True, True, False, False, False, False]


def test_ipv6(spark):
    assert values(spark, ["2001:db8::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7"], ipv6_valid) == [True, True, False]
    assert found(spark, "from 2001:db8::ff00:42:8329 to ::", types=["IP_ADDRESS"]) == [
        ("IP_ADDRESS", "2001:db8::ff00:42:8329")]


def test_masks(spark):
    assert values(spark, ["john@email.com", "j@x.org", "none"], m.mask_email) == ["j***@email.com", "*@x.org", "[REDACTED]"]
    assert values(spark, ["+91 9876543210", "123"], m.mask_phone) == ["XXXXXXXX3210", "XXX"]
    assert values(spark, ["4111-1111-1111-1234", "4111111111111234"], m.mask_card) == [
        "XXXX-XXXX-XXXX-1234", "XXXXXXXXXXXX1234"]
    assert values(spark, ["2234 5678 9018", "223456789018"], m.mask_aadhaar) == ["XXXX XXXX 9018", "XXXXXXXX9018"]
    assert values(spark, ["ABCPK1234F", "AB"], m.mask_pan) == ["AB*******F", "[REDACTED_PAN]"]


def test_mask_counts_separators(spark):
    assert values(spark, ["4111-1111-1111-1111"], lambda v: m.mask_chars(v, "X", 12)) == ["XXXXXXXXXXXX11-1111"[:12] + "11-1111"]
    assert values(spark, ["2234 5678 9018"], lambda v: m.mask_chars(v, "X", 8)) == ["XXXXXXXX8 9018"]


def test_offsets_are_characters(spark):
    text = "é😀 naïve a.b@c.de, ü 10.0.0.1 ﷐x@y.zz﷑"
    rows = explode_spans(detect(docs(spark, text)), ["doc_id"]).collect()
    # Characters outside the basic plane count as one, as in Python.
    assert [text[r.start_pos:r.end_pos] for r in rows] == ["a.b@c.de", "10.0.0.1", "x@y.zz"]


def test_word_guards(spark):
    assert found(spark, "é123-45-6789 x123-45-6789 123-45-6789.", types=["US_SSN"]) == [("US_SSN", "123-45-6789")]


def test_frequency_words_are_dropped(spark):
    text = "The quarterly billing reconciliation ran overnight on 2024-05-06"
    assert [t for t, _ in found(spark, text, types=["DATE_TIME"])] == ["DATE_TIME"] * 3
    kept = explode_spans(apply_context_rules(detect(docs(spark, text))), ["doc_id"]).collect()
    assert [r.value for r in kept] == ["2024-05-06"]


def test_clean_text(spark):
    text = "The weather is nice today and we will go for a walk."
    row = dual_state(scan_spans(docs(spark, text))).collect()[0]
    assert (row.entity_count, row.masked_text, row.entities) == (0, text, [])


def test_null_and_empty_text(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [(r.doc_id, r.sanitized) for r in sanitize_text(df).orderBy("doc_id").collect()] == [(1, None), (2, "")]


def test_kyc_text(spark):
    text = ("Name: Ananya Kapoor\nEmail: ananya@corp.in\nPhone: +91 9876543210\nAadhaar: 2234 5678 9018\n"
            "PAN: ABCPK1234F\nCredit Card: 5425-2334-3010-9903\nTransaction reference code only: 2345678901")
    out = masked_text(scan_spans(docs(spark, text))).collect()[0].masked_text
    assert out == ("Name: Ananya Kapoor\nEmail: a*****@corp.in\nPhone: XXXXXXXX3210\nAadhaar: XXXX XXXX 9018\n"
                   "PAN: AB*******F\nCredit Card: XXXX-XXXX-XXXX-9903\nTransaction reference code only: 2345678901")


def test_masked_text_holds_no_more_redactable_values(spark):
    text = "a@b.co 4111111111111111 2234 5678 9018 ABCPK1234F 10.1.2.3 2024-01-02 https://x.yz/q 123-45-6789"
    clean = sanitize_text(docs(spark, text)).select("doc_id", F.col("sanitized").alias("text"))
    assert explode_spans(scan_spans(clean), ["doc_id"]).count() == 0


def test_dedup_leaves_disjoint_spans(spark):
    df = spark.sql("""SELECT 1L AS doc_id, from_json('[[0,9,"X",0.5],[0,12,"Y",0.4],[0,12,"IN_Z",0.3],[11,15,"X",1.0],[12,14,"X",0.4]]',
      'array<array<string>>') AS a""").select("doc_id", F.transform("a", lambda x: F.struct(
          x[0].cast("int").alias("start_pos"), x[1].cast("int").alias("end_pos"), x[2].alias("entity_type"),
          x[3].cast("double").alias("score"), F.lit("v").alias("value"))).alias("spans"))
    got = [(r.start_pos, r.end_pos, r.entity_type) for r in explode_spans(dedup(df), ["doc_id"]).collect()]
    assert got == [(0, 12, "IN_Z"), (12, 14, "X")]


def test_aes_round_trip_nonce_and_tamper(spark):
    df = spark.createDataFrame([("Rajesh — 2234 5678 9018",), ("same",), ("same",)], "v string")
    df = df.select("v", c.encrypt_gcm(F.col("v"), AES).alias("s")).persist()
    rows = df.select("v", "s", c.decrypt_gcm(F.col("s"), AES).alias("d")).collect()
    assert all(r.v == r.d for r in rows)
    assert rows[1].s.ciphertext != rows[2].s.ciphertext
    other = df.select(c.is_tampered(F.col("s"), "ff" * 32).alias("t")).collect()
    assert all(r.t for r in other)
    with pytest.raises(ValueError):
        c.encrypt_gcm(F.lit("x"), "00" * 16)


@pytest.mark.parametrize("key,tweak,plain,cipher", [
    (FF3_KEY, "D8E7920AFA330A73", "890121234567890000", "750918814058654607"),
    (FF31_KEY, "CBD09280979564", "3992520240", "8901801106"),
])
def test_ff3_vectors(spark, key, tweak, plain, cipher):
    df = spark.createDataFrame([(plain,)], "d string")
    out = c.fpe_decrypt(c.fpe_encrypt(df, "d", "e", key, tweak), "e", "x", key, tweak).collect()[0]
    assert (out.e, out.x) == (cipher, plain)


def test_fpe_lengths(spark):
    items = ["9" * n for n in range(4, 21)] + ["ABCD1234EFGH"]
    df = spark.createDataFrame([(i,) for i in items], "d string")
    rows = c.fpe_decrypt(c.fpe_encrypt(df, "d", "e", FF31_KEY, "CBD09280979564"), "e", "x", FF31_KEY, "CBD09280979564").collect()
    for r in rows:
        if r.d.isdigit() and 6 <= len(r.d) <= 20:
            assert r.x == r.d and len(r.e) == len(r.d) and r.e != r.d
        else:
            assert r.e is None
    with pytest.raises(Exception, match="more than 20 digits"):
        c.fpe_encrypt(spark.createDataFrame([("9" * 21,)], "d string"), "d", "e", FF31_KEY, "CBD09280979564").collect()


@pytest.mark.parametrize("spans,score,level", [
    ([("PERSON", 0.8)], 0.8, "LOW"),
    ([("EMAIL_ADDRESS", 0.9), ("PHONE_NUMBER", 0.85), ("PERSON", 0.7), ("PERSON", 0.8)], 9.35, "LOW"),
    ([("CREDIT_CARD", 0.95), ("IN_AADHAAR", 0.9), ("IN_PAN", 0.85), ("EMAIL_ADDRESS", 0.8), ("PHONE_NUMBER", 0.8)], 31.55, "HIGH"),
    ([("IN_AADHAAR", 0.95), ("IN_AADHAAR", 0.9), ("CREDIT_CARD", 0.95), ("CREDIT_CARD", 0.9), ("IN_PAN", 0.85),
      ("IN_PAN", 0.8), ("US_SSN", 0.9), ("EMAIL_ADDRESS", 0.8)], 60.55, "CRITICAL"),
])
def test_risk(spark, spans, score, level):
    df = spark.createDataFrame([(1, t, s) for t, s in spans], "doc_id long, entity_type string, score double")
    row = risk_score(df).withColumn("lv", level_of(F.col("risk_score"))).collect()[0]
    assert (row.risk_score, row.lv) == (score, level)


def test_actions(spark):
    got = values(spark, ["LOW", "MEDIUM", "HIGH", "CRITICAL", "??"], lambda v: F.size(actions_of(v)))
    assert got == [3, 4, 5, 6, 3]


def audit_rows(spark, n, lanes=2):
    return spark.range(n).select(
        F.lit(1).cast("long").alias("chain_id"), F.format_string("d/%s", F.col("id") % lanes).alias("lane"), F.col("id").alias("ord"),
        F.col("id").cast("string").alias("timestamp"), F.lit("u").alias("user"), F.lit("A").alias("action"), F.lit("d").alias("details"))


def test_audit_notices_changes_and_losses(spark):
    chain = append(audit_rows(spark, 50)).persist()
    kept = anchors(chain).persist()
    state = lambda df: tuple(verify(df, kept).collect()[0])[1:]
    broken = lambda df: tuple(first_break(df, kept).collect()[0])
    assert state(chain) == (50, True) and first_break(chain, kept).count() == 0
    edited = chain.withColumn("details", F.when(F.col("ord") == 33, "x").otherwise(F.col("details")))
    assert state(edited) == (50, False) and broken(edited) == (1, "d/1", 16, "hash")
    removed = chain.where(F.col("ord") != 4)
    assert state(removed) == (49, False) and broken(removed) == (1, "d/0", 3, "link")
    assert verify(removed).collect()[0].is_valid is False
    shorter = chain.where(F.col("ord") < 48)
    assert state(shorter) == (48, False) and broken(shorter) == (1, "d/0", 24, "anchor")
    assert state(chain.where("lane = 'd/0'")) == (25, False)
    assert state(chain.union(chain.where("ord = 7"))) == (51, False)
    assert not verify(chain, kept.withColumn("details", F.lit("9 x"))).collect()[0].is_valid
    assert verify(chain.limit(0), kept.limit(0)).count() == 0 and tuple(verify(chain.limit(0), kept).collect()[0]) == (1, 0, False)


def test_audit_continues_stored_chains(spark):
    log = audit_rows(spark, 40)
    first = append(log.where("ord < 21"))
    both = first.unionByName(append(log.where("ord >= 21"), tails(first)))
    assert sorted(both.collect()) == sorted(append(log).collect())


def test_audit_of_one_busy_chain(spark):
    """One lane far beyond any batch: one chain whatever its length, in linear time."""
    import hashlib
    import time

    took = []
    for n in (10_000, 40_000):
        start = time.perf_counter()
        rows = append(audit_rows(spark, n, lanes=1)).select("seq", "prev_hash", "entry_hash").collect()
        took.append(time.perf_counter() - start)
        last = "0" * 64
        for k, row in enumerate(sorted(rows)):
            mine = hashlib.sha256(f"{k}|u|A|d|{last}".encode()).hexdigest()
            assert tuple(row) == (k, last, mine)
            last = mine
    assert took[1] < 8 * took[0] + 2


def test_audit_load_keeps_damaged_lines(spark, tmp_path):
    chain = append(audit_rows(spark, 10, lanes=1))
    lines = chain.drop("ord").toJSON().collect()
    kept = anchors(chain)
    whole, damaged = tmp_path / "whole.json", tmp_path / "damaged.json"
    whole.write_text("\n".join(lines))
    damaged.write_text("\n".join([*lines[:-1], lines[-1][:40]]))
    assert [tuple(r) for r in verify(load_chain(spark, str(whole)), kept).collect()] == [(1, 10, True)]
    got = {r.chain_id: (r.entries, r.is_valid) for r in verify(load_chain(spark, str(damaged)), kept).collect()}
    assert got == {1: (9, False), None: (1, False)}


DUMP = (
    "CREATE TABLE users (name VARCHAR(9)); -- 'a@b.co'\n"
    "insert into `users` (name, email)\n VALUES (1, 'John \\'J\\' Doe', 'john@email.com', NULL, 42),\n (2, '', 'x (y@z.org; ok)', 3);\n"
    "ALTER TABLE users ADD COLUMN c TEXT DEFAULT 'q@r.st';\n")


def test_dump(spark):
    df = docs(spark, DUMP)
    assert [r.table_name for r in extract_inserts(df).collect()] == ["users"]
    literals = [r.value for r in extract_literals(extract_inserts(df)).orderBy("literal_start").collect()]
    assert literals == ["John \\'J\\' Doe", "john@email.com", "x (y@z.org; ok)"]
    clean = sanitize_dump(df).collect()[0].sanitized
    assert clean == DUMP.replace("john@email.com", "[REDACTED_EMAIL]").replace("y@z.org", "[REDACTED_EMAIL]")


def test_dump_without_inserts_is_unchanged(spark):
    text = "CREATE TABLE t (a INT);\n-- call 'a@b.co'\n"
    assert sanitize_dump(docs(spark, text)).collect()[0].sanitized == text


def test_long_insert_does_not_exhaust_the_regex_stack(spark):
    rows = ",\n".join(f"({i}, 'u{i}@x.org', 'it''s', NULL)" for i in range(20_000))
    text = f"INSERT INTO t VALUES {rows};"
    clean = sanitize_dump(docs(spark, text)).collect()[0].sanitized
    assert clean.count("[REDACTED_EMAIL]") == 20_000 and "@x.org" not in clean


TABLE = """+------------------+------------------+------------------------+
| Name             | Aadhaar Number   | Email                  |
+------------------+------------------+------------------------+
| Ananya Kapoor    | 2234 5678 9018   | ananya@example.com     |
| Priya Sharma     | 223456789018     | priya.sharma@mail.com  |
+------------------+------------------+------------------------+

  Roll Number: 2345678901"""


def test_table(spark):
    out = process_table(docs(spark, TABLE)).collect()[0].sanitized.split("\n")
    assert out[0:3] == TABLE.split("\n")[0:3]
    assert out[3] == "| [REDACTED_NAME]  | XXXXXXXX8 9018   | ******************     |"
    assert out[4] == "| [REDACTED_NAME]  | XXXXXXXX9018     | *********************  |"
    assert len({len(line) for line in out[:6]}) == 1
    assert out[7] == "  Roll Number: 2345678901" or "2345678901" in out[7]


def test_text_without_table_goes_line_by_line(spark):
    text = "no table here\nmail a@b.co\n\nend"
    expected = "no table here\nmail ******\n\nend"
    assert process_table(docs(spark, text)).collect()[0].sanitized == expected
    assert process_lines(docs(spark, text)).collect()[0].sanitized == expected


def test_decode(spark):
    rows = spark.createDataFrame([(b"caf\xc3\xa9",), (b"caf\xe9",)], "v binary")
    assert [r[0] for r in rows.select(decode_text(F.col("v"))).collect()] == ["café", "café"]


def test_unknown_role_is_refused(spark):
    with pytest.raises(ValueError):
        role_projection("guest", None, None)


NAMES = ["New York", "New York City", "York", "Newcastle upon Tyne", "Federal Islamic Republic of the Comoro Islands", "São Paulo", "a.b c", "St.", "", "*", None]


def test_places_of_any_length(spark):
    text = "New York City, Newcastle upon Tyne; New Yorker York. Federal Islamic Republic of the Comoro Islands São Paulo xYork a.b c a.b d St. New York Federal Islamic"
    want = ["New York City", "Newcastle upon Tyne", "York", "Federal Islamic Republic of the Comoro Islands", "São Paulo", "a.b c", "New York"]
    places = spark.createDataFrame([(n,) for n in NAMES], "name string")
    rows = explode_spans(dedup(detect(docs(spark, text), types=["LOCATION"], bank=[place_recognizer(places)])), ["doc_id"]).orderBy("start_pos").collect()
    assert [r.value for r in rows] == want and all(text[r.start_pos:r.end_pos] == r.value for r in rows)
    joined = {(r.start_pos, r.value) for r in detect_places(docs(spark, text), places).collect()}
    assert joined >= {(r.start_pos, r.value) for r in rows} and all(text[s:s + len(v)] == v for s, v in joined)
    assert place_recognizer(places.limit(0)) is None and detect_places(docs(spark, text), places.limit(0)).count() == 0
