"""Derived views the queries run on, in SQL that two engines read alike.

``kyc`` turns every customer into a text with valid and invalid identifiers,
``pipe_tables`` and ``sql_dumps`` pack 60 of them into a table or dump,
``entities_fx`` reads line items as spans, ``files_fx`` reads orders as files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators.audit import lane_of

KYC = """
SELECT k AS doc_id,
 concat('Name: ', fn, ' ', ln, chr(10), 'Email: ', em, chr(10), 'Phone: ', ph, chr(10),
        'Aadhaar: ', aad, chr(10), 'PAN: ', pan, chr(10), 'Credit Card: ', cc, chr(10), 'SSN: ', ssn, chr(10),
        'IP: ', ip, ' URL: https://site', CAST(k % 50 AS VARCHAR(9)), '.example.com/u/', CAST(k AS VARCHAR(9)), chr(10),
        'Joined: ', dt, ' Frequency: quarterly', chr(10), 'Device: ', bio, chr(10),
        'Transaction ID: ', txn, ' Place: ', n_name) AS text,
 fn, ln, em, ph, aad, pan, cc, ssn, ip, dt, bio, txn, n_name, n_nationkey
FROM (
 SELECT c_custkey AS k, n_name, n_nationkey,
  CASE c_custkey % 6 WHEN 0 THEN 'Priya' WHEN 1 THEN 'Rajesh' WHEN 2 THEN 'Walter' WHEN 3 THEN 'Neha' WHEN 4 THEN 'Olga' ELSE 'Amit' END AS fn,
  CASE c_custkey % 5 WHEN 0 THEN 'Sharma' WHEN 1 THEN 'Kumar' WHEN 2 THEN 'Kowalski' WHEN 3 THEN 'Patel' ELSE 'Berg' END AS ln,
  concat('cust', CAST(c_custkey AS VARCHAR(9)), '@example.com') AS em,
  concat('+91 9', lpad(CAST((c_custkey * 6151 + 17) % 1000000000 AS VARCHAR(12)), 9, '0')) AS ph,
  concat(substr(a11,1,4), ' ', substr(a11,5,4), ' ', substr(a11,9,3), CAST(c_custkey % 10 AS VARCHAR(2))) AS aad,
  concat(chr(CAST(65 + c_custkey % 26 AS INT)), chr(CAST(65 + (c_custkey * 5) % 26 AS INT)), chr(CAST(65 + (c_custkey * 7) % 26 AS INT)),
         substr('ABCFGHLJPTQX', CAST(c_custkey % 12 + 1 AS INT), 1), chr(CAST(65 + (c_custkey * 11) % 26 AS INT)),
         lpad(CAST(c_custkey % 10000 AS VARCHAR(5)), 4, '0'), chr(CAST(65 + (c_custkey * 3) % 26 AS INT))) AS pan,
  concat('4', lpad(CAST((c_custkey * 1234567891 + 99) % 1000000000000000 AS VARCHAR(16)), 15, '0')) AS cc,
  concat(lpad(CAST(c_custkey % 1000 AS VARCHAR(4)),3,'0'), '-', lpad(CAST(c_custkey % 100 AS VARCHAR(3)),2,'0'), '-', lpad(CAST((c_custkey * 37) % 10000 AS VARCHAR(5)),4,'0')) AS ssn,
  concat('10.', CAST(c_custkey % 300 AS VARCHAR(4)), '.', CAST((c_custkey * 7) % 256 AS VARCHAR(4)), '.1') AS ip,
  concat('20', lpad(CAST(c_custkey % 25 AS VARCHAR(3)),2,'0'), '-', lpad(CAST(c_custkey % 12 + 1 AS VARCHAR(3)),2,'0'), '-', lpad(CAST(c_custkey % 28 + 1 AS VARCHAR(3)),2,'0')) AS dt,
  concat('fp_hash_', substr(h, 1, 16)) AS bio,
  CAST(2000000000 + c_custkey * 104729 AS VARCHAR(12)) AS txn
 FROM (SELECT c_custkey, n_name, n_nationkey,
        CAST(20000000000 + (c_custkey * 48271 * 1009 + 11) % 80000000000 AS VARCHAR(12)) AS a11,
        <sha>(CAST(c_custkey AS VARCHAR(12))<bits>) AS h
       FROM <customer> JOIN <nation> ON c_nationkey = n_nationkey) b) t
"""

# Header, divider, data rows and a column that holds no personal data.
PIPE_TABLES = """
SELECT CAST(floor(doc_id / 60) AS BIGINT) AS doc_id,
 concat('| Name             | Aadhaar Number | Email                   | Serial     |', chr(10),
        '|------------------|----------------|-------------------------|------------|', chr(10),
        <agg>(concat('| ', rpad(concat(fn,' ',ln),16,' '), ' | ', aad, ' | ', rpad(em,23,' '), ' | ', txn, ' |')<by>)) AS text
FROM <kyc> GROUP BY CAST(floor(doc_id / 60) AS BIGINT)
"""

# DDL, one INSERT per customer with parentheses inside a literal, DDL.
SQL_DUMPS = """
SELECT CAST(floor(doc_id / 60) AS BIGINT) AS doc_id,
 concat('CREATE TABLE customers (id INT, name VARCHAR(50), email VARCHAR(80), note TEXT);', chr(10),
        <agg>(concat('INSERT INTO customers VALUES (', CAST(doc_id AS VARCHAR(9)), ', ', chr(39), fn, ' ', ln, chr(39), ', ', chr(39), em, chr(39), ', ', chr(39), 'contact (phone ', ph, ') PAN ', pan, chr(39), ');')<by>),
        chr(10), 'ALTER TABLE customers ADD COLUMN dept VARCHAR(10);') AS text
FROM <kyc> GROUP BY CAST(floor(doc_id / 60) AS BIGINT)
"""

ENTITIES = """
SELECT l_orderkey AS doc_id,
 CASE l_partkey % 12 WHEN 0 THEN 'IN_AADHAAR' WHEN 1 THEN 'US_SSN' WHEN 2 THEN 'CREDIT_CARD' WHEN 3 THEN 'IN_PAN' WHEN 4 THEN 'PHONE_NUMBER'
  WHEN 5 THEN 'EMAIL_ADDRESS' WHEN 6 THEN 'IP_ADDRESS' WHEN 7 THEN 'LOCATION' WHEN 8 THEN 'DATE_TIME' WHEN 9 THEN 'URL' WHEN 10 THEN 'PERSON' ELSE 'BIOMETRIC_HASH' END AS entity_type,
 CAST((l_suppkey * 13 + l_linenumber * 97) % 1500 AS INT) AS start_pos,
 CAST((l_suppkey * 13 + l_linenumber * 97) % 1500 + 8 + l_partkey % 12 AS INT) AS end_pos,
 CAST(40 + l_partkey % 60 AS DOUBLE) / 100 AS score, l_linenumber AS ord
FROM <lineitem>
"""

FILES = """
SELECT o_orderkey AS doc_id, concat('file_', CAST(o_orderkey AS VARCHAR(12)), CASE o_orderkey % 7 WHEN 0 THEN '.TXT' WHEN 1 THEN '.csv' WHEN 2 THEN '.sql' WHEN 3 THEN '.pdf' WHEN 4 THEN '.docx' WHEN 5 THEN '.png' ELSE '.exe' END) AS filename,
 concat('user', CAST(o_custkey AS VARCHAR(12))) AS uploaded_by, o_orderdate AS uploaded_at,
 CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'failed' END AS status
FROM <orders>
"""

# Files of every route: texts, drawn tables under two extensions, dumps, and files nobody can read.
MIXED = """
SELECT doc_id * 4 AS doc_id, concat('kyc_', CAST(doc_id AS VARCHAR(9)), '.txt') AS filename, text FROM <kyc>
UNION ALL SELECT doc_id * 4 + 1, concat('table_', CAST(doc_id AS VARCHAR(9)), CASE WHEN doc_id % 2 = 0 THEN '.CSV' ELSE '.sql' END), text FROM <tabs>
UNION ALL SELECT doc_id * 4 + 2, concat('dump_', CAST(doc_id AS VARCHAR(9)), '.sql'), text FROM <dumps>
UNION ALL SELECT doc_id * 4 + 3, concat('tool_', CAST(doc_id AS VARCHAR(9)), '.exe'), text FROM <kyc> WHERE doc_id % 10 = 0
"""

SPARK = {"<sha>": "sha2", "<bits>": ", 256", "<agg>": "string_agg",
         "<by>": ", chr(10)) WITHIN GROUP (ORDER BY doc_id"}
DUCKDB = {"<sha>": "sha256", "<bits>": "", "<agg>": "string_agg", "<by>": ", chr(10) ORDER BY doc_id"}


def duckdb_sql(template: str) -> str:
    for token, text in DUCKDB.items():
        template = template.replace(token, text)
    for name in ("customer", "nation", "kyc", "lineitem", "orders", "tabs", "dumps"):
        template = template.replace(f"<{name}>", name)
    return template


def _spark(spark: SparkSession, template: str, **tables: DataFrame) -> DataFrame:
    for token, text in SPARK.items():
        template = template.replace(token, text)
    for name in tables:
        template = template.replace(f"<{name}>", "{" + name + "}")
    return spark.sql(template, **tables)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy text work at least one partition per core.

    Only small inputs in few files are moved; anything that already has enough
    splits is read where it lies.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def kyc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, KYC, customer=spread(load(spark, sf_dir, "customer")),
                  nation=load(spark, sf_dir, "nation"))


def pipe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, PIPE_TABLES, kyc=kyc(spark, sf_dir))


def sql_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, SQL_DUMPS, kyc=kyc(spark, sf_dir))


def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, MIXED, kyc=kyc(spark, sf_dir), tabs=pipe_tables(spark, sf_dir), dumps=sql_dumps(spark, sf_dir))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, ENTITIES, lineitem=load(spark, sf_dir, "lineitem"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, FILES, orders=load(spark, sf_dir, "orders"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "documents").select("doc_id", "text"))


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as audit entries, chained per user and lane."""
    return load(spark, sf_dir, "events").select(
        F.col("user_id").alias("chain_id"),
        F.struct("ts", "event_id").alias("ord"),
        F.col("event_id").cast("string").alias("timestamp"),
        F.col("user_id").cast("string").alias("user"),
        F.col("event_type").alias("action"),
        F.lit("d").alias("details"),
        lane_of(F.col("ts"), F.col("event_id")).alias("lane"),
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kyc texts as positioned and timed words."""
    base = kyc(spark, sf_dir).select(
        "doc_id", F.lit(0).alias("page"), F.posexplode(F.split("text", r"[ \n]+")).alias("word_no", "word"))
    n = F.col("word_no")
    return base.select(
        "doc_id", "page", "word_no", "word",
        (n % 12 * 10).alias("x0"), (F.floor(n / 12) * 14).cast("int").alias("y0"),
        (n % 12 * 10 + 9).alias("x1"), (F.floor(n / 12) * 14 + 12).cast("int").alias("y1"),
        (n * 400).alias("start_ms"), (n * 400 + 30 + n % 40 * 10).alias("end_ms"))
