"""Stored scans are seen whole or not at all; every path of a scan is logged as what it was."""

import pytest

from veilspark.plans import scan
from veilspark.plans.catalog.crypto import TEST_KEYS
from veilspark.sources import sinks

FILES = [
    (1, "a.TXT", "mail ann@example.com"), (2, "b.sql", "INSERT INTO t VALUES ('bob@example.com');\n-- x"), (3, "c.exe", "cid@example.com"), (4, "d.txt", None), (5, "e.sql", ""),
    (6, "f.csv", "| Name | Email |\n|------|-------|\n| Priya Sharma | p@q.org |\n| Amit Kumar | r@s.org |"), (7, "g.pdf", "card 4111 1111 1111 1111"), (8, None, "no name e@f.org")]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "doc_id long, filename string, text string")


def test_paths_and_their_sanitisers(files):
    got = {r["doc_id"]: r for r in scan.scan_files(files).collect()}
    assert {i: r["path"] for i, r in got.items()} == {1: "text", 2: "dump", 3: "rejected", 4: "text", 5: "dump", 6: "table", 7: "text", 8: "rejected"}
    assert got[2]["masked_text"] == "INSERT INTO t VALUES ('[REDACTED_EMAIL]');\n-- x" and got[2]["entity_count"] == 1
    assert "p@q.org" not in got[6]["masked_text"] and "Priya" not in got[6]["masked_text"] and (got[6]["entity_count"], got[6]["threat_level"]) == (0, "LOW")
    assert got[3]["masked_text"] is None and got[3]["error_message"] == "Unsupported file format: .exe"
    assert len(got) == len(FILES)


def test_a_scan_is_published_at_once(spark, files, monkeypatch):
    path = sinks.new_path(spark, "scan")
    with monkeypatch.context() as broken, pytest.raises(RuntimeError):
        broken.setattr(scan, "scan_trail", lambda docs: (_ for _ in ()).throw(RuntimeError("lost")))
        scan.store_scan(files, path, *TEST_KEYS)
    with pytest.raises(LookupError):
        sinks.published(spark, path, "documents")
    scan.store_scan(files, path, *TEST_KEYS)
    assert sinks.published(spark, path, "documents").count() == len(FILES)
    steps = {(r["doc_id"], r["action"]) for r in sinks.published(spark, path, "audit_logs").collect()}
    assert {(2, "SQL_SANITIZE"), (6, "TABLE_SANITIZE"), (1, "ENCRYPT")} <= steps and not {i for i, _ in steps} & {3, 8}
    scan.store_scan(files.where("doc_id = 1"), path, *TEST_KEYS)
    assert sinks.published(spark, path, "documents").count() == len(FILES) + 1
