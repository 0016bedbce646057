"""Redaction and its SQL follow one rule on texts where marks and neighbours meet."""

import pytest

duckdb = pytest.importorskip("duckdb")

from tallyspark.functions import redact  # noqa: E402
from tallyspark.plans import jobs, registry  # noqa: E402

TEXTS = [
    "++a.b@c.io/ ..bob@x.org a.+b@c.io", "(555) 234-5678,(555) 234-5678", "x/+1 555 234 5678_(555) 234-5678(5552345678",
    "-4111 1111 1111 1111/4111-1111-1111-1111 4111111111111111", "Account  123456789;Acct.\x0b#\x0b123456789012", "que que QUE the house The  House",
    "555-0100 555-234-5678 555-234-5679\n+1.555.234.5670.", "", None, "info@example.comle de123-45-6789",
]


def test_redaction_equals_its_sql_on_odd_texts(spark):
    rows = list(enumerate(TEXTS))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    done = redact.redact(spark.createDataFrame(rows, "doc_id long, text string"), jobs._CONFIG)
    texts = {r.doc_id: r.redacted for r in done.collect()}
    assert texts == dict(con.execute(registry.ORACLES["redact_text"]).fetchall())
    assert texts[0] == "++EMAIL REDACTED/ ..EMAIL REDACTED EMAIL REDACTED" and texts[1] == "PHONE REDACTED,PHONE REDACTED"
    found = sorted(tuple(r) for r in redact.redactions(done, "doc_id").select("doc_id", "pass_no", "category", "original").collect())
    assert found == sorted(con.execute(f"SELECT doc_id, pass_no, category, original FROM ({registry.ORACLES['redact_report']})").fetchall())
    assert (4, 6, "account_number", "Account  123456789") in found
