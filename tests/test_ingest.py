"""Statements, advice files, streams, schema checks."""

import datetime

import pytest
from pyspark.sql import functions as F

from creditweave import schemas
from creditweave.config import DEFAULT
from creditweave.operators import book
from creditweave.plans import metrics
from creditweave.sources import statements
from creditweave.streaming import ingest


def test_statement_files(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("UTR,Date,Credit Amount,Remitter\nU1,05/01/2026,\"Rs. 1,000.00\",ABC Traders\nU1,05/01/2026,5,ABC\nU2,31-Dec-2025,0,Zen\nU3,bad,5,Zen\nU4,2026-01-06,7.5,\nU5,2026-01-06,7.5,Zen\nU6,2026-01-06,9,Zen\n")
    raw = statements.read_statement(spark, str(path))
    new, bad, summary = statements.load_statement(raw, spark.createDataFrame([("U6",)], "statement_ref string"))
    assert {(r["statement_ref"], r["value_date"], r["payer_name_normalized"]) for r in new.collect()} == {("U1", datetime.date(2026, 1, 5), "abc traders"), ("U5", datetime.date(2026, 1, 6), "zen")}
    assert {r["statement_ref"] for r in bad.collect()} == {"U2", "U3", "U4"}
    s = summary.first()
    assert (s["rows_read"], s["created"], s["skipped"], s["failed"]) == (7, 2, 2, 3)
    with pytest.raises(ValueError, match="amount"):
        statements.map_headers(["UTR", "Date", "Payer"])
    none = raw.limit(0)
    assert statements.load_statement(none, spark.createDataFrame([], "statement_ref string"))[2].first()["rows_read"] == 0


def test_advice_files(spark, tmp_path):
    for name, content in (("a.txt", "naïve INV-00042".encode()), ("b.txt", "caf\xe9".encode("cp1252")), ("c.txt", b"\xef\xbb\xbfmarked"), ("d.txt", b"  "), ("e.pdf", b"%PDF")):
        (tmp_path / name).write_bytes(content)
    got = {r["source_filename"]: r for r in statements.read_advice(spark, str(tmp_path)).collect()}
    assert [got[f"{x}.txt"]["raw_text"] for x in "abc"] == ["naïve INV-00042", "café", "marked"]
    assert got["d.txt"]["error"] == "no text" and got["e.pdf"]["source_type"] == "pdf" and got["a.txt"]["error"] is None


def test_stream_drops_repeats(spark, tmp_path):
    t = datetime.datetime(2026, 1, 1, 10)
    rows = [("U1", t, 100), ("U2", t, 200), ("U1", t + datetime.timedelta(hours=1), 100)]
    source = tmp_path / "in"
    spark.createDataFrame(rows, "statement_ref string, received_at timestamp, amount_paise long").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("statement_ref string, received_at timestamp, amount_paise long").parquet(str(source))
    q = ingest.unique_credits(stream).writeStream.format("memory").queryName("credits").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["statement_ref"] for r in spark.table("credits").collect()) == ["U1", "U2"]


def test_pool_cap_and_window(spark):
    day = datetime.date(2026, 3, 15)
    items = [(n, f"INV-{n:05d}", f"INV{n}", 1, day - datetime.timedelta(days=n), day - datetime.timedelta(days=n - 30), 100) for n in [*range(-25, 0), *range(1, 260)]]
    items = spark.createDataFrame(items, "invoice_id long, invoice_number string, normalized_number string, customer_id long, invoice_date date, due_date date, open_amount_paise long")
    pay = spark.createDataFrame([("U", day, 1, 5)], "statement_ref string, value_date date, customer_id long, amount_paise long")
    got = book.candidate_pool(pay, items, DEFAULT).collect()
    want = sorted((abs(n - 30), f"INV-{n:05d}", n) for n in [*range(-20, 0), *range(1, 211)])[: DEFAULT.max_pool]
    assert [(r["invoice_id"]) for r in sorted(got, key=lambda r: r["pool_rank"])] == [n for _, _, n in want]


def test_running_balance_and_schema(spark):
    pay = spark.createDataFrame([("U1", "a", datetime.date(2026, 1, 2), 5), ("U2", "a", datetime.date(2026, 1, 1), 7)], "statement_ref string, payer_name_normalized string, value_date date, amount_paise long")
    assert {r["statement_ref"]: r["running_paise"] for r in metrics.running_balance(pay).collect()} == {"U1": 12, "U2": 7}
    for name in ("customers", "invoices"):
        assert schemas.empty(spark, name).count() == 0
    bad = schemas.empty(spark, "invoices")
    assert schemas.violations(bad, "invoices").select(F.count("*")).first()[0] == 0
