"""Versions of a data set, posting by compare-and-swap, re-runs beside reviews."""

import datetime
import json
import threading

import pytest
from pyspark.sql import functions as F

from creditweave import config, store
from creditweave.operators import ledger
from creditweave.plans import generate
from creditweave.store import Conflict, Store
from tests.test_engine import decide


def small(spark, base=None):
    _, inv, pay, out = decide(spark, [(42, 1, 41850), (43, 1, 1000), (44, 1, 2500)], [(41850, "abc traders", "INV-00042"), (1000, "abc traders", "INV-00043")])
    return inv, pay, out


def test_two_posters_one_wins(spark, tmp_path):
    inv, pay, out = small(spark)
    s = Store(spark, str(tmp_path / "set"))
    assert s.version() == 0 and not s.is_populated() and s.read("match_results").count() == 0
    base = s.publish(0, {"invoices": inv, "bank_transactions": pay})
    results, allocations = ledger.decisions(out, "a")
    won, lost, ready = [], [], threading.Barrier(2)

    def poster(run):
        own = Store(spark, s.folder)
        claim = own._claim
        own._claim = lambda *a: (ready.wait(60), claim(*a))[1]  # both have written their tables before either publishes
        try:
            won.append(ledger.post(own, run, base, results, allocations))
        except Conflict:
            lost.append(run)

    both = [threading.Thread(target=poster, args=(r,)) for r in ("a", "b")]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert won == [base + 1] and len(lost) == 1 and s.version() == base + 1
    assert {r["invoice_id"]: r["open_amount_paise"] for r in s.read("invoices").collect()} == {42: 0, 43: 0, 44: 250000}
    assert {r["status"] for r in s.read("bank_transactions").collect()} == {"matched"}
    assert s.read("audit_log").count() == 2 and s.read("match_results").count() == 2
    assert len(list((tmp_path / "set" / "invoices").iterdir())) == 2  # the loser's folder is gone
    assert s.read("invoices", base).agg(F.sum("open_amount_paise")).first()[0] == 41850_00 + 1000_00 + 2500_00
    with pytest.raises(Conflict):  # the same batch again, from the version it was matched on
        ledger.post(s, "a", base, results, allocations)
    after = ledger.post(s, "a", s.version(), results, allocations)  # and from the newest: its payments are posted already
    assert s.read("invoices", after).exceptAll(s.read("invoices", base + 1)).count() == 0


def test_a_run_after_a_review_keeps_the_reviewers_allocations(spark):
    inv, pay, out = small(spark)
    first, placed = ledger.decisions(out, "1")
    at = datetime.datetime(2026, 3, 16)
    acts = spark.createDataFrame([("U0", "reassign", "me", "", at)], "statement_ref string, action string, reviewer string, note string, at timestamp")
    lines = spark.createDataFrame([("U0", "INV-00044", 250000)], "statement_ref string, invoice_number string, allocated_amount_paise long")
    results, held, _ = ledger.apply_reviews(first, placed, acts, lines, inv, pay)
    for run in ("2", "3"):
        new, own = ledger.decisions(out, run)
        held = ledger.replace_allocations(results, held, new, own)
        results = ledger.replace_own(results, new)
    got = {(r["result_id"], r["invoice_number"]) for r in held.collect()}
    assert got == {("U0@1", "INV-00044"), ("U0@3", "INV-00042"), ("U1@3", "INV-00043")}
    assert {r["result_id"] for r in results.collect()} == {"U0@1", "U0@3", "U1@3"}
    _, after = ledger.post_cash(pay, inv, results, held, ("auto_applied", "manually_applied"))
    assert {r["invoice_id"]: r["open_amount_paise"] for r in after.collect()} == {42: 4185000, 43: 0, 44: 0}  # the review is what is posted


def test_an_accepted_review_has_its_audit_row_beside_a_refused_one(spark):
    inv, pay, out = small(spark)
    results, allocations = ledger.decisions(out)
    at = [datetime.datetime(2026, 3, 16, h) for h in (1, 2)]
    acts = spark.createDataFrame([("U0", "approve", "me", "", at[0]), ("U0", "approve", "you", "", at[1]), ("U9", "approve", "me", "", at[0])], "statement_ref string, action string, reviewer string, note string, at timestamp")
    none = spark.createDataFrame([], "statement_ref string, invoice_number string, allocated_amount_paise long")
    new, _, errors = ledger.apply_reviews(results, allocations, acts, none, inv, pay)
    assert [(r["entity_id"], r["actor"]) for r in ledger.review_audit(new, acts).collect()] == [("U0", "user:me")]
    assert errors.count() == 2


def test_generated_set_is_written_once_and_reset(spark, tmp_path):
    s, g = Store(spark, str(tmp_path / "set")), generate.Generator(5, 40)
    assert generate.write(s, g) == 1
    row = s.read("audit_log").first()
    assert row["action"] == "dataset_generated" and json.loads(row["payload_after"])["digest"] == config.digest(g)
    with pytest.raises(ValueError, match="already"):
        generate.write(s, g)
    assert s.reset(1) == 2 and not s.is_populated() and s.is_populated(1)
    assert all(s.read(name).count() == 0 for name in store.RESET_ORDER) and s.read("audit_log").count() == 1
    assert generate.write(s, g) == 3 and s.read("audit_log").count() == 2
    with pytest.raises(ValueError, match="already"):  # the newest version counts, not one that was named
        generate.write(s, g)
    assert generate.write(s, g, force=True) == 4
