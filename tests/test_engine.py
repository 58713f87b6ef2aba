"""Operators on hand-built rows: money, names, references, search, settlement, the cascade, the ledger."""

import dataclasses
import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from creditweave.config import DEFAULT, Search
from creditweave.functions import money as M
from creditweave.functions import similarity
from creditweave.functions import text as T
from creditweave.operators import book, identity, ledger, score
from creditweave.operators.search import find_sets
from creditweave.plans import cascade, extract

DAY = datetime.date(2026, 3, 15)


def values(spark, column, inputs, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_amounts(spark):
    assert values(spark, M.parse_amount, ["Rs. 4,18,500.00", "418500.00", "4,18,500.00/-", "INR 418,500.00", "₹418500.00"]) == [41850000] * 5
    assert values(spark, M.parse_amount, ["0.07", "", "  ", "words", "Rs.", None]) == [7, None, None, None, None, None]


def test_format_inr(spark):
    assert values(spark, M.format_inr, [0, 99, 100_00, 1_00_000_00, 12_34_56_789_01, -5_00], "long") == ["₹0.00", "₹0.99", "₹100.00", "₹1,00,000.00", "₹12,34,56,789.01", "-₹5.00"]


def test_party_names(spark):
    same = ["M/s A.B.C. Traders Pvt. Ltd.", "ABC TRADERS", "NEFT CR ABC Traders Private Limited", "abc  traders", "ABC-Traders (P.) by transfer"]
    assert set(values(spark, T.normalize_party_name, same[:4])) == {"abc traders"}
    assert values(spark, T.normalize_party_name, ["The Company Co", None, ""]) == ["the company co", "", ""]


def test_references(spark):
    of = lambda c: F.transform(T.all_references(T.normalize_narration(c), DEFAULT.reference), lambda t: t["normalized"])
    got = values(spark, of, ["NEFT INV-00042", "inv 42", "INVOICE NO. 42", "INV/42 - thanks", "INV 0042", "BILL 42 PAID"])
    assert all("INV42" in x for x in got)
    assert values(spark, of, ["INV-00042 AND INV-00042", "INV-00042 AND INV 42", "PMT REF 42/43/44", "no digits", "12345678901234", "INV 7", "INV-00042-A", None, ""]) == [["INV42"], ["INV42", "42"], ["42", "43", "44"], [], [], [], ["INV00042A"], [], []]


def test_reasons(spark):
    assert values(spark, T.classify_reason, ["12 cases damaged", "festival scheme", "rate difference", "short supply", "freight", "TDS 194Q", "nothing", None]) == ["damage", "promo", "pricing", "short_ship", "freight", "tds", None, None]


def brute_sets(amounts, low, high, cfg):
    found = [list(c) for n in range(cfg.min_size, cfg.max_size + 1) for c in itertools.combinations(range(len(amounts)), n) if low <= sum(amounts[i] for i in c) <= high]
    return sorted(found)[: cfg.max_solutions]


def test_search_equals_all_combinations():
    rng = random.Random(1)
    for _ in range(400):
        amounts = sorted((rng.randrange(1, 60) for _ in range(rng.randrange(0, 11))), reverse=True)
        low = rng.randrange(0, 120)
        cfg = Search(True, rng.choice([1, 2]), rng.choice([2, 3, 5]), rng.choice([1, 3, 1000]), 10**6)
        high = low + rng.randrange(0, 12)
        found, _, exhausted, _ = find_sets(amounts, low, high, cfg)
        assert found == brute_sets(amounts, low, high, cfg) and not exhausted


def test_search_of_full_pools():
    """45 items, sets of up to five: against a walk, with many ties, and with a band that every set is in."""
    rng = random.Random(2)
    for low, high, spread in ((300_000, 300_040, 100_000), (40, 44, 12), (1, 10**9, 9)):
        amounts = sorted((rng.randrange(1, spread) for _ in range(45)), reverse=True)
        cfg = Search(True, 2, 5, 5, 10**8)
        found, _, exhausted, _ = find_sets(amounts, low, high, cfg)
        assert not exhausted and found == list(itertools.islice(walk(amounts, low, high, 2, 5), 5))


def walk(amounts, low, high, least, most, path=()):
    for i in range(path[-1] + 1 if path else 0, len(amounts)):
        total = sum(amounts[j] for j in path) + amounts[i]
        if total > high or total + sum(amounts[i + 1 : i + most - len(path)]) < low:
            continue
        here = (*path, i)
        if total >= low and len(here) >= least:
            yield list(here)
        if len(here) < most:
            yield from walk(amounts, low, high, least, most, here)


def test_search_budget():
    assert find_sets(list(range(60, 20, -1)), 10**6, 10**6 + 1, Search(True, 2, 5, 5, 100))[1] <= 100
    assert find_sets([9, 8, 7, 6, 5, 4], 10, 12, Search(True, 2, 5, 5, 1))[2]


def test_wratio_behaves():
    assert similarity.wratio("shree balaji traders", "shree balaji traders") == 100
    assert similarity.wratio("shree balaji traders pune br", "shree balaji traders") >= 86
    assert similarity.wratio("konark stores puna", "konark stores pune") - similarity.wratio("konark stores puna", "konark stores pura") < 5
    assert similarity.wratio("acme", "zenith industries") < 60


def make(spark, invoices, payments, customers=((1, "abc traders"),), aliases=((1, 1, "abc trdrs"),)):
    inv = [(n, f"INV-{n:05d}", f"INV{n}", c, DAY - datetime.timedelta(days=40), DAY - datetime.timedelta(days=10), rupees * 100, rupees * 100, "open") for n, c, rupees in invoices]
    inv = spark.createDataFrame(inv, "invoice_id long, invoice_number string, normalized_number string, customer_id long, invoice_date date, due_date date, amount_paise long, open_amount_paise long, status string")
    pay = spark.createDataFrame([(f"U{i}", int(round(rupees * 100)), DAY, payer, text.upper(), "unmatched") for i, (rupees, payer, text) in enumerate(payments)], "statement_ref string, amount_paise long, value_date date, payer_name_normalized string, normalized_narration string, status string")
    names = book.names(spark.createDataFrame(list(customers), "customer_id long, normalized_name string"))
    al = book.alias_names(spark.createDataFrame(list(aliases), "alias_id long, customer_id long, normalized_alias string"))
    return inv, pay, names, al


def decide(spark, *args, advice=None, **kw):
    inv, pay, names, al = make(spark, *args, **kw)
    out = score.score(cascade.match(pay, book.open_items(inv), names, al, advice), DEFAULT.scoring)
    return {r["statement_ref"]: r for r in out.collect()}, inv, pay, out


def test_cascade(spark):
    invoices = [(42, 1, 41850), (43, 1, 1000), (44, 1, 2500), (45, 1, 9999), (50, 2, 7777)]
    payments = [
        (41850, "abc traders", "NEFT INV-00042"), (41850, "stranger", "NEFT INV-00042"), (7777, "abc traders", "INV-00050"), (3500, "abc traders", "NEFT"), (9999, "abc traders", "cash"),
        (40000, "abc traders", "INV-00042"), (20000, "abc traders", "INV-00042"), (5, "stranger", ""), (9700, "abc trdrs", "cash"), (3500, "abc traders", "INV-00043 INV-00044"), (41850.5, "abc traders", "INV 42"), (0.01, "abc traders", "x"),
    ]
    got, inv, pay, out = decide(spark, invoices, payments, customers=((1, "abc traders"), (2, "zen foods")))
    assert [got[f"U{i}"]["strategy"] for i in range(12)] == ["reference_exact", "reference_exact", "none", "subset_sum", "amount_exact", "reference_exact", "reference_exact", "none", "short_pay", "reference_exact", "reference_exact", "none"]
    assert [got[f"U{i}"]["decision"] for i in (0, 1, 2, 3, 5, 6, 10)] == ["auto_applied", "auto_applied", "unapplied", "needs_review", "auto_applied", "auto_applied", "needs_review"]
    assert (round(got["U0"]["confidence"], 4), round(got["U1"]["confidence"], 4), round(got["U6"]["confidence"], 4), round(got["U10"]["confidence"], 4), round(got["U3"]["confidence"], 4)) == (1.0, 0.9791, 0.9093, 0.85, 0.5442)
    assert got["U1"]["method"] == "reference" and got["U8"]["method"] == "alias"
    assert [s["name"] for s in got["U0"]["trail"]] == ["customer_identified", "references_found", "reference_exact"]
    amount = {r["statement_ref"]: r["amount_paise"] for r in pay.collect()}
    open_ = {r["invoice_id"]: r["open_amount_paise"] for r in inv.collect()}
    for ref, r in got.items():
        assert len(r["reason_text"]) <= 500
        for c in r["candidates"]:
            assert sum(a["allocated"] for a in c["allocations"]) <= amount[ref]
            assert all(a["allocated"] + a["deduction"] <= open_[a["invoice_id"]] for a in c["allocations"])


def test_posting_and_reviews(spark):
    _, inv, pay, out = decide(spark, [(42, 1, 41850), (43, 1, 1000), (44, 1, 2500)], [(41850, "abc traders", "INV-00042"), (3500, "abc traders", "NEFT")])
    results, allocations = ledger.decisions(out)
    paid, after = ledger.post_cash(pay, inv, results, allocations)
    assert {r["invoice_id"]: (r["open_amount_paise"], r["status"]) for r in after.collect()} == {42: (0, "paid"), 43: (100000, "open"), 44: (250000, "open")}
    assert {r["statement_ref"]: r["status"] for r in paid.collect()} == {"U0": "matched", "U1": "unmatched"}
    again = ledger.post_cash(paid, after, results, allocations)[1]
    assert again.exceptAll(after).count() == 0
    at = datetime.datetime(2026, 3, 16)
    acts = spark.createDataFrame([("U1", "reassign", "me", "", at), ("U9", "approve", "me", "", at), ("U0", "reassign", "me", "", at)], "statement_ref string, action string, reviewer string, note string, at timestamp")
    lines = spark.createDataFrame([("U1", "INV-00043", 100000), ("U0", "INV-00099", 5)], "statement_ref string, invoice_number string, allocated_amount_paise long")
    new, allocs, errors = ledger.apply_reviews(results, allocations, acts, lines, inv, pay)
    assert {r["statement_ref"]: (r["decision"], r["matched_amount_paise"]) for r in new.collect()} == {"U0": ("auto_applied", 4185000), "U1": ("manually_applied", 100000)}
    assert {(r["statement_ref"], r["error"]) for r in errors.collect()} == {("U9", "already reviewed, or no such result"), ("U0", "no such invoice")}
    assert [r["invoice_number"] for r in allocs.where("statement_ref = 'U1'").collect()] == ["INV-00043"]


def test_identity_tiers(spark):
    _, pay, names, al = make(spark, [(42, 1, 1)], [(1, p, "") for p in ("abc traders", "abc trdrs", "shree balaji traders pune br", "konark stores puna", "nobody", "")], customers=((1, "abc traders"), (2, "shree balaji traders"), (3, "konark stores pune"), (4, "konark stores pura")))
    got = {r["statement_ref"]: r["identity"] for r in identity.identify(pay, names, al, DEFAULT.identification).collect()}
    assert [got[f"U{i}"]["method"] for i in range(6)] == ["exact", "alias", "fuzzy", "ambiguous", "none", "none"]
    assert got["U2"]["customer_id"] == 2 and got["U3"]["customer_id"] is None


def test_advice_layouts(spark):
    docs = [
        (1, "U1", "Total transferred Rs. 4,18,500.00\nINV-00042  Rs. 2,18,500.00\nINV-00043  Rs. 2,00,000.00", 41850000),
        (2, "U2", "INV-00746 | 2,04,931.43/- | less INR 12,250.00 damage", 19268143),
        (3, "U3", "INV-00879 61,765.84 4,900.00 56,865.84", 5686584),
        (4, "U4", "", 1), (5, "U5", None, 1),
    ]
    df = spark.createDataFrame(docs, "remittance_id long, statement_ref string, raw_text string, credit_paise long")
    got = {r["remittance_id"]: r for r in extract.extract(df).collect()}
    assert got[1]["references"] == ["INV42", "INV43"] and got[1]["reconciliation"] == "ties"
    line = got[2]["lines"][0]
    assert (line["gross_amount_paise"], line["deduction_amount_paise"], line["deduction_reason"]) == (20493143, 1225000, "damage")
    line = got[3]["lines"][0]
    assert (line["gross_amount_paise"], line["deduction_amount_paise"], line["paid_amount_paise"]) == (6176584, 490000, 5686584)
    assert got[4]["lines"] == [] and got[5]["lines"] == []


def test_config_is_strict():
    with pytest.raises((ValueError, TypeError)):
        dataclasses.replace(DEFAULT.scoring, auto_apply=0.1, review_floor=0.5)


def test_only_what_a_new_alias_touches_is_matched_again(spark):
    payers = ["abc traders", "abc trdrs", "zenith fds", "zenith fd", "zenith foods", "konark stores puna", "nobody at all", ""]
    inv, pay, names, al = make(spark, [(42, 1, 100), (43, 2, 200), (44, 3, 300)], [(k + 1, p, "NEFT") for k, p in enumerate(payers)] + [(200, "zenith fds", "cash"), (300, "konark stores puna", "cash")], customers=((1, "abc traders"), (2, "zenith foods"), (3, "konark stores pune")))
    items = book.open_items(inv)
    old = cascade.match(pay, items, names, al)
    learned = spark.createDataFrame([(2, "zenith fds", "learned"), (3, "konark stores puna branch", "learned")], "customer_id long, normalized_alias string, source string")
    got = cascade.rematch(old, pay, items, names, al, learned)
    both = al.unionByName(learned.select("normalized_alias", "customer_id"))
    whole = cascade.match(pay, items, names, both)
    assert got.drop("again").select(whole.columns).withColumn("trail", F.to_json("trail")).exceptAll(whole.withColumn("trail", F.to_json("trail"))).count() == 0 and got.count() == whole.count()
    assert {r["statement_ref"] for r in got.where("again").collect()} == {"U2", "U3", "U5", "U8", "U9"}  # spelt so, near to it, or with it as a rival
