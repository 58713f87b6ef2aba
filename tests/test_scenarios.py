"""Ranks without one big sort, exact shares, disjoint runs, and what payments and advice look like."""

import random

import pytest
from pyspark.sql import functions as F

from creditweave.functions import text as T
from creditweave.operators.ranks import running
from creditweave.plans import cascade, extract, generate, scenarios
from creditweave.operators import book
from creditweave.config import DEFAULT


def test_running_totals_equal_a_loop(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aab"), rng.randrange(50), i, rng.choice([None, 0, 1, 5])) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, day int, id int, v int").repartition(6)
    got = {r["id"]: (r["rank"], r["before"]) for r in running(df, ["g"], ["day", "id"], F.expr("day div 7"), "v").collect()}
    for g in "ab":
        total = 0
        for i, (_, _, key, v) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), 1):
            assert got[key] == (i, total)
            total += v or 0
    whole = running(df, [], ["day", "id"], F.expr("day div 7")).collect()
    assert [r["id"] for r in sorted(whole, key=lambda r: r["rank"])] == [r[2] for r in sorted(rows, key=lambda r: (r[1], r[2]))]
    assert running(df.limit(0), ["g"], ["id"], F.lit(0), "v").count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 99, 800, 1237])
def test_shares_are_exact_at_any_size(spark, n):
    got = {r["scenario"]: r["n"] for r in scenarios.dealt(spark.range(n).select(F.col("id").alias("payment_id")), scenarios.SCENARIOS).groupBy("scenario").agg(F.count("*").alias("n")).collect()}
    assert got == {k: v for k, v in scenarios.apportion(scenarios.SCENARIOS, n).items() if v}


def test_a_customer_with_most_invoices_and_one_with_few(spark):
    items = spark.range(3000).select(
        F.col("id").alias("invoice_id"), F.concat(F.lit("INV-"), F.col("id").cast("string")).alias("invoice_number"), F.when(F.col("id") < 2900, 1).otherwise(F.col("id") % 40).cast("long").alias("customer_id"),
        F.expr("date_add(date'2025-01-01', cast(id % 300 as int))").alias("invoice_date"), F.expr("date_add(date'2025-02-01', cast(id % 300 as int))").alias("due_date"), (F.col("id") * 1000 + 500).alias("open_amount_paise"),
    )
    rows = scenarios.plan(items).collect()
    used = [i["invoice_id"] for r in rows for i in r["invoices"]]
    assert len(used) == len(set(used))
    sizes = {k: {len(r["invoices"]) for r in rows if r["scenario"] == k} for k in scenarios.SCENARIOS}
    assert sizes["bundled_multi"] == {2, 3, 4, 5} and sizes["no_matching_invoice"] == {0} and sizes["exact_single"] == {1}
    assert all({i["invoice_id"] < 2900 for i in r["invoices"]} == {r["customer_id"] == 1} for r in rows if r["invoices"] and r["customer_id"] == 1)
    counts = {k: sum(r["scenario"] == k for r in rows) for k in scenarios.SCENARIOS}
    assert counts == scenarios.apportion(scenarios.SCENARIOS, len(rows)) and len(rows) > 960


@pytest.fixture(scope="module")
def built(spark):
    return {k: v.cache() for k, v in generate.tables(spark, generate.Generator(40, 4000)).items()}


def test_payers_are_spelt_as_their_scenario_says(built):
    names = {r["customer_id"]: r["normalized_name"] for r in built["customers"].collect()}
    aliases = {r["normalized_alias"] for r in built["customer_aliases"].collect()}
    rows = built["bank_transactions"].join(built["ground_truth"].select("statement_ref", "scenario", "customer_id"), "statement_ref").collect()
    for r in rows:
        payer = r["payer_name_normalized"]
        if r["scenario"] in ("payer_name_variant", "no_matching_invoice"):
            assert payer not in aliases and payer not in names.values()
        else:
            assert payer == names[r["customer_id"]] or payer in aliases
    assert len({r["payer_name_raw"] for r in rows if r["customer_id"] == 1}) > 5


def test_every_mangling_and_clean_spelling(spark):
    df = spark.createDataFrame([("INV-0000420", "M/s. Kamo Traders Pvt. Ltd.", "PUNE"), ("INV-0000077", "Rishi Foods LLP", "DELHI")], "n string, name string, city string").withColumn("payment_id", F.lit(1))
    r = df.select(F.array(*scenarios.manglings(F.col("n"))).alias("m"), F.array(*(T.normalize_party_name(c) for c in scenarios.clean_spellings(F.col("name")))).alias("c"), T.normalize_party_name(F.col("name")).alias("own"), F.array(*(T.normalize_party_name(c) for c in scenarios.hard_spellings(F.col("name"), F.col("city")))).alias("h")).collect()
    assert r[0]["m"] == ["inv 420", "INV420", "Invoice No. 420", "INV/420", "420", "INV-0000420-A", "BILL 420"]
    for x in r:
        assert set(x["c"]) == {x["own"]}
        assert x["own"] not in x["h"][:2] + x["h"][3:]  # a short name stays whole when cut


def test_advice_is_read_back(built):
    read = extract.extract(extract.with_credit(built["remittances"], built["bank_transactions"])).join(built["ground_truth"].select(F.expr("cast(substring(statement_ref, 4) as bigint)").alias("remittance_id"), "expected"), "remittance_id")
    rows = read.collect()
    assert len(rows) > 300
    year = lambda x: int(digits(x)) < 10 or 1900 <= int(digits(x)) < 2100  # noqa: E731  alone these are too short, or read as a date
    for r in rows:
        wanted, got = {digits(a["invoice_number"]) for a in r["expected"]}, {digits(x) for x in r["references"]}
        assert got == wanted or got == {x for x in wanted if not year(x)}, r["raw_text"]
    linked = [r for r in rows if r["statement_ref"]]
    assert 0.25 < len(linked) / len(rows) < 0.45
    reasons = {r["claimed_reason"] for r in rows}
    assert {"damage", "promo", "pricing", "short_ship", "freight", "tds"} <= reasons


def digits(x):
    return x.split("-")[-1].replace("INV", "").lstrip("0")


def test_truth_adds_up_and_most_is_matched(built, spark):
    pay, truth = built["bank_transactions"], built["ground_truth"]
    both = pay.join(truth.drop("customer_id"), "statement_ref").where("scenario <> 'no_matching_invoice'")
    placed = F.aggregate("expected", F.lit(0).cast("bigint"), lambda t, a: t + a["allocated"])
    assert both.where(placed != F.col("amount_paise")).count() == 0
    out = cascade.match(pay, book.open_items(built["invoices"]), book.names(built["customers"]), book.alias_names(built["customer_aliases"]), None, DEFAULT, fuzzy=False)
    exact = out.join(truth.where("scenario in ('exact_single', 'bundled_multi')").select("statement_ref"), "statement_ref").where("strategy = 'reference_exact'").count()
    assert exact / truth.where("scenario in ('exact_single', 'bundled_multi')").count() > 0.9
