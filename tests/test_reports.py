"""Complete scoring of names, reports, settings files, uploads, resets, apportionment."""

import json
import random

import pytest
from pyspark.sql import functions as F

from creditweave import config, schemas
from creditweave.config import DEFAULT, Identification
from creditweave.functions import similarity
from creditweave.operators import identity
from creditweave.plans import evaluate, extract, generate, reports
from creditweave.sources import statements

WORDS = ["sharma", "enterprises", "steel", "works", "ab", "traders", "pune", "shree", "balaji", "konark", "stores", "and", "sons", "global", "foods"]


def names_of(rng, n):
    return sorted({" ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 2, 3, 4, 7]))) for _ in range(n)})


def misspelt(rng, name):
    letters = list(name)
    for _ in range(rng.randrange(4)):
        i = rng.randrange(len(letters))
        letters[i : i + 1] = rng.choice([[], [rng.choice("aeinrst ")], [letters[i], rng.choice("aeinrst")]])
    return " ".join("".join(letters).split()) or "q"


@pytest.mark.parametrize(("scorer", "floor"), [("wratio", 81.0), ("wratio", 60.0), ("levenshtein", 65.0), ("token_set_ratio", 80.0)])
def test_close_names_equal_scoring_every_name(scorer, floor):
    rng = random.Random(5)
    names = [*names_of(rng, 220), "x" * 90, "shree " * 20]
    owners = list(range(len(names)))
    known, of = similarity.Choices(names), getattr(similarity, scorer)
    for _ in range(25):
        payer = misspelt(rng, rng.choice(names))
        every = [(i, of(payer, n)) for i, n in enumerate(names)]
        want = sorted(((i, s) for i, s in every if s >= floor), key=lambda t: (-t[1], names[t[0]], owners[t[0]]))[:5]
        assert known.close(payer, scorer, floor, 5, owners) == want, payer


def test_similar_names_miss_no_typo(spark):
    """Typos in every word; blocks so small that payers and names meet in many tasks."""
    rng = random.Random(6)
    names = names_of(rng, 120)
    payers = sorted({"shrama enterprisos", "stranger", *(misspelt(rng, n) for n in names[::3])})
    book = spark.createDataFrame([(n, i) for i, n in enumerate(names)] + [("sharma enterprises", 999)], "normalized_name string, customer_id long").dropDuplicates(["normalized_name"])
    none = spark.createDataFrame([], "normalized_alias string, customer_id long")
    cfg = Identification()
    got = {r["payer"]: r for r in identity.similar_names(spark.createDataFrame([(p,) for p in payers], "payer string"), book, none, cfg, payer_rows=7, choice_rows=11).collect()}
    rows = [(r["normalized_name"], r["customer_id"]) for r in book.collect()]
    assert set(got) == set(payers)
    for p in payers:
        best = sorted(((-similarity.wratio(p, n), n, o) for n, o in rows))[:5]
        rival = next((-s for s, _, o in best if o != best[0][2]), None)
        top = -best[0][0]
        want = "none" if top < cfg.fuzzy_min_score else "ambiguous" if rival is not None and top - rival < cfg.fuzzy_margin else "fuzzy"
        assert (got[p]["method"], got[p]["customer_id"]) == (want, best[0][2] if want == "fuzzy" else None), p
    assert got["shrama enterprisos"]["method"] == "fuzzy"
    assert identity.similar_names(book.limit(0).select(F.col("normalized_name").alias("payer")), book, none, cfg).count() == 0


def judged(spark):
    rows = [("a", "exact_single", "auto_applied", "correct", 0.99, 12_345_600, True, None, True, False, 1), ("b", "exact_single", "auto_applied", "wrong", 0.95, 500_000, False, None, False, True, 1), ("c", "typo_reference", "needs_review", "correct", 0.6, 700, True, True, True, False, 1), ("d", "typo_reference", "unapplied", "missed", 0.0, 900, False, None, False, False, 0), ("e", "exact_single", "auto_applied", "correct", 1.0, 100, True, None, True, False, 1)]
    return spark.createDataFrame(rows, "statement_ref string, scenario string, decision string, verdict string, confidence double, amount_paise long, invoices_correct boolean, reason_correct boolean, is_correct boolean, is_costly boolean, n_candidates int").withColumn("strategy", F.lit("reference_exact"))


def test_reports(spark):
    df = judged(spark)
    assert [r["scenario"] for r in reports.by_scenario(df).collect()] == ["exact_single", "typo_reference"]
    text, md = reports.as_text(df, DEFAULT.scoring), reports.as_markdown(df, DEFAULT.scoring)
    assert "precision of these      66.67% (1 wrong, ₹5,000.00)" in text and "0.90 (now)" in text and "Costly errors" in text
    assert "| applied automatically | 60.0% (3) |" in md and "| exact_single | 3 | 100% | 66.7% | 66.7% |" in md and "| deduction reasons | 100.0% (1 of 1) |" in md
    assert evaluate.report(df).first()["auto_wrong"] == 1
    assert "0 (₹0.00)" in reports.as_text(df.limit(0), DEFAULT.scoring)


def test_settings_file_and_digest(tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"max_pool": 30, "scoring": {"auto_apply": 0.95}}))
    got = config.load_file(config.Matching, path)
    assert got.max_pool == 30 and got.scoring.auto_apply == 0.95
    assert config.digest(got) != config.digest(DEFAULT) == config.digest(config.Matching()) and len(config.digest(got)) == 7 + 16
    for bad in ("[]", '{"max_poll": 1}'):
        path.write_text(bad)
        with pytest.raises(ValueError):
            config.load_file(config.Matching, path)


def test_uploads(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x")
    statements.check_upload(spark, str(tmp_path / "a.csv"))
    (tmp_path / "b.csv").write_text("")
    with pytest.raises(ValueError, match="empty"):
        statements.check_upload(spark, str(tmp_path / "b.csv"))


def test_apportion():
    assert generate.apportion({"a": 34, "b": 33, "c": 33}, 10) == {"a": 4, "b": 3, "c": 3}
    assert generate.apportion({"a": 50, "b": 50}, 3) == {"a": 1, "b": 2}
    assert sum(generate.apportion({"a": 34, "b": 18, "c": 48}, 801).values()) == 801


def test_drafts(spark):
    said = ['```json\n{"lines": []}\n```', "", "nope", "[1]", '{"lines": [{"gross_amount": "1"}]}', None, '{"lines": [{"invoice_reference": "INV 7", "gross_amount": "100.00", "paid_amount": "200.00"}, {"invoice_reference": "INV-0042", "paid_amount": "90.00", "deduction_amount": "10.00"}, {"invoice_reference": "inv 42"}, {"invoice_reference": "--"}], "unattributed_deduction": "5.00"}']
    df = extract.lines_from_drafts(extract.parse_drafts(spark.createDataFrame(list(enumerate(said)), "remittance_id long, response string")))
    got = {r["remittance_id"]: r for r in df.collect()}
    assert [got[i]["problem"] for i in range(6)] == [None, "the answer is empty", "the answer is not JSON", "the answer is no object", "lines.0.invoice_reference: missing", None]
    assert [(x["normalized_reference"], x["gross_amount_paise"], x["paid_amount_paise"], x["deduction_amount_paise"], x["deduction_reason"]) for x in got[6]["lines"]] == [("INV42", 10_000, 9_000, 1_000, "unknown")]
    assert (got[6]["document_deduction_paise"], got[6]["document_deduction_reason"]) == (500, "unknown")
