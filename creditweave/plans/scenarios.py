"""Payments for an open book: every scenario in its exact share, every invoice in one payment at most.

A customer's open invoices stand in a row; every third one brings a payment. Each payment wants a number of invoices, and takes the run of them
that begins behind what the customer's payments before it take, so runs never meet. All draws are md5 digests of a payment's id, so
any engine can draw the same; ranks and running totals come from operators.ranks, so no customer is one task's burden."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.ranks import running
from ..session import settled

# Shares in percent, and ranges of what is drawn.
SCENARIOS = {"exact_single": 34, "bundled_multi": 18, "short_pay_deduction": 14, "partial_payment": 10, "missing_reference": 10, "typo_reference": 8, "payer_name_variant": 4, "no_matching_invoice": 2}
REASONS = {"damage": 30, "promo": 25, "pricing": 18, "short_ship": 12, "freight": 10, "tds": 5}
CLAIMS = {"damage": "12 cases damaged in transit", "promo": "festival scheme", "pricing": "rate difference", "short_ship": "short supply of 3 cases", "freight": "freight on return", "tds": "TDS as per certificate"}
CHANNELS = ["NEFT CR", "RTGS CR", "IMPS"]


@dataclass(frozen=True)
class Mix:
    scenarios: dict[str, int] = field(default_factory=lambda: dict(SCENARIOS))
    reasons: dict[str, int] = field(default_factory=lambda: dict(REASONS))
    every: int = 3
    bundle: tuple[int, int] = (2, 5)
    partial_pct: tuple[int, int] = (25, 85)
    claim_pct: tuple[int, int] = (2, 12)
    claim_step_paise: int = 5000
    days_after_due: tuple[int, int] = (-6, 45)
    advice_pct: int = 55
    linked_pct: int = 35
    days_of_advice: tuple[int, int] = (-2, 3)

    def __post_init__(self) -> None:
        if sum(self.scenarios.values()) != 100 or sum(self.reasons.values()) != 100:
            raise ValueError("shares must sum to 100")
        if self.every < 2 or not 2 <= self.bundle[0] <= self.bundle[1]:
            raise ValueError("a payment needs two invoices at least to choose from, and so does a bundle")


def apportion(weights: dict[str, int], total: int) -> dict[str, int]:
    """Counts in proportion to weights (percent) that sum to total: floors, then one more for the largest remainders, of equal
    ones the name that sorts last."""
    left = {k: total * w % 100 for k, w in weights.items()}
    out = {k: total * w // 100 for k, w in weights.items()}
    for k in sorted(left, key=lambda k: (left[k], k), reverse=True)[: max(0, total - sum(out.values()))]:
        out[k] += 1
    return out


def draw(salt: str, n: int | Column, key: str = "payment_id") -> Column:
    """A number from 0 to n - 1 that follows from the id."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(salt)).cast("binary")), 1, 8), 16, 10).cast("bigint") % n


def between(salt: str, bounds: tuple[int, int]) -> Column:
    return F.lit(bounds[0]) + draw(salt, bounds[1] - bounds[0] + 1)


def _weighted(salt: str, weights: dict[str, int]) -> Column:
    out, below, at = F.lit(None).cast("string"), 0, draw(salt, 100)
    for k, w in weights.items():
        out = F.when((at >= below) & (at < below + w), k).otherwise(out)
        below += w
    return out


def _one_of(values: list[str] | list[Column], salt: str) -> Column:
    return F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (draw(salt, len(values)) + 1).cast("int"))


def dealt(payments: DataFrame, weights: dict[str, int], digits: int = 3) -> DataFrame:
    """payments (payment_id, unique) with `scenario`: counts are exactly apportion()'s, who gets which is drawn.

    Rows are put in the order of their digests by ranks of buckets (of `digits` hexadecimal digits); only their number reaches the driver."""
    rows = payments.withColumn("_digest", F.md5(F.concat_ws(":", F.col("payment_id").cast("string"), F.lit("deal")).cast("binary")))
    ranked = running(rows, [], ["_digest", "payment_id"], F.substring("_digest", 1, digits), rank="_place")
    name, upto = F.lit(None).cast("string"), 0
    for k, n in apportion(weights, payments.count()).items():
        name = F.when((F.col("_place") > upto) & (F.col("_place") <= upto + n), k).otherwise(name)
        upto += n
    return ranked.withColumn("scenario", name).drop("_digest", "_place")


def plan(items: DataFrame, mix: Mix | None = None) -> DataFrame:
    """(payment_id, customer_id, scenario, invoices): the invoices that each payment settles, in the order of date and number.

    items are open invoices with unique ids. Of a customer's n open invoices floor(n / every) bring payments. A bundle gets two at least, and
    of what it wants beyond as much as the customer's spare invoices allow; no invoice is taken twice. Payments without
    a matching invoice take none. No items give no payments."""
    mix = mix or Mix()
    month = F.year("invoice_date") * 12 + F.month("invoice_date")
    row = settled(running(items, ["customer_id"], ["invoice_date", "invoice_number", "invoice_id"], month, rank="place"), "row")
    bring = row.where(F.col("place") % mix.every == 0).select(F.col("invoice_id").alias("payment_id"), "customer_id", F.expr(f"place div {mix.every}").alias("turn"), F.date_add("invoice_date", 30).alias("stray_date"))
    bring = dealt(settled(bring, "bring"), mix.scenarios)
    bundle, least = F.col("scenario") == "bundled_multi", mix.bundle[0]
    bring = settled(bring.withColumn("more", F.when(bundle, draw("size", mix.bundle[1] - least + 1)).otherwise(F.lit(0)).cast("bigint")), "dealt")
    # A payment has mix.every invoices to choose from; what all need at least is set aside, the rest goes to bundles in turn.
    need = F.when(bundle, least).otherwise(1)
    spare = row.groupBy("customer_id").agg(F.count("*").alias("n")).join(bring.groupBy("customer_id").agg(F.sum(need).alias("need")), "customer_id").select("customer_id", (F.col("n") - F.col("need")).alias("spare"))
    thousand = F.expr("turn div 1000")
    wants = running(bring, ["customer_id"], ["turn"], thousand, "more", rank="_r", before="given").join(spare, "customer_id")
    more = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("more"), F.col("spare") - F.col("given")))
    wants = wants.withColumn("wants", F.when(F.col("scenario") == "no_matching_invoice", F.lit(0).cast("bigint")).otherwise(need + more)).drop("_r", "given", "spare", "more")
    runs = settled(running(wants, ["customer_id"], ["turn"], thousand, "wants", rank="_r", before="behind").drop("_r"), "runs")
    takes = runs.where("wants > 0").select("payment_id", "customer_id", F.explode(F.sequence(F.col("behind") + 1, F.col("behind") + F.col("wants"))).alias("place"))
    item = F.struct("place", "invoice_id", "invoice_number", "invoice_date", "due_date", "open_amount_paise")
    taken = takes.join(row, ["customer_id", "place"]).groupBy("payment_id").agg(F.array_sort(F.collect_list(item)).alias("invoices"))
    kind = "array<struct<place: bigint, invoice_id: bigint, invoice_number: string, invoice_date: date, due_date: date, open_amount_paise: bigint>>"
    out = runs.join(taken, "payment_id", "left").withColumn("invoices", F.coalesce("invoices", F.array().cast(kind)))
    return out.select("payment_id", "customer_id", "scenario", "stray_date", "invoices")


def amounts(planned: DataFrame, mix: Mix | None = None) -> DataFrame:
    """planned with amount_paise, claim_paise, reason and value_date.

    A claim is a share of the invoice in whole steps, one at least, and leaves a rupee; its reason is drawn by weight. A payment comes some days
    around the latest due date, and after the latest invoice was written."""
    mix = mix or Mix()
    open_ = F.aggregate("invoices", F.lit(0).cast("bigint"), lambda t, i: t + i["open_amount_paise"])
    step = mix.claim_step_paise
    claim = F.least(F.greatest(F.lit(step), F.expr(f"open_paise * share div 100 div {step} * {step}")), F.col("open_paise") - 100)
    out = planned.withColumns({"open_paise": open_, "share": between("claim", mix.claim_pct), "part": between("part", mix.partial_pct)})
    short, partial, stray = (F.col("scenario") == s for s in ("short_pay_deduction", "partial_payment", "no_matching_invoice"))
    zero = F.lit(0).cast("bigint")
    out = out.withColumns({"claim_paise": F.when(short, F.greatest(claim, zero)).otherwise(zero).cast("bigint"), "reason": F.when(short & (claim > 0), _weighted("reason", mix.reasons))})
    paid = F.when(stray, 800_000 + draw("stray", 94_200_001)).when(partial, F.expr("open_paise * part div 100")).otherwise(F.col("open_paise") - F.col("claim_paise"))
    due, written = F.array_max(F.transform("invoices", lambda i: i["due_date"])), F.array_max(F.transform("invoices", lambda i: i["invoice_date"]))
    late = between("late", mix.days_after_due).cast("int")
    return out.withColumns({"amount_paise": paid.cast("bigint"), "value_date": F.when(stray, F.col("stray_date")).otherwise(F.greatest(F.date_add(due, late), F.date_add(written, 1)))}).drop("share", "part", "open_paise", "stray_date")


def _bare(name: Column) -> Column:
    return F.regexp_replace(name, r"(M/s\. | Pvt\. Ltd\.| Private Limited| & Co\.| LLP)", "")


def clean_spellings(name: Column) -> list[Column]:
    """Five ways to write a registered name that mean the same once normalised."""
    other = F.when(name.endswith("Pvt. Ltd."), F.regexp_replace(name, r"Pvt\. Ltd\.$", "Private Limited")).otherwise(F.concat(_bare(name), F.lit(" PVT LTD")))
    return [F.upper(name), F.concat(F.lit("M/s "), _bare(name)), F.concat_ws(" ", _one_of(CHANNELS, "channel"), F.upper(_bare(name))), other, F.concat(F.lit("  "), F.upper(F.regexp_replace(_bare(name), " ", "  ")))]


def hard_spellings(name: Column, city: Column) -> list[Column]:
    """Five ways that normalisation can't undo: vowels left out of the trade, the city glued on, cut at 24 letters, the first
    letters dropped, another legal form."""
    bare = F.upper(_bare(name))
    trade = F.regexp_extract(bare, r"(\S+)$", 1)
    thin = F.concat(F.left(trade, F.lit(1)), F.regexp_replace(F.substring(trade, 2, 40), "[AEIOU]", ""))
    return [F.concat(F.regexp_replace(bare, r"\S+$", ""), thin), F.concat_ws("-", F.upper(name), F.upper(city)), F.rtrim(F.left(F.upper(name), F.lit(24))), F.substring(bare, 4, 100), F.concat(bare, F.lit(" P LTD"))]


def manglings(number: Column) -> list[Column]:
    """Seven ways to type an invoice number from memory."""
    digits = F.regexp_replace(F.regexp_extract(number, r"(\d+)$", 1), "^0+(?=.)", "")
    return [*(F.concat(F.lit(p), digits) for p in ("inv ", "INV", "Invoice No. ", "INV/", "")), F.concat(number, F.lit("-A")), F.concat(F.lit("BILL "), digits)]


def _payers(paid: DataFrame, customers: DataFrame, aliases: DataFrame) -> DataFrame:
    """paid with payer_name_raw: registered, clean or on file; for variants a hard spelling that isn't, for strays a name of nobody."""
    own = aliases.groupBy("customer_id").agg(F.min("alias").alias("alias"))
    rows = paid.join(customers.select("customer_id", "legal_name", "city"), "customer_id").join(own, "customer_id", "left")
    p, name = draw("payer", 100), F.col("legal_name")
    usual = F.when(p < 35, name).when((p < 85) | F.col("alias").isNull(), _one_of(clean_spellings(name), "clean")).otherwise(F.col("alias"))
    # Attempts in order; the last one is the city behind everything, or a number, and is on no file.
    hard = hard_spellings(name, F.col("city"))
    first = draw("hard", len(hard))
    turned = F.transform(F.sequence(F.lit(0), F.lit(len(hard) - 1)), lambda i: F.element_at(F.array(*hard), ((first + i) % len(hard) + 1).cast("int")))
    hard = F.concat(turned, F.array(F.concat(F.upper(name), F.lit("-"), F.upper("city"), F.lit(" BR"))))
    stray = F.array(*(F.concat(F.lit(word), F.lit(" "), F.col("payment_id").cast("string")) for word in ("CASH DEPOSIT", "COUNTER RECEIPT", "WALK IN SALE")))
    tries = F.when(F.col("scenario") == "payer_name_variant", hard).when(F.col("scenario") == "no_matching_invoice", stray)
    rows = settled(rows.withColumns({"usual": usual, "tries": tries}).drop("alias"), "payers")
    known = customers.select("normalized_name").unionByName(aliases.select(F.col("normalized_alias").alias("normalized_name"))).distinct()
    tried = rows.where("tries is not null").select("payment_id", F.posexplode("tries").alias("pos", "name")).withColumn("normalized_name", T.normalize_party_name(F.col("name")))
    chosen = tried.join(known, "normalized_name", "left_anti").groupBy("payment_id").agg(F.min_by("name", "pos").alias("chosen"))
    return rows.join(chosen, "payment_id", "left").withColumn("payer_name_raw", F.coalesce("chosen", F.when(F.col("tries").isNull(), F.col("usual")), F.element_at("tries", -1))).drop("usual", "tries", "chosen")


def _ref(key: str = "payment_id") -> Column:
    return F.concat(F.lit("UTR"), F.lpad(F.col(key).cast("string"), 12, "0"))


def payments(paid: DataFrame, customers: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows of bank_transactions for what amounts() gives."""
    rows = _payers(paid.where("amount_paise > 0"), customers, aliases)
    numbers = F.transform("invoices", lambda i: i["invoice_number"])
    refs, payer = F.concat_ws(" ", numbers), F.upper("legal_name")
    typed = _one_of(manglings(F.get(numbers, F.lit(0))), "mangle")
    channel = _one_of(["NEFT", "RTGS", "IMPS", "UPI"], "way")
    told = F.when(F.col("reason").isNull(), "").otherwise(F.concat(F.lit(" less "), _pick_claim()))
    plain = [F.concat(channel, F.lit(" "), refs), F.concat(channel, F.lit(" "), payer, F.lit(" "), refs), F.concat(F.lit("PMT REF "), refs)]
    text = (
        F.when(F.col("scenario") == "no_matching_invoice", "CASH").when(F.col("scenario") == "missing_reference", _one_of([F.concat(channel, F.lit(" PAYMENT RECEIVED")), F.concat(channel, F.lit(" "), payer), F.lit("ON ACCOUNT")], "silent"))
        .when(F.col("scenario") == "typo_reference", F.concat(channel, F.lit(" "), typed)).when(F.col("scenario") == "partial_payment", F.concat(channel, F.lit(" "), refs, F.lit(" part payment")))
        .otherwise(F.concat(_one_of(plain, "told"), told))
    )
    out = rows.select(
        _ref().alias("statement_ref"), "value_date", "amount_paise", "payer_name_raw", T.normalize_party_name(F.col("payer_name_raw")).alias("payer_name_normalized"), text.alias("narration"),
        T.normalize_narration(text).alias("normalized_narration"), F.lit("ACC-1").alias("bank_account"), F.lit("unmatched").alias("status"),
    )
    return out


def _pick_claim() -> Column:
    out = F.lit(None).cast("string")
    for reason, words in CLAIMS.items():
        out = F.when(F.col("reason") == reason, words).otherwise(out)
    return out


def truth(paid: DataFrame) -> DataFrame:
    """The answer key: what each payment settles, what is deducted of its first invoice, and why."""
    one = F.col("scenario") == "partial_payment"
    alloc = F.transform("invoices", lambda i, k: F.struct(
        i["invoice_number"].alias("invoice_number"), F.when(one, F.col("amount_paise")).otherwise(i["open_amount_paise"] - F.when(k == 0, F.col("claim_paise")).otherwise(0)).alias("allocated"),
        F.when(k == 0, F.col("claim_paise")).otherwise(F.lit(0).cast("bigint")).alias("deduction"), F.when(k == 0, F.col("reason")).alias("reason")))
    return paid.where("amount_paise > 0").select(_ref().alias("statement_ref"), "scenario", "customer_id", F.col("amount_paise").alias("paid_paise"), alloc.alias("expected"))


def money_styles(paise: Column) -> list[Column]:
    """Four ways to write an amount."""
    rupees, rest = (paise / 100).cast("bigint"), F.lpad((paise % 100).cast("string"), 2, "0")
    plain = F.concat(rupees.cast("string"), F.lit("."), rest)
    grouped = F.concat(F.regexp_replace(rupees.cast("string"), r"(?<=\d)(?=(\d{2})*\d{3}$)", ","), F.lit("."), rest)
    return [F.concat(F.lit("Rs. "), grouped), plain, F.concat(grouped, F.lit("/-")), F.concat(F.lit("INR "), plain)]


def advice(paid: DataFrame, mix: Mix | None = None) -> DataFrame:
    """Rows of remittances for a share of the payments: four layouts, four ways to write money and references, a share that quotes
    the bank reference and so is linked, received some days around the payment."""
    mix = mix or Mix()
    rows = paid.where((F.size("invoices") > 0) & (F.col("amount_paise") > 0) & (draw("advice", 100) < mix.advice_pct))
    money = lambda c: _one_of(money_styles(c), "money")
    digits = lambda n: F.regexp_replace(F.regexp_extract(n, r"(\d+)$", 1), "^0+(?=.)", "")
    named = lambda n: _one_of([n, F.concat(F.lit("INV "), digits(n)), F.concat(F.lit("Invoice No. "), digits(n)), F.concat(F.lit("INV/"), digits(n))], "spelt")
    claim, said = F.col("claim_paise") > 0, _pick_claim()
    line = lambda i, k: F.concat(named(i["invoice_number"]), F.lit("  "), money(i["open_amount_paise"]))
    itemised = F.concat_ws("\n", F.concat(F.lit("Total transferred "), money(F.col("amount_paise"))), F.array_join(F.transform("invoices", line), "\n"), F.when(claim, F.concat(money(F.col("claim_paise")), F.lit(" deducted - "), said)))
    table = F.array_join(F.transform("invoices", lambda i, k: F.concat(named(i["invoice_number"]), F.lit(" | "), money(i["open_amount_paise"]), F.when(claim & (k == 0), F.concat(F.lit(" | less "), money(F.col("claim_paise")), F.lit(" "), said)).otherwise(""))), "\n")
    columns = F.array_join(F.transform("invoices", lambda i, k: F.concat_ws(" ", named(i["invoice_number"]), money(i["open_amount_paise"]), F.when(claim & (k == 0), F.concat_ws(" ", money(F.col("claim_paise")), money(i["open_amount_paise"] - F.col("claim_paise")))))), "\n")
    thread = F.concat_ws("\n", F.lit("From: accounts"), F.array_join(F.transform("invoices", lambda i: F.concat(F.lit("> "), named(i["invoice_number"]))), "\n"), F.concat(F.lit("transfer of "), money(F.col("amount_paise"))), F.when(claim, F.concat(money(F.col("claim_paise")), F.lit(" deducted - "), said)))
    linked = draw("linked", 100) < mix.linked_pct
    body = F.concat(_one_of([itemised, table, columns, thread], "layout"), F.when(linked, F.concat(F.lit("\n"), _ref())).otherwise(""))
    return rows.select(
        F.col("payment_id").alias("remittance_id"), F.when(linked, _ref()).alias("statement_ref"), F.lit("email").alias("source_type"), body.alias("raw_text"), F.concat(F.lit("advice-"), F.col("payment_id").cast("string"), F.lit(".txt")).alias("source_filename"),
        F.date_add("value_date", between("received", mix.days_of_advice).cast("int")).cast("timestamp").alias("received_at"), F.when(linked, "explicit").alias("link_source"), F.lit("pending").alias("extraction_status"),
        *(F.lit(None).cast("string").alias(c) for c in ("extraction_method", "extracted_payload", "extraction_error")),
    )
