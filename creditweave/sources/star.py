"""A cash-application data set derived from a star schema of customers, nations and orders.

Every order is an invoice; every third open order is paid, in one of eight ways. All columns follow from keys, so the same
rows come out on any cluster. `truth` is only for evaluation: nothing that matches reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import settled

SYLLABLES = ["ka", "ri", "mo", "tu", "ben", "sha", "dev", "lal", "gor", "nim", "pat", "sur", "vij", "hem", "raj", "yel"]
TRADES = ["Traders", "Stores", "Agencies", "Enterprises", "Distributors", "Marketing", "Foods", "Pharma"]
FORMS = [" Pvt. Ltd.", " Private Limited", " & Co.", " LLP"]
#: Upper bounds, in percent, of the scenarios' shares.
SCENARIOS = [("exact_single", 34), ("bundled_multi", 52), ("short_pay_deduction", 66), ("partial_payment", 76), ("missing_reference", 86), ("typo_reference", 94), ("payer_name_variant", 98), ("no_matching_invoice", 100)]


_derived: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, d: str | dict[str, DataFrame], name: str, df: DataFrame) -> DataFrame:
    """A derived table, written to the shared folder once for each application and source folder."""
    if isinstance(d, dict):
        return df
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _derived:
        _derived[key] = settled(df, name)
    return _derived[key]


def _read(spark: SparkSession, d: str | dict[str, DataFrame], name: str) -> DataFrame:
    """A table of a folder, or of a dict of tables."""
    if isinstance(d, dict):
        return d[name]
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pick(values: list[str], index: str):
    return F.element_at(F.array(*map(F.lit, values)), F.expr(f"cast(({index}) % {len(values)} as int) + 1"))


def customers(spark: SparkSession, d: str) -> DataFrame:
    """customer_id, code, legal_name, normalized_name, city, payment_terms_days."""
    k = "c_custkey"
    word = F.concat(*(_pick(SYLLABLES, f"{k} div {16**i}") for i in range(5)))
    legal = F.concat(F.when(F.expr(f"{k} % 7 = 0"), "M/s. ").otherwise(""), F.initcap(word), F.lit(" "), _pick(TRADES, k), _pick(FORMS, k))
    out = _read(spark, d, "customer").join(_read(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = out.select(F.col(k).alias("customer_id"), F.concat(F.lit("CUST-"), F.col(k).cast("string")).alias("code"), legal.alias("legal_name"), T.normalize_party_name(legal).alias("normalized_name"), F.col("n_name").alias("city"), F.expr(f"cast(15 * (1 + {k} % 4) as int)").alias("payment_terms_days"))
    return _once(spark, d, "customers", out)


def aliases(spark: SparkSession, d: str) -> DataFrame:
    """alias_id, customer_id, alias, normalized_alias: two of three customers have one."""
    alias = F.concat(F.upper(F.regexp_replace("legal_name", "(M/s\\. | Pvt\\. Ltd\\.| Private Limited| & Co\\.| LLP)", "")), F.lit("-"), F.upper("city"))
    out = customers(spark, d).where("customer_id % 3 < 2").select(F.col("customer_id").alias("alias_id"), "customer_id", alias.alias("alias"), T.normalize_party_name(alias).alias("normalized_alias"))
    return _once(spark, d, "aliases", out)


def invoices(spark: SparkSession, d: str) -> DataFrame:
    """invoice_id, invoice_number, normalized_number, customer_id, invoice_date, due_date, amount_paise, open_amount_paise, status."""
    o = _read(spark, d, "orders")
    number = F.expr("concat('INV-', lpad(cast(o_orderkey as string), greatest(7, length(cast(o_orderkey as string))), '0'))")
    o = o.select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("day"), F.expr("cast(round(o_totalprice * 100) as bigint)").alias("amount"), number.alias("number"))
    open_ = F.expr("case o_orderstatus when 'F' then 0 when 'P' then amount - amount * (10 + o_orderkey % 50) div 100 else amount end")
    status = F.expr("case o_orderstatus when 'F' then 'paid' when 'P' then 'partially_paid' else 'open' end")
    out = o.select(
        F.col("o_orderkey").alias("invoice_id"), F.col("number").alias("invoice_number"), T.normalize_reference(F.col("number")).alias("normalized_number"), F.col("o_custkey").alias("customer_id"),
        F.col("day").alias("invoice_date"), F.expr("date_add(day, cast(15 * (1 + o_custkey % 4) as int))").alias("due_date"), F.col("amount").alias("amount_paise"), open_.cast("bigint").alias("open_amount_paise"), status.alias("status"),
    )
    return _once(spark, d, "invoices", out)


def _paid(spark: SparkSession, d: str) -> DataFrame:
    """The invoices that are paid, with their scenario and, for bundles, the customer's next open invoice."""
    open_ = invoices(spark, d).where("status in ('open', 'partially_paid') and open_amount_paise > 0")
    order = Window.partitionBy("customer_id").orderBy("invoice_date", "invoice_number")
    nxt = F.lead(F.struct("invoice_id", "invoice_number", "open_amount_paise")).over(order)
    k = "(invoice_id div 3) % 100"
    scenario = F.lit(SCENARIOS[-1][0])
    for name, below in reversed(SCENARIOS[:-1]):
        scenario = F.when(F.expr(f"{k} < {below}"), name).otherwise(scenario)
    out = open_.withColumns({"nxt": nxt, "scenario": scenario}).where("invoice_id % 3 = 0")
    return out.withColumn("scenario", F.when((F.col("scenario") == "bundled_multi") & F.col("nxt").isNull(), "exact_single").otherwise(F.col("scenario")))


def _amounts(paid: DataFrame) -> DataFrame:
    o = "open_amount_paise"
    claim = f"greatest({o} * (2 + invoice_id % 10) div 100 div 5000 * 5000, 0)"
    return paid.withColumn("claim_paise", F.expr(f"case when scenario = 'short_pay_deduction' then {claim} else 0 end").cast("bigint")).withColumn(
        "amount_paise",
        F.expr(f"case scenario when 'bundled_multi' then {o} + nxt.open_amount_paise when 'short_pay_deduction' then {o} - claim_paise when 'partial_payment' then {o} * (25 + invoice_id % 60) div 100 when 'no_matching_invoice' then {o} + 777777 else {o} end").cast("bigint"),
    )


def payments(spark: SparkSession, d: str) -> DataFrame:
    """statement_ref, value_date, amount_paise, payer_name_raw, payer_name_normalized, narration, normalized_narration, bank_account, status."""
    p = _amounts(_paid(spark, d)).where("amount_paise > 0").join(customers(spark, d).select("customer_id", "legal_name", "city"), "customer_id")
    payer = F.expr("""case when scenario = 'no_matching_invoice' then concat('CASH DEPOSIT ', cast(invoice_id as string))
        when scenario = 'payer_name_variant' then concat(upper(legal_name), ' ', upper(city), ' BR')
        when invoice_id % 5 = 0 then concat(upper(regexp_replace(legal_name, '(M/s\\\\. | Pvt\\\\. Ltd\\\\.| Private Limited| & Co\\\\.| LLP)', '')), '-', upper(city))
        when invoice_id % 5 = 1 then concat('NEFT CR ', upper(legal_name)) else legal_name end""")
    narration = F.expr("""case scenario when 'exact_single' then concat('NEFT ', invoice_number) when 'bundled_multi' then concat('RTGS ', invoice_number, ', ', nxt.invoice_number)
        when 'short_pay_deduction' then concat('NEFT  INVOICE NO. ', cast(invoice_id as string)) when 'partial_payment' then concat('imps inv/', cast(invoice_id as string), ' part payment')
        when 'missing_reference' then 'NEFT PAYMENT RECEIVED' when 'typo_reference' then concat('NEFT BILL 00', cast(invoice_id as string)) when 'payer_name_variant' then concat('UPI ', invoice_number) else 'CASH' end""")
    p = p.select(
        F.expr("concat('UTR', lpad(cast(invoice_id as string), 12, '0'))").alias("statement_ref"), F.expr("greatest(date_add(due_date, cast(invoice_id % 52 as int) - 6), date_add(invoice_date, 1))").alias("value_date"),
        "amount_paise", payer.alias("payer_name_raw"), narration.alias("narration"), F.lit("ACC-1").alias("bank_account"), F.lit("unmatched").alias("status"),
    )
    p = p.withColumns({"payer_name_normalized": T.normalize_party_name(F.col("payer_name_raw")), "normalized_narration": T.normalize_narration(F.col("narration"))})
    return _once(spark, d, "payments", p)


def truth(spark: SparkSession, d: str) -> DataFrame:
    """statement_ref, scenario, customer_id and the expected allocations; for evaluation only."""
    one = "named_struct('invoice_number', invoice_number, 'allocated', case when scenario = 'bundled_multi' then open_amount_paise else amount_paise end, 'deduction', claim_paise, 'reason', case when claim_paise > 0 then 'damage' end)"
    two = "named_struct('invoice_number', nxt.invoice_number, 'allocated', nxt.open_amount_paise, 'deduction', cast(0 as bigint), 'reason', cast(null as string))"
    expected = F.expr(f"case scenario when 'no_matching_invoice' then filter(array({one}), x -> false) when 'bundled_multi' then array({one}, {two}) else array({one}) end")
    p = _amounts(_paid(spark, d)).where("amount_paise > 0")
    return p.select(F.expr("concat('UTR', lpad(cast(invoice_id as string), 12, '0'))").alias("statement_ref"), "scenario", "customer_id", F.col("amount_paise").alias("paid_paise"), expected.alias("expected"))


def remittances(spark: SparkSession, d: str) -> DataFrame:
    """remittance_id, statement_ref (null for unlinked advice), raw_text: four layouts, for some 55% of payments."""
    p = _amounts(_paid(spark, d)).where("amount_paise > 0 and scenario <> 'no_matching_invoice' and invoice_id % 20 < 11")
    money = lambda c: f"concat('Rs. ', cast(cast({c} as decimal(20,0)) / 100 as decimal(20,2)))"
    second = f"case when scenario = 'bundled_multi' then concat('\\n', nxt.invoice_number, '  ', {money('nxt.open_amount_paise')}) else '' end"
    body = f"""case invoice_id % 4
        when 0 then concat('Subject: remittance advice\\nTotal transferred {"'"}, {money('amount_paise')}, '\\n', invoice_number, '  ', {money('open_amount_paise')}, {second}, case when claim_paise > 0 then concat('\\n', {money('claim_paise')}, ' deducted - 12 cases damaged in transit') else '' end)
        when 1 then concat(invoice_number, ' | ', {money('open_amount_paise')}, '/-', case when claim_paise > 0 then concat(' | less ', {money('claim_paise')}, ' damage') else '' end, {second})
        when 2 then concat('Dear Sir,\\n> ', invoice_number, ' ', {money('open_amount_paise')}, case when claim_paise > 0 then concat(' ', {money('claim_paise')}, ' ', {money('open_amount_paise - claim_paise')}) else '' end, {second}, '\\nRegards, 21 Jan 2026')
        else concat('payment of ', {money('amount_paise')}, ' against ', invoice_number, {second}, '\\nUTR', lpad(cast(invoice_id as string), 12, '0')) end""".replace("""{"'"}""", "'")
    out = p.select(
        F.col("invoice_id").alias("remittance_id"), F.expr("case when invoice_id % 7 = 0 then null else concat('UTR', lpad(cast(invoice_id as string), 12, '0')) end").alias("statement_ref"),
        F.expr(body).alias("raw_text"), F.col("amount_paise").alias("credit_paise"), F.lit("email").alias("source_type"), F.expr("concat('advice-', cast(invoice_id as string), '.txt')").alias("source_filename"),
    )
    return _once(spark, d, "remittances", out)
