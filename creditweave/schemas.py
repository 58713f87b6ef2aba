"""The tables, and the rules that their rows must meet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = {
    "customers": "customer_id bigint, code string, legal_name string, normalized_name string, city string, payment_terms_days int",
    "customer_aliases": "alias_id bigint, customer_id bigint, alias string, normalized_alias string, source string",
    "invoices": "invoice_id bigint, invoice_number string, normalized_number string, customer_id bigint, invoice_date date, due_date date, amount_paise bigint, open_amount_paise bigint, currency string, status string, po_number string",
    "bank_transactions": "statement_ref string, value_date date, amount_paise bigint, payer_name_raw string, payer_name_normalized string, narration string, normalized_narration string, bank_account string, status string",
    "remittances": "remittance_id bigint, statement_ref string, source_type string, raw_text string, source_filename string, received_at timestamp, link_source string, extraction_status string, extraction_method string, extracted_payload string, extraction_error string",
    "match_results": "result_id string, statement_ref string, decision string, confidence decimal(5,4), strategy string, matched_amount_paise bigint, unapplied_amount_paise bigint, explanation string, reason_text string, engine_version string, reviewed_by string, reviewed_at timestamp, review_action string, review_note string",
    "match_allocations": "result_id string, statement_ref string, invoice_id bigint, invoice_number string, allocated_amount_paise bigint, deduction_amount_paise bigint, deduction_reason string, deduction_note string",
    "ground_truth": "statement_ref string, scenario string, customer_id bigint, paid_paise bigint, expected array<struct<invoice_number: string, allocated: bigint, deduction: bigint, reason: string>>",
    "audit_log": "entity_type string, entity_id string, action string, actor string, payload_before string, payload_after string",
}
# The domains of the status columns.
DOMAINS = {
    ("customer_aliases", "source"): ["erp", "learned", "manual"],
    ("invoices", "status"): ["open", "partially_paid", "paid", "written_off"],
    ("bank_transactions", "status"): ["unmatched", "matched", "partially_applied", "ignored"],
    ("match_results", "decision"): ["auto_applied", "needs_review", "unapplied", "manually_applied", "rejected"],
    ("match_allocations", "deduction_reason"): ["damage", "short_ship", "promo", "pricing", "freight", "tds", "unknown"],
}
UNIQUE = {"customers": ["code"], "customer_aliases": ["customer_id", "normalized_alias"], "invoices": ["invoice_number"], "bank_transactions": ["statement_ref"], "match_results": ["result_id"], "match_allocations": ["result_id", "invoice_id"]}
RULES = {
    "invoices": {"amount above 0": "amount_paise > 0", "open between 0 and amount": "open_amount_paise between 0 and amount_paise"},
    "bank_transactions": {"amount above 0": "amount_paise > 0"},
    "match_results": {"confidence from 0 to 1": "confidence between 0 and 1", "matched at least 0": "matched_amount_paise >= 0"},
    "match_allocations": {"amounts at least 0": "allocated_amount_paise >= 0 and deduction_amount_paise >= 0"},
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def violations(df: DataFrame, name: str) -> DataFrame:
    """(rule, rows) that fail in df; none where the table is sound."""
    checks = {k: ~F.coalesce(F.expr(v), F.lit(False)) for k, v in RULES.get(name, {}).items()}
    for (table, column), values in DOMAINS.items():
        if table == name and column in df.columns:
            checks[f"{column} in its domain"] = F.col(column).isNotNull() & ~F.col(column).isin(values)
    if name in UNIQUE:
        df = df.withColumn("_n", F.count("*").over(Window.partitionBy(*UNIQUE[name])))
        checks[f"unique {', '.join(UNIQUE[name])}"] = F.col("_n") > 1
    bad = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items())), lambda x: x.isNotNull())
    return df.select(F.explode(bad).alias("rule")).groupBy("rule").agg(F.count("*").alias("rows"))


#: The tables of a data set, children first: the order in which they are emptied. The audit log is no part of it.
RESET_ORDER = ["match_allocations", "match_results", "ground_truth", "remittances", "bank_transactions", "invoices", "customer_aliases", "customers"]

