"""What the dashboard, the review queue and the pickers show."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import format_inr
from ..operators.book import is_open
from .evaluate import rate


def by_decision(results: DataFrame, payments: DataFrame) -> DataFrame:
    both = results.join(payments.select("statement_ref", "amount_paise"), "statement_ref")
    return both.groupBy("decision").agg(F.count("*").alias("n"), F.sum("amount_paise").cast("bigint").alias("value_paise"))


def by_strategy(results: DataFrame) -> DataFrame:
    return results.groupBy("strategy").agg(F.count("*").alias("n"))


def dashboard(customers: DataFrame, invoices: DataFrame, payments: DataFrame, results: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """One row; rates are of what was decided. auto_precision is measured where an answer key was joined (judged, as
    evaluate.compare gives it) and something was applied, else null. Receivables count what is left of open items, and sum by status alone."""
    credits = payments.agg(F.count("*").alias("credits"), F.coalesce(F.sum("amount_paise"), F.lit(0)).cast("bigint").alias("credit_paise"))
    owed = F.col("status").isin("open", "partially_paid")
    book = invoices.agg(F.count_if(is_open()).alias("open_invoices"), F.coalesce(F.sum(F.when(owed, F.col("open_amount_paise"))), F.lit(0)).cast("bigint").alias("receivable_paise"))
    people = customers.agg(F.count("*").alias("customers"))
    done = results.agg(F.count("*").alias("decided"), F.count_if(F.col("decision") == "auto_applied").alias("auto_applied"), F.count_if(F.col("decision") == "needs_review").alias("needs_review"), F.count_if(F.col("decision") == "unapplied").alias("unapplied"), F.count_if(F.col("reviewed_at").isNotNull()).alias("reviewed"))
    out = credits.crossJoin(book).crossJoin(people).crossJoin(done)  # single rows
    if judged is None:
        out = out.withColumn("auto_precision", F.lit(None).cast("double"))
    else:
        out = out.crossJoin(judged.agg((F.count_if((F.col("decision") == "auto_applied") & F.col("is_correct")) / F.nullif(F.count_if(F.col("decision") == "auto_applied"), F.lit(0))).alias("auto_precision")))
    return out.withColumns({"auto_rate": rate(F.col("auto_applied"), F.col("decided")), "review_rate": rate(F.col("needs_review"), F.col("decided")), "unapplied_rate": rate(F.col("unapplied"), F.col("decided"))})


def decision_summary(scored: DataFrame) -> DataFrame:
    """Counts and value of each bucket, deductions found, and the three rates, in one pass."""
    first = F.get("candidates", F.lit(0))["allocations"]
    claim = F.coalesce(F.exists(first, lambda a: a["deduction"] > 0), F.lit(False)) & (F.col("decision") != "unapplied")
    cols = [F.count("*").alias("total")]
    for d in ("auto_applied", "needs_review", "unapplied"):
        cols += [F.count_if(F.col("decision") == d).alias(d), F.coalesce(F.sum(F.when(F.col("decision") == d, F.col("amount_paise"))), F.lit(0)).cast("bigint").alias(f"{d}_paise")]
    out = scored.agg(*cols, F.count_if(claim).alias("deductions"))
    return out.withColumns({f"{d}_rate": rate(F.col(d), F.col("total")) for d in ("auto_applied", "needs_review", "unapplied")})


def confidence_histogram(scored: DataFrame) -> DataFrame:
    """Bands of ten points, the top one with 1.0; `0.00` for none."""
    band = F.least(F.floor(F.col("confidence") * 10) / 10, F.lit(0.9))
    name = F.when(F.col("confidence") <= 0, "0.00").otherwise(F.concat(F.format_string("%.1f", band), F.lit("-"), F.format_string("%.1f", band + 0.1)))
    return scored.groupBy(name.alias("band")).agg(F.count("*").alias("n"))


def match_summary(outcomes: DataFrame) -> DataFrame:
    """By strategy and identification: payments, ties, nodes searched, largest pool, searches cut short."""
    return outcomes.groupBy("strategy", "method").agg(
        F.count("*").alias("n"), F.count_if(F.size("candidates") > 1).alias("ambiguous"), F.coalesce(F.sum("subset_nodes"), F.lit(0)).cast("bigint").alias("subset_nodes"), F.coalesce(F.sum("short_nodes"), F.lit(0)).cast("bigint").alias("short_nodes"),
        F.max("pool_size").alias("largest_pool"), F.count_if(F.col("subset_exhausted") | F.col("short_exhausted")).alias("exhausted"),
    )


def customer_balances(customers: DataFrame, invoices: DataFrame) -> DataFrame:
    owed = invoices.where(is_open()).groupBy("customer_id").agg(F.count("*").alias("open_invoices"), F.sum("open_amount_paise").cast("bigint").alias("open_paise"))
    zero = F.lit(0).cast("bigint")
    return customers.select("customer_id", "code", "legal_name", "city").join(owed, "customer_id", "left").withColumns({"open_invoices": F.coalesce("open_invoices", zero), "open_paise": F.coalesce("open_paise", zero)})


def find_customers(customers: DataFrame, text: str = "", limit: int = 50) -> DataFrame:
    hit = F.lower("legal_name").contains(text.lower()) | F.lower("code").contains(text.lower())
    return customers.where(hit).orderBy("legal_name", "customer_id").limit(limit)


def find_invoices(invoices: DataFrame, customer_id: int | None = None, text: str = "", limit: int = 50) -> DataFrame:
    out = invoices.where(is_open() & F.lower("invoice_number").contains(text.lower()))
    return (out if customer_id is None else out.where(F.col("customer_id") == customer_id)).orderBy("due_date", "invoice_number").limit(limit)


def money(paise: str):
    """STRUCT<paise, display>, as the wire format has it."""
    return F.struct(F.col(paise).alias("paise"), format_inr(F.col(paise)).alias("display"))


def review_queue(results: DataFrame, payments: DataFrame, allocations: DataFrame | None = None, *, decision: str | None = None, strategy: str | None = None, reviewed: bool | None = None, least: float | None = None, most: float | None = None, text: str = "", has_deduction: bool | None = None, offset: int = 0, limit: int = 50, legacy_paging: bool = False) -> tuple[DataFrame, DataFrame]:
    """(page, total): newest value date first. Filters narrow the total too; with legacy_paging has_deduction is applied
    to the page only."""
    rows = results.join(payments.select("statement_ref", "value_date", "amount_paise", "payer_name_raw", "narration"), "statement_ref")
    for column, value in (("decision", decision), ("strategy", strategy)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if reviewed is not None:
        rows = rows.where(F.col("reviewed_at").isNotNull() if reviewed else F.col("reviewed_at").isNull())
    if least is not None:
        rows = rows.where(F.col("confidence") >= least)
    if most is not None:
        rows = rows.where(F.col("confidence") <= most)
    if text:
        rows = rows.where(F.lower("statement_ref").contains(text.lower()) | F.lower("payer_name_raw").contains(text.lower()) | F.lower("narration").contains(text.lower()))

    def deducted(df: DataFrame) -> DataFrame:
        if has_deduction is None or allocations is None:
            return df
        some = allocations.where("deduction_amount_paise > 0").select("result_id").distinct()
        return df.join(some, "result_id", "left_semi" if has_deduction else "left_anti")

    order = [F.desc("value_date"), F.desc("statement_ref")]
    if legacy_paging:
        return deducted(rows.orderBy(*order).offset(offset).limit(limit)).orderBy(*order), rows.agg(F.count("*").alias("total"))
    rows = deducted(rows)
    return rows.orderBy(*order).offset(offset).limit(limit), rows.agg(F.count("*").alias("total"))


def result_detail(results: DataFrame, payments: DataFrame, allocations: DataFrame, invoices: DataFrame, customers: DataFrame, advice: DataFrame | None = None) -> DataFrame:
    """Each result with its payment, its allocations (invoice and customer inside) and the first linked advice's text."""
    own = allocations.join(invoices.select("invoice_id", "customer_id", "due_date", F.col("amount_paise").alias("invoice_paise")), "invoice_id", "left").join(customers.select("customer_id", "legal_name"), "customer_id", "left")
    own = own.groupBy("result_id").agg(F.array_sort(F.collect_list(F.struct("invoice_number", "allocated_amount_paise", "deduction_amount_paise", "deduction_reason", "due_date", "invoice_paise", "legal_name"))).alias("allocations"))
    out = results.join(payments.drop("status"), "statement_ref").join(own, "result_id", "left")
    if advice is not None:
        text = advice.where("statement_ref is not null").groupBy("statement_ref").agg(F.min_by("raw_text", "remittance_id").alias("advice_text"))
        out = out.join(text, "statement_ref", "left")
    return out


def statement(payments: DataFrame, statement_ref: str | None = None, limit: int = 0) -> DataFrame:
    """Unmatched credits by (value_date, statement_ref); a named one whatever its status; limit 0 is no limit."""
    out = payments.where(F.col("statement_ref") == statement_ref) if statement_ref else payments.where("status = 'unmatched'")
    out = out.orderBy("value_date", "statement_ref")
    return out.limit(limit) if limit else out


def running_balance(payments: DataFrame) -> DataFrame:
    """Credits of each payer in statement order with their running sum."""
    order = Window.partitionBy("payer_name_normalized").orderBy("value_date", "statement_ref").rowsBetween(Window.unboundedPreceding, 0)
    return payments.select("statement_ref", "payer_name_normalized", F.sum("amount_paise").over(order).alias("running_paise"))
