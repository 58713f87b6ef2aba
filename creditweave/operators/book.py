"""The open-item book: what is open, who is known by what name, which items a payment may settle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Matching

ITEM = ["invoice_id", "invoice_number", "normalized_number", "customer_id", "invoice_date", "due_date", "open_amount_paise"]


def is_open() -> Column:
    return F.col("status").isin("open", "partially_paid") & (F.col("open_amount_paise") > 0)


def open_items(invoices: DataFrame) -> DataFrame:
    """Open and part-paid invoices with something left, in the seven columns that matching needs."""
    return invoices.where(is_open()).select(*ITEM)


def names(customers: DataFrame) -> DataFrame:
    """normalized_name -> customer_id; of equal names the highest id."""
    return customers.where("normalized_name <> ''").groupBy("normalized_name").agg(F.max("customer_id").alias("customer_id"))


def alias_names(aliases: DataFrame) -> DataFrame:
    """normalized_alias -> customer_id; of equal aliases the first one entered."""
    return aliases.where("normalized_alias <> ''").groupBy("normalized_alias").agg(F.min_by("customer_id", "alias_id").alias("customer_id"))


def by_number(items: DataFrame) -> DataFrame:
    """One item for each normalised number: the earliest by (invoice_date, invoice_number)."""
    first = F.row_number().over(Window.partitionBy("normalized_number").orderBy("invoice_date", "invoice_number", "invoice_id"))
    return items.withColumn("_rn", first).where("_rn = 1").drop("_rn")


def candidate_pool(payments: DataFrame, items: DataFrame, cfg: Matching) -> DataFrame:
    """For each payment (statement_ref, value_date, customer_id) its customer's items in the date window: the `max_pool`
    nearest by due date (ties: invoice_number), as rows. The cap is a window limit, so Spark prunes before the shuffle.

    The join is on customer and span of days, as long as the window: a payment meets one or two spans of its customer, so
    the years of a large customer's book spread over tasks and never meet all of its payments."""
    first, last = F.date_sub("value_date", cfg.days_before_payment), F.date_add("value_date", cfg.days_after_payment)
    width = cfg.days_before_payment + cfg.days_after_payment + 1
    span = lambda day: F.floor(F.unix_date(day) / width)
    near = F.abs(F.datediff("due_date", "value_date"))
    rank = F.row_number().over(Window.partitionBy("statement_ref").orderBy(near, "invoice_number", "invoice_id"))
    joined = payments.withColumn("_span", F.explode(F.sequence(span(first), span(last)))).join(items.withColumn("_span", span(F.col("invoice_date"))), ["customer_id", "_span"])
    joined = joined.where(F.col("invoice_date").between(first, last)).drop("_span")
    return joined.withColumn("pool_rank", rank).where(F.col("pool_rank") <= cfg.max_pool)
