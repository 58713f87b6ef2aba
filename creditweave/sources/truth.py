"""The answer key as JSON: written with the data set, read by evaluation only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "statement_ref string, scenario string, customer_id bigint, paid_paise bigint, expected array<struct<invoice_number: string, allocated: bigint, deduction: bigint, reason: string>>"


def write(truth: DataFrame, path: str) -> None:
    truth.write.mode("overwrite").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def faults(truth: DataFrame) -> DataFrame:
    """(statement_ref, fault): sums that don't make the payment, empty keys of payments that should match, claims without a reason."""
    total = F.aggregate("expected", F.lit(0).cast("bigint"), lambda t, a: t + a["allocated"])
    fault = (
        F.when((F.size("expected") == 0) & (F.col("scenario") != "no_matching_invoice"), "no allocation")
        .when((F.size("expected") > 0) & (total != F.col("paid_paise")), "the allocations don't sum to the payment")
        .when(F.exists("expected", lambda a: (a["deduction"] > 0) & a["reason"].isNull()), "a deduction has no reason")
    )
    return truth.select("statement_ref", fault.alias("fault")).where("fault is not null")
