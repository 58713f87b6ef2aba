"""Exact ranks and running totals of any number of rows without sorting them in one task.

Rows are cut into buckets that keep the order; a bucket's rows are ranked where they are, and what stands before it comes from
counts of a row a bucket. So a task sorts one bucket of one group, however large the group is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, by: list[str], order: list[str], bucket: Column, value: str | None = None, rank: str = "rank", before: str = "before") -> DataFrame:
    """df with `rank` (from 1) inside each group of `by` (all rows, if empty) and, where a value column is named, `before`: the sum
    of the values of the rows before.

    order must be unique in a group, and bucket must not fall as order goes up. Rows with a null in `by` or a null bucket are
    left out; a null value adds nothing. Without `by` the counts of all buckets pass through one task, so there
    should be some thousands of buckets at most."""
    amount = F.coalesce(F.col(value), F.lit(0)) if value else F.lit(0)
    rows = df.withColumns({"_bucket": bucket, "_amount": amount.cast("bigint")})
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"), F.sum("_amount").alias("_s"))
    zero = F.lit(0).cast("bigint")
    sums = sums.select(*by, "_bucket", F.coalesce(F.sum("_n").over(earlier), zero).alias("_n"), F.coalesce(F.sum("_s").over(earlier), zero).alias("_s"))
    here = Window.partitionBy(*by, "_bucket").orderBy(*order)
    inside = here.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_rank": F.row_number().over(here), "_before": F.coalesce(F.sum("_amount").over(inside), zero)})
    out = rows.join(sums, [*by, "_bucket"])
    added = {rank: F.col("_n") + F.col("_rank")} | ({before: F.col("_s") + F.col("_before")} if value else {})
    return out.withColumns(added).drop("_bucket", "_amount", "_n", "_s", "_rank", "_before")
