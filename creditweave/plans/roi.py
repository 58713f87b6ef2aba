"""What automation saves, in hours and money, at measured rates. Projections are rounded to whole paise, half-even."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Assumptions:
    monthly_payments: int = 800
    minutes_per_payment: float = 4.0
    review_minutes: float = 2.0
    hourly_cost_rupees: float = 600.0
    error_hours: float = 3.0

    def __post_init__(self) -> None:
        if self.monthly_payments <= 0 or self.minutes_per_payment <= 0 or self.hourly_cost_rupees <= 0:
            raise ValueError("volume, minutes and hourly cost must be above 0")
        if self.review_minutes < 0 or self.error_hours < 0:
            raise ValueError("review minutes and error hours must not be below 0")


def outcome(rates: DataFrame, a: Assumptions) -> DataFrame:
    """rates (auto_match_rate, review_rate, unapplied_rate, precision) with hours and paise a month; an unknown precision
    leaves the cost of errors out."""
    paise = lambda rupees: F.bround(rupees * 100, 0).cast("bigint")
    before = F.lit(a.monthly_payments * a.minutes_per_payment / 60)
    left = F.col("review_rate") * (a.monthly_payments * a.review_minutes / 60) + F.col("unapplied_rate") * (a.monthly_payments * a.minutes_per_payment / 60)
    wrong: Column = F.col("auto_match_rate") * a.monthly_payments * (1 - F.col("precision"))
    out = rates.withColumns({"baseline_hours": before, "remaining_hours": left}).withColumn("hours_saved", F.col("baseline_hours") - F.col("remaining_hours"))
    out = out.withColumns({"baseline_cost_paise": paise(F.col("baseline_hours") * a.hourly_cost_rupees), "remaining_cost_paise": paise(F.col("remaining_hours") * a.hourly_cost_rupees), "expected_error_cost_paise": F.coalesce(paise(wrong * (a.error_hours * a.hourly_cost_rupees)), F.lit(0).cast("bigint"))})
    out = out.withColumn("gross_saving_paise", F.col("baseline_cost_paise") - F.col("remaining_cost_paise"))
    return out.withColumn("net_saving_paise", F.col("gross_saving_paise") - F.col("expected_error_cost_paise")).withColumn("annual_net_paise", F.col("net_saving_paise") * 12)


def sensitivity(rates: DataFrame, a: Assumptions, levels: tuple[float, ...] = (1.0, 0.99, 0.97, 0.95, 0.90)) -> DataFrame:
    return outcome(rates.drop("precision").withColumn("precision", F.explode(F.array(*map(F.lit, levels)))), a)
