"""How money lands on a set of invoices: exact, short-paid, part-paid, or not at all. Pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Matching

ALLOCATION = "struct<invoice_id: bigint, invoice_number: string, normalized_number: string, customer_id: bigint, due_date: date, open_amount_paise: bigint, allocated: bigint, deduction: bigint, reason: string, bearer_asserted: boolean>"
SETTLEMENT = f"struct<shape: string, allocations: array<{ALLOCATION}>>"


def total_open(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda t, i: t + i["open_amount_paise"])


def smallest(items: Column, above: Column | None = None) -> Column:
    """The smallest item (ties: invoice number), of those that are open for more than `above`; null if there is none."""
    fits = items if above is None else F.filter(items, lambda i: i["open_amount_paise"] > above)
    ranked = F.array_sort(F.transform(fits, lambda i: F.struct(i["open_amount_paise"].alias("o"), i["invoice_number"].alias("n"), i["invoice_id"].alias("id"))))
    return F.when(F.size(ranked) > 0, F.try_element_at(ranked, F.lit(1)))


def plausible_deduction(gap: Column, bearer_open: Column, cfg: Matching) -> Column:
    share = gap.cast("double") / bearer_open.cast("double") * 100
    short = cfg.short_pay
    return F.coalesce((gap > 0) & (gap < bearer_open) & (gap <= short.max_deduction_paise) & (share >= short.min_deduction_pct) & (share <= short.max_deduction_pct), F.lit(False))


def deduction_band(amount: Column, cfg: Matching) -> tuple[Column, Column]:
    """Totals worth searching for a short payment of this amount: above it, by the largest possible claim at most."""
    share = cfg.short_pay.max_deduction_pct / (100 - cfg.short_pay.max_deduction_pct)
    gap = F.least(F.floor(amount.cast("double") * share).cast("bigint"), F.lit(cfg.short_pay.max_deduction_paise).cast("bigint"))
    return amount + 1, amount + F.greatest(gap, F.lit(0).cast("bigint"))


def _allocate(items: Column, bearer_id: Column, taken: Column, reason: str | None) -> Column:
    """Every item in full, but for `taken` on the bearer, which is booked as its deduction."""

    def one(i: Column) -> Column:
        here = F.coalesce(i["invoice_id"] == bearer_id, F.lit(False))
        cut = F.when(here, taken).otherwise(F.lit(0).cast("bigint"))
        return F.struct(
            i["invoice_id"].alias("invoice_id"), i["invoice_number"].alias("invoice_number"), i["normalized_number"].alias("normalized_number"), i["customer_id"].alias("customer_id"), i["due_date"].alias("due_date"),
            i["open_amount_paise"].alias("open_amount_paise"), (i["open_amount_paise"] - cut).alias("allocated"), cut.alias("deduction"), F.when(cut > 0, F.lit(reason)).alias("reason"), F.lit(False).alias("bearer_asserted"),
        )

    return F.transform(items, one)


def settle(items: Column, amount: Column, cfg: Matching, allow_partial: bool = True, allow_short_pay: bool = True) -> Column:
    """SETTLEMENT of these items (in order of invoice_number) by this amount, or null. Exact comes first, then short-pay
    (a believable claim on the smallest item that can bear it; there is no second choice), then part payment of one item."""
    total, tolerance, zero = total_open(items), cfg.tolerance_paise, F.lit(0).cast("bigint")
    gap = total - amount
    least, bearer = smallest(items), smallest(items, gap)
    exact = _allocate(items, F.when(gap > 0, least["id"]), F.greatest(gap, zero), "unknown")
    short = _allocate(items, bearer["id"], gap, "unknown")
    left = F.transform(items, lambda i: F.struct(*(i[c].alias(c) for c in ("invoice_id", "invoice_number", "normalized_number", "customer_id", "due_date", "open_amount_paise")), amount.alias("allocated"), zero.alias("deduction"), F.lit(None).cast("string").alias("reason"), F.lit(False).alias("bearer_asserted")))
    usable = (F.size(items) > 0) & (amount > 0)
    made = lambda shape, a: F.struct(F.lit(shape).alias("shape"), a.alias("allocations")).cast(SETTLEMENT)
    out = F.when(usable & (F.abs(gap) <= tolerance), made("exact", exact))
    if allow_short_pay and cfg.short_pay.search.enabled:
        out = out.when(usable & (gap > 0) & plausible_deduction(gap, bearer["o"], cfg), made("short_pay", short))
    if allow_partial:
        out = out.when(usable & (F.size(items) == 1) & (amount < total - tolerance), made("partial", left))
    return out
