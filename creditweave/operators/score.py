"""Confidence of a match, and what to do with it: five weighted signals, four penalties, two thresholds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Scoring, Weights

# How far each way of identification or matching is trusted.
IDENTITY_VALUE = {"exact": 1.0, "alias": 1.0, "reference": 0.90}
AMOUNT_VALUE = {"remittance_guided": 1.0, "reference_exact": 1.0, "amount_exact": 1.0, "subset_sum": 0.80, "short_pay": 0.55}
PARTIAL, SHORT_BY_NAME, UNRECONCILED = 0.70, 0.88, 0.65
NAMES = ["reference_match", "amount_match", "customer_identity", "remittance_agreement", "date_proximity"]


def _lookup(key: str, values: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for k, v in values.items():
        out = F.when(F.col(key) == k, v).otherwise(out)
    return out


def proximity(days: Column, cfg: Scoring) -> Column:
    """1 up to ideal_days, 0 from zero_days, linear between."""
    return F.when(days <= cfg.ideal_days, 1.0).when(days >= cfg.zero_days, 0.0).otherwise(1.0 - (days - cfg.ideal_days) / float(cfg.zero_days - cfg.ideal_days))


def add_values(outcomes: DataFrame, cfg: Scoring) -> DataFrame:
    """outcomes with v_<signal> (null where the signal doesn't apply) and max_days_from_due."""
    top = F.get("candidates", F.lit(0))
    shape, due = top["shape"], F.transform(top["allocations"], lambda a: F.abs(F.datediff(F.col("value_date"), a["due_date"])))
    amount = _lookup("strategy", AMOUNT_VALUE)
    amount = F.when(shape == "partial", amount * PARTIAL).when((shape == "short_pay") & (F.col("strategy") != "short_pay"), amount * SHORT_BY_NAME).otherwise(amount)
    guided, linked = F.col("strategy") == "remittance_guided", F.col("n_documents").isNotNull()
    worst = F.array_max(due)
    return outcomes.withColumns({
        "max_days_from_due": worst,
        "v_reference_match": F.when(F.col("strategy").isin("remittance_guided", "reference_exact"), 1.0).otherwise(0.0),
        "v_amount_match": amount,
        "v_customer_identity": F.when(F.col("method") == "fuzzy", F.col("identity_score")).otherwise(_lookup("method", IDENTITY_VALUE)),
        "v_remittance_agreement": F.when(guided, F.when(F.col("advice_reconciled"), 1.0).otherwise(UNRECONCILED)).when(linked, 0.0),
        "v_date_proximity": F.when(worst.isNotNull(), proximity(worst, cfg)),
    })


def base_score(weights: Weights | dict[str, Column]) -> Column:
    """Weighted mean of the signals that apply; the weights of others leave the denominator. Rounded at 12 places, so that
    sums of binary fractions cannot fall beside a threshold."""
    own = weights if isinstance(weights, dict) else {n: getattr(weights, n) for n in NAMES}
    top = sum((F.coalesce(F.col(f"v_{n}"), F.lit(0.0)) * w for n, w in own.items()), F.lit(0.0))
    bottom = sum((F.when(F.col(f"v_{n}").isNotNull(), w).otherwise(0.0) for n, w in own.items()), F.lit(0.0))
    return F.when(bottom > 0, F.round(top / bottom, 12)).otherwise(0.0)


def penalties(cfg: Scoring) -> list[tuple[str, float, Column]]:
    """(name, multiplier, condition), in the order that they are applied."""
    allocations = F.get("candidates", F.lit(0))["allocations"]
    return [
        ("ambiguous", cfg.ambiguous, F.size("candidates") > 1),
        ("unreconciled_advice", cfg.unreconciled_advice, (F.col("strategy") == "remittance_guided") & ~F.col("advice_reconciled")),
        ("guessed_claim_bearer", cfg.guessed_claim_bearer, (F.size(allocations) > 1) & F.exists(allocations, lambda a: a["deduction"] > 0) & ~F.exists(allocations, lambda a: a["bearer_asserted"])),
        ("residual_cash", cfg.residual_cash, F.col("residual_paise") > 0),
    ]


def decide(confidence: Column, auto: float | Column, floor: float) -> Column:
    """Both bounds are inclusive."""
    return F.when(F.size("candidates") == 0, "unapplied").when(confidence >= auto, "auto_applied").when(confidence >= floor, "needs_review").otherwise("unapplied")


def with_confidence(valued: DataFrame, cfg: Scoring, weights: Weights | dict[str, Column] | None = None) -> DataFrame:
    """Values to base_score, penalties, confidence and decision."""
    has = F.size("candidates") > 0
    out = valued.withColumn("base_score", F.when(has, base_score(weights or cfg.weights)).otherwise(0.0))
    confidence, rows = F.col("base_score"), []
    for name, factor, when in penalties(cfg):
        when = has & F.coalesce(when, F.lit(False))
        confidence = confidence * F.when(when, factor).otherwise(1.0)
        rows.append(F.when(when, F.struct(F.lit(name).alias("name"), F.lit(factor).alias("multiplier"))))
    out = out.withColumns({"confidence": F.when(has, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(confidence, 12)))).otherwise(0.0), "penalties": F.filter(F.array(*rows), lambda p: p.isNotNull())})
    return out.withColumn("decision", decide(F.col("confidence"), cfg.auto_apply, cfg.review_floor))


def score(outcomes: DataFrame, cfg: Scoring) -> DataFrame:
    """Outcomes with signals, confidence, decision and a sentence of at most 500 characters that says why."""
    out = with_confidence(add_values(outcomes, cfg), cfg)
    rows = []
    for n in NAMES:
        v, w = F.col(f"v_{n}"), getattr(cfg.weights, n)
        rows.append(F.struct(F.lit(n).alias("name"), F.coalesce(v > 0, F.lit(False)).alias("fired"), F.coalesce(v, F.lit(0.0)).alias("value"), F.lit(w).alias("weight"), v.isNotNull().alias("applicable")))
    out = out.withColumn("signals", F.when(F.size("candidates") > 0, F.array(*rows)).otherwise(F.slice(F.array(*rows), 1, 0)))
    first = F.get("candidates", F.lit(0))["allocations"]
    numbers = F.array_join(F.transform(first, lambda a: a["invoice_number"]), ", ")
    claim = F.aggregate(first, F.lit(0).cast("bigint"), lambda t, a: t + a["deduction"])
    lead = F.when(F.col("decision") == "auto_applied", "Applied automatically").when(F.col("decision") == "needs_review", "Sent for review").otherwise("Left unapplied")
    text = F.concat(lead, F.lit(" at "), F.round(F.col("confidence") * 100, 0).cast("int").cast("string"), F.lit("% confidence: "), numbers, F.lit(", by "), F.col("strategy"), F.lit("."), F.when(claim > 0, F.concat(F.lit(" Deduction: "), claim.cast("string"), F.lit(" paise."))).otherwise(""), F.when(F.size("penalties") > 0, F.concat(F.lit(" Penalties: "), F.array_join(F.transform("penalties", lambda p: p["name"]), ", "), F.lit("."))).otherwise(""))
    missed = F.filter("trail", lambda s: ~s["fired"])
    nothing = F.concat(F.lit("No credible allocation: "), F.coalesce(F.when(F.size(missed) > 0, F.try_element_at(missed, F.lit(-1))["detail"]), F.lit("no signal fired")), F.lit("."))
    out = out.withColumn("reason_text", F.left(F.when(F.size("candidates") > 0, text).otherwise(nothing), F.lit(500)))
    return out.withColumn("explanation", F.to_json(F.struct("decision", F.round("confidence", 4).alias("confidence"), F.round("base_score", 4).alias("base_score"), "signals", "penalties", F.col("reason_text").alias("reason"), F.struct("strategy", "method", "references", "trail", "pool_size").alias("matching"))))


def expected_ladder(values: list[tuple[float, float]], factors: list[float]) -> float:
    """The confidence of (value, weight) pairs under these penalties; for tests and documentation."""
    return math.prod(factors, start=sum(v * w for v, w in values) / sum(w for _, w in values))
