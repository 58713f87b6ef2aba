"""How good the decisions are against an answer key. Only this module joins the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Scoring
from ..operators import score as S


def rate(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole == 0, empty).otherwise(part / whole)


def compare(scored: DataFrame, truth: DataFrame, tolerance: int = 100) -> DataFrame:
    """One row for each decided payment: scenario, verdict, reason_correct (null where nothing was to be classified).

    verdict: correct, wrong, missed or correctly_unapplied; an unapplied decision proposes nothing. A decision without
    truth raises when the result is computed."""
    return _judged(scored.join(_wanted(truth), "statement_ref", "left"), tolerance)


def _wanted(truth: DataFrame) -> DataFrame:
    return truth.select("statement_ref", "scenario", F.array_sort(F.transform("expected", lambda a: F.struct(a["invoice_number"].alias("n"), a["allocated"].alias("v"), a["deduction"].alias("d"), a["reason"].alias("r")))).alias("wanted"))


def _judged(both: DataFrame, tolerance: int = 100, keep: tuple[str, ...] = ()) -> DataFrame:
    """Verdicts on decisions that stand beside what was `wanted`."""
    first = F.get("candidates", F.lit(0))["allocations"]
    kept = F.coalesce(F.when(F.col("decision") != "unapplied", first), F.slice(first, 1, 0))
    proposed = F.coalesce(F.array_sort(F.transform(kept, lambda a: F.struct(a["invoice_number"].alias("n"), a["allocated"].alias("v"), a["deduction"].alias("d"), a["reason"].alias("r")))), F.array().cast("array<struct<n: string, v: bigint, d: bigint, r: string>>"))
    both = both.withColumn("proposed", proposed)
    numbers = lambda c: F.transform(c, lambda a: a["n"])
    same = numbers("wanted") == numbers("proposed")
    tie = F.forall(F.zip_with("wanted", "proposed", lambda a, b: F.coalesce(F.abs(a["v"] - b["v"]) <= tolerance, F.lit(False))), lambda x: x)
    none, nothing = F.size("proposed") == 0, F.size("wanted") == 0
    verdict = F.when(none & nothing, "correctly_unapplied").when(none, "missed").when(nothing, "wrong").when(same & tie, "correct").otherwise("wrong")
    claims = F.filter("wanted", lambda a: (a["d"] > 0) & a["r"].isNotNull())
    right = F.forall(claims, lambda w: F.exists("proposed", lambda p: (p["n"] == w["n"]) & (p["d"] > 0) & F.coalesce(p["r"] == w["r"], F.lit(False))))
    out = both.withColumn("verdict", F.when(F.col("wanted").isNull(), F.raise_error(F.concat(F.lit("no truth for "), F.col("statement_ref")))).otherwise(verdict))
    out = out.withColumns({"invoices_correct": same & ~none & ~nothing, "reason_correct": F.when((F.col("verdict") == "correct") & (F.size(claims) > 0), right)})
    is_correct = F.col("verdict").isin("correct", "correctly_unapplied")
    return out.withColumns({"is_correct": is_correct, "is_costly": (F.col("decision") == "auto_applied") & ~is_correct}).select(*keep, "statement_ref", "scenario", "strategy", "decision", "verdict", "confidence", "amount_paise", "invoices_correct", "reason_correct", "is_correct", "is_costly", F.size("candidates").alias("n_candidates"))


def _counts() -> dict[str, Column]:
    auto = F.col("decision") == "auto_applied"
    money = lambda when: F.coalesce(F.sum(F.when(when, F.col("amount_paise"))), F.lit(0)).cast("bigint")
    return {
        "total": F.count("*"), "auto_applied": F.count_if(auto), "needs_review": F.count_if(F.col("decision") == "needs_review"), "unapplied": F.count_if(F.col("decision") == "unapplied"),
        "correct": F.count_if("is_correct"), "wrong": F.count_if(F.col("verdict") == "wrong"), "missed": F.count_if(F.col("verdict") == "missed"), "auto_wrong": F.count_if("is_costly"),
        "review_correct": F.count_if((F.col("decision") == "needs_review") & F.col("is_correct")), "reason_scored": F.count_if(F.col("reason_correct").isNotNull()), "reason_correct": F.count_if("reason_correct"),
        "value_paise": money(F.lit(True)), "auto_value_paise": money(auto), "auto_wrong_value_paise": money(F.col("is_costly")),
    }


def _rates(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns({
        "auto_match_rate": rate(c("auto_applied"), c("total")), "auto_precision": rate(c("auto_applied") - c("auto_wrong"), c("auto_applied")), "value_precision": rate(c("auto_value_paise") - c("auto_wrong_value_paise"), c("auto_value_paise")),
        "review_rate": rate(c("needs_review"), c("total")), "unapplied_rate": rate(c("unapplied"), c("total")), "accuracy": rate(c("correct"), c("total")), "reason_accuracy": rate(c("reason_correct"), c("reason_scored")), "recoverable_rate": rate(c("review_correct"), c("total")),
    })


def report(judged: DataFrame) -> DataFrame:
    """The headline row."""
    return _rates(judged.agg(*(v.alias(k) for k, v in _counts().items())))


def breakdown(judged: DataFrame) -> DataFrame:
    """The same for each scenario and each strategy, from one pass with grouping sets."""
    sets = judged.groupingSets([("scenario",), ("strategy",)], "scenario", "strategy").agg(*(v.alias(k) for k, v in _counts().items()))
    return _rates(sets)


def worst_errors(judged: DataFrame, n: int = 10) -> DataFrame:
    return judged.where("is_costly").orderBy(F.desc("amount_paise"), "statement_ref").limit(n)


def sweep(judged: DataFrame, cfg: Scoring, thresholds: list[float] | None = None) -> DataFrame:
    """Re-decides every payment at each cut-off, without scoring again. Precision is 1 where nothing is applied."""
    cuts = thresholds or [round(0.50 + 0.05 * i, 2) for i in range(11)]
    each = judged.withColumn("threshold", F.explode(F.array(*map(F.lit, cuts))))
    some = F.col("n_candidates") > 0
    auto = some & (F.col("confidence") >= F.col("threshold"))
    review = some & ~auto & (F.col("confidence") >= cfg.review_floor)
    money = lambda when: F.coalesce(F.sum(F.when(when, F.col("amount_paise"))), F.lit(0)).cast("bigint")
    out = each.groupBy("threshold").agg(
        F.count("*").alias("total"), F.count_if(auto).alias("auto_applied"), F.count_if(auto & F.col("is_correct")).alias("auto_correct"), F.count_if(auto & ~F.col("is_correct")).alias("auto_wrong"),
        F.count_if(review).alias("review"), F.count_if(~auto & ~review).alias("unapplied"), money(auto).alias("auto_value_paise"), money(auto & ~F.col("is_correct")).alias("auto_wrong_value_paise"),
    )
    return out.withColumns({"auto_rate": rate(F.col("auto_applied"), F.col("total")), "precision": rate(F.col("auto_correct"), F.col("auto_applied"), 1.0)})


def recommend(rows: DataFrame, least_precision: float = 0.99) -> DataFrame:
    """The sweep row with the most automation at this precision; of equal ones the lowest threshold."""
    return rows.where((F.col("auto_applied") > 0) & (F.col("precision") >= least_precision)).orderBy(F.desc("auto_rate"), "threshold").limit(1)


def ablation(outcomes: DataFrame, truth: DataFrame, cfg: Scoring) -> DataFrame:
    """For each signal left out (and none), the headline counts. The search isn't run again: every outcome is scored with all
    sets of weights where it stands, so outcomes and truth are read once and only sums move."""
    sets = {"none": cfg.weights} | {name: cfg.weights.without(name) for name in S.NAMES}
    rows = F.array(*(F.struct(F.lit(k).alias("left_out"), *(F.lit(float(getattr(w, n))).alias(n) for n in S.NAMES)) for k, w in sets.items()))
    both = S.add_values(outcomes, cfg).join(_wanted(truth), "statement_ref", "left").withColumn("weights", F.explode(rows))
    scored = S.with_confidence(both, cfg, {n: F.col(f"weights.{n}") for n in S.NAMES}).withColumn("left_out", F.col("weights.left_out"))
    return _rates(_judged(scored, keep=("left_out",)).groupBy("left_out").agg(*(v.alias(k) for k, v in _counts().items())))
