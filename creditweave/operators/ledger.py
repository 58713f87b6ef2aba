"""Decisions, postings, reviews and their audit. Tables are snapshots: an operator gives the next snapshot of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import status_for_open
from ..store import Store

ENGINE_VERSION = "creditweave@1"


def decisions(scored: DataFrame, run: str = "1") -> tuple[DataFrame, DataFrame]:
    """(result rows, allocation rows) of scored outcomes. A candidate below the floor keeps its allocations.

    result_id ties allocations to their result; it names the run and the payment, so each run over the same payments needs a name
    of its own."""
    first = F.get("candidates", F.lit(0))["allocations"]
    matched = F.aggregate(first, F.lit(0).cast("bigint"), lambda t, a: t + a["allocated"])
    scored = scored.withColumn("result_id", F.concat_ws("@", "statement_ref", F.lit(run)))
    results = scored.select(
        "result_id", "statement_ref", "decision", F.round("confidence", 4).cast("decimal(5,4)").alias("confidence"), "strategy", F.coalesce(matched, F.lit(0).cast("bigint")).alias("matched_amount_paise"),
        (F.col("amount_paise") - F.coalesce(matched, F.lit(0).cast("bigint"))).alias("unapplied_amount_paise"), "explanation", "reason_text", F.lit(ENGINE_VERSION).alias("engine_version"),
        F.lit(None).cast("string").alias("reviewed_by"), F.lit(None).cast("timestamp").alias("reviewed_at"), F.lit(None).cast("string").alias("review_action"), F.lit(None).cast("string").alias("review_note"),
    )
    rows = scored.where(F.size("candidates") > 0).select("result_id", "statement_ref", F.explode(first).alias("a"))
    allocations = rows.select("result_id", "statement_ref", "a.invoice_id", "a.invoice_number", F.col("a.allocated").alias("allocated_amount_paise"), F.col("a.deduction").alias("deduction_amount_paise"), F.col("a.reason").alias("deduction_reason"), F.col("a.reason").alias("deduction_note"))
    return results, allocations


def replace_own(old: DataFrame, new: DataFrame) -> DataFrame:
    """New results instead of the engine's own unreviewed ones of the same payments; reviewed ones stay."""
    again = new.select("statement_ref").distinct().withColumn("_again", F.lit(True))
    kept = old.join(again, "statement_ref", "left").where(F.col("reviewed_at").isNotNull() | F.col("_again").isNull()).drop("_again")
    return kept.unionByName(new)


def replace_allocations(old_results: DataFrame, old: DataFrame, new_results: DataFrame, new: DataFrame) -> DataFrame:
    """Allocations beside replace_own: those of a replaced result go with it, all others stay, a reviewer's among them."""
    again = new_results.select("statement_ref").distinct()
    gone = old_results.where("reviewed_at is null").join(again, "statement_ref", "left_semi").select("result_id")
    return old.join(gone, "result_id", "left_anti").unionByName(new)


def _live(payments: DataFrame, results: DataFrame, applied: tuple[str, ...]) -> DataFrame:
    """The result that is posted for each unmatched payment: of several the reviewed one, then the largest id."""
    rows = results.where(F.col("decision").isin(*applied)).join(payments.where("status = 'unmatched'").select("statement_ref"), "statement_ref")
    best = F.max_by(F.struct(*[c for c in results.columns if c != "statement_ref"]), F.struct(F.col("reviewed_at").isNotNull(), F.col("result_id")))
    return rows.groupBy("statement_ref").agg(best.alias("r")).select("statement_ref", "r.*")


def post_cash(payments: DataFrame, invoices: DataFrame, results: DataFrame, allocations: DataFrame, applied: tuple[str, ...] = ("auto_applied",)) -> tuple[DataFrame, DataFrame]:
    """(payments, invoices) after posting: only these decisions, only on payments still unmatched, one result a payment.

    An invoice loses what all payments clear on it, down to 0 at least; a payment is matched if nothing of it is left."""
    live = _live(payments, results, applied).select("result_id", "statement_ref", F.col("matched_amount_paise").alias("placed"))
    rows = allocations.join(live.select("result_id"), "result_id", "left_semi")
    cleared = rows.groupBy("invoice_id").agg(F.sum(F.col("allocated_amount_paise") + F.col("deduction_amount_paise")).cast("bigint").alias("cleared"))
    after = invoices.join(cleared, "invoice_id", "left").withColumn("open_amount_paise", F.when(F.col("cleared").isNull(), F.col("open_amount_paise")).otherwise(F.greatest(F.lit(0).cast("bigint"), F.col("open_amount_paise") - F.col("cleared"))))
    after = after.withColumn("status", F.when(F.col("cleared").isNull(), F.col("status")).otherwise(status_for_open(F.col("open_amount_paise"), F.col("amount_paise")))).drop("cleared")
    paid = payments.join(live.drop("result_id"), "statement_ref", "left")
    paid = paid.withColumn("status", F.when(F.col("placed").isNull(), F.col("status")).when(F.col("placed") >= F.col("amount_paise"), "matched").otherwise("partially_applied")).drop("placed")
    return paid, after


def post(store: Store, run: str, base: int, results: DataFrame, allocations: DataFrame, applied: tuple[str, ...] = ("auto_applied",)) -> int:
    """Posts a run's results to the data set as read in version `base`, and publishes payments, invoices, results, allocations and
    audit rows as one version. Raises Conflict, and posts nothing, if another poster was first; then match again from its version."""
    payments, invoices, old, placed = (store.read(t, base) for t in ("bank_transactions", "invoices", "match_results", "match_allocations"))
    paid, after = post_cash(payments, invoices, results, allocations, applied)
    rows = posting_audit(payments, results, allocations, applied).withColumn("payload_before", F.lit(None).cast("string"))
    tables = {
        "bank_transactions": paid, "invoices": after, "match_results": replace_own(old, results), "match_allocations": replace_allocations(old, placed, results, allocations),
        "audit_log": store.read("audit_log", base).unionByName(rows),
    }
    return store.publish(base, tables, f"posting of run {run}")


def audit(entity: str, rows: DataFrame, key: str, action: Column, actor: str | Column = "engine", payload: list[str] | None = None) -> DataFrame:
    """Append-only audit rows: entity_type, entity_id, action, actor, payload_after."""
    return rows.select(F.lit(entity).alias("entity_type"), F.col(key).cast("string").alias("entity_id"), action.alias("action"), (F.lit(actor) if isinstance(actor, str) else actor).alias("actor"), F.to_json(F.struct(*(payload or [key]))).alias("payload_after"))


def posting_audit(payments: DataFrame, results: DataFrame, allocations: DataFrame, applied: tuple[str, ...] = ("auto_applied",)) -> DataFrame:
    """A `cash_posted` row for each result that post_cash posts: its invoices, the cash applied and the deductions booked."""
    live = _live(payments, results, applied)
    sums = allocations.groupBy("result_id").agg(F.array_sort(F.collect_list("invoice_id")).alias("invoices"), F.sum("allocated_amount_paise").cast("bigint").alias("cash_applied_paise"), F.sum("deduction_amount_paise").cast("bigint").alias("deductions_booked_paise"))
    return audit("match_result", live.join(sums, "result_id"), "statement_ref", F.lit("cash_posted"), f"system:{ENGINE_VERSION}", ["statement_ref", "confidence", "strategy", "invoices", "cash_applied_paise", "deductions_booked_paise"])


def review_audit(results: DataFrame, actions: DataFrame) -> DataFrame:
    """A `review_<action>` row by its reviewer for each action that apply_reviews accepted; results are those after it.

    An accepted action has left its name, reviewer and time on the result, so one that was refused beside it has no row."""
    done = actions.select("statement_ref", F.col("action").alias("review_action"), F.col("reviewer").alias("reviewed_by"), F.col("at").alias("reviewed_at")).distinct()
    rows = results.join(done, ["statement_ref", "review_action", "reviewed_by", "reviewed_at"], "left_semi")
    return audit("match_result", rows, "statement_ref", F.concat(F.lit("review_"), F.col("review_action")), payload=["result_id", "statement_ref", "decision", "confidence", "engine_version"], actor=F.concat(F.lit("user:"), F.col("reviewed_by")))


def reassignment_errors(lines: DataFrame, invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """(statement_ref, error) of asked reassignments (statement_ref, invoice_number, allocated_amount_paise): the first reason in
    this order: unknown invoice, named twice, amount not above 0, more than is open, more in all than was received."""
    twice = F.count("*").over(Window.partitionBy("statement_ref", "invoice_number")) > 1
    total = F.sum("allocated_amount_paise").over(Window.partitionBy("statement_ref"))
    rows = lines.withColumns({"twice": twice, "total": total}).join(invoices.select("invoice_number", "open_amount_paise"), "invoice_number", "left").join(payments.select("statement_ref", "amount_paise"), "statement_ref", "left")
    ask = F.col("allocated_amount_paise")
    rank = F.when(F.col("open_amount_paise").isNull(), 1).when(F.col("twice"), 2).when(ask.isNull() | (ask <= 0), 3).when(ask > F.col("open_amount_paise"), 4).when(F.col("total") > F.coalesce("amount_paise", F.lit(0)), 5)
    worst = rows.groupBy("statement_ref").agg(F.min(rank).alias("r")).where("r is not null")
    said = F.element_at(F.array(*map(F.lit, ["no such invoice", "an invoice is named twice", "an amount must be above 0", "more than the invoice has open", "more than was received"])), F.col("r"))
    return worst.select("statement_ref", said.alias("error"))


def apply_reviews(results: DataFrame, allocations: DataFrame, actions: DataFrame, lines: DataFrame, invoices: DataFrame, payments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, allocations, errors) after actions (statement_ref, action, reviewer, note, at): approve, reject or reassign.

    Approving or reassigning makes a result manually_applied, rejecting makes it unapplied with nothing placed. A second
    action on a result, one on a reviewed or missing result, and a reassignment that fails its checks are error rows."""
    once = F.row_number().over(Window.partitionBy("statement_ref").orderBy("at", "action"))
    acts = actions.withColumn("rn", once)
    open_ = results.where("reviewed_at is null").select("statement_ref").distinct().withColumn("_open", F.lit(True))
    bad = reassignment_errors(lines, invoices, payments).join(actions.where("action = 'reassign'").select("statement_ref"), "statement_ref", "left_semi")
    empty = acts.where("action = 'reassign'").join(lines.select("statement_ref").distinct(), "statement_ref", "left_anti").select("statement_ref", F.lit("no invoice is named").alias("error"))
    acts = acts.join(open_, "statement_ref", "left").join(bad.unionByName(empty).groupBy("statement_ref").agg(F.min("error").alias("e")), "statement_ref", "left")
    error = F.when(~F.col("action").isin("approve", "reject", "reassign"), "unknown action").when(F.col("_open").isNull() | (F.col("rn") > 1), "already reviewed, or no such result").when(F.col("action") == "reassign", F.col("e"))
    acts = acts.withColumn("error", error)
    good = acts.where("error is null").select("statement_ref", F.col("action").alias("_a"), F.col("reviewer").alias("_r"), F.col("note").alias("_n"), F.col("at").alias("_t"))
    moved = lines.join(good.where("_a = 'reassign'").select("statement_ref"), "statement_ref", "left_semi")
    sums = moved.groupBy("statement_ref").agg(F.sum("allocated_amount_paise").cast("bigint").alias("_sum"))
    out = results.join(good, "statement_ref", "left").join(sums, "statement_ref", "left").join(payments.select("statement_ref", F.col("amount_paise").alias("_amount")), "statement_ref", "left")
    hit = F.col("_a").isNotNull() & F.col("reviewed_at").isNull()
    placed = F.when(hit & (F.col("_a") == "reject"), F.lit(0).cast("bigint")).when(hit & (F.col("_a") == "reassign"), F.col("_sum")).otherwise(F.col("matched_amount_paise"))
    out = out.withColumns({
        "decision": F.when(hit & (F.col("_a") == "reject"), "unapplied").when(hit, "manually_applied").otherwise(F.col("decision")), "strategy": F.when(hit & (F.col("_a") == "reassign"), "manual").otherwise(F.col("strategy")),
        "matched_amount_paise": placed, "unapplied_amount_paise": F.when(hit, F.col("_amount") - placed).otherwise(F.col("unapplied_amount_paise")),
        "reviewed_by": F.when(hit, F.col("_r")).otherwise(F.col("reviewed_by")), "review_action": F.when(hit, F.col("_a")).otherwise(F.col("review_action")), "review_note": F.when(hit, F.col("_n")).otherwise(F.col("review_note")), "reviewed_at": F.when(hit, F.col("_t")).otherwise(F.col("reviewed_at")),
    }).select(results.columns)
    own = results.where("reviewed_at is null").select("statement_ref", "result_id")
    gone = own.join(good.where("_a in ('reject', 'reassign')").select("statement_ref"), "statement_ref", "left_semi").select("result_id")
    new = moved.join(own, "statement_ref").join(invoices.select("invoice_number", "invoice_id"), "invoice_number").select("result_id", "statement_ref", "invoice_id", "invoice_number", "allocated_amount_paise", F.lit(0).cast("bigint").alias("deduction_amount_paise"), F.lit(None).cast("string").alias("deduction_reason"), F.lit(None).cast("string").alias("deduction_note"))
    return out, allocations.join(gone, "result_id", "left_anti").unionByName(new), acts.where("error is not null").select("statement_ref", "action", "error")


def learn_aliases(reviewed: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """New aliases (customer_id, normalized_alias, source) from reviewed payments (customer_id, payer_name_normalized): spellings
    that are no name and no alias of any customer; of several customers the smallest id learns it."""
    new = reviewed.where("payer_name_normalized <> '' and customer_id is not null").select("customer_id", F.col("payer_name_normalized").alias("normalized_alias"))
    new = new.join(names.select(F.col("normalized_name").alias("normalized_alias")), "normalized_alias", "left_anti").join(aliases.select("normalized_alias"), "normalized_alias", "left_anti")
    return new.groupBy("normalized_alias").agg(F.min("customer_id").alias("customer_id")).withColumn("source", F.lit("learned"))
