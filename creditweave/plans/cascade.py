"""Payment to candidate allocations: advice, then references, then amounts; each tier sees what the ones before left.

All payments are matched against one snapshot of the book. Tiers are joins on keys (statement_ref, normalised number,
customer_id); the bounded search runs on one array a payment, and only for payments that nothing cheaper settled. Each
tier is written to the shared folder before the next reads it: a tier's filters test what is stored, not its formulas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Matching
from ..functions import text as T
from ..operators import book, resolve, settle
from ..operators.identity import identify, similar_names
from ..operators.search import FOUND, search
from ..session import discard, settled

SIGNAL = "struct<name: string, fired: boolean, detail: string, raw: string>"
CANDIDATES = f"array<{settle.SETTLEMENT}>"


def signal(name: str, fired: Column | bool, detail: Column | str, raw: Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(name).alias("name"), lit(fired).alias("fired"), lit(detail).alias("detail"), (F.lit(None).cast("string") if raw is None else raw).alias("raw")).cast(SIGNAL)


def _one(settlement: Column) -> Column:
    return F.array(settlement).cast(CANDIDATES)


def _advice_tier(base: DataFrame, items: DataFrame, advice: DataFrame, cfg: Matching, settled: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """statement_ref, the winning document and its settlement, the customer that advice named, and counts.

    advice: remittance_id, statement_ref, method, reconciled, references, lines, claimed_reason. Documents are taken by id:
    the first that names one owner makes it the customer of an unknown payer, also if it settles nothing, and documents
    of other owners are then passed over."""
    docs = settled(advice, "advice").join(base.select("statement_ref", F.col("identity.customer_id").alias("known"), "amount_paise"), "statement_ref")
    usable = docs.where((F.size("references") > 0) & (F.col("reconciled") | F.lit(not cfg.require_reconciled)))
    tokens = usable.select("statement_ref", "remittance_id", "known", F.posexplode("references").alias("pos", "normalized")).withColumn("digits", F.regexp_replace("normalized", "[^0-9]", ""))
    keys = ["statement_ref", "remittance_id"]
    first = settled(resolve.resolve(tokens, items, keys, "known").withColumn("owners", resolve.owners(F.col("resolved"))), "advice-read")
    named = first.join(usable.select(*keys, "known"), keys).where("known is null and size(owners) = 1")
    named = settled(named.groupBy("statement_ref").agg(F.min_by(F.try_element_at(F.col("owners"), F.lit(1)), "remittance_id").alias("named"), F.min("remittance_id").alias("named_by")), "advice-named")
    later = tokens.join(named, "statement_ref").where("remittance_id > named_by").select(*keys, F.col("named").alias("known"), "pos", "normalized", "digits")
    again = resolve.resolve(later, items, keys, "known").withColumn("owners", resolve.owners(F.col("resolved")))
    either = first.select(*keys, F.struct("resolved", "unresolved", "owners").alias("x")).join(again.select(*keys, F.struct("resolved", "unresolved", "owners").alias("y")), keys, "left")
    either = settled(either.select(*keys, F.coalesce("y", "x").alias("z")).select(*keys, "z.*").join(usable, keys).join(named, "statement_ref", "left"), "advice-owners")
    mine = F.coalesce("known", "named")
    either = either.withColumn("settlement", F.when((F.size("owners") == 1) & (F.try_element_at(F.col("owners"), F.lit(1)) == mine), settle.settle(F.col("resolved"), F.col("amount_paise"), cfg)))
    doc = F.struct("remittance_id", "method", "reconciled", "references", "unresolved", "lines", "claimed_reason", "settlement")
    won = either.where("settlement is not null").groupBy("statement_ref").agg(F.min_by(doc, "remittance_id").alias("advice"))
    seen = docs.groupBy("statement_ref").agg(F.count("*").alias("n_documents"))
    return seen.join(won, "statement_ref", "left").join(named.select("statement_ref", "named"), "statement_ref", "left")


def apply_advice_reasons(settlement: Column, lines: Column, claimed: Column) -> Column:
    """The advice's reason on what is deducted; the bearer is asserted where its own line states a claim."""

    def one(a: Column) -> Column:
        line = F.try_element_at(F.filter(lines, lambda x: x["normalized_reference"] == a["normalized_number"]), F.lit(-1))
        own = F.when(F.size(F.filter(lines, lambda x: x["normalized_reference"] == a["normalized_number"])) > 0, line["deduction_reason"])
        stated = F.exists(lines, lambda x: (x["normalized_reference"] == a["normalized_number"]) & (x["deduction_amount_paise"] > 0))
        reason = F.when(own.isNull() | (own == "unknown"), claimed).otherwise(own)
        touched = (a["deduction"] > 0) & claimed.isNotNull()
        return a.withField("reason", F.when(touched, reason).otherwise(a["reason"])).withField("bearer_asserted", F.coalesce(touched & stated, F.lit(False)))

    return F.when(settlement.isNotNull(), settlement.withField("allocations", F.transform(settlement["allocations"], one))).cast(settle.SETTLEMENT)


def _search_amounts(base: DataFrame, items: DataFrame, cfg: Matching) -> DataFrame:
    """base with the pool of each payment that nothing settled yet, its items of the very amount, and the sets that the searches find."""
    left = base.where("guided is null and by_reference is null and customer_id is not null").select("statement_ref", "value_date", "customer_id", "amount_paise")
    pool = book.candidate_pool(left, items, cfg).groupBy("statement_ref").agg(F.collect_list(F.struct((-F.col("open_amount_paise")).alias("o"), "invoice_number", F.struct(*book.ITEM).alias("item"))).alias("p"))
    pool = pool.select("statement_ref", F.transform(F.array_sort("p"), lambda x: x["item"]).alias("pool"))
    base = base.join(pool, "statement_ref", "left")

    hits = F.filter("pool", lambda i: F.abs(i["open_amount_paise"] - F.col("amount_paise")) <= cfg.tolerance_paise)
    base = base.withColumn("hits", F.array_sort(F.transform(hits, lambda i: F.struct(i["invoice_number"].alias("n"), i.alias("item")))))
    amounts = F.transform("pool", lambda i: i["open_amount_paise"])
    base = base.withColumn("subset", search(F.when(F.size("hits") == 0, amounts), F.col("amount_paise") - cfg.tolerance_paise, F.col("amount_paise") + cfg.tolerance_paise, cfg.subset_sum))
    low, high = settle.deduction_band(F.col("amount_paise"), cfg)
    base = base.withColumn("short", search(F.when((F.size("hits") == 0) & (F.size("subset.solutions") == 0), amounts), low, high, cfg.short_pay.search))
    return base


def _no_amounts(base: DataFrame, items: DataFrame) -> DataFrame:
    """The columns of _search_amounts, all null."""
    item = items.select(F.struct(*book.ITEM).alias("item")).schema["item"].dataType.simpleString()
    kinds = {"pool": f"array<{item}>", "hits": f"array<struct<n: string, item: {item}>>", "subset": FOUND, "short": FOUND}
    return base.withColumns({name: F.lit(None).cast(kind) for name, kind in kinds.items()})


def match(payments: DataFrame, items: DataFrame, names: DataFrame, aliases: DataFrame, advice: DataFrame | None = None, cfg: Matching = DEFAULT, fuzzy: bool = True, by_amounts: bool = True) -> DataFrame:
    """One row for each payment: identity, references, strategy, candidates (all readings that tie), trail and diagnostics.

    Without `by_amounts` the cascade ends behind the references: no pools are built and nothing is searched.

    Payments need a unique statement_ref. Amounts of 0 or less, unknown payers and customers without open items end with
    strategy `none` and a trail that says why. What the tiers wrote on the way is removed at the end."""
    steps: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        steps.append(settled(df, name))
        return steps[-1]

    base = identify(payments.select("statement_ref", "amount_paise", "value_date", "payer_name_normalized", "normalized_narration"), names, aliases, cfg.identification, fuzzy, keep)
    base = keep(base.withColumn("references", T.all_references(F.col("normalized_narration"), cfg.reference)), "identified")

    if advice is not None and cfg.remittance_enabled:
        base = base.join(_advice_tier(base, items, advice, cfg, keep), "statement_ref", "left")
    else:
        kind = "struct<remittance_id: bigint, method: string, reconciled: boolean, references: array<string>, unresolved: array<string>>"
        base = base.withColumns({"n_documents": F.lit(None).cast("bigint"), "advice": F.lit(None).cast(kind), "named": F.lit(None).cast("bigint")})
    guided = F.when(F.col("advice").isNotNull(), apply_advice_reasons(F.col("advice.settlement"), F.col("advice.lines"), F.col("advice.claimed_reason"))) if advice is not None and cfg.remittance_enabled else F.lit(None).cast(settle.SETTLEMENT)
    base = keep(base.withColumns({"guided": guided, "customer_id": F.coalesce("identity.customer_id", "named")}), "guided")

    asked = base.where("guided is null")
    tokens = asked.select("statement_ref", "customer_id", F.posexplode("references").alias("pos", "t")).select("statement_ref", "customer_id", "pos", "t.normalized", "t.digits")
    read = resolve.resolve(tokens, items, ["statement_ref"]).withColumn("owners", resolve.owners(F.col("resolved")))
    base = keep(base.join(read, "statement_ref", "left").withColumn("owner", F.when(F.size("owners") == 1, F.try_element_at(F.col("owners"), F.lit(1)))), "read")
    agrees = F.col("owner").isNotNull() & (F.col("customer_id").isNull() | (F.col("customer_id") == F.col("owner")))
    base = base.withColumns({
        "by_reference": F.when(F.col("guided").isNull() & agrees, settle.settle(F.col("resolved"), F.col("amount_paise"), cfg)).cast(settle.SETTLEMENT),
        "recovered": F.col("customer_id").isNull() & F.col("owner").isNotNull(),
        "conflict": F.coalesce(F.col("customer_id") != F.col("owner"), F.lit(False)),
    })
    base = keep(base.withColumn("customer_id", F.coalesce("customer_id", "owner")), "referred")

    base = keep(_search_amounts(base, items, cfg) if by_amounts else _no_amounts(base, items), "searched")

    def sets(found: str, partial: bool = False) -> Column:
        """Settled sets of a search, in the order of (total, invoice numbers) for short payments, else as found."""
        chosen = F.transform(F.col(f"{found}.solutions"), lambda s: F.transform(F.array_sort(F.transform(s, lambda i: F.struct(F.try_element_at(F.col("pool"), i + 1)["invoice_number"].alias("n"), F.try_element_at(F.col("pool"), i + 1).alias("item")))), lambda x: x["item"]))
        if found == "short":
            key = F.transform(chosen, lambda s: F.struct(settle.total_open(s).alias("t"), F.transform(s, lambda i: i["invoice_number"]).alias("n"), s.alias("s")))
            chosen = F.transform(F.array_sort(key), lambda x: x["s"])
        return F.transform(chosen, lambda s: settle.settle(s, F.col("amount_paise"), cfg, allow_partial=False))

    by_amount = F.transform("hits", lambda h: settle.settle(F.array(h["item"]), F.col("amount_paise"), cfg, allow_partial=False, allow_short_pay=False))
    base = base.withColumns({"by_amount": by_amount.cast(CANDIDATES), "by_subset": F.filter(sets("subset"), lambda s: s.isNotNull()).cast(CANDIDATES), "by_short": F.filter(sets("short"), lambda s: F.coalesce(s["shape"] == "short_pay", F.lit(False))).cast(CANDIDATES)})
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    strategy = (
        F.when(F.col("guided").isNotNull(), "remittance_guided").when(F.col("by_reference").isNotNull(), "reference_exact").when(some("by_amount"), "amount_exact")
        .when(some("by_subset"), "subset_sum").when(some("by_short"), "short_pay").otherwise("none")
    )
    chosen = (
        F.when(F.col("guided").isNotNull(), _one(F.col("guided"))).when(F.col("by_reference").isNotNull(), _one(F.col("by_reference"))).when(some("by_amount"), F.col("by_amount"))
        .when(some("by_subset"), F.col("by_subset")).when(some("by_short"), F.col("by_short")).otherwise(F.array().cast(CANDIDATES))
    )
    method = F.when(F.col("identity.customer_id").isNull() & F.col("customer_id").isNotNull(), "reference").otherwise(F.col("identity.method"))
    base = base.withColumns({"strategy": strategy, "candidates": chosen, "method": method, "identity_score": F.when(method == "reference", 1.0).otherwise(F.col("identity.score"))})
    first = F.get("candidates", F.lit(0))["allocations"]
    placed = F.aggregate(F.coalesce(first, F.array().cast(f"array<{settle.ALLOCATION}>")), F.lit(0).cast("bigint"), lambda t, a: t + a["allocated"])
    base = base.withColumn("residual_paise", F.when(F.size("candidates") > 0, F.col("amount_paise") - placed).otherwise(F.lit(0).cast("bigint")))
    out = base.withColumn("trail", _trail(cfg, by_amounts)).withColumn("pool_size", F.coalesce(F.size("pool"), F.lit(0))).select(
        "statement_ref", "amount_paise", "value_date", "customer_id", "method", "identity_score", F.col("identity.matched_on").alias("matched_on"), "references", "strategy", "candidates", "residual_paise", "trail",
        "pool_size", F.col("subset.nodes").alias("subset_nodes"), F.col("subset.exhausted").alias("subset_exhausted"), F.col("short.nodes").alias("short_nodes"), F.col("short.exhausted").alias("short_exhausted"),
        F.col("advice.reconciled").alias("advice_reconciled"), F.col("n_documents"),
    )
    out = settled(out, "outcomes")
    for step in steps:
        discard(step)
    return out


def touched(payments: DataFrame, names: DataFrame, aliases: DataFrame, learned: DataFrame, cfg: Matching = DEFAULT, fuzzy: bool = True) -> DataFrame:
    """The payments whose identity may change with learned aliases (customer_id, normalized_alias).

    A payer that is a name or an alias already stays what it is. Of the others, those change that the new alias spells, and with `fuzzy` those
    that come near enough to one to be matched by it, or to have it as a rival: only payers left over meet only new aliases."""
    payers = payments.select(F.col("payer_name_normalized").alias("payer")).where("payer <> ''").distinct()
    left = payers.join(names.select(F.col("normalized_name").alias("payer")), "payer", "left_anti").join(aliases.select(F.col("normalized_alias").alias("payer")), "payer", "left_anti")
    spelt = left.join(learned.select(F.col("normalized_alias").alias("payer")), "payer", "left_semi")
    if fuzzy:
        near = similar_names(left, names.limit(0), learned.select("normalized_alias", "customer_id"), cfg.identification)
        spelt = spelt.unionByName(near.where("matched_on is not null").select("payer")).distinct()
    return payments.join(spelt.select(F.col("payer").alias("payer_name_normalized")), "payer_name_normalized", "left_semi")


def rematch(outcomes: DataFrame, payments: DataFrame, items: DataFrame, names: DataFrame, aliases: DataFrame, learned: DataFrame, advice: DataFrame | None = None, cfg: Matching = DEFAULT, fuzzy: bool = True) -> DataFrame:
    """outcomes as match() would give them with the learned aliases as well: only payments that these touch are matched again.

    outcomes come from match() with these payments, items, names, aliases and advice. `again` tells which rows are new."""
    again = settled(touched(payments, names, aliases, learned, cfg, fuzzy), "touched")
    ref = again.select("statement_ref")
    both = aliases.select("normalized_alias", "customer_id").unionByName(learned.select("normalized_alias", "customer_id"))
    new = match(again, items, names, both, None if advice is None else advice.join(ref, "statement_ref", "left_semi"), cfg, fuzzy)
    old = outcomes.join(ref, "statement_ref", "left_anti")
    return old.withColumn("again", F.lit(False)).unionByName(new.withColumn("again", F.lit(True)))


def _trail(cfg: Matching, by_amounts: bool) -> Column:
    """What was tried, in order, and whether it fired; steps that were not reached are absent."""
    refs = F.transform("references", lambda t: t["normalized"])
    many = lambda c: F.to_json(c)
    guided, by_ref = F.col("guided").isNotNull(), F.col("by_reference").isNotNull()
    asked, known = ~guided & ~by_ref & F.lit(by_amounts), F.col("customer_id").isNotNull()
    pooled = asked & known & F.col("pool").isNotNull()
    hit, sub, short = (F.coalesce(F.size(c) > 0, F.lit(False)) for c in ("by_amount", "by_subset", "by_short"))
    steps = [
        (F.lit(True), signal("customer_identified", F.col("identity.customer_id").isNotNull(), F.concat(F.lit("payer name: "), F.col("identity.method")), F.to_json(F.struct("identity.customer_id", "identity.method")))),
        (F.lit(True), signal("references_found", F.size("references") > 0, F.concat(F.size("references").cast("string"), F.lit(" reference(s) in the narration")), many(refs))),
        (F.col("n_documents").isNotNull(), signal("remittance_guided", guided, F.when(guided, "advice names open items that settle the credit").otherwise("linked advice settles nothing"), F.when(guided, F.to_json(F.struct("advice.remittance_id", "advice.method", "advice.reconciled", "advice.references", "advice.unresolved"))))),
        (~guided & F.col("recovered"), signal("customer_from_reference", True, "a reference names the payer", F.col("owner").cast("string"))),
        (~guided & (F.size("references") > 0), signal("reference_exact", by_ref, F.when(by_ref, "references resolve and settle").when(F.size("resolved") == 0, "no reference names an open item").when(F.size("owners") > 1, "references of several customers").when(F.col("conflict"), "references name another customer").otherwise("the referenced items do not settle this amount"), many(F.when(by_ref, F.transform("resolved", lambda i: i["invoice_number"])).otherwise(F.col("unresolved"))))),
        (asked & ~known, signal("amount_strategies", False, "skipped: the customer is unknown")),
        (asked & known & F.col("pool").isNull(), signal("candidate_pool", False, "no open item in the date window")),
        (pooled, signal("amount_exact", hit, F.concat(F.coalesce(F.size("hits"), F.lit(0)).cast("string"), F.lit(" item(s) of this amount")), many(F.transform("hits", lambda h: h["n"])))),
        (pooled & ~hit & F.lit(cfg.subset_sum.enabled), signal("subset_sum", sub, F.concat(F.size("subset.solutions").cast("string"), F.lit(" set(s) of this total")), many(F.col("subset.solutions")))),
        (pooled & ~hit & ~sub & F.lit(cfg.short_pay.search.enabled), signal("short_pay", short, F.concat(F.size("by_short").cast("string"), F.lit(" set(s) short by a believable claim")), many(F.col("short.solutions")))),
    ]
    return F.filter(F.array(*(F.when(when, s) for when, s in steps)), lambda s: s.isNotNull())
