"""References to open items: by normalised number, else by bare digits; the known customer settles what is ambiguous."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .book import ITEM, by_number

RESOLVED = "array<struct<invoice_id: bigint, invoice_number: string, normalized_number: string, customer_id: bigint, invoice_date: date, due_date: date, open_amount_paise: bigint>>"


def token_hits(tokens: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """For each token (keys, normalized, digits) the items it names, one row each with `item` and `how` (exact or digits).

    Digits count only where the number as a whole names nothing; every item with these digits is then a hit."""
    exact = by_number(items).select(F.col("normalized_number").alias("normalized"), F.struct(*ITEM).alias("item"))
    first = tokens.join(exact, "normalized", "left")
    found = first.where("item is not null").withColumn("how", F.lit("exact"))
    loose = items.select(T.digits_key(F.regexp_replace("normalized_number", "[^0-9]", "")).alias("d"), F.struct(*ITEM).alias("item"))
    rest = first.where("item is null").drop("item").withColumn("d", T.digits_key(F.col("digits")))
    return found.unionByName(rest.join(loose, "d").drop("d").withColumn("how", F.lit("digits")))


def resolve(tokens: DataFrame, items: DataFrame, keys: list[str], customer: str = "customer_id") -> DataFrame:
    """One row for each of tokens' `keys`: resolved (items by invoice_number, each once), unresolved (normalised tokens in
    order) and n_ambiguous. tokens: keys, pos, normalized, digits and the known customer's id (or null).

    A token with several hits counts only if exactly one of them is the known customer's."""
    hits = token_hits(tokens.select(*keys, "pos", "normalized", "digits"), items, keys)
    own = hits.join(tokens.select(*keys, "pos", F.col(customer).alias("_known")), [*keys, "pos"])
    mine = F.coalesce(F.col("item.customer_id") == F.col("_known"), F.lit(False))
    each = own.groupBy(*keys, "pos").agg(F.count("*").alias("n"), F.count_if(mine).alias("m"), F.min("item").alias("any"), F.min(F.when(mine, F.col("item"))).alias("mine"))
    item = F.when(F.col("n") == 1, F.col("any")).when(F.col("m") == 1, F.col("mine"))
    each = tokens.select(*keys, "pos", "normalized").join(each, [*keys, "pos"], "left").withColumn("item", item)
    out = each.groupBy(*keys).agg(
        F.collect_set("item").alias("resolved"),
        F.array_sort(F.collect_list(F.when(F.col("item").isNull(), F.struct("pos", "normalized")))).alias("u"),
        F.count_if(F.col("item").isNull() & (F.col("n") > 1)).alias("n_ambiguous"),
    )
    by_no = F.array_sort(F.transform("resolved", lambda i: F.struct(i["invoice_number"].alias("no"), i.alias("item"))))
    return out.select(*keys, F.transform(by_no, lambda x: x["item"]).alias("resolved"), F.transform("u", lambda x: x["normalized"]).alias("unresolved"), "n_ambiguous")


def owners(resolved: Column) -> Column:
    return F.array_distinct(F.transform(resolved, lambda i: i["customer_id"]))


def narration_tokens(payments: DataFrame, cfg) -> DataFrame:
    """statement_ref, pos, raw, normalized, digits of every reference in a narration."""
    refs = payments.select("statement_ref", F.posexplode(T.all_references(F.col("normalized_narration"), cfg)).alias("pos", "t"))
    return refs.select("statement_ref", "pos", "t.raw", "t.normalized", "t.digits")


def first_mentions(tokens: DataFrame) -> DataFrame:
    """Of each normalised reference of a document its first mention."""
    rn = F.row_number().over(Window.partitionBy("remittance_id", "normalized").orderBy("line_no", "pos"))
    return tokens.withColumn("_rn", rn).where("_rn = 1").drop("_rn")
