"""A seeded data set of any size: customers and invoices come from hashes of a range, payments and advice from plans.scenarios.

The same seed gives the same rows on any cluster. Nothing is generated on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..operators import book, ledger
from ..schemas import empty
from ..session import settled
from ..sources import star
from ..store import Store
from . import scenarios
from .scenarios import apportion  # noqa: F401

CITIES = ["PUNE", "MUMBAI", "DELHI", "CHENNAI", "KOLKATA", "HYDERABAD", "JAIPUR", "SURAT", "INDORE", "NAGPUR"]


@dataclass(frozen=True)
class Generator:
    customers: int = 50
    invoices: int = 2000
    seed: int = 42

    def __post_init__(self) -> None:
        if not 0 < self.customers <= self.invoices:
            raise ValueError("there must be customers, and an invoice for each")


def scenario_counts(truth: DataFrame) -> DataFrame:
    """(scenario, n) of every scenario, also of those that no payment has."""
    names = truth.sparkSession.createDataFrame([(s,) for s, _ in star.SCENARIOS], "scenario string")
    return names.join(truth.groupBy("scenario").agg(F.count("*").alias("n")), "scenario", "left").select("scenario", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def off_book(payments: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Payments whose payer is no name and no alias of the book."""
    known = names.select(F.col("normalized_name").alias("payer_name_normalized")).unionByName(aliases.select(F.col("normalized_alias").alias("payer_name_normalized")))
    return payments.join(known, "payer_name_normalized", "left_anti")


def write(store: Store, g: Generator, force: bool = False) -> int:
    """Publishes a data set's tables, its key and its audit row (`dataset_generated`, with the settings' digest) as one version.
    Refuses a store whose newest version has rows, unless forced; then results and allocations are emptied too."""
    base = store.version()
    if not force and store.is_populated():
        raise ValueError(f"{store.folder} has a data set already")
    row = store.spark.createDataFrame([(config.digest(g), g.seed, g.customers, g.invoices)], "digest string, seed int, customers int, invoices int")
    log = ledger.audit("dataset", row, "digest", F.lit("dataset_generated"), "system:generator", ["digest", "seed", "customers", "invoices"])
    log = store.read("audit_log", base).unionByName(log.withColumn("payload_before", F.lit(None).cast("string")))
    stale = {name: empty(store.spark, name) for name in ("match_results", "match_allocations")}
    return store.publish(base, {**stale, **tables(store.spark, g), "audit_log": log}, "generated")


def tables(spark: SparkSession, g: Generator) -> dict[str, DataFrame]:
    """customers, customer_aliases, invoices, bank_transactions, remittances and ground_truth.

    Each customer has an invoice; the rest go to tiers of weight 8, 3 and 1. Amounts are 8,000 to 950,000 rupees, 15% of
    them in steps of 500; four of five invoices are open, a fifth of these part-paid."""
    h = lambda salt: F.pmod(F.xxhash64("id", F.lit(g.seed), F.lit(salt)), F.lit(1_000_003))
    customer = spark.range(1, g.customers + 1).select(F.col("id").alias("c_custkey"), F.pmod("id", F.lit(len(CITIES))).cast("int").alias("c_nationkey"))
    nation = spark.createDataFrame([(i, c) for i, c in enumerate(CITIES)], "n_nationkey int, n_name string")
    heavy, middle = max(1, g.customers // 10), max(1, g.customers // 3)
    pick = h("tier") % 12
    owner = F.when(F.col("id") <= g.customers, F.col("id")).when(pick < 8, 1 + h("a") % heavy).when(pick < 11, 1 + h("b") % middle).otherwise(1 + h("c") % g.customers)
    rupees = 8000 + h("amount") % 942_001
    rupees = F.when(h("round") % 100 < 15, F.floor(rupees / 500) * 500).otherwise(rupees)
    paise = F.when(h("round") % 100 < 15, F.lit(0)).otherwise(h("paise") % 100)
    status = F.when(h("status") % 5 == 0, "F").when(h("part") % 5 == 0, "P").otherwise("O")
    orders = spark.range(1, g.invoices + 1).select(
        F.col("id").alias("o_orderkey"), owner.cast("bigint").alias("o_custkey"), status.alias("o_orderstatus"), (rupees + paise / 100).cast("double").alias("o_totalprice"),
        F.date_add(F.lit("2025-07-01").cast("date"), (h("day") % 240).cast("int")).cast("timestamp").alias("o_orderdate"),
    )
    own = {"customer": customer, "nation": nation, "orders": orders}
    named, spelt, invoices = star.customers(spark, own), star.aliases(spark, own), star.invoices(spark, own)
    paid = settled(scenarios.amounts(scenarios.plan(book.open_items(invoices))), "paid")
    return {
        "customers": named, "customer_aliases": spelt.withColumn("source", F.lit("erp")), "invoices": invoices, "bank_transactions": scenarios.payments(paid, named, spelt),
        "remittances": scenarios.advice(paid), "ground_truth": scenarios.truth(paid),
    }
