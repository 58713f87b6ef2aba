"""Credits that wait for their advice: a stream of each, joined within the days that advice may be early or late.

A credit is held in state until no advice for it can come any more, then handed on once, with all that came, so decisions are those
of a batch over the same rows in whatever order they arrive. On tables that stand still the same plan gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, Matching
from ..plans import cascade

ADVICE = ["remittance_id", "method", "reconciled", "references", "lines", "claimed_reason"]


def hold(credits: DataFrame, advice: DataFrame, early: int = 2, late: int = 3, lateness: str = "1 day") -> DataFrame:
    """(statement_ref, credit, documents): each credit with the advice that was received from `early` days before its value_date to `late`
    days after it, when that time is over; no advice gives an empty list.

    credits have value_date, advice has statement_ref (null: linked to nothing, left out), received_at and the columns of ADVICE. Rows
    that come later than `lateness` behind the newest of their stream are dropped, as watermarks do. A repeated credit counts
    once, if it repeats within its day. State holds the days that are still open, not the past."""
    at = credits.withColumn("value_at", F.col("value_date").cast("timestamp")).withWatermark("value_at", lateness)
    own = F.struct(*credits.columns)
    docs = advice.where("statement_ref is not null").select(F.col("statement_ref").alias("_ref"), "received_at", F.struct(*ADVICE).alias("document")).withWatermark("received_at", lateness)
    near = (F.col("statement_ref") == F.col("_ref")) & (F.col("received_at") >= F.col("value_at") - F.expr(f"interval {early} days")) & (F.col("received_at") <= F.col("value_at") + F.expr(f"interval {late} days"))
    both = at.withColumn("credit", own).join(docs, near, "leftOuter")
    grouped = both.groupBy(F.window("value_at", "1 day"), "statement_ref").agg(F.first("credit").alias("credit"), F.array_distinct(F.collect_list("document")).alias("documents"))
    return grouped.select("statement_ref", "credit", "documents")


def decide(held: DataFrame, items: DataFrame, names: DataFrame, aliases: DataFrame, cfg: Matching = DEFAULT, fuzzy: bool = True) -> DataFrame:
    """The cascade over held credits and their documents."""
    advice = held.select("statement_ref", F.explode("documents").alias("d")).select("statement_ref", "d.*")
    return cascade.match(held.select("credit.*"), items, names, aliases, advice, cfg, fuzzy)


def start(credits: DataFrame, advice: DataFrame, book: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], sink: Callable[[DataFrame, int], None], checkpoint: str, cfg: Matching = DEFAULT, fuzzy: bool = True, **trigger) -> StreamingQuery:
    """Runs hold() over two streams and gives each batch's outcomes to sink(outcomes, batch id); book() gives items, names and aliases as
    they are then. A batch that is run again after a failure has the same id, by which the sink can tell."""

    def each(held: DataFrame, batch: int) -> None:
        if not held.isEmpty():
            sink(decide(held, *book(), cfg, fuzzy), batch)

    return hold(credits, advice).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
