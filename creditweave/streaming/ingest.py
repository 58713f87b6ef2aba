"""Bank credits as a stream: checked, loaded once for each reference, matched in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def unique_credits(stream: DataFrame, event_time: str = "received_at", delay: str = "3 days") -> DataFrame:
    """The first row of each statement_ref within the watermark; state older than that is let go."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["statement_ref"])


def credits_by_window(stream: DataFrame, event_time: str = "received_at", width: str = "1 day", delay: str = "3 days") -> DataFrame:
    """Count and sum of credits of each window; rows later than the watermark don't count."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width)).agg(F.count("*").alias("credits"), F.sum("amount_paise").cast("bigint").alias("paise"))


def match_stream(stream: DataFrame, match: Callable[[DataFrame], DataFrame], output: str, checkpoint: str) -> StreamingQuery:
    """Runs `match` on each micro-batch against its own snapshot of the book; a batch that runs again replaces itself."""

    def one(batch: DataFrame, batch_id: int) -> None:
        match(batch).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
