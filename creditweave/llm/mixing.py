"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

A source of weight w (its share of all weights, not rounded) has its j-th block (from 0) released at slot floor(j/w) and due
by slot ceil((j+1)/w). Earliest deadline first keeps every block inside its window, so at any slot a source is less than one
block off its weight, until it ends. The schedule is metadata: a slot for each block. Blocks grow with the corpus, so that
there are MOST_BLOCKS of them and one more a source; documents find their slots by a join."""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST_CHARS, MOST_BLOCKS, MOST_SOURCES = 65_536, 65_536, 10_000


def schedule(weights: dict[str, float], blocks: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source's blocks, in order, by earliest deadline first (ties by name). Arithmetic is exact.

    A source without blocks keeps its share of the slots, as one that has ended does: they stay empty."""
    if any(w is None or not (w > 0 and math.isfinite(w)) for w in weights.values()):
        raise ValueError("a target weight must be above 0")
    shares = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in shares.values()))
    part = {s: int(w * scale) for s, w in shares.items()}
    total = sum(part.values())
    later = [(0, -(-total // part[s]), s, 0) for s, n in blocks.items() if n > 0]
    heapq.heapify(later)
    ready: list[tuple[int, str, int]] = []
    out: dict[str, list[int]] = {s: [] for s in blocks}
    slot = 0
    while later or ready:
        if not ready:
            slot = max(slot, later[0][0])
        while later and later[0][0] <= slot:
            _, due, s, j = heapq.heappop(later)
            heapq.heappush(ready, (due, s, j))
        due, s, j = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a deadline was missed")
        out[s].append(slot)
        slot, j = slot + 1, j + 1
        if j < blocks[s]:
            heapq.heappush(later, (j * total // part[s], -(-(j + 1) * total // part[s]), s, j))
    return out


def source_chars(docs: DataFrame) -> dict[str, int]:
    """Characters of all documents of each source; a null source is ''. Raises beyond MOST_SOURCES sources, as weights and
    schedule are kept on the driver."""
    sums = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).alias("n"))
    rows = sums.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return {r["source"]: r["n"] for r in rows}


def tempered(docs: DataFrame, power: float = 0.5) -> dict[str, float]:
    """Weights in proportion to (1 + characters of all the source's documents) ** power. A null source is ''."""
    return {s: (1.0 + n) ** power for s, n in source_chars(docs).items()}


def block_size(chars: dict[str, int]) -> int:
    """Characters of a block, for sources of these sizes."""
    return max(LEAST_CHARS, -(-sum(chars.values()) // MOST_BLOCKS))


def mix(docs: DataFrame, weights: dict[str, float], block_chars: int | None = None, rows_a_bucket: int = 500) -> DataFrame:
    """docs with block, slot, block_offset and block_chars; ordered by slot, block_offset and doc_id the sources stand in the target mix.

    A source's documents follow one another in the order of a hash of doc_id; its characters are cut into blocks (of
    block_size(), unless given), and a document belongs to the block it starts in. No row is dropped or repeated: once a source
    has ended, its slots stay empty and the others keep theirs. Null texts have no characters, a null source is the source '';
    every source of docs must have a weight (ValueError). Columns of docs with the results' names are replaced. No rows give
    none. No sort of a whole source takes place: its rows are cut into buckets of about rows_a_bucket by the hash, and running
    totals add the buckets before."""
    names = [c for c in docs.columns if c not in ("block", "slot", "block_offset", "block_chars")]
    chars = source_chars(docs)
    if chars.keys() - weights.keys():
        raise ValueError(f"no target weight for {sorted(chars.keys() - weights.keys())[:5]}")
    size = block_chars or block_size(chars)
    slots = schedule(weights, {s: n // size + 1 for s, n in chars.items()}) if chars else {}
    plan = docs.sparkSession.createDataFrame(list(slots.items()), "_source string, _slots array<long>")
    plan = plan.select("_source", F.posexplode("_slots").alias("block", "slot")).withColumn("block", F.col("block").cast("bigint"))
    buckets = max(1, docs.count() // rows_a_bucket)
    rows = docs.select(*(F.col(f"`{c}`") for c in names))
    rows = rows.withColumns({"_source": F.coalesce("source", F.lit("")), "_chars": F.coalesce(F.length("text"), F.lit(0)).cast("bigint"), "_hash": F.xxhash64("doc_id")})
    rows = rows.withColumn("_bucket", F.pmod(F.col("_hash"), F.lit(buckets)))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_source", "_bucket").agg(F.sum("_chars").alias("n"))
    sums = sums.select("_source", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_source", "_bucket").orderBy("_hash", "doc_id", "_chars").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("_chars").over(inside), F.lit(0))).join(sums, ["_source", "_bucket"])
    rows = rows.withColumn("_start", F.col("_before") + F.col("_inside"))
    rows = rows.withColumns({"block": F.expr(f"_start div {size}"), "block_offset": F.pmod("_start", F.lit(size)), "block_chars": F.lit(size).cast("bigint")})
    few = sum(map(len, slots.values())) <= MOST_BLOCKS + MOST_SOURCES  # always, unless block_chars is given
    rows = rows.join(F.broadcast(plan) if few else plan, ["_source", "block"])
    return rows.select(*(F.col(f"`{c}`") for c in names), "block", "slot", "block_offset", "block_chars")
