"""Who paid: exact name, then alias, then similarity, each tier seeing only what the ones before left."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Identification
from ..functions import similarity
from ..session import settled

#: Tasks that a search for similar names makes at least, where there is work for them.
TASKS = 24
IDENTITY = ["customer_id", "method", "score", "matched_on", "runner_up", "runner_up_score"]


def similar_names(payers: DataFrame, names: DataFrame, aliases: DataFrame, cfg: Identification, top: int = 5, payer_rows: int = 2048, choice_rows: int = 131_072, keep: Callable[[DataFrame, str], DataFrame] = settled) -> DataFrame:
    """For each distinct `payer`, the identity that similarity gives: fuzzy, ambiguous or none.

    The best of all names and aliases must score fuzzy_min_score, and lead by fuzzy_margin over the best one of another owner
    among the `top`. Every name is considered for every payer: first each payer meets one block of choice_rows names, then, with what its
    `top` best score there as the least to reach, all other blocks. Bounds on that least leave out nearly all names of a block (see
    similarity.Choices), so a task holds a block of names and gives `top` rows a payer at most.
    Pairs that cannot score within the margin of fuzzy_min_score are left out, so `score` and `runner_up` are null or 0 where
    nothing comes that near. No payers or no names give none."""
    choices = names.select(F.col("normalized_name").alias("choice"), F.col("customer_id").alias("owner")).unionByName(aliases.select(F.col("normalized_alias").alias("choice"), F.col("customer_id").alias("owner")))
    choices, left = keep(choices.where("choice <> ''"), "choices"), keep(payers.select("payer").distinct(), "payers")
    n_left, blocks = left.count(), max(1, -(-choices.count() // choice_rows))
    floor, scorer = max(0.0, cfg.fuzzy_min_score - cfg.fuzzy_margin), cfg.fuzzy_scorer  # what scores less is neither an identity nor a rival
    home = F.pmod(F.xxhash64("payer", F.lit(1)), F.lit(blocks)).cast("int")

    def best(own: pa.Table, block: pa.Table) -> pa.Table:
        known, owners, texts = similarity.Choices(block["choice"].to_pylist(), block["owner"].to_pylist()), block["owner"].to_pylist(), own["payer"].to_pylist()
        out = [(texts[p], known.given[i], owners[i], score) for p, i, score in known.closest(texts, own["least"].to_pylist(), scorer, top, floor)]
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.float64()), strict=True)], names=["payer", "choice", "owner", "score"])

    def meet(asking: DataFrame, n: int, rows: int) -> DataFrame:
        """asking: payer, least, c, the block that it meets; n of them, of which a task gets `rows` at most, on average."""
        parts = max(-(-n // (rows * blocks)), min(-(-n // (256 * blocks)), -(-TASKS // blocks)), 1)
        asking = asking.withColumn("p", F.pmod(F.xxhash64("payer"), F.lit(parts)).cast("int"))
        asked = choices.select("choice", "owner", F.pmod(F.xxhash64("choice"), F.lit(blocks)).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"))
        tasks = min(10_000, 4 * parts * blocks)  # a block of pairs is much work and few bytes, so its partitions are not to be joined
        asking, asked = asking.repartition(tasks, "p", "c"), asked.repartition(tasks, "p", "c")
        return asking.groupBy("p", "c").cogroup(asked.groupBy("p", "c")).applyInArrow(best, "payer string, choice string, owner long, score double")

    pairs = keep(meet(left.select("payer", F.lit(floor).alias("least"), home.alias("c")), n_left, payer_rows), "close-names")
    if blocks > 1:
        reached = pairs.groupBy("payer").agg(F.when(F.count("*") >= top, F.min("score")).alias("least"))
        others = left.join(reached, "payer", "left").select("payer", F.coalesce("least", F.lit(floor)).alias("least"), F.explode(F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda c: c != home)).alias("c"))
        pairs = pairs.unionByName(keep(meet(others, n_left * (blocks - 1), 8 * payer_rows), "close-names"))
    rank = F.row_number().over(Window.partitionBy("payer").orderBy(F.desc("score"), "choice", "owner"))
    best = pairs.withColumn("rn", rank).where(F.col("rn") <= top)
    first = best.where("rn = 1").select("payer", F.col("owner").alias("o"), F.col("choice").alias("matched_on"), F.col("score").alias("best"))
    rival = best.join(first, "payer").where("owner <> o").groupBy("payer").agg(F.min_by(F.struct("choice", "score"), "rn").alias("r"))
    out = left.join(first, "payer", "left").join(rival, "payer", "left")
    method = F.when(F.coalesce("best", F.lit(-1.0)) < cfg.fuzzy_min_score, "none").when(F.col("best") - F.col("r.score") < cfg.fuzzy_margin, "ambiguous").otherwise("fuzzy")
    return out.select("payer", method.alias("method"), F.when(method == "fuzzy", F.col("o")).alias("customer_id"), (F.coalesce("best", F.lit(0.0)) / 100).alias("score"), "matched_on", F.col("r.choice").alias("runner_up"), (F.col("r.score") / 100).alias("runner_up_score"))


def identify(payments: DataFrame, names: DataFrame, aliases: DataFrame, cfg: Identification, fuzzy: bool = True, keep: Callable[[DataFrame, str], DataFrame] = settled) -> DataFrame:
    """payments with an `identity` struct (IDENTITY). Payers are judged once each, however many payments they make.

    keep writes a step into the shared folder."""
    payers = payments.select(F.coalesce("payer_name_normalized", F.lit("")).alias("payer")).distinct()
    known = payers.join(names.select(F.col("normalized_name").alias("payer"), F.col("customer_id").alias("by_name")), "payer", "left")
    known = known.join(aliases.select(F.col("normalized_alias").alias("payer"), F.col("customer_id").alias("by_alias")), "payer", "left")
    none = F.lit(None).cast("string")
    sure = known.select(
        "payer", F.coalesce("by_name", "by_alias").alias("customer_id"), F.when(F.col("by_name").isNotNull(), "exact").when(F.col("by_alias").isNotNull(), "alias").otherwise("none").alias("method"),
        F.when(F.coalesce("by_name", "by_alias").isNotNull(), 1.0).otherwise(0.0).alias("score"), F.when(F.coalesce("by_name", "by_alias").isNotNull(), F.col("payer")).alias("matched_on"), none.alias("runner_up"), F.lit(None).cast("double").alias("runner_up_score"),
    )
    if fuzzy:
        rest = sure.where("method = 'none' and payer <> ''").select("payer")
        close = similar_names(rest, names, aliases, cfg, keep=keep).select("payer", F.struct(*IDENTITY).alias("close"))
        sure = sure.select("payer", F.struct(*IDENTITY).alias("sure")).join(close, "payer", "left").select("payer", F.coalesce("close", "sure").alias("identity"))
    else:
        sure = sure.select("payer", F.struct(*IDENTITY).alias("identity"))
    return payments.join(sure, F.coalesce("payer_name_normalized", F.lit("")) == F.col("payer")).drop("payer")
