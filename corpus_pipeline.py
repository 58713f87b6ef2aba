"""From raw documents to packed training sequences: quality, near duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns what it kept of docs, in the columns of documents; the last one returns
pieces of sequences. run() writes each stage as Parquet into the shared folder and hands the next one what it reads there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditweave.llm import jaccard, mixing, packing, quality, queries, substrings
from creditweave.llm.common import durable, table
from creditweave.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score is under 0.3; the classifier learns from docs and the labels of sf_dir."""
    ship(spark)
    forest = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs.select(COLUMNS), forest, 0.3).where("predicted = 1").select(COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of documents that share 0.8 of their five-word shingles.

    Rows that repeat a doc_id stand or fall together; documents without words are nobody's copies."""
    ship(spark)
    found = jaccard.similar_documents(docs, 5, 80, 100)
    copies = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.select(COLUMNS).join(copies, "doc_id", "left_anti").select(COLUMNS)


def substrings_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts runs of 20 words that start earlier; documents of which nothing is left go, others keep their text unless cut."""
    ship(spark)
    cut = substrings.remove_repeats(docs.select(COLUMNS), 20).where("kept is null or kept <> ''")
    text = F.coalesce("kept", "text")
    return cut.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.length("kept").cast("bigint")).alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts all documents into the order of the mix: files and their rows follow the slots."""
    ship(spark)
    order = ["slot", "block_offset", "doc_id"]
    mixed = mixing.mix(docs.select(COLUMNS), mixing.tempered(docs))
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1,024 tokens; runs of sequences follow the mix, whose slots are worked out again."""
    ship(spark)
    mixed = mixing.mix(docs.select(COLUMNS), mixing.tempered(docs))
    return packing.pack_mixed(mixed, queries.tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("substrings", substrings_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: No SQL expresses the classifier or the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
