"""Bank statements and advice documents from files: read as text, checked as columns, loaded once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.money import parse_credit

# The headers that a statement's columns go by, in order of preference.
HEADERS = {
    "statement_ref": ["statement_ref", "utr", "reference", "transaction_id", "txn_id", "ref"],
    "value_date": ["value_date", "date", "transaction_date", "posting_date", "txn_date"],
    "amount": ["amount", "credit", "credit_amount", "amount_inr", "value"],
    "payer_name": ["payer_name", "payer", "remitter", "customer", "beneficiary", "name"],
    "narration": ["narration", "description", "remarks", "particulars", "details", "memo"],
    "bank_account": ["bank_account", "account", "account_number", "our_account"],
}
REQUIRED = ["statement_ref", "value_date", "amount", "payer_name"]
MAX_BYTES, ERRORS_KEPT = 16 << 20, 25
#: Where Windows-1252 differs from Latin-1 (five of its bytes have no character and stay as they are).
_WINDOWS = {chr(b): c for b in range(0x80, 0xA0) if (c := bytes([b]).decode("windows-1252", "ignore"))}


def map_headers(columns: list[str]) -> dict[str, str]:
    """Logical name -> column of the file; a missing required one is an error that names it."""
    known = {c.strip().lower().replace(" ", "_").lstrip("﻿"): c for c in columns}
    found = {k: known[n] for k, names in HEADERS.items() for n in reversed(names) if n in known}
    if missing := [k for k in REQUIRED if k not in found]:
        raise ValueError(f"the statement has no column for: {', '.join(missing)}")
    return found


def decode(content: Column) -> Column:
    """Text of bytes: UTF-8 (with or without a mark) where it is valid, else Windows-1252."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    windows = F.translate(F.decode(content, "iso-8859-1"), "".join(_WINDOWS), "".join(_WINDOWS.values()))
    return F.regexp_replace(F.coalesce(utf8, windows), "^\ufeff", "")


def check_statement(raw: DataFrame) -> DataFrame:
    """Rows of a statement (all strings) with typed columns, `error` (null, or why the row can't be loaded) and `row`, which
    rises through a file that was just read."""
    at = map_headers(raw.columns)
    get = lambda k: F.trim(F.col(f"`{at[k]}`")) if k in at else F.lit(None).cast("string")
    out = raw.select(*(get(k).alias(k) for k in HEADERS), F.monotonically_increasing_id().alias("row"))
    day, paise = T.parse_date(F.col("value_date")), parse_credit(F.col("amount"))
    error = (
        F.when(F.coalesce("statement_ref", F.lit("")) == "", "no statement reference").when(day.isNull(), "the date can't be read")
        .when(paise.isNull(), "the amount isn't above 0 in whole paise").when(F.coalesce("payer_name", F.lit("")) == "", "no payer")
    )
    narration = F.coalesce("narration", F.lit(""))
    return out.select(
        F.left("statement_ref", F.lit(64)).alias("statement_ref"), day.alias("value_date"), paise.alias("amount_paise"), F.left("payer_name", F.lit(255)).alias("payer_name_raw"), T.normalize_party_name(F.col("payer_name")).alias("payer_name_normalized"),
        narration.alias("narration"), T.normalize_narration(narration).alias("normalized_narration"), F.coalesce("bank_account", F.lit("")).alias("bank_account"), F.lit("unmatched").alias("status"), error.alias("error"), "row",
    )


def load_statement(raw: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new payments, bad rows, one-row summary with the first ERRORS_KEPT errors of the file). References that exist already, or came earlier in the file, are skipped."""
    checked = check_statement(raw)
    good, bad = checked.where("error is null").drop("error"), checked.where("error is not null").drop("row")
    rn = F.row_number().over(Window.partitionBy("statement_ref").orderBy("row"))
    new = good.withColumn("_rn", rn).where("_rn = 1").drop("_rn", "row").join(existing.select("statement_ref"), "statement_ref", "left_anti")
    counts = checked.agg(F.count("*").alias("rows_read"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    said = checked.where("error is not null").orderBy("row").limit(ERRORS_KEPT).select("row", F.concat(F.coalesce("statement_ref", F.lit("?")), F.lit(": "), F.col("error")).alias("e"))
    errors = said.agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "e"))), lambda x: x["e"]).alias("errors"))
    summary = counts.crossJoin(errors).crossJoin(new.agg(F.count("*").alias("created"))).withColumn("skipped", F.col("rows_read") - F.col("failed") - F.col("created"))
    return new, bad, summary


def read_statement(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False, mode="PERMISSIVE", encoding=encoding, multiLine=True)


def check_upload(spark: SparkSession, path: str) -> None:
    """Raises where a file (or one of a pattern) that is to be loaded is missing, larger than 16 MB, or empty."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    if not found:
        raise ValueError(f"{path} does not exist")
    for f in found:
        if not 0 < f.getLen() <= MAX_BYTES:
            raise ValueError(f"{f.getPath().getName()} is {'empty' if f.getLen() == 0 else 'larger than 16 MB'}")


def read_advice(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a folder as unlinked advice; empty and oversized ones have an error."""
    files = spark.read.format("binaryFile").load(path)
    text = F.when(~F.lower("path").endswith(".pdf"), decode(F.col("content")))
    out = files.select(F.element_at(F.split("path", "/"), -1).alias("source_filename"), F.when(F.lower("path").endswith(".pdf"), "pdf").otherwise("email").alias("source_type"), F.col("modificationTime").alias("received_at"), text.alias("raw_text"), F.col("length").alias("size"))
    error = F.when(F.col("size") > MAX_BYTES, "larger than 16 MB").when(F.trim(F.coalesce("raw_text", F.lit(""))) == "", "no text")
    return out.withColumn("statement_ref", F.lit(None).cast("string")).withColumn("error", error)


def with_text(remittances: DataFrame, files: DataFrame) -> DataFrame:
    """remittances with the text to read: that of the file of their source_filename, where one has any, else the stored raw_text, else
    an empty one. files have source_filename and raw_text (as read_advice gives, or from any extractor of PDF text); of several files of a
    name the one with the largest text counts."""
    known = files.where(F.trim(F.coalesce("raw_text", F.lit(""))) != "").groupBy("source_filename").agg(F.max("raw_text").alias("_text"))
    out = remittances.join(known, "source_filename", "left")
    return out.withColumn("raw_text", F.coalesce("_text", "raw_text", F.lit(""))).select(*remittances.columns)
