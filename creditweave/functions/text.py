"""Canonical names, references, narrations, dates, reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Reference

# Tokens of a party name that carry no identity.
NOISE = ["pvt", "private", "ltd", "limited", "llp", "plc", "inc", "incorporated", "corp", "corporation", "company", "co", "messrs", "the", "neft", "rtgs", "imps", "upi", "chq", "cheque", "cr", "by", "transfer", "payment", "pmt", "from"]
# Spellings of an invoice label.
INVOICE_LABELS = ["INVOICE", "INVOICENO", "INVOICENUM", "INVOICENUMBER", "INVNO", "INVNUM", "BILL", "BILLNO"]
# Narration words that are never references.
STOP_WORDS = ["NEFT", "RTGS", "IMPS", "UPI", "A/C", "AC", "GST", "TDS"]
# Claim reasons in the order that they are tried, and their keywords; \b marks whole words.
REASONS = {
    "damage": ["damage", "damaged", "breakage", "broken", "torn", "leak", "spoil", r"\bdmg\b"],
    "short_ship": ["short received", "short supply", "short ship", "shortage", "short qty", "quantity mismatch", "qty mismatch", "cases short", "not received"],
    "promo": ["scheme", "promo", "promotion", "offer", "festival", "trade discount", "rebate"],
    "pricing": ["rate diff", "rate difference", "price diff", "pricing", "price protection", "old rate", "revised price", "mrp diff"],
    "freight": ["freight", "transport", "octroi", "cartage", r"\bfrt\b", "delivery charge"],
    "tds": [r"\btds\b", "194q", r"\b194\b", "withholding", "tax deducted", r"\bwht\b"],
}
# Words that tell of money withheld.
DEDUCTION_MARKS = ["less", "deduct", "deducted", "deduction", "adjust", "adjusted", "claim", "net of", "withheld", "short", "credit note"]
# A label and a number that stand apart.
LABELLED = r"(?i)(?:INV(?:OICE)?|BILL)\.?(?:\s*(?:NO|NUM|NUMBER)\b\.?)?\s*[:#/.\-]?\s*(\d{1,8})(?![\w-])"
# Date formats of bank statements, tried in this order.
DATE_FORMATS = ["yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "d-MMM-yyyy", "d MMM yyyy", "M/d/yyyy", "d.M.yyyy"]


def normalize_party_name(raw: Column) -> Column:
    """Lower-case words of a name without legal forms and bank words; all words, if nothing else is left."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?i)^\s*m\s*/\s*s\.?\s*", "")
    text = F.trim(F.regexp_replace(F.lower(F.replace(text, F.lit("."), F.lit(""))), "[^a-z0-9]+", " "))
    kept = F.filter(F.split(text, " "), lambda t: ~t.isin(NOISE))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(text)


def normalize_reference(raw: Column) -> Column:
    """Letters and digits in upper case; of <letters><digits>, invoice labels become INV and leading zeros go."""
    compact = F.upper(F.regexp_replace(F.coalesce(raw, F.lit("")), "[^A-Za-z0-9]+", ""))
    shape = "^([A-Z]+)?0*([0-9]+)$"
    prefix = F.regexp_extract(compact, shape, 1)
    prefix = F.when(prefix.isin(INVOICE_LABELS), "INV").otherwise(prefix)
    return F.when(compact.rlike(shape), F.concat(prefix, F.regexp_extract(compact, shape, 2))).otherwise(compact)


def normalize_narration(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(F.coalesce(raw, F.lit(""))), r"\s+", " "))


def digits_key(digits: Column) -> Column:
    """Digits without leading zeros; 0 if nothing is left."""
    bare = F.regexp_replace(digits, "^0+", "")
    return F.when(bare == "", "0").otherwise(bare)


# What parts the words of a narration, and what is stripped from them.
BETWEEN_WORDS = r"[\s,;|&+]+|(?<=\d)/(?=\d)|(?<=[A-Za-z])/(?=[A-Za-z])"
AROUND_WORD = r"^[.,:;()\[\]\-]+|[.,:;()\[\]\-]+$"


def _first_of_each(tokens: Column) -> Column:
    names = F.transform(tokens, lambda t: t["normalized"])
    return F.filter(tokens, lambda t, i: F.array_position(names, t["normalized"]) == i + 1)


def extract_references(narration: Column, cfg: Reference) -> Column:
    """array<struct<raw, normalized, digits>>: the words of a narration that could be invoice references, in order."""
    words = F.split(F.coalesce(narration, F.lit("")), BETWEEN_WORDS)
    words = F.transform(words, lambda w: F.regexp_replace(w, AROUND_WORD, ""))
    tokens = F.transform(words, lambda w: F.struct(w.alias("raw"), normalize_reference(w).alias("normalized"), F.regexp_replace(w, "[^0-9]", "").alias("digits")))

    def usable(t: Column) -> Column:
        ok = (t["raw"] != "") & ~F.upper(t["raw"]).isin(STOP_WORDS) & F.length(t["digits"]).between(cfg.min_digits, cfg.max_digits) & (t["normalized"] != "")
        return ok if cfg.allow_bare_numeric else ok & t["raw"].rlike(r"\p{L}")

    return _first_of_each(F.filter(tokens, usable))


def labelled_references(narration: Column, cfg: Reference) -> Column:
    """References whose label and number are separate words; a number with a suffix is another document."""
    found = F.filter(F.regexp_extract_all(F.coalesce(narration, F.lit("")), F.lit(LABELLED), 1), lambda d: F.length(d).between(cfg.min_digits, cfg.max_digits))
    return F.transform(found, lambda d: F.struct(d.alias("raw"), F.concat(F.lit("INV"), digits_key(d)).alias("normalized"), digits_key(d).alias("digits")))


def all_references(narration: Column, cfg: Reference) -> Column:
    if not cfg.enabled:
        return F.array().cast("array<struct<raw: string, normalized: string, digits: string>>")
    return _first_of_each(F.concat(extract_references(narration, cfg), labelled_references(narration, cfg)))


def classify_reason(text: Column) -> Column:
    """The first family with a keyword in the text; null if none has."""
    low, out = F.lower(text), F.lit(None).cast("string")
    for reason, keys in reversed(REASONS.items()):
        out = F.when(low.rlike("|".join(keys)), reason).otherwise(out)
    return out


def describes_deduction(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(DEDUCTION_MARKS)), F.lit(False))


def parse_date(raw: Column) -> Column:
    """The first format that fits; day before month where both would."""
    text = F.trim(raw)
    return F.coalesce(*(F.try_to_timestamp(F.initcap(text) if "MMM" in f else text, F.lit(f)).cast("date") for f in DATE_FORMATS))


def status_for_open(open_paise: Column, amount_paise: Column) -> Column:
    return F.when(open_paise <= 0, "paid").when(open_paise < amount_paise, "partially_paid").otherwise("open")


def register(spark) -> None:
    """normalize_party_name, normalize_reference and normalize_narration as SQL functions of the session."""
    noise = ", ".join(f"'{w}'" for w in NOISE)
    labels = ", ".join(f"'{w}'" for w in INVOICE_LABELS)
    spark.sql(rf"""CREATE OR REPLACE TEMPORARY FUNCTION normalize_party_name(raw STRING) RETURNS STRING RETURN (
        SELECT CASE WHEN size(filter(split(t, ' '), x -> x NOT IN ({noise}))) > 0 THEN array_join(filter(split(t, ' '), x -> x NOT IN ({noise})), ' ') ELSE t END
        FROM (SELECT trim(regexp_replace(lower(replace(regexp_replace(coalesce(raw, ''), r'(?i)^\s*m\s*/\s*s\.?\s*', ''), '.', '')), '[^a-z0-9]+', ' ')) AS t))""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION normalize_reference(raw STRING) RETURNS STRING RETURN (
        SELECT CASE WHEN c RLIKE '^([A-Z]+)?0*([0-9]+)$' THEN concat(CASE WHEN regexp_extract(c, '^([A-Z]+)?0*([0-9]+)$', 1) IN ({labels}) THEN 'INV' ELSE regexp_extract(c, '^([A-Z]+)?0*([0-9]+)$', 1) END, regexp_extract(c, '^([A-Z]+)?0*([0-9]+)$', 2)) ELSE c END
        FROM (SELECT upper(regexp_replace(coalesce(raw, ''), '[^A-Za-z0-9]+', '')) AS c))""")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION normalize_narration(raw STRING) RETURNS STRING RETURN trim(regexp_replace(upper(coalesce(raw, '')), r'\s+', ' '))")
