"""Registered queries over the derived data set, and what they give in DuckDB's SQL."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import DEFAULT, Search
from .functions import money as M
from .functions import text as T
from .operators import book, identity, ledger, resolve, score, search, settle
from .plans import cascade, evaluate, extract, generate, metrics, reports, roi, scenarios
from .session import ship
from .sources import star, statements
from .streaming import advice as late_advice
from .streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_party(x: str) -> str:
    t = rf"trim(regexp_replace(lower(replace(regexp_replace(coalesce({x}, ''), '^\s*[mM]\s*/\s*[sS]\.?\s*', ''), '.', '')), '[^a-z0-9]+', ' ', 'g'))"
    kept = f"list_filter(string_split({t}, ' '), lambda w: w NOT IN ({_list(T.NOISE)}))"
    return f"(CASE WHEN len({kept}) > 0 THEN array_to_string({kept}, ' ') ELSE {t} END)"


def sql_reference(x: str) -> str:
    c, p = f"upper(regexp_replace(coalesce({x}, ''), '[^A-Za-z0-9]+', '', 'g'))", "'^([A-Z]+)?0*([0-9]+)$'"
    return f"(CASE WHEN regexp_matches({c}, {p}) THEN (CASE WHEN regexp_extract({c}, {p}, 1) IN ({_list(T.INVOICE_LABELS)}) THEN 'INV' ELSE regexp_extract({c}, {p}, 1) END) || regexp_extract({c}, {p}, 2) ELSE {c} END)"


def sql_narration(x: str) -> str:
    return rf"trim(regexp_replace(upper(coalesce({x}, '')), '\s+', ' ', 'g'))"


_BARE = r"regexp_replace(legal_name, '(M/s\. | Pvt\. Ltd\.| Private Limited| & Co\.| LLP)', '', 'g')"
_WORD = " || ".join(f"[{_list(star.SYLLABLES)}][(c_custkey // {16**i}) % 16 + 1]" for i in range(5))
_SCENARIO = "CASE " + " ".join(f"WHEN (invoice_id // 3) % 100 < {b} THEN '{n}'" for n, b in star.SCENARIOS) + " END"
DOMAIN = f"""WITH named AS (
  SELECT c_custkey, n_name, (CASE WHEN c_custkey % 7 = 0 THEN 'M/s. ' ELSE '' END) || upper(w[1]) || w[2:] || ' ' || [{_list(star.TRADES)}][c_custkey % 8 + 1] || [{_list(star.FORMS)}][c_custkey % 4 + 1] AS legal_name
  FROM (SELECT c_custkey, n_name, {_WORD} AS w FROM customer JOIN nation ON c_nationkey = n_nationkey)),
customers AS (SELECT c_custkey AS customer_id, 'CUST-' || c_custkey AS code, legal_name, {sql_party('legal_name')} AS normalized_name, n_name AS city, CAST(15 * (1 + c_custkey % 4) AS INT) AS payment_terms_days FROM named),
aliases AS (SELECT customer_id AS alias_id, customer_id, alias, {sql_party('alias')} AS normalized_alias FROM (SELECT customer_id, upper({_BARE}) || '-' || upper(city) AS alias FROM customers WHERE customer_id % 3 < 2)),
inv AS (SELECT o_orderkey AS invoice_id, 'INV-' || lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(7, length(CAST(o_orderkey AS VARCHAR))) AS INT), '0') AS invoice_number, o_custkey AS customer_id, o_orderstatus, CAST(o_orderdate AS DATE) AS invoice_date, CAST(round(o_totalprice * 100) AS BIGINT) AS amount_paise FROM orders),
invoices AS (SELECT invoice_id, invoice_number, 'INV' || invoice_id AS normalized_number, customer_id, invoice_date, invoice_date + CAST(15 * (1 + customer_id % 4) AS INT) AS due_date, amount_paise,
  CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN amount_paise - amount_paise * (10 + invoice_id % 50) // 100 ELSE amount_paise END AS BIGINT) AS open_amount_paise,
  CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'P' THEN 'partially_paid' ELSE 'open' END AS status FROM inv),
items AS (SELECT invoice_id, invoice_number, normalized_number, customer_id, invoice_date, due_date, open_amount_paise FROM invoices WHERE status IN ('open', 'partially_paid') AND open_amount_paise > 0),
paired AS (SELECT *, lead(invoice_number) OVER w AS next_number, lead(open_amount_paise) OVER w AS next_open FROM items WINDOW w AS (PARTITION BY customer_id ORDER BY invoice_date, invoice_number)),
paid0 AS (SELECT *, {_SCENARIO} AS s FROM paired WHERE invoice_id % 3 = 0),
paid1 AS (SELECT * EXCLUDE (s), CASE WHEN s = 'bundled_multi' AND next_number IS NULL THEN 'exact_single' ELSE s END AS scenario FROM paid0),
paid2 AS (SELECT *, CAST(CASE WHEN scenario = 'short_pay_deduction' THEN greatest(open_amount_paise * (2 + invoice_id % 10) // 100 // 5000 * 5000, 0) ELSE 0 END AS BIGINT) AS claim_paise FROM paid1),
paid AS (SELECT * FROM (SELECT *, CAST(CASE scenario WHEN 'bundled_multi' THEN open_amount_paise + next_open WHEN 'short_pay_deduction' THEN open_amount_paise - claim_paise WHEN 'partial_payment' THEN open_amount_paise * (25 + invoice_id % 60) // 100 WHEN 'no_matching_invoice' THEN open_amount_paise + 777777 ELSE open_amount_paise END AS BIGINT) AS amount_paise FROM paid2) WHERE amount_paise > 0),
pay AS (SELECT 'UTR' || lpad(CAST(invoice_id AS VARCHAR), 12, '0') AS statement_ref, greatest(due_date + CAST(invoice_id % 52 - 6 AS INT), invoice_date + 1) AS value_date, amount_paise,
  CASE WHEN scenario = 'no_matching_invoice' THEN 'CASH DEPOSIT ' || invoice_id WHEN scenario = 'payer_name_variant' THEN upper(legal_name) || ' ' || upper(city) || ' BR' WHEN invoice_id % 5 = 0 THEN upper({_BARE}) || '-' || upper(city) WHEN invoice_id % 5 = 1 THEN 'NEFT CR ' || upper(legal_name) ELSE legal_name END AS payer_name_raw,
  CASE scenario WHEN 'exact_single' THEN 'NEFT ' || invoice_number WHEN 'bundled_multi' THEN 'RTGS ' || invoice_number || ', ' || next_number WHEN 'short_pay_deduction' THEN 'NEFT  INVOICE NO. ' || invoice_id WHEN 'partial_payment' THEN 'imps inv/' || invoice_id || ' part payment'
    WHEN 'missing_reference' THEN 'NEFT PAYMENT RECEIVED' WHEN 'typo_reference' THEN 'NEFT BILL 00' || invoice_id WHEN 'payer_name_variant' THEN 'UPI ' || invoice_number ELSE 'CASH' END AS narration FROM paid JOIN customers USING (customer_id)),
payments AS (SELECT *, {sql_party('payer_name_raw')} AS payer_name_normalized, {sql_narration('narration')} AS normalized_narration FROM pay),
names AS (SELECT normalized_name, max(customer_id) AS customer_id FROM customers WHERE normalized_name <> '' GROUP BY 1),
alias_names AS (SELECT normalized_alias, min_by(customer_id, alias_id) AS customer_id FROM aliases WHERE normalized_alias <> '' GROUP BY 1),
known AS (SELECT p.*, coalesce(n.customer_id, a.customer_id) AS customer_id, CASE WHEN n.customer_id IS NOT NULL THEN 'exact' WHEN a.customer_id IS NOT NULL THEN 'alias' ELSE 'none' END AS method
  FROM payments p LEFT JOIN names n ON n.normalized_name = p.payer_name_normalized LEFT JOIN alias_names a ON a.normalized_alias = p.payer_name_normalized)"""

#: Words of a narration as references: blanks for slashes between two digits or two letters, then one item a word.
_SPACED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(normalized_narration, '([0-9])/([0-9])', '\1 \2', 'g'), '([0-9])/([0-9])', '\1 \2', 'g'), '([A-Za-z])/([A-Za-z])', '\1 \2', 'g'), '([A-Za-z])/([A-Za-z])', '\1 \2', 'g')"
_CUT = rf"list_transform(string_split_regex({_SPACED}, '[\s,;|&+]+'), lambda w: regexp_replace(regexp_replace(w, '^[-.,:;()\[\]]+', ''), '[-.,:;()\[\]]+$', ''))"
_DIG = "regexp_replace(w, '[^0-9]', '', 'g')"
_USABLE = f"list_filter({_CUT}, lambda w: w <> '' AND upper(w) NOT IN ({_list(T.STOP_WORDS)}) AND length({_DIG}) BETWEEN 2 AND 8)"
_FOUND = rf"regexp_extract_all(normalized_narration, '(?i)(?:INV(?:OICE)?|BILL)\.?(?:\s*(?:NO|NUM|NUMBER)\b\.?)?\s*[:#/.\-]?\s*(\d{{1,8}})(?:[^\w-]|$)', 1)"
_LABELLED = f"list_transform(list_filter({_FOUND}, lambda d: length(d) BETWEEN 2 AND 8), lambda d: 'INV' || (CASE WHEN ltrim(d, '0') = '' THEN '0' ELSE ltrim(d, '0') END))"
TOKENS = DOMAIN + f""", words AS (SELECT statement_ref, list_transform({_USABLE}, lambda w: {sql_reference('w')}) AS a, {_LABELLED} AS b FROM payments),
each_token AS (SELECT statement_ref, unnest(list_concat(a, b)) AS normalized, generate_subscripts(list_concat(a, b), 1) AS pos FROM words),
tokens AS (SELECT statement_ref, normalized, min(pos) AS pos FROM each_token GROUP BY 1, 2)"""
#: Tokens resolved: by the whole number, else by digits; of several hits only a single one of the known customer.
RESOLVED = TOKENS + """, hit AS (SELECT t.*, i.invoice_id, i.invoice_number, i.customer_id AS owner, i.open_amount_paise, i.due_date FROM tokens t JOIN items i ON i.normalized_number = t.normalized),
loose AS (SELECT t.*, i.invoice_id, i.invoice_number, i.customer_id AS owner, i.open_amount_paise, i.due_date FROM tokens t JOIN items i ON CAST(i.invoice_id AS VARCHAR) = (CASE WHEN ltrim(regexp_replace(t.normalized, '[^0-9]', '', 'g'), '0') = '' THEN '0' ELSE ltrim(regexp_replace(t.normalized, '[^0-9]', '', 'g'), '0') END)
  WHERE NOT EXISTS (SELECT 1 FROM items x WHERE x.normalized_number = t.normalized)),
resolved AS (SELECT DISTINCT statement_ref, invoice_id, invoice_number, owner, open_amount_paise, due_date FROM (SELECT * FROM hit UNION ALL SELECT * FROM loose)),
sets AS (SELECT r.statement_ref, k.amount_paise, k.value_date, k.method, k.customer_id, count(*) AS n, sum(open_amount_paise) AS total, min(owner) AS owner, count(DISTINCT owner) AS owners, max(abs(k.value_date - r.due_date)) AS worst,
  list(invoice_number ORDER BY invoice_number) AS numbers, list(open_amount_paise ORDER BY invoice_number) AS opens, min(open_amount_paise) AS least,
  min(CASE WHEN open_amount_paise > tot - k.amount_paise THEN open_amount_paise END) AS bearer FROM (SELECT *, sum(open_amount_paise) OVER (PARTITION BY statement_ref) AS tot FROM resolved) r JOIN known k USING (statement_ref) GROUP BY ALL),
settled AS (SELECT *, total - amount_paise AS gap, CASE WHEN abs(total - amount_paise) <= 100 THEN 'exact' WHEN total > amount_paise AND bearer IS NOT NULL AND total - amount_paise <= 15000000 AND (total - amount_paise) / bearer * 100 BETWEEN 0.5 AND 15 THEN 'short_pay'
  WHEN n = 1 AND amount_paise < total - 100 THEN 'partial' END AS shape FROM sets WHERE owners = 1 AND (customer_id IS NULL OR customer_id = owner)),
scored AS (SELECT *, CASE WHEN customer_id IS NULL THEN 0.9 ELSE 1.0 END AS v_id, CASE shape WHEN 'partial' THEN 0.7 WHEN 'short_pay' THEN 0.88 ELSE 1.0 END AS v_amount, CASE WHEN worst <= 35 THEN 1.0 WHEN worst >= 200 THEN 0.0 ELSE 1.0 - (worst - 35) / 165.0 END AS v_date FROM settled WHERE shape IS NOT NULL),
confident AS (SELECT *, (0.34 + 0.26 * v_amount + 0.18 * v_id + 0.08 * v_date) / 0.86 * (CASE WHEN n > 1 AND gap > 0 THEN 0.6 ELSE 1.0 END) * (CASE WHEN gap < 0 THEN 0.85 ELSE 1.0 END) AS c FROM scored),
decided AS (SELECT *, CASE WHEN round(c, 9) >= 0.9 THEN 'auto_applied' WHEN round(c, 9) >= 0.45 THEN 'needs_review' ELSE 'unapplied' END AS decision FROM confident)"""


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        key = name or f.__name__
        QUERIES[key] = lambda spark, d: f(ship(spark), d)
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def _known(spark: SparkSession, d: str) -> DataFrame:
    """Payments with the customer that exact name or alias gives."""
    found = identity.identify(star.payments(spark, d), book.names(star.customers(spark, d)), book.alias_names(star.aliases(spark, d)), DEFAULT.identification, fuzzy=False)
    return found.withColumns({"customer_id": F.col("identity.customer_id"), "method": F.col("identity.method")})


def _items(spark: SparkSession, d: str) -> DataFrame:
    return book.open_items(star.invoices(spark, d))


def _by_reference(spark: SparkSession, d: str) -> DataFrame:
    """The cascade for payments that references settle, without advice or similarity."""
    out = cascade.match(star.payments(spark, d), _items(spark, d), book.names(star.customers(spark, d)), book.alias_names(star.aliases(spark, d)), None, DEFAULT, fuzzy=False, by_amounts=False)
    return score.score(out.where("strategy = 'reference_exact'"), DEFAULT.scoring)


# --- scans and scalars


@query(DOMAIN + " SELECT * FROM items")
def open_items(spark, d):
    return _items(spark, d)


@query(DOMAIN + " SELECT 'name' AS kind, normalized_name AS spelling, customer_id FROM names UNION ALL SELECT 'alias', normalized_alias, customer_id FROM alias_names")
def customer_spellings(spark, d):
    a = book.names(star.customers(spark, d)).select(F.lit("name").alias("kind"), F.col("normalized_name").alias("spelling"), "customer_id")
    return a.unionByName(book.alias_names(star.aliases(spark, d)).select(F.lit("alias").alias("kind"), F.col("normalized_alias").alias("spelling"), "customer_id"))


@query(DOMAIN + " SELECT statement_ref, value_date, amount_paise, payer_name_raw, payer_name_normalized, narration, normalized_narration FROM payments")
def unmatched_statement(spark, d):
    return metrics.statement(star.payments(spark, d)).select("statement_ref", "value_date", "amount_paise", "payer_name_raw", "payer_name_normalized", "narration", "normalized_narration")


@query("SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS paise, CAST(round(o_totalprice * 100) AS BIGINT) AS credit_paise, CAST(round(o_totalprice * 100) AS BIGINT) AS exact_paise FROM orders")
def money_to_paise(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_totalprice").cast("decimal(20,2)").cast("string").alias("t"))
    spelled = F.expr("case o_orderkey % 5 when 0 then concat('Rs. ', t) when 1 then concat(t, '/-') when 2 then concat('INR ', t) when 3 then concat('(', t, ')') else concat('₹', t) end")
    return o.select("o_orderkey", M.parse_amount(spelled).alias("paise"), M.parse_credit(F.concat(F.lit("Rs. "), "t", F.lit(" CR"))).alias("credit_paise"), M.rupees_to_paise(F.col("t")).alias("exact_paise"))


@query(r"""SELECT o_orderkey, (CASE WHEN length(r) > 3 THEN ltrim(reverse(regexp_replace(reverse(left(r, length(r) - 3)), '(\d\d)', '\1,', 'g')), ',') || ',' || right(r, 3) ELSE r END) AS grouped, '₹' || (CASE WHEN length(r) > 3 THEN ltrim(reverse(regexp_replace(reverse(left(r, length(r) - 3)), '(\d\d)', '\1,', 'g')), ',') || ',' || right(r, 3) ELSE r END) || '.' || lpad(CAST(p % 100 AS VARCHAR), 2, '0') AS shown
  FROM (SELECT o_orderkey, p, CAST(p // 100 AS VARCHAR) AS r FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) * (1 + o_orderkey % 7 * 1000) AS p FROM orders))""")
def format_inr(spark, d):
    p = F.expr("cast(round(o_totalprice * 100) as bigint) * (1 + o_orderkey % 7 * 1000)")
    shown = M.format_inr(p)
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.regexp_extract(shown, "₹(.*)\\.", 1).alias("grouped"), shown.alias("shown"))


_RAW = "CASE o_orderkey % 6 WHEN 0 THEN 'INV-00' || o_orderkey WHEN 1 THEN 'Invoice No. ' || o_orderkey WHEN 2 THEN 'bill/' || o_orderkey WHEN 3 THEN 'PO 12-' || o_orderkey WHEN 4 THEN '00' || o_orderkey ELSE 'x-' || o_orderkey || '-A' END"


@query(f"SELECT o_orderkey, {sql_reference(_RAW)} AS reference FROM orders")
def normalize_reference(spark, d):
    raw = F.expr(_RAW.replace("'", '"').replace('"', "'"))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", T.normalize_reference(raw).alias("reference"))


_PARTY = "CASE c_custkey % 5 WHEN 0 THEN 'M/s A.B.C. ' || c_name || ' Pvt. Ltd.' WHEN 1 THEN 'NEFT CR ' || upper(c_name) WHEN 2 THEN 'The Company Co' WHEN 3 THEN '  ' || c_name || ' & Sons, LLP' ELSE 'm / s. ' || c_name END"


@query(f"SELECT c_custkey, {sql_party(_PARTY)} AS party FROM customer")
def normalize_party(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", T.normalize_party_name(F.expr(_PARTY)).alias("party"))


@query(DOMAIN + f" SELECT statement_ref, {sql_narration('narration')} AS narration FROM payments")
def normalize_narration(spark, d):
    T.register(spark)
    return star.payments(spark, d).select("statement_ref", F.expr("normalize_narration(narration)").alias("narration"))


@query(TOKENS + " SELECT statement_ref, array_to_string(list(normalized ORDER BY pos), ' ') AS refs FROM tokens GROUP BY 1")
def extract_references(spark, d):
    refs = F.transform(T.all_references(F.col("normalized_narration"), DEFAULT.reference), lambda t: t["normalized"])
    return star.payments(spark, d).select("statement_ref", F.array_join(refs, " ").alias("refs")).where("refs <> ''")


@query(DOMAIN + f" SELECT statement_ref, array_to_string({_LABELLED}, ' ') AS refs FROM payments")
def labelled_references(spark, d):
    refs = F.transform(T.labelled_references(F.col("normalized_narration"), DEFAULT.reference), lambda t: t["normalized"])
    return star.payments(spark, d).select("statement_ref", F.array_join(refs, " ").alias("refs"))


_PHRASES = ["12 cases damaged in transit", "short supply of 3 cases", "festival scheme", "rate difference", "freight on return", "TDS 194Q", "no remark", "unless noted", "credit note", "less dmg", "mrp diff claim", "outdoors"]
_REASON_CASE = "CASE " + " ".join(f"WHEN regexp_matches(lower(x), '{'|'.join(k)}') THEN '{r}'" for r, k in T.REASONS.items()) + " END"


@query(f"SELECT o_orderkey, {_REASON_CASE} AS reason, regexp_matches(lower(x), '{'|'.join(T.DEDUCTION_MARKS)}') AS deduction FROM (SELECT o_orderkey, [{_list(_PHRASES)}][o_orderkey % {len(_PHRASES)} + 1] AS x FROM orders)")
def classify_reason(spark, d):
    x = star._pick(_PHRASES, "o_orderkey")
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", T.classify_reason(x).alias("reason"), T.describes_deduction(x).alias("deduction"))


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 8 = 7 THEN NULL ELSE o_orderdate END AS DATE) AS day FROM orders")
def parse_dates(spark, d):
    day = F.col("o_orderdate")
    text = F.lit("n/a")
    for i, f in enumerate(["yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "dd-MMM-yyyy", "d MMM yyyy", "d/M/yyyy", "dd.MM.yyyy"]):
        text = F.when(F.col("o_orderkey") % 8 == i, F.date_format(day, f)).otherwise(text)
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", T.parse_date(F.upper(text)).alias("day"))


# --- identity and references


@query(DOMAIN + " SELECT statement_ref, method, customer_id FROM known")
def identify_exact_alias(spark, d):
    return _known(spark, d).select("statement_ref", "method", "customer_id")


@query()
def identify_fuzzy(spark, d):
    found = identity.identify(star.payments(spark, d), book.names(star.customers(spark, d)), book.alias_names(star.aliases(spark, d)), DEFAULT.identification)
    return found.select("statement_ref", "identity.method", "identity.customer_id", F.round("identity.score", 4).alias("score"))


_CLOSE = """, left_over AS (SELECT DISTINCT payer_name_normalized AS payer FROM known WHERE method = 'none' AND payer_name_normalized <> ''),
choice AS (SELECT normalized_name AS choice, customer_id AS owner FROM names UNION ALL SELECT normalized_alias, customer_id FROM alias_names),
pairs AS (SELECT payer, choice, owner, 100.0 - levenshtein(payer, choice) * 100.0 / greatest(length(payer), length(choice)) AS score FROM left_over, choice),
ranked AS (SELECT *, row_number() OVER (PARTITION BY payer ORDER BY round(score, 9) DESC, choice, owner) AS rn FROM pairs),
best AS (SELECT * FROM ranked WHERE rn = 1), rival AS (SELECT r.payer, arg_min(r.score, r.rn) AS score FROM ranked r JOIN best b USING (payer) WHERE r.rn <= 5 AND r.owner <> b.owner GROUP BY 1)
SELECT l.payer, CASE WHEN coalesce(b.score, -1) < 70 THEN 'none' WHEN b.score - r.score < 5 THEN 'ambiguous' ELSE 'fuzzy' END AS method, CASE WHEN coalesce(b.score, -1) >= 70 AND NOT coalesce(b.score - r.score < 5, false) THEN b.owner END AS customer_id
FROM left_over l LEFT JOIN best b USING (payer) LEFT JOIN rival r USING (payer)"""
@query(DOMAIN + _CLOSE)
def identify_similarity(spark, d):
    cfg = dataclasses.replace(DEFAULT.identification, fuzzy_scorer="levenshtein", fuzzy_min_score=70.0)
    rest = _known(spark, d).where("method = 'none' and payer_name_normalized <> ''").select(F.col("payer_name_normalized").alias("payer"))
    return identity.similar_names(rest, book.names(star.customers(spark, d)), book.alias_names(star.aliases(spark, d)), cfg).select("payer", "method", "customer_id")


@query(RESOLVED + " SELECT statement_ref, normalized, invoice_number, 'exact' AS how FROM hit UNION ALL SELECT statement_ref, normalized, invoice_number, 'digits' FROM loose")
def reference_hits(spark, d):
    tokens = resolve.narration_tokens(star.payments(spark, d), DEFAULT.reference)
    return resolve.token_hits(tokens.select("statement_ref", "pos", "normalized", "digits"), _items(spark, d), ["statement_ref"]).select("statement_ref", "normalized", F.col("item.invoice_number").alias("invoice_number"), "how")


@query(RESOLVED + " SELECT statement_ref, array_to_string(numbers, ' ') AS numbers, CAST(total AS BIGINT) AS total_paise, CAST(owners AS BIGINT) AS owners FROM sets")
def resolve_references(spark, d):
    known = _known(spark, d)
    tokens = resolve.narration_tokens(known, DEFAULT.reference).join(known.select("statement_ref", "customer_id"), "statement_ref")
    out = resolve.resolve(tokens, _items(spark, d), ["statement_ref"]).where("size(resolved) > 0")
    return out.select("statement_ref", F.array_join(F.transform("resolved", lambda i: i["invoice_number"]), " ").alias("numbers"), settle.total_open(F.col("resolved")).alias("total_paise"), F.size(resolve.owners(F.col("resolved"))).cast("bigint").alias("owners"))


# --- pools, amounts, search

_POOL = DOMAIN + """, pool AS (SELECT * FROM (SELECT k.statement_ref, k.amount_paise, i.invoice_id, i.invoice_number, i.open_amount_paise, row_number() OVER (PARTITION BY k.statement_ref ORDER BY abs(i.due_date - k.value_date), i.invoice_number) AS pool_rank
  FROM known k JOIN items i ON i.customer_id = k.customer_id AND i.invoice_date BETWEEN k.value_date - 210 AND k.value_date + 20) WHERE pool_rank <= {cap})"""


def _pool(spark, d, cap: int = 45) -> DataFrame:
    known = _known(spark, d).where("customer_id is not null").select("statement_ref", "amount_paise", "value_date", "customer_id")
    return book.candidate_pool(known, _items(spark, d), dataclasses.replace(DEFAULT, max_pool=cap))


@query(_POOL.replace("{cap}", "45") + " SELECT statement_ref, invoice_number, CAST(pool_rank AS INT) AS pool_rank FROM pool")
def candidate_pool(spark, d):
    return _pool(spark, d).select("statement_ref", "invoice_number", "pool_rank")


@query(_POOL.replace("{cap}", "2") + " SELECT statement_ref, invoice_number, CAST(pool_rank AS INT) AS pool_rank FROM pool")
def candidate_pool_capped(spark, d):
    return _pool(spark, d, 2).select("statement_ref", "invoice_number", "pool_rank")


@query(_POOL.replace("{cap}", "45") + " SELECT statement_ref, invoice_number, open_amount_paise FROM pool WHERE abs(open_amount_paise - amount_paise) <= 100")
def amount_exact(spark, d):
    return _pool(spark, d).where("abs(open_amount_paise - amount_paise) <= 100").select("statement_ref", "invoice_number", "open_amount_paise")


def _sets(spark, d, low, high, cfg: Search) -> DataFrame:
    """A row for each set that the bounded search finds: statement_ref, numbers, total_paise."""
    pool = _pool(spark, d).groupBy("statement_ref", "amount_paise").agg(F.array_sort(F.collect_list(F.struct((-F.col("open_amount_paise")).alias("o"), "invoice_number", "open_amount_paise"))).alias("p"))
    found = pool.withColumn("f", search.search(F.transform("p", lambda i: i["open_amount_paise"]), low, high, cfg))
    rows = found.select("statement_ref", "p", F.explode("f.solutions").alias("s"))
    numbers = F.array_sort(F.transform("s", lambda i: F.try_element_at(F.col("p"), i + 1)["invoice_number"]))
    total = F.aggregate("s", F.lit(0).cast("bigint"), lambda t, i: t + F.try_element_at(F.col("p"), i + 1)["open_amount_paise"])
    return rows.select("statement_ref", F.array_join(numbers, " ").alias("numbers"), total.alias("total_paise"))


_PAIRS = " SELECT a.statement_ref, a.invoice_number || ' ' || b.invoice_number AS numbers, CAST(a.open_amount_paise + b.open_amount_paise AS BIGINT) AS total_paise FROM pool a JOIN pool b ON a.statement_ref = b.statement_ref AND a.invoice_number < b.invoice_number WHERE abs(a.open_amount_paise + b.open_amount_paise - a.amount_paise) <= {tolerance}"


@query(_POOL.replace("{cap}", "45") + _PAIRS.replace("{tolerance}", "100"))
def subset_pairs(spark, d):
    a = F.col("amount_paise")
    return _sets(spark, d, a - 100, a + 100, Search(True, 2, 2, 1000, 400_000))


@query(_POOL.replace("{cap}", "45") + _PAIRS.replace("{tolerance}", "200000") + """ UNION ALL SELECT a.statement_ref, a.invoice_number || ' ' || b.invoice_number || ' ' || c.invoice_number, CAST(a.open_amount_paise + b.open_amount_paise + c.open_amount_paise AS BIGINT) FROM pool a JOIN pool b ON a.statement_ref = b.statement_ref AND a.invoice_number < b.invoice_number JOIN pool c ON a.statement_ref = c.statement_ref AND b.invoice_number < c.invoice_number
  WHERE abs(a.open_amount_paise + b.open_amount_paise + c.open_amount_paise - a.amount_paise) <= 200000""")
def subset_triples(spark, d):
    a = F.col("amount_paise")
    return _sets(spark, d, a - 200_000, a + 200_000, Search(True, 2, 3, 1000, 400_000))


@query(_POOL.replace("{cap}", "45") + _PAIRS.replace("{tolerance}", "100"))
def subset_pairs_sql(spark, d):
    """The search as a table function in SQL, a partition a payment."""
    search.register(spark, Search(True, 2, 2, 1000, 400_000), 100, "find_pairs")
    _pool(spark, d).select("statement_ref", "amount_paise", "invoice_number", "open_amount_paise").createOrReplaceTempView("payment_pools")
    return spark.sql("SELECT statement_ref, numbers, total_paise FROM find_pairs(TABLE(payment_pools) PARTITION BY statement_ref)")


@query()
def subset_sum_full(spark, d):
    a = F.col("amount_paise")
    return _sets(spark, d, a - 100, a + 100, DEFAULT.subset_sum)


@query(_POOL.replace("{cap}", "45") + " SELECT statement_ref, invoice_number, open_amount_paise - amount_paise AS claim_paise FROM pool WHERE open_amount_paise > amount_paise + 100 AND open_amount_paise - amount_paise <= 15000000 AND (open_amount_paise - amount_paise) / open_amount_paise * 100 BETWEEN 0.5 AND 15")
def short_pay_single(spark, d):
    item = F.struct(*book.ITEM)
    s = _pool(spark, d).select("statement_ref", "invoice_number", settle.settle(F.array(item), F.col("amount_paise"), DEFAULT, allow_partial=False).alias("s"))
    return s.where("s.shape = 'short_pay'").select("statement_ref", "invoice_number", F.get("s.allocations", F.lit(0))["deduction"].alias("claim_paise"))


# --- settlement, scoring, ledger


@query(RESOLVED + " SELECT statement_ref, shape, CAST(greatest(CASE WHEN shape = 'partial' THEN 0 ELSE gap END, 0) AS BIGINT) AS deduction_paise, CAST(CASE WHEN shape = 'partial' THEN amount_paise ELSE least(total, amount_paise) END AS BIGINT) AS allocated_paise FROM scored")
def settle_shapes(spark, d):
    first = F.get("candidates", F.lit(0))
    add = lambda k: F.aggregate(first["allocations"], F.lit(0).cast("bigint"), lambda t, a: t + a[k])
    return _by_reference(spark, d).select("statement_ref", first["shape"].alias("shape"), add("deduction").alias("deduction_paise"), add("allocated").alias("allocated_paise"))


@query(RESOLVED + " SELECT statement_ref, CAST(round(c, 6) AS DECIMAL(9,6)) AS confidence, decision FROM decided")
def confidence_by_reference(spark, d):
    return _by_reference(spark, d).select("statement_ref", F.round("confidence", 6).cast("decimal(9,6)").alias("confidence"), "decision")


@query(RESOLVED + " SELECT decision, count(*) AS n, CAST(sum(amount_paise) AS BIGINT) AS value_paise FROM decided GROUP BY 1")
def decision_buckets(spark, d):
    results, _ = ledger.decisions(_by_reference(spark, d))
    return metrics.by_decision(results, star.payments(spark, d))


@query(RESOLVED + """ SELECT count(*) AS total, count(*) FILTER (decision = 'auto_applied') AS auto_applied, CAST(coalesce(sum(amount_paise) FILTER (decision = 'auto_applied'), 0) AS BIGINT) AS auto_applied_paise, count(*) FILTER (decision = 'needs_review') AS needs_review, count(*) FILTER (decision = 'unapplied') AS unapplied,
  count(*) FILTER (decision <> 'unapplied' AND shape <> 'partial' AND gap > 0) AS deductions, CAST(round(count(*) FILTER (decision = 'auto_applied') / count(*), 6) AS DECIMAL(9,6)) AS auto_rate FROM decided""")
def decision_summary(spark, d):
    s = metrics.decision_summary(_by_reference(spark, d))
    return s.select("total", "auto_applied", "auto_applied_paise", "needs_review", "unapplied", "deductions", F.round("auto_applied_rate", 6).cast("decimal(9,6)").alias("auto_rate"))


@query(RESOLVED + " SELECT CASE WHEN c <= 0 THEN '0.00' ELSE printf('%.1f-%.1f', least(floor(round(c, 9) * 10) / 10, 0.9), least(floor(round(c, 9) * 10) / 10, 0.9) + 0.1) END AS band, count(*) AS n FROM decided GROUP BY 1")
def confidence_histogram(spark, d):
    return metrics.confidence_histogram(_by_reference(spark, d).withColumn("confidence", F.round("confidence", 9)))


_CLEARED = """, lines AS (SELECT statement_ref, unnest(numbers) AS invoice_number, unnest(opens) AS o FROM decided WHERE decision = 'auto_applied' AND shape <> 'partial' UNION ALL SELECT statement_ref, numbers[1], amount_paise FROM decided WHERE decision = 'auto_applied' AND shape = 'partial'),
cleared AS (SELECT invoice_number, sum(o) AS c FROM lines GROUP BY 1)"""


@query(RESOLVED + _CLEARED + " SELECT invoice_number, CAST(CASE WHEN c IS NULL THEN open_amount_paise ELSE greatest(0, open_amount_paise - c) END AS BIGINT) AS open_amount_paise, CASE WHEN c IS NULL THEN status WHEN open_amount_paise - c <= 0 THEN 'paid' WHEN open_amount_paise - c < amount_paise THEN 'partially_paid' ELSE 'open' END AS status FROM invoices LEFT JOIN cleared USING (invoice_number)")
def post_ledger(spark, d):
    results, allocations = ledger.decisions(_by_reference(spark, d))
    return ledger.post_cash(star.payments(spark, d), star.invoices(spark, d), results, allocations)[1].select("invoice_number", "open_amount_paise", "status")


@query(RESOLVED + " SELECT p.statement_ref, CASE WHEN d.decision = 'auto_applied' THEN (CASE WHEN gap < 0 THEN 'partially_applied' WHEN gap > 0 AND shape <> 'partial' THEN (CASE WHEN total - gap >= p.amount_paise THEN 'matched' ELSE 'partially_applied' END) ELSE 'matched' END) ELSE 'unmatched' END AS status FROM payments p LEFT JOIN decided d USING (statement_ref)")
def post_payments(spark, d):
    results, allocations = ledger.decisions(_by_reference(spark, d))
    return ledger.post_cash(star.payments(spark, d), star.invoices(spark, d), results, allocations)[0].select("statement_ref", "status")


@query(RESOLVED + " SELECT statement_ref, CASE WHEN customer_id % 4 = 0 THEN 'kept' ELSE 'new' END AS origin FROM decided UNION ALL SELECT statement_ref, 'new' FROM decided WHERE customer_id % 4 = 0 UNION ALL SELECT statement_ref, 'new' FROM decided WHERE customer_id IS NULL AND false")
def replace_results(spark, d):
    scored = _by_reference(spark, d)
    results, _ = ledger.decisions(scored)
    seen = scored.join(_known(spark, d).select("statement_ref", F.col("customer_id").alias("own")), "statement_ref").select("statement_ref", F.coalesce(F.col("own") % 4 == 0, F.lit(False)).alias("r"))
    old = results.join(seen, "statement_ref").withColumn("reviewed_at", F.when(F.col("r"), F.lit("2026-01-01").cast("timestamp"))).drop("r")
    both = ledger.replace_own(old, results)
    return both.select("statement_ref", F.when(F.col("reviewed_at").isNotNull(), "kept").otherwise("new").alias("origin"))


@query(RESOLVED + " SELECT 'match_result' AS entity_type, statement_ref AS entity_id, 'decided_' || decision AS action, 'engine' AS actor FROM decided")
def audit_rows(spark, d):
    results, _ = ledger.decisions(_by_reference(spark, d))
    return ledger.audit("match_result", results, "statement_ref", F.concat(F.lit("decided_"), F.col("decision")), payload=["statement_ref", "decision"]).drop("payload_after")


@query(RESOLVED + " SELECT statement_ref, CASE WHEN customer_id % 2 = 0 THEN 'manually_applied' ELSE 'unapplied' END AS decision, CAST(CASE WHEN customer_id % 2 = 0 THEN (CASE WHEN shape = 'partial' THEN amount_paise ELSE least(total, amount_paise) END) ELSE 0 END AS BIGINT) AS matched_amount_paise FROM decided WHERE decision = 'needs_review' AND customer_id IS NOT NULL")
def review_actions(spark, d):
    results, allocations = ledger.decisions(_by_reference(spark, d).where("decision = 'needs_review'"))
    own = _known(spark, d).where("customer_id is not null").select("statement_ref", "customer_id")
    actions = results.join(own, "statement_ref").select("statement_ref", F.when(F.col("customer_id") % 2 == 0, "approve").otherwise("reject").alias("action"), F.lit("reviewer").alias("reviewer"), F.lit("").alias("note"), F.lit("2026-01-02").cast("timestamp").alias("at"))
    none = spark.createDataFrame([], "statement_ref string, invoice_number string, allocated_amount_paise bigint")
    out, _, _ = ledger.apply_reviews(results, allocations, actions, none, star.invoices(spark, d), star.payments(spark, d))
    return out.where("review_action is not null").select("statement_ref", "decision", "matched_amount_paise")


@query(DOMAIN + " SELECT payer_name_normalized AS normalized_alias, min(c.customer_id) AS customer_id FROM known k JOIN paid p ON k.statement_ref = 'UTR' || lpad(CAST(p.invoice_id AS VARCHAR), 12, '0') JOIN customers c ON c.customer_id = p.customer_id WHERE k.method = 'none' AND payer_name_normalized <> '' GROUP BY 1")
def alias_learning(spark, d):
    reviewed = star.payments(spark, d).select("statement_ref", "payer_name_normalized").join(star.truth(spark, d).select("statement_ref", "customer_id"), "statement_ref")
    return ledger.learn_aliases(reviewed, book.names(star.customers(spark, d)), book.alias_names(star.aliases(spark, d))).select("normalized_alias", "customer_id")


# --- reports


@query(DOMAIN + " SELECT c.customer_id, c.code, count(i.invoice_id) AS open_invoices, CAST(coalesce(sum(i.open_amount_paise), 0) AS BIGINT) AS open_paise FROM customers c LEFT JOIN items i USING (customer_id) GROUP BY 1, 2")
def customer_balances(spark, d):
    return metrics.customer_balances(star.customers(spark, d), star.invoices(spark, d)).select("customer_id", "code", "open_invoices", "open_paise")


@query(DOMAIN + " SELECT customer_id, legal_name FROM customers WHERE contains(lower(legal_name), 'traders') ORDER BY legal_name, customer_id LIMIT 50")
def customer_picker(spark, d):
    return metrics.find_customers(star.customers(spark, d), "traders").select("customer_id", "legal_name")


@query(DOMAIN + " SELECT invoice_number, due_date, open_amount_paise FROM items WHERE contains(invoice_number, '7') ORDER BY due_date, invoice_number LIMIT 50")
def open_invoice_picker(spark, d):
    return metrics.find_invoices(star.invoices(spark, d), None, "7").select("invoice_number", "due_date", "open_amount_paise")


@query(RESOLVED + " SELECT (SELECT count(*) FROM payments) AS credits, (SELECT CAST(sum(amount_paise) AS BIGINT) FROM payments) AS credit_paise, (SELECT count(*) FROM items) AS open_invoices, (SELECT CAST(sum(open_amount_paise) AS BIGINT) FROM invoices WHERE status IN ('open', 'partially_paid')) AS receivable_paise, (SELECT count(*) FROM customers) AS customers, (SELECT count(*) FROM decided) AS decided, (SELECT count(*) FROM decided WHERE decision = 'auto_applied') AS auto_applied")
def dashboard_metrics(spark, d):
    results, _ = ledger.decisions(_by_reference(spark, d))
    return metrics.dashboard(star.customers(spark, d), star.invoices(spark, d), star.payments(spark, d), results).select("credits", "credit_paise", "open_invoices", "receivable_paise", "customers", "decided", "auto_applied")


@query(RESOLVED + " SELECT statement_ref, value_date, decision FROM decided WHERE decision = 'needs_review' ORDER BY value_date DESC, statement_ref DESC LIMIT 20 OFFSET 10")
def review_queue_page(spark, d):
    results, _ = ledger.decisions(_by_reference(spark, d))
    return metrics.review_queue(results, star.payments(spark, d), decision="needs_review", offset=10, limit=20)[0].select("statement_ref", "value_date", "decision")


@query(DOMAIN + " SELECT statement_ref, CAST(sum(amount_paise) OVER (PARTITION BY payer_name_normalized ORDER BY value_date, statement_ref) AS BIGINT) AS running_paise FROM payments")
def running_balance(spark, d):
    return metrics.running_balance(star.payments(spark, d)).select("statement_ref", "running_paise")


# --- advice

_ADVICE = DOMAIN + """, adv AS (SELECT *, invoice_id % 4 AS layout FROM paid WHERE scenario <> 'no_matching_invoice' AND invoice_id % 20 < 11)"""


@query(_ADVICE + """ SELECT invoice_id AS remittance_id, 'INV' || invoice_id || (CASE WHEN scenario = 'bundled_multi' THEN ' ' || regexp_replace(next_number, '^INV-0*', 'INV') ELSE '' END) AS refs, CAST(CASE WHEN layout IN (1, 2) THEN claim_paise ELSE 0 END AS BIGINT) AS line_claim, CAST(CASE WHEN layout = 0 THEN claim_paise ELSE 0 END AS BIGINT) AS document_claim,
  CASE WHEN claim_paise > 0 AND layout IN (0, 1) THEN 'damage' WHEN claim_paise > 0 AND layout = 2 THEN 'unknown' END AS reason FROM adv""")
def extract_lines(spark, d):
    return extract.extract(star.remittances(spark, d)).select("remittance_id", F.array_join("references", " ").alias("refs"), F.col("line_deduction_paise").alias("line_claim"), F.col("document_deduction_paise").alias("document_claim"), F.col("claimed_reason").alias("reason"))


@query(_ADVICE + """ SELECT invoice_id AS remittance_id, CASE WHEN g <= 100 THEN 'ties' ELSE 'does_not_tie' END AS reconciliation, CAST(g AS BIGINT) AS gap_paise FROM (SELECT *, CASE WHEN layout = 0 THEN 0 WHEN layout IN (1, 2) THEN abs(open_amount_paise - claim_paise + (CASE WHEN scenario = 'bundled_multi' THEN next_open ELSE 0 END) - amount_paise)
  ELSE abs((CASE WHEN scenario = 'bundled_multi' THEN next_open ELSE 0 END) + amount_paise - amount_paise) END AS g FROM adv)""")
def reconcile_advice(spark, d):
    return extract.extract(star.remittances(spark, d)).select("remittance_id", "reconciliation", F.col("reconciliation_gap_paise").alias("gap_paise"))


@query()
def extraction_summary(spark, d):
    return extract.summary(extract.extract(star.remittances(spark, d)))


# --- the whole cascade, evaluation, ROI


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    advice = extract.advice_index(extract.extract(star.remittances(spark, d)))
    return cascade.match(star.payments(spark, d), _items(spark, d), book.names(star.customers(spark, d)), book.alias_names(star.aliases(spark, d)), advice)


def decided(spark: SparkSession, d: str) -> DataFrame:
    return score.score(outcomes(spark, d), DEFAULT.scoring)


@query()
def full_cascade(spark, d):
    return decided(spark, d).select("statement_ref", "strategy", "method", "decision", F.round("confidence", 6).alias("confidence"), F.size("candidates").alias("readings"), "reason_text")


@query()
def match_summary(spark, d):
    return metrics.match_summary(outcomes(spark, d))


_TRUE = """, want AS (SELECT 'UTR' || lpad(CAST(invoice_id AS VARCHAR), 12, '0') AS statement_ref, scenario, CASE scenario WHEN 'no_matching_invoice' THEN [] WHEN 'bundled_multi' THEN list_sort([invoice_number, next_number]) ELSE [invoice_number] END AS numbers, CASE WHEN scenario = 'bundled_multi' THEN open_amount_paise + next_open ELSE amount_paise END AS allocated FROM paid),
judged AS (SELECT d.*, w.scenario, CASE WHEN d.decision = 'unapplied' THEN (CASE WHEN len(w.numbers) = 0 THEN 'correctly_unapplied' ELSE 'missed' END) WHEN d.numbers = w.numbers AND abs((CASE WHEN d.shape = 'partial' THEN d.amount_paise ELSE least(d.total, d.amount_paise) END) - w.allocated) <= 100 THEN 'correct' ELSE 'wrong' END AS verdict FROM decided d JOIN want w USING (statement_ref))"""


def _judged(spark, d) -> DataFrame:
    return evaluate.compare(_by_reference(spark, d), star.truth(spark, d))


@query(RESOLVED + _TRUE + " SELECT statement_ref, scenario, verdict FROM judged")
def verdicts(spark, d):
    return _judged(spark, d).select("statement_ref", "scenario", "verdict")


@query(RESOLVED + _TRUE + " SELECT scenario, count(*) AS total, count(*) FILTER (decision = 'auto_applied') AS auto_applied, count(*) FILTER (verdict IN ('correct', 'correctly_unapplied')) AS correct, count(*) FILTER (decision = 'auto_applied' AND verdict NOT IN ('correct', 'correctly_unapplied')) AS auto_wrong FROM judged GROUP BY GROUPING SETS ((scenario), (shape))".replace("(scenario), (shape)", "(scenario), ()"))
def scenario_breakdown(spark, d):
    return evaluate.breakdown(_judged(spark, d)).select("scenario", "total", "auto_applied", "correct", "auto_wrong")


@query(RESOLVED + _TRUE + """, cuts AS (SELECT round(0.5 + 0.05 * i, 2) AS threshold FROM range(11) t(i)) SELECT CAST(threshold AS DECIMAL(4,2)) AS threshold, count(*) FILTER (round(c, 9) >= threshold) AS auto_applied, count(*) FILTER (round(c, 9) >= threshold AND verdict NOT IN ('correct', 'correctly_unapplied')) AS auto_wrong, count(*) FILTER (round(c, 9) < threshold AND round(c, 9) >= 0.45) AS review, CAST(coalesce(sum(amount_paise) FILTER (round(c, 9) >= threshold), 0) AS BIGINT) AS auto_value_paise FROM judged CROSS JOIN cuts GROUP BY 1""")
def threshold_sweep(spark, d):
    s = evaluate.sweep(_judged(spark, d), DEFAULT.scoring)
    return s.select(F.col("threshold").cast("decimal(4,2)").alias("threshold"), "auto_applied", "auto_wrong", "review", "auto_value_paise")


@query(RESOLVED + _TRUE + " SELECT statement_ref, amount_paise, scenario FROM judged WHERE decision = 'auto_applied' AND verdict NOT IN ('correct', 'correctly_unapplied') ORDER BY amount_paise DESC, statement_ref LIMIT 10")
def worst_errors(spark, d):
    return evaluate.worst_errors(_judged(spark, d)).select("statement_ref", "amount_paise", "scenario")


@query()
def evaluation_report(spark, d):
    return evaluate.report(evaluate.compare(decided(spark, d), star.truth(spark, d)))


@query()
def ablation(spark, d):
    return evaluate.ablation(outcomes(spark, d), star.truth(spark, d), DEFAULT.scoring)


# --- ingest and streams


@query(DOMAIN + " SELECT statement_ref, value_date, amount_paise, payer_name_normalized FROM payments WHERE amount_paise % 3 <> 0")
def ingest_idempotent(spark, d):
    p = star.payments(spark, d)
    raw = p.select(F.col("statement_ref").alias("UTR"), F.date_format("value_date", "dd/MM/yyyy").alias("Date"), M.paise_to_rupees(F.col("amount_paise")).cast("string").alias("Credit Amount"), F.col("payer_name_raw").alias("Remitter"), F.col("narration").alias("Description"))
    twice = raw.unionByName(raw.where("length(UTR) > 0"))
    return statements.load_statement(twice, p.where("amount_paise % 3 = 0").select("statement_ref"))[0].select("statement_ref", "value_date", "amount_paise", "payer_name_normalized")


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS credits, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS paise FROM events GROUP BY 1")
def credits_by_day(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("ts").alias("received_at"), F.expr("cast(round(value * 100) as bigint)").alias("amount_paise"))
    return ingest.credits_by_window(e).select(F.col("window.start").cast("date").alias("day"), "credits", "paise")


# --- the cascade's own tiers by amount, reviews of doubtful results, advice that was stored

_LEFT = RESOLVED + """, rest AS (SELECT k.statement_ref, k.amount_paise, k.value_date, coalesce(k.customer_id, CASE WHEN s.owners = 1 THEN s.owner END) AS customer_id FROM known k LEFT JOIN sets s USING (statement_ref)
  WHERE k.statement_ref NOT IN (SELECT statement_ref FROM settled WHERE shape IS NOT NULL)),
pool AS (SELECT * FROM (SELECT k.statement_ref, k.amount_paise, i.invoice_number AS num, i.open_amount_paise AS o, row_number() OVER (PARTITION BY k.statement_ref ORDER BY abs(i.due_date - k.value_date), i.invoice_number) AS pool_rank
  FROM rest k JOIN items i ON i.customer_id = k.customer_id AND i.invoice_date BETWEEN k.value_date - 210 AND k.value_date + 20) WHERE pool_rank <= 45),
hits AS (SELECT statement_ref, count(*) AS n, min(num) AS first_number FROM pool WHERE abs(o - amount_paise) <= 100 GROUP BY 1),
others AS (SELECT * FROM pool WHERE statement_ref NOT IN (SELECT statement_ref FROM hits)),
two AS (SELECT a.statement_ref, a.amount_paise, b.num AS last, a.o + b.o AS t FROM others a JOIN others b ON a.statement_ref = b.statement_ref AND a.num < b.num WHERE a.o + b.o <= a.amount_paise + 100),
three AS (SELECT a.statement_ref, a.amount_paise, b.num AS last, a.t + b.o AS t FROM two a JOIN others b ON a.statement_ref = b.statement_ref AND a.last < b.num WHERE a.t + b.o <= a.amount_paise + 100),
four AS (SELECT a.statement_ref, a.amount_paise, b.num AS last, a.t + b.o AS t FROM three a JOIN others b ON a.statement_ref = b.statement_ref AND a.last < b.num WHERE a.t + b.o <= a.amount_paise + 100),
five AS (SELECT a.statement_ref, a.amount_paise, b.num AS last, a.t + b.o AS t FROM four a JOIN others b ON a.statement_ref = b.statement_ref AND a.last < b.num WHERE a.t + b.o <= a.amount_paise + 100)"""


def _plain(spark: SparkSession, d: str) -> DataFrame:
    """The cascade without advice and similarity: references, then amounts."""
    return cascade.match(star.payments(spark, d), _items(spark, d), book.names(star.customers(spark, d)), book.alias_names(star.aliases(spark, d)), None, DEFAULT, fuzzy=False)


@query(_LEFT + " SELECT statement_ref, CAST(n AS BIGINT) AS readings, first_number FROM hits")
def cascade_by_amount(spark, d):
    first = F.get(F.get("candidates", F.lit(0))["allocations"], F.lit(0))["invoice_number"]
    return _plain(spark, d).where("strategy = 'amount_exact'").select("statement_ref", F.size("candidates").cast("bigint").alias("readings"), first.alias("first_number"))


#: The same where no narration names anything, so that amounts alone decide.
_MUTE = DOMAIN + ", rest AS (SELECT statement_ref, amount_paise, value_date, customer_id FROM known WHERE customer_id IS NOT NULL),\npool AS" + _LEFT.split("\npool AS", 1)[1]
_SETS = "(SELECT * FROM two UNION ALL SELECT * FROM three UNION ALL SELECT * FROM four UNION ALL SELECT * FROM five)"


def _mute(spark: SparkSession, d: str) -> DataFrame:
    """The cascade over payments whose narration says nothing."""
    payments = star.payments(spark, d).withColumn("normalized_narration", F.lit("NEFT PAYMENT RECEIVED"))
    return cascade.match(payments, _items(spark, d), book.names(star.customers(spark, d)), book.alias_names(star.aliases(spark, d)), None, DEFAULT, fuzzy=False)


@query(_MUTE + f" SELECT statement_ref, CAST(least(5, count(*)) AS BIGINT) AS readings FROM {_SETS} WHERE abs(t - amount_paise) <= 100 GROUP BY 1")
def cascade_by_sets(spark, d):
    return _mute(spark, d).where("strategy = 'subset_sum'").select("statement_ref", F.size("candidates").cast("bigint").alias("readings"))


@query(_MUTE + f""" SELECT statement_ref, CASE WHEN h.statement_ref IS NOT NULL THEN 'amount_exact' WHEN t.statement_ref IS NOT NULL THEN 'subset_sum' ELSE 'later' END AS tier FROM payments p LEFT JOIN hits h USING (statement_ref)
  LEFT JOIN (SELECT DISTINCT statement_ref FROM {_SETS} WHERE abs(t - amount_paise) <= 100) t USING (statement_ref)""")
def cascade_tiers(spark, d):
    tier = F.when(F.col("strategy").isin("amount_exact", "subset_sum"), F.col("strategy")).otherwise("later")
    return _mute(spark, d).select("statement_ref", tier.alias("tier"))


#: Sets of items in the order of a walk from the largest item down: their places, numbers and amounts.
_WALK = _MUTE.split(",\ntwo AS", 1)[0] + """, placed AS (SELECT *, row_number() OVER (PARTITION BY statement_ref ORDER BY o DESC, num) AS pos FROM others),
w1 AS (SELECT statement_ref, amount_paise, [pos] AS path, [num] AS nums, [o] AS opens, o AS t, pos AS last FROM placed),
""" + ",\n".join(f"""w{k} AS (SELECT a.statement_ref, a.amount_paise, list_append(path, b.pos) AS path, list_append(nums, b.num) AS nums, list_append(opens, b.o) AS opens, t + b.o AS t, b.pos AS last FROM w{k - 1} a JOIN placed b ON a.statement_ref = b.statement_ref AND a.last < b.pos
  WHERE t + b.o <= a.amount_paise + {'100' if k > 3 else 'greatest(100, least(floor(a.amount_paise * (15.0::DOUBLE / 85.0::DOUBLE)), 15000000))'})""" for k in range(2, 6)) + """,
tied AS (SELECT *, row_number() OVER (PARTITION BY statement_ref ORDER BY path) AS rn FROM (SELECT * FROM w2 UNION ALL SELECT * FROM w3 UNION ALL SELECT * FROM w4 UNION ALL SELECT * FROM w5) WHERE abs(t - amount_paise) <= 100),
near AS (SELECT *, row_number() OVER (PARTITION BY statement_ref ORDER BY path) AS rn, t - amount_paise AS gap FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3) x
  WHERE t BETWEEN amount_paise + 1 AND amount_paise + least(floor(amount_paise * (15.0::DOUBLE / 85.0::DOUBLE)), 15000000) AND statement_ref NOT IN (SELECT statement_ref FROM tied)),
borne AS (SELECT *, list_min(list_filter(opens, lambda x: x > gap)) AS bearer FROM near WHERE rn <= 3),
short AS (SELECT * FROM borne WHERE gap > 100 AND gap <= 15000000 AND gap::DOUBLE / bearer::DOUBLE * 100 BETWEEN 0.5 AND 15)"""


@query(_WALK + " SELECT statement_ref, CAST(rn AS INT) AS place, array_to_string(list_sort(nums), ' ') AS numbers FROM tied WHERE rn <= 5")
def subset_sets(spark, d):
    """Which sets of up to five items tie with a payment, the first five in the order of the search."""
    found = _mute(spark, d).where("strategy = 'subset_sum'").select("statement_ref", F.posexplode("candidates").alias("place", "c"))
    return found.select("statement_ref", (F.col("place") + 1).alias("place"), F.array_join(F.array_sort(F.transform("c.allocations", lambda a: a["invoice_number"])), " ").alias("numbers"))


@query(_WALK + " SELECT statement_ref, CAST(row_number() OVER (PARTITION BY statement_ref ORDER BY t, list_sort(nums)) AS INT) AS place, array_to_string(list_sort(nums), ' ') AS numbers, CAST(gap AS BIGINT) AS claim_paise, CAST(bearer AS BIGINT) AS bearer_paise FROM short")
def short_pay_sets(spark, d):
    """Which sets of up to three items a payment is short of by a believable claim, and who bears it, smallest total first."""
    found = _mute(spark, d).where("strategy = 'short_pay'").select("statement_ref", F.posexplode("candidates").alias("place", "c"))
    claim = F.get(F.filter("c.allocations", lambda a: a["deduction"] > 0), F.lit(0))
    return found.select("statement_ref", (F.col("place") + 1).alias("place"), F.array_join(F.array_sort(F.transform("c.allocations", lambda a: a["invoice_number"])), " ").alias("numbers"), claim["deduction"].alias("claim_paise"), claim["open_amount_paise"].alias("bearer_paise"))


_DOUBT = RESOLVED.replace("round(c, 9) >= 0.9 THEN", "round(c, 9) >= 0.97 THEN")
_PLACED = "(CASE WHEN shape = 'partial' THEN amount_paise ELSE least(total, amount_paise) END)"


def _doubtful(spark: SparkSession, d: str) -> DataFrame:
    """Decisions with a bar for automation that few clear, so that many wait for review."""
    rows = _by_reference(spark, d)
    return score.score(rows.select(*[c for c in cascade_columns if c in rows.columns]), dataclasses.replace(DEFAULT.scoring, auto_apply=0.97))


cascade_columns = ["statement_ref", "amount_paise", "value_date", "customer_id", "method", "identity_score", "matched_on", "references", "strategy", "candidates", "residual_paise", "trail", "pool_size", "subset_nodes", "subset_exhausted", "short_nodes", "short_exhausted", "advice_reconciled", "n_documents"]


def _reviewed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Results, allocations and errors after reviews of all doubtful results, and the actions."""
    results, allocations = ledger.decisions(_doubtful(spark, d).where("decision = 'needs_review'"))
    asked = F.expr("cast(substring(statement_ref, 4) as bigint) % 2")
    actions = results.select("statement_ref", F.when(asked == 0, "approve").otherwise("reject").alias("action"), F.lit("reviewer").alias("reviewer"), F.lit("").alias("note"), F.lit("2026-01-02").cast("timestamp").alias("at"))
    none = spark.createDataFrame([], "statement_ref string, invoice_number string, allocated_amount_paise bigint")
    return *ledger.apply_reviews(results, allocations, actions, none, star.invoices(spark, d), star.payments(spark, d)), actions


_EVEN = "CAST(substr(statement_ref, 4) AS BIGINT) % 2 = 0"


@query(_DOUBT + f" SELECT statement_ref, CASE WHEN {_EVEN} THEN 'manually_applied' ELSE 'unapplied' END AS decision, CAST(CASE WHEN {_EVEN} THEN {_PLACED} ELSE 0 END AS BIGINT) AS matched_amount_paise FROM decided WHERE decision = 'needs_review'")
def review_doubtful(spark, d):
    return _reviewed(spark, d)[0].select("statement_ref", "decision", "matched_amount_paise")


@query(_DOUBT + f" SELECT statement_ref AS entity_id, CASE WHEN {_EVEN} THEN 'review_approve' ELSE 'review_reject' END AS action, 'user:reviewer' AS actor, CASE WHEN {_EVEN} THEN 'manually_applied' ELSE 'unapplied' END AS decision FROM decided WHERE decision = 'needs_review'")
def review_audit(spark, d):
    results, _, _, actions = _reviewed(spark, d)
    return ledger.review_audit(results, actions).select("entity_id", "action", "actor", F.get_json_object("payload_after", "$.decision").alias("decision"))


@query(_DOUBT + f" SELECT statement_ref, CASE WHEN {_EVEN} THEN 'user:first' ELSE 'user:only' END AS actor, CAST(CASE WHEN {_EVEN} THEN 1 ELSE 0 END AS BIGINT) AS refused FROM decided WHERE decision = 'needs_review'")
def review_twice(spark, d):
    """Half of the doubtful results are approved twice: the first approval counts and is on record, the second is refused."""
    results, allocations = ledger.decisions(_doubtful(spark, d).where("decision = 'needs_review'"))
    even = F.expr("cast(substring(statement_ref, 4) as bigint) % 2 = 0")
    say = lambda who, day: results.select("statement_ref", F.lit("approve").alias("action"), who.alias("reviewer"), F.lit("").alias("note"), F.lit(day).cast("timestamp").alias("at"))
    actions = say(F.when(even, "first").otherwise("only"), "2026-01-02").unionByName(say(F.lit("second"), "2026-01-03").where(even))
    none = spark.createDataFrame([], "statement_ref string, invoice_number string, allocated_amount_paise bigint")
    after, _, errors = ledger.apply_reviews(results, allocations, actions, none, star.invoices(spark, d), star.payments(spark, d))
    rows = ledger.review_audit(after, actions).select(F.col("entity_id").alias("statement_ref"), "actor")
    return rows.join(errors.groupBy("statement_ref").agg(F.count("*").alias("refused")), "statement_ref", "left").select("statement_ref", "actor", F.coalesce("refused", F.lit(0)).cast("bigint").alias("refused"))


@query(RESOLVED + f" SELECT statement_ref AS entity_id, 'cash_posted' AS action, CAST({_PLACED} AS BIGINT) AS cash_applied_paise, CAST(greatest(CASE WHEN shape = 'partial' THEN 0 ELSE gap END, 0) AS BIGINT) AS deductions_booked_paise FROM decided WHERE decision = 'auto_applied'")
def posting_audit(spark, d):
    results, allocations = ledger.decisions(_by_reference(spark, d))
    rows = ledger.posting_audit(star.payments(spark, d), results, allocations)
    return rows.select("entity_id", "action", *(F.get_json_object("payload_after", f"$.{c}").cast("bigint").alias(c) for c in ("cash_applied_paise", "deductions_booked_paise")))


@query(RESOLVED + " SELECT statement_ref, unnest(numbers) AS invoice_number, CASE WHEN CAST(substr(statement_ref, 4) AS BIGINT) % 4 = 0 THEN 'kept and new' ELSE 'new' END AS origin FROM decided")
def replace_allocations(spark, d):
    scored = _by_reference(spark, d)
    (first, placed), (results, allocations) = ledger.decisions(scored, "first"), ledger.decisions(scored, "third")
    held = F.expr("cast(substring(statement_ref, 4) as bigint) % 4 = 0")
    old = first.withColumn("reviewed_at", F.when(held, F.lit("2026-01-01").cast("timestamp"))).unionByName(ledger.decisions(scored, "second")[0].where(held))
    placed = placed.withColumn("deduction_note", F.lit("old")).unionByName(ledger.decisions(scored, "second")[1].where(held).withColumn("deduction_note", F.lit("second")))
    both = ledger.replace_allocations(old, placed, results, allocations.withColumn("deduction_note", F.lit("new")))
    said = F.array_join(F.array_sort(F.collect_set("deduction_note")), " and ")
    return both.groupBy("statement_ref", "invoice_number").agg(F.regexp_replace(said, "new and old", "kept and new").alias("origin"))


@query(RESOLVED + " SELECT 'reference_exact' AS strategy, count(*) AS n FROM decided")
def strategy_counts(spark, d):
    return metrics.by_strategy(ledger.decisions(_by_reference(spark, d))[0])


_OTHER = _TRUE.replace("- w.allocated) <= 100", "- w.allocated - (CASE WHEN right(d.statement_ref, 1) IN ('0', '5') THEN 500000 ELSE 0 END)) <= 100")


def _other_truth(spark: SparkSession, d: str) -> DataFrame:
    """A key in which a fifth of the payments were placed elsewhere, so that decisions are wrong."""
    off = F.when(F.right("statement_ref", F.lit(1)).isin("0", "5"), 500_000).otherwise(0).cast("bigint")
    return star.truth(spark, d).withColumn("expected", F.transform("expected", lambda a, i: a.withField("allocated", a["allocated"] + F.when(i == 0, off).otherwise(0))))


def _judged_otherwise(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.compare(_by_reference(spark, d), _other_truth(spark, d))


@query(RESOLVED + _OTHER + " SELECT statement_ref, amount_paise, scenario FROM judged WHERE decision = 'auto_applied' AND verdict NOT IN ('correct', 'correctly_unapplied') ORDER BY amount_paise DESC, statement_ref LIMIT 10")
def costly_errors(spark, d):
    return evaluate.worst_errors(_judged_otherwise(spark, d)).select("statement_ref", "amount_paise", "scenario")


#: Confidence without one signal, whose weight the others share in proportion.
_WEIGHTS = {"reference_match": (0.34, "1.0"), "amount_match": (0.26, "v_amount"), "customer_identity": (0.18, "v_id"), "remittance_agreement": (0.14, None), "date_proximity": (0.08, "v_date")}


def _sql_without(left_out: str) -> str:
    own = [(w, v) for k, (w, v) in _WEIGHTS.items() if v and k != left_out]
    penalty = "(CASE WHEN n > 1 AND gap > 0 THEN 0.6 ELSE 1.0 END) * (CASE WHEN gap < 0 THEN 0.85 ELSE 1.0 END)"
    return f"SELECT '{left_out}' AS left_out, * EXCLUDE (c), ({' + '.join(f'{w} * {v}' for w, v in own)}) / {sum(w for w, _ in own)} * {penalty} AS c FROM confident"


_ABLATED = RESOLVED.split(",\ndecided AS", 1)[0] + ",\nvaried AS (" + " UNION ALL ".join(map(_sql_without, ["none", *_WEIGHTS])) + "),\ndecided AS" + RESOLVED.split(",\ndecided AS", 1)[1].replace("FROM confident", "FROM varied")


@query(_ABLATED + _OTHER + """ SELECT left_out, count(*) AS total, count(*) FILTER (decision = 'auto_applied') AS auto_applied, count(*) FILTER (decision = 'needs_review') AS needs_review, count(*) FILTER (verdict IN ('correct', 'correctly_unapplied')) AS correct,
  count(*) FILTER (decision = 'auto_applied' AND verdict NOT IN ('correct', 'correctly_unapplied')) AS auto_wrong, CAST(coalesce(sum(amount_paise) FILTER (decision = 'auto_applied'), 0) AS BIGINT) AS auto_value_paise FROM judged GROUP BY 1""")
def ablation_by_reference(spark, d):
    """What each signal is worth, where references settle, against the key with errors."""
    rows = _by_reference(spark, d)
    out = evaluate.ablation(rows.select(*[c for c in cascade_columns if c in rows.columns]), _other_truth(spark, d), DEFAULT.scoring)
    return out.select("left_out", "total", "auto_applied", "needs_review", "correct", "auto_wrong", "auto_value_paise")


@query(RESOLVED + _OTHER + """ SELECT count(*) AS total, count(*) FILTER (decision = 'auto_applied') AS auto_applied, count(*) FILTER (decision = 'needs_review') AS needs_review, count(*) FILTER (verdict = 'wrong') AS wrong, count(*) FILTER (verdict = 'missed') AS missed,
  count(*) FILTER (decision = 'needs_review' AND verdict IN ('correct', 'correctly_unapplied')) AS review_correct, CAST(coalesce(sum(amount_paise) FILTER (decision = 'auto_applied' AND verdict NOT IN ('correct', 'correctly_unapplied')), 0) AS BIGINT) AS auto_wrong_value_paise,
  CAST(round(count(*) FILTER (verdict IN ('correct', 'correctly_unapplied')) / count(*), 6) AS DECIMAL(9,6)) AS accuracy FROM judged""")
def report_by_reference(spark, d):
    """The headline row of an evaluation with errors in it."""
    r = evaluate.report(_judged_otherwise(spark, d))
    return r.select("total", "auto_applied", "needs_review", "wrong", "missed", "review_correct", "auto_wrong_value_paise", F.round("accuracy", 6).cast("decimal(9,6)").alias("accuracy"))


#: Savings at the rates of decided payments, at some precisions.
_ROI = """, rates AS (SELECT count(*) FILTER (decision = 'auto_applied')::DOUBLE / count(*) AS auto, count(*) FILTER (decision = 'needs_review')::DOUBLE / count(*) AS review, count(*) FILTER (decision = 'unapplied')::DOUBLE / count(*) AS unapplied,
  (count(*) FILTER (decision = 'auto_applied') - count(*) FILTER (decision = 'auto_applied' AND verdict NOT IN ('correct', 'correctly_unapplied')))::DOUBLE / count(*) FILTER (decision = 'auto_applied') AS own FROM judged),
months AS (SELECT auto, review * 26.666666666666668::DOUBLE + unapplied * 53.333333333333336::DOUBLE AS rem, unnest([{p}]) AS p FROM rates)
SELECT CAST(round(53.333333333333336::DOUBLE - rem, 6) AS DECIMAL(12,6)) AS hours_saved, CAST(round_even(53.333333333333336::DOUBLE * 600 * 100, 0) - round_even(rem * 600 * 100, 0) AS BIGINT) AS gross_saving_paise, CAST(round_even(auto * 800 * (1 - p) * 1800 * 100, 0) AS BIGINT) AS expected_error_cost_paise FROM months"""


def _saved(rows: DataFrame) -> DataFrame:
    return rows.select(F.round("hours_saved", 6).cast("decimal(12,6)").alias("hours_saved"), "gross_saving_paise", "expected_error_cost_paise")


def _measured(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.report(_judged_otherwise(spark, d)).select("auto_match_rate", "review_rate", "unapplied_rate", F.col("auto_precision").alias("precision"))


@query(RESOLVED + _OTHER + _ROI.replace("{p}", "own"), name="roi")
def roi_case(spark, d):
    return _saved(roi.outcome(_measured(spark, d), roi.Assumptions()))


@query(RESOLVED + _OTHER + _ROI.replace("{p}", "1.0::DOUBLE, 0.99::DOUBLE, 0.97::DOUBLE, 0.95::DOUBLE, 0.90::DOUBLE"))
def roi_sensitivity(spark, d):
    return _saved(roi.sensitivity(_measured(spark, d), roi.Assumptions()))


_PRECISION = "CAST(round(count(*) FILTER (decision = 'auto_applied' AND verdict IN ('correct', 'correctly_unapplied')) / count(*) FILTER (decision = 'auto_applied'), 6) AS DECIMAL(9,6))"


@query(RESOLVED + _OTHER + f" SELECT (SELECT count(*) FROM payments) AS credits, {_PRECISION} AS auto_precision FROM judged")
def dashboard_precision(spark, d):
    results, _ = ledger.decisions(_by_reference(spark, d))
    board = metrics.dashboard(star.customers(spark, d), star.invoices(spark, d), star.payments(spark, d), results, _judged_otherwise(spark, d))
    return board.select("credits", F.round("auto_precision", 6).cast("decimal(9,6)").alias("auto_precision"))


@query(RESOLVED + _OTHER + """, cuts AS (SELECT round(0.5 + 0.05 * i, 2) AS threshold FROM range(11) t(i)), rows AS (SELECT threshold, count(*) FILTER (round(c, 9) >= threshold) AS applied, count(*) FILTER (round(c, 9) >= threshold AND verdict NOT IN ('correct', 'correctly_unapplied')) AS wrong, count(*) AS n FROM judged, cuts GROUP BY 1)
SELECT CAST(threshold AS DECIMAL(4,2)) AS threshold, applied AS auto_applied, wrong AS auto_wrong FROM rows WHERE applied > 0 AND (applied - wrong) / applied >= 0.5 ORDER BY applied / n DESC, threshold LIMIT 1""")
def recommended_threshold(spark, d):
    best = evaluate.recommend(evaluate.sweep(_judged_otherwise(spark, d), DEFAULT.scoring), 0.5)
    return best.select(F.col("threshold").cast("decimal(4,2)").alias("threshold"), "auto_applied", "auto_wrong")


@query(RESOLVED + _OTHER + " SELECT scenario, count(*) AS total, count(*) FILTER (verdict = 'wrong') AS wrong, CAST(row_number() OVER (ORDER BY count(*) DESC, scenario) AS INT) AS place FROM judged GROUP BY scenario")
def scenario_order(spark, d):
    rows = reports.by_scenario(_judged_otherwise(spark, d))
    return rows.select("scenario", "total", "wrong", F.row_number().over(Window.orderBy(F.desc("total"), "scenario")).alias("place"))  # eight rows


@query(DOMAIN + ", names8 AS (SELECT unnest([" + _list([n for n, _ in star.SCENARIOS]) + "]) AS scenario) SELECT n.scenario, count(p.scenario) AS n FROM names8 n LEFT JOIN paid p ON p.scenario = n.scenario GROUP BY 1")
def scenario_counts(spark, d):
    return generate.scenario_counts(star.truth(spark, d))


@query(DOMAIN + """, bad AS (SELECT statement_ref, row_number() OVER (ORDER BY statement_ref) AS rn FROM payments WHERE amount_paise % 5 = 0)
SELECT CAST(rn - 1 AS INT) AS pos, statement_ref || ': the amount isn''t above 0 in whole paise' AS error FROM bad WHERE rn <= 25""")
def ingest_errors(spark, d):
    p = star.payments(spark, d)
    amount = F.when(F.col("amount_paise") % 5 == 0, "n/a").otherwise(M.paise_to_rupees(F.col("amount_paise")).cast("string"))
    raw = p.select(F.col("statement_ref").alias("UTR"), F.date_format("value_date", "yyyy-MM-dd").alias("Date"), amount.alias("Credit"), F.col("payer_name_raw").alias("Payer")).orderBy("UTR")
    summary = statements.load_statement(raw, p.where("false").select("statement_ref"))[2]
    return summary.select(F.posexplode("errors").alias("pos", "error"))


@query(_ADVICE + """ SELECT 'UTR' || lpad(CAST(invoice_id AS VARCHAR), 12, '0') AS statement_ref, invoice_id AS remittance_id, 'INV' || invoice_id || (CASE WHEN scenario = 'bundled_multi' THEN ' ' || regexp_replace(next_number, '^INV-0*', 'INV') ELSE '' END) AS refs,
  CASE WHEN claim_paise > 0 AND layout IN (0, 1) THEN 'damage' WHEN claim_paise > 0 AND layout = 2 THEN 'unknown' END AS reason FROM adv WHERE invoice_id % 7 <> 0""")
def stored_advice(spark, d):
    """Advice that was read, stored as JSON beside its document and rebuilt from there."""
    raw = star.remittances(spark, d).withColumns({"extraction_status": F.lit("pending"), "extraction_method": F.lit(None).cast("string"), "extraction_error": F.lit(None).cast("string"), "extracted_payload": F.lit(None).cast("string")})
    read = extract.extract(extract.with_credit(extract.pending(raw), star.payments(spark, d)))
    kept = extract.stored(raw, read)
    return extract.stored_advice(kept, star.payments(spark, d)).select("statement_ref", "remittance_id", F.array_join("references", " ").alias("refs"), F.col("claimed_reason").alias("reason"))


def scripted_model(asked: DataFrame) -> DataFrame:
    """Answers of a model that is right, never right, right when asked again, and not reached, by remittance_id."""
    good = F.concat(F.lit('```json\n{"lines": [{"invoice_reference": "Inv No. 00'), F.col("remittance_id").cast("string"), F.lit('", "gross_amount": "1,250.00", "deduction_amount": "250.00", "deduction_reason": "short supply"}]}\n```'))
    bad = F.lit('{"lines": [{"gross_amount": "12.00"}]}')
    again = F.col("prompt").contains("The last answer was rejected: lines.0.invoice_reference: missing")
    k = F.col("remittance_id") % 5
    return asked.select("remittance_id", F.when(k == 0, good).when(k == 1, bad).when((k == 2) & again, good).when(k == 2, bad).when(k == 3, "no JSON at all").alias("response"))


@query(_ADVICE + """ SELECT invoice_id AS remittance_id, CASE WHEN invoice_id % 5 IN (0, 2) THEN 'llm' ELSE 'regex_fallback' END AS method, CAST(CASE WHEN invoice_id % 5 IN (0, 4) THEN 1 ELSE 2 END AS INT) AS attempts,
  CASE WHEN invoice_id % 5 IN (0, 2) THEN 'INV' || invoice_id ELSE 'INV' || invoice_id || (CASE WHEN scenario = 'bundled_multi' THEN ' ' || regexp_replace(next_number, '^INV-0*', 'INV') ELSE '' END) END AS refs,
  CASE WHEN invoice_id % 5 IN (0, 2) THEN 100000 END AS paid_paise,
  CASE invoice_id % 5 WHEN 1 THEN 'two answers did not fit: lines.0.invoice_reference: missing' WHEN 2 THEN 'accepted on retry after: lines.0.invoice_reference: missing' WHEN 3 THEN 'two answers did not fit: the answer is not JSON' WHEN 4 THEN 'the model was not reached' END AS error FROM adv""")
def extract_with_model(spark, d):
    read = extract.extract_with(star.remittances(spark, d), scripted_model)
    paid = F.when(F.col("method") == "llm", F.get("lines", F.lit(0))["paid_amount_paise"].cast("int"))
    return read.select("remittance_id", "method", "attempts", F.array_join("references", " ").alias("refs"), paid.alias("paid_paise"), "error")


# --- payments planned for the open book: exact shares, disjoint runs of invoices

_SHARES = f"unnest([{_list(list(scenarios.SCENARIOS))}]) AS name, unnest([{', '.join(map(str, scenarios.SCENARIOS.values()))}]) AS w, unnest(range({len(scenarios.SCENARIOS)})) AS k"
_PLAN = DOMAIN + f""", in_row AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY invoice_date, invoice_number, invoice_id) AS place, count(*) OVER (PARTITION BY customer_id) AS n FROM items),
bring AS (SELECT invoice_id AS payment_id, customer_id, n, place // 3 AS turn FROM in_row WHERE place % 3 = 0),
counts AS (SELECT name, k, t * w // 100 + CASE WHEN row_number() OVER (ORDER BY t * w % 100 DESC, name DESC) <= t - sum(t * w // 100) OVER () THEN 1 ELSE 0 END AS c FROM (SELECT {_SHARES}), (SELECT count(*) AS t FROM bring)),
cuts AS (SELECT name, sum(c) OVER (ORDER BY k) - c AS lo, sum(c) OVER (ORDER BY k) AS hi FROM counts),
deal AS (SELECT *, row_number() OVER (ORDER BY md5(payment_id || ':deal'), payment_id) AS pl FROM bring),
said AS (SELECT d.*, c.name AS scenario, CASE WHEN name = 'bundled_multi' THEN 2 ELSE 1 END AS need, CASE WHEN name = 'bundled_multi' THEN CAST('0x' || substr(md5(payment_id || ':size'), 1, 8) AS BIGINT) % 4 ELSE 0 END AS more FROM deal d JOIN cuts c ON d.pl > c.lo AND d.pl <= c.hi),
spared AS (SELECT *, n - sum(need) OVER (PARTITION BY customer_id) AS spare, coalesce(sum(more) OVER (PARTITION BY customer_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given FROM said),
wanted AS (SELECT *, CASE WHEN scenario = 'no_matching_invoice' THEN 0 ELSE need + greatest(0, least(more, spare - given)) END AS wants FROM spared),
runs AS (SELECT *, coalesce(sum(wants) OVER (PARTITION BY customer_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS behind FROM wanted),
taken AS (SELECT r.payment_id, list(i.invoice_number ORDER BY i.place) AS numbers, CAST(sum(i.open_amount_paise) AS BIGINT) AS open_paise FROM runs r JOIN in_row i ON i.customer_id = r.customer_id AND i.place > r.behind AND i.place <= r.behind + r.wants GROUP BY 1),
planned AS (SELECT r.payment_id, r.customer_id, r.scenario, coalesce(t.numbers, []) AS numbers, coalesce(t.open_paise, 0) AS open_paise FROM runs r LEFT JOIN taken t USING (payment_id))"""


def _planned(spark: SparkSession, d: str) -> DataFrame:
    return scenarios.plan(_items(spark, d))


@query(_PLAN + " SELECT payment_id, scenario, array_to_string(numbers, ' ') AS numbers FROM planned")
def planned_payments(spark, d):
    return _planned(spark, d).select("payment_id", "scenario", F.array_join(F.transform("invoices", lambda i: i["invoice_number"]), " ").alias("numbers"))


@query(_PLAN + " SELECT scenario, count(*) AS payments, CAST(sum(len(numbers)) AS BIGINT) AS invoices, CAST(max(len(numbers)) AS INT) AS most, CAST((SELECT count(*) FROM (SELECT 1 FROM (SELECT unnest(numbers) AS x FROM planned) GROUP BY x HAVING count(*) > 1)) AS BIGINT) AS twice FROM planned GROUP BY 1")
def exclusive_use(spark, d):
    """How many invoices each scenario uses, and how many invoices any two payments share: none."""
    planned = _planned(spark, d)
    used = planned.select(F.explode("invoices.invoice_id").alias("x")).groupBy("x").agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("twice"))
    own = planned.groupBy("scenario").agg(F.count("*").alias("payments"), F.sum(F.size("invoices")).cast("bigint").alias("invoices"), F.max(F.size("invoices")).alias("most"))
    return own.join(F.broadcast(used))  # one row


_DRAW = "(CAST('0x' || substr(md5(payment_id || ':{salt}'), 1, 8) AS BIGINT) % {n})"
_REASON_DRAW = _DRAW.format(salt="reason", n=100)
_BELOW = [sum(list(scenarios.REASONS.values())[: i + 1]) for i in range(len(scenarios.REASONS))]
_CLAIMED = f"""{_PLAN}, claimed AS (SELECT *, CASE WHEN scenario = 'short_pay_deduction' THEN greatest(0, least(greatest(5000, open_paise * (2 + {_DRAW.format(salt='claim', n=11)}) // 100 // 5000 * 5000), open_paise - 100)) ELSE 0 END AS claim_paise FROM planned)
SELECT payment_id, CAST(claim_paise AS BIGINT) AS claim_paise, CASE WHEN claim_paise > 0 THEN (CASE {' '.join(f"WHEN {_REASON_DRAW} < {b} THEN '{r}'" for r, b in zip(scenarios.REASONS, _BELOW, strict=True))} END) END AS reason,
  CAST(CASE scenario WHEN 'no_matching_invoice' THEN 800000 + {_DRAW.format(salt='stray', n=94_200_001)} WHEN 'partial_payment' THEN open_paise * (25 + {_DRAW.format(salt='part', n=61)}) // 100 ELSE open_paise - claim_paise END AS BIGINT) AS amount_paise FROM claimed"""


@query(_CLAIMED)
def planned_claims(spark, d):
    """What each planned payment pays, holds back, and why."""
    return scenarios.amounts(_planned(spark, d)).select("payment_id", "claim_paise", "reason", "amount_paise")


# --- advice that names, conflicts, names nobody or does not reconcile

_DOCS = DOMAIN + """, asked AS (SELECT k.*, CAST(substr(statement_ref, 4) AS BIGINT) AS id FROM known k),
refs AS (SELECT statement_ref, id * 2 AS doc, id AS ref FROM asked WHERE id % 6 IN (0, 2, 4) UNION ALL SELECT statement_ref, id * 2 AS doc, id + 2 FROM asked WHERE id % 6 IN (1, 4)
  UNION ALL SELECT statement_ref, id * 2 + 1, id FROM asked WHERE id % 6 IN (1, 4) UNION ALL SELECT statement_ref, id * 2, id + 100000000 FROM asked WHERE id % 6 = 3),
read AS (SELECT statement_ref, doc, count(i.invoice_id) AS n, count(DISTINCT i.customer_id) AS owners, min(i.customer_id) AS owner, sum(i.open_amount_paise) AS total, list(i.open_amount_paise) AS opens, list(i.due_date) AS dues, list_sort(list(i.invoice_number)) AS numbers FROM refs r JOIN items i ON i.invoice_id = r.ref GROUP BY 1, 2),
first_named AS (SELECT r.statement_ref, arg_min(owner, doc) AS named FROM read r JOIN asked a USING (statement_ref) WHERE a.customer_id IS NULL AND owners = 1 GROUP BY 1),
mine AS (SELECT r.*, a.id, a.amount_paise, a.value_date, coalesce(a.customer_id, f.named) AS customer_id, CASE WHEN a.customer_id IS NULL THEN 'reference' ELSE a.method END AS method, total - a.amount_paise AS gap FROM read r JOIN asked a USING (statement_ref) LEFT JOIN first_named f USING (statement_ref)),
borne AS (SELECT *, list_min(list_filter(opens, lambda o: o > gap)) AS bearer, list_max(list_transform(dues, lambda x: abs(value_date - x))) AS worst FROM mine WHERE owners = 1 AND owner = customer_id),
fits AS (SELECT *, CASE WHEN abs(gap) <= 100 THEN 'exact' WHEN gap > 0 AND bearer IS NOT NULL AND gap <= 15000000 AND gap::DOUBLE / bearer::DOUBLE * 100 BETWEEN 0.5 AND 15 THEN 'short_pay' WHEN n = 1 AND gap > 100 THEN 'partial' END AS shape FROM borne),
guided AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY statement_ref ORDER BY doc) AS rn FROM fits WHERE shape IS NOT NULL) WHERE rn = 1),
sure AS (SELECT *, (0.34 + 0.26 * (CASE shape WHEN 'partial' THEN 0.7 WHEN 'short_pay' THEN 0.88 ELSE 1.0 END) + 0.18 * (CASE WHEN method = 'reference' THEN 0.9 ELSE 1.0 END) + 0.14 * (CASE WHEN id % 6 = 2 THEN 0.65 ELSE 1.0 END)
  + 0.08 * (CASE WHEN worst <= 35 THEN 1.0 WHEN worst >= 200 THEN 0.0 ELSE 1.0 - (worst - 35) / 165.0 END)) * (CASE WHEN id % 6 = 2 THEN 0.92 ELSE 1.0 END) * (CASE WHEN n > 1 AND gap > 0 THEN 0.6 ELSE 1.0 END) * (CASE WHEN gap < 0 THEN 0.85 ELSE 1.0 END) AS c FROM guided)
SELECT statement_ref, array_to_string(numbers, ' ') AS numbers, shape, method, CASE WHEN gap > 0 AND shape <> 'partial' THEN (CASE id % 6 WHEN 0 THEN 'pricing' WHEN 2 THEN 'freight' ELSE 'unknown' END) END AS reason, CAST(round(c, 6) AS DECIMAL(9,6)) AS confidence,
  CASE WHEN round(c, 9) >= 0.9 THEN 'auto_applied' WHEN round(c, 9) >= 0.45 THEN 'needs_review' ELSE 'unapplied' END AS decision FROM sure"""


def _advice_cases(spark: SparkSession, d: str) -> DataFrame:
    """Advice by payment: its own invoice, with a claim; another customer's first; its own, unreconciled; one that nobody has; its own beside
    another's, then alone; none."""
    p = star.payments(spark, d).select("statement_ref", F.expr("cast(substring(statement_ref, 4) as bigint)").alias("id"))
    k, own, other = F.col("id") % 6, F.col("id"), F.col("id") + 2
    first = F.when(k.isin(0, 2), F.array(own)).when(k == 1, F.array(other)).when(k == 3, F.array(own + 100_000_000)).when(k == 4, F.array(own, other))
    docs = F.array(F.struct((own * 2).alias("remittance_id"), first.alias("ids")), F.struct((own * 2 + 1).alias("remittance_id"), F.when(k.isin(1, 4), F.array(own)).alias("ids")))
    p = p.select("statement_ref", "id", F.explode(docs).alias("doc")).where("doc.ids is not null").select("statement_ref", "id", "doc.*")
    named = lambda i: F.concat(F.lit("INV"), i.cast("string"))
    none = F.lit(None).cast("bigint")
    claim = F.when(k == 0, 100).otherwise(0).cast("bigint")
    line = lambda i: F.struct(named(i).alias("invoice_reference"), named(i).alias("normalized_reference"), none.alias("gross_amount_paise"), none.alias("paid_amount_paise"), claim.alias("deduction_amount_paise"), F.when(k == 0, "pricing").alias("deduction_reason"), F.lit(None).cast("string").alias("deduction_note"))
    return p.select("remittance_id", "statement_ref", F.lit("mock").alias("method"), (k != 2).alias("reconciled"), F.transform("ids", named).alias("references"), F.transform("ids", line).cast(f"array<{extract.LINE}>").alias("lines"), F.when(k == 0, "promo").when(k == 2, "freight").alias("claimed_reason"))


@query(_DOCS)
def cascade_by_advice(spark, d):
    """What advice settles, its reasons, and how sure that is."""
    out = cascade.match(star.payments(spark, d), _items(spark, d), book.names(star.customers(spark, d)), book.alias_names(star.aliases(spark, d)), _advice_cases(spark, d), DEFAULT, fuzzy=False)
    out = score.score(out.where("strategy = 'remittance_guided'"), DEFAULT.scoring)
    first = F.get("candidates", F.lit(0))
    numbers = F.array_sort(F.transform(first["allocations"], lambda a: a["invoice_number"]))
    reason = F.get(F.filter(first["allocations"], lambda a: a["deduction"] > 0), F.lit(0))["reason"]
    return out.select("statement_ref", F.array_join(numbers, " ").alias("numbers"), first["shape"].alias("shape"), "method", reason.alias("reason"), F.round("confidence", 6).cast("decimal(9,6)").alias("confidence"), "decision")


@query(_DOCS.split(",\nread AS", 1)[0] + """ SELECT a.statement_ref, count(r.doc) AS documents FROM asked a LEFT JOIN (SELECT DISTINCT statement_ref, doc FROM refs WHERE doc % 9 BETWEEN 2 AND 7) r USING (statement_ref) GROUP BY 1""")
def held_credits(spark, d):
    """Credits with the advice that came from two days before them to three days after, some of it four days off."""
    pay = star.payments(spark, d)
    advice = _advice_cases(spark, d).join(pay.select("statement_ref", "value_date"), "statement_ref")
    advice = advice.withColumn("received_at", F.date_add("value_date", F.expr("cast(remittance_id % 9 - 4 as int)")).cast("timestamp"))
    held = late_advice.hold(pay.select("statement_ref", "amount_paise", "value_date", "payer_name_normalized", "normalized_narration"), advice.drop("value_date"))
    return held.select("statement_ref", F.size("documents").cast("bigint").alias("documents"))


@query(RESOLVED + """, learned AS (SELECT payer_name_normalized AS alias, min(c.customer_id) AS owner FROM known k JOIN paid p ON k.statement_ref = 'UTR' || lpad(CAST(p.invoice_id AS VARCHAR), 12, '0') JOIN customers c ON c.customer_id = p.customer_id WHERE k.method = 'none' AND payer_name_normalized <> '' AND p.customer_id % 2 = 0 GROUP BY 1)
SELECT k.statement_ref, l.alias IS NOT NULL AS again, CASE WHEN k.method <> 'none' THEN k.method WHEN l.alias IS NOT NULL THEN 'alias' WHEN s.owners = 1 THEN 'reference' ELSE 'none' END AS method, coalesce(k.customer_id, l.owner, CASE WHEN s.owners = 1 THEN s.owner END) AS customer_id
FROM known k LEFT JOIN learned l ON l.alias = k.payer_name_normalized AND k.method = 'none' LEFT JOIN sets s USING (statement_ref)""")
def rematch_learned(spark, d):
    """Half of the unknown payers become aliases; only their payments are matched again."""
    pay, names, aliases = star.payments(spark, d), book.names(star.customers(spark, d)), book.alias_names(star.aliases(spark, d))
    reviewed = pay.select("statement_ref", "payer_name_normalized").join(star.truth(spark, d).where("customer_id % 2 = 0").select("statement_ref", "customer_id"), "statement_ref")
    out = cascade.rematch(_plain(spark, d), pay, _items(spark, d), names, aliases, ledger.learn_aliases(reviewed, names, aliases), fuzzy=False)
    return out.select("statement_ref", "again", "method", "customer_id")


# --- reviews that reassign, summaries

_ASK = f"""{_DOUBT}, asked AS (SELECT d.*, CAST(substr(statement_ref, 4) AS BIGINT) % 6 AS k, i.open_amount_paise AS first_open FROM decided d JOIN items i ON i.invoice_number = d.numbers[1] WHERE decision = 'needs_review'),
said AS (SELECT *, CASE WHEN k = 1 THEN 'no such invoice' WHEN k = 2 THEN 'an invoice is named twice' WHEN k = 3 THEN 'an amount must be above 0' WHEN k = 4 THEN 'more than the invoice has open' WHEN k = 5 THEN 'no invoice is named' WHEN amount_paise < 100 THEN 'more than was received' END AS error FROM asked)
SELECT statement_ref, CASE WHEN error IS NULL THEN 'manually_applied' ELSE 'needs_review' END AS decision, CASE WHEN error IS NULL THEN 'manual' ELSE 'reference_exact' END AS strategy, CAST(CASE WHEN error IS NULL THEN 100 ELSE {_PLACED} END AS BIGINT) AS matched_amount_paise, error, CASE WHEN error IS NULL THEN numbers[1] ELSE array_to_string(numbers, ' ') END AS numbers FROM said"""


@query(_ASK)
def review_reassigned(spark, d):
    """Doubtful results reassigned to one rupee of their first invoice, and five ways in which that is refused."""
    results, allocations = ledger.decisions(_doubtful(spark, d).where("decision = 'needs_review'"))
    invoices, payments = star.invoices(spark, d), star.payments(spark, d)
    k = F.expr("cast(substring(statement_ref, 4) as bigint) % 6")
    first = allocations.groupBy("statement_ref").agg(F.min("invoice_number").alias("invoice_number")).join(invoices.select("invoice_number", "open_amount_paise"), "invoice_number")
    amount = F.when(k == 3, 0).when(k == 4, F.col("open_amount_paise") + 1).otherwise(100).cast("bigint")
    lines = first.where(k != 5).select("statement_ref", F.when(k == 1, "INV-none").otherwise(F.col("invoice_number")).alias("invoice_number"), amount.alias("allocated_amount_paise"))
    lines = lines.unionByName(lines.where(k == 2))
    actions = results.select("statement_ref", F.lit("reassign").alias("action"), F.lit("reviewer").alias("reviewer"), F.lit("").alias("note"), F.lit("2026-01-02").cast("timestamp").alias("at"))
    after, placed, errors = ledger.apply_reviews(results, allocations, actions, lines, invoices, payments)
    numbers = placed.groupBy("statement_ref").agg(F.array_join(F.array_sort(F.collect_list("invoice_number")), " ").alias("numbers"))
    return after.join(errors.select("statement_ref", "error"), "statement_ref", "left").join(numbers, "statement_ref", "left").select("statement_ref", "decision", "strategy", "matched_amount_paise", "error", "numbers")


_WHOLE = _WALK + """, whole AS (SELECT k.statement_ref, k.method, k.customer_id, CASE WHEN h.statement_ref IS NOT NULL THEN 'amount_exact' WHEN t.statement_ref IS NOT NULL THEN 'subset_sum' WHEN s.statement_ref IS NOT NULL THEN 'short_pay' ELSE 'none' END AS strategy,
  CASE WHEN h.statement_ref IS NOT NULL THEN h.n WHEN t.statement_ref IS NOT NULL THEN t.n ELSE coalesce(s.n, 0) END AS readings, coalesce(p.n, 0) AS pool FROM known k LEFT JOIN hits h USING (statement_ref)
  LEFT JOIN (SELECT statement_ref, count(*) AS n FROM tied WHERE rn <= 5 GROUP BY 1) t USING (statement_ref) LEFT JOIN (SELECT statement_ref, count(*) AS n FROM short GROUP BY 1) s USING (statement_ref) LEFT JOIN (SELECT statement_ref, count(*) AS n FROM pool GROUP BY 1) p USING (statement_ref))"""


@query(_WHOLE + """ SELECT strategy, method, count(*) AS n, count(*) FILTER (readings > 1) AS ambiguous, CAST(max(pool) AS INT) AS largest_pool FROM whole GROUP BY 1, 2""")
def match_summary_by_amount(spark, d):
    """Payments by strategy and identification where amounts alone decide, ties among them and the largest pool."""
    return metrics.match_summary(_mute(spark, d)).select("strategy", "method", "n", "ambiguous", "largest_pool")


@query(_WHOLE + " SELECT strategy, count(*) AS n FROM whole GROUP BY 1")
def strategy_counts_by_amount(spark, d):
    """Results by strategy where amounts alone decide."""
    return metrics.by_strategy(ledger.decisions(score.score(_mute(spark, d), DEFAULT.scoring))[0])


@query(_ADVICE + """, told AS (SELECT *, CASE WHEN layout = 0 THEN 0 WHEN layout IN (1, 2) THEN abs(open_amount_paise - claim_paise + (CASE WHEN scenario = 'bundled_multi' THEN next_open ELSE 0 END) - amount_paise) ELSE abs((CASE WHEN scenario = 'bundled_multi' THEN next_open ELSE 0 END)) END AS g FROM adv)
SELECT 'mock' AS method, count(*) AS documents, count(*) AS with_lines, count(*) FILTER (g <= 100) AS ties, count(*) FILTER (g > 100) AS does_not_tie, CAST(0 AS BIGINT) AS not_checked, CAST(round(count(*) FILTER (g <= 100) / count(*), 6) AS DECIMAL(9,6)) AS reconciled_rate FROM told""")
def extraction_counts(spark, d):
    """Documents by how they reconcile."""
    s = extract.summary(extract.extract(star.remittances(spark, d)))
    return s.select("method", "documents", "with_lines", "ties", "does_not_tie", "not_checked", F.round("reconciled_rate", 6).cast("decimal(9,6)").alias("reconciled_rate"))


@query(_WALK + """, given AS (SELECT k.statement_ref, k.method, k.value_date, CASE WHEN h.statement_ref IS NOT NULL THEN 'amount_exact' WHEN t.statement_ref IS NOT NULL THEN 'subset_sum' WHEN s.statement_ref IS NOT NULL THEN 'short_pay' END AS strategy,
  CASE WHEN h.statement_ref IS NOT NULL THEN h.n WHEN t.statement_ref IS NOT NULL THEN t.n ELSE s.n END AS readings, CASE WHEN h.statement_ref IS NOT NULL THEN [h.first_number] WHEN t.statement_ref IS NOT NULL THEN t.nums ELSE s.nums END AS nums,
  CASE WHEN h.statement_ref IS NOT NULL THEN i.open_amount_paise - k.amount_paise WHEN t.statement_ref IS NOT NULL THEN t.gap ELSE s.gap END AS gap
  FROM known k LEFT JOIN hits h USING (statement_ref) LEFT JOIN items i ON i.invoice_number = h.first_number
  LEFT JOIN (SELECT statement_ref, count(*) AS n, arg_min(nums, rn) AS nums, arg_min(t - amount_paise, rn) AS gap FROM tied WHERE rn <= 5 GROUP BY 1) t USING (statement_ref)
  LEFT JOIN (SELECT statement_ref, count(*) AS n, arg_min(nums, pl) AS nums, arg_min(gap, pl) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY statement_ref ORDER BY t, list_sort(nums)) AS pl FROM short) GROUP BY 1) s USING (statement_ref)),
dated AS (SELECT g.statement_ref, any_value(method) AS method, any_value(strategy) AS strategy, any_value(readings) AS readings, any_value(gap) AS gap, count(*) AS n, max(abs(g.value_date - i.due_date)) AS worst FROM (SELECT *, unnest(nums) AS num FROM given WHERE strategy IS NOT NULL) g JOIN items i ON i.invoice_number = g.num GROUP BY 1),
weighed AS (SELECT *, round((0.26 * (CASE strategy WHEN 'amount_exact' THEN 1.0 WHEN 'subset_sum' THEN 0.8 ELSE 0.55 END) + 0.18 + 0.08 * (CASE WHEN worst <= 35 THEN 1.0 WHEN worst >= 200 THEN 0.0 ELSE 1.0 - (worst - 35) / 165.0 END)) / 0.86, 12)
  * (CASE WHEN readings > 1 THEN 0.55 ELSE 1.0 END) * (CASE WHEN n > 1 AND gap > 0 THEN 0.6 ELSE 1.0 END) * (CASE WHEN gap < 0 THEN 0.85 ELSE 1.0 END) AS c FROM dated)
SELECT statement_ref, strategy, CAST(round(c, 6) AS DECIMAL(9,6)) AS confidence, concat_ws(' ', CASE WHEN readings > 1 THEN 'ambiguous' END, CASE WHEN n > 1 AND gap > 0 THEN 'guessed_claim_bearer' END, CASE WHEN gap < 0 THEN 'residual_cash' END) AS penalties FROM weighed""")
def confidence_by_amount(spark, d):
    """How sure amounts alone are: ties, guessed bearers and cash that is left all cost."""
    out = score.score(_mute(spark, d).where("strategy <> 'none'"), DEFAULT.scoring)
    return out.select("statement_ref", "strategy", F.round("confidence", 6).cast("decimal(9,6)").alias("confidence"), F.array_join(F.transform("penalties", lambda p: p["name"]), " ").alias("penalties"))


# --- the wire: one result with all that belongs to it, the queue's filters, which text is read


@query(RESOLVED + ", documents_of AS (SELECT 'UTR' || lpad(CAST(invoice_id AS VARCHAR), 12, '0') AS statement_ref FROM paid WHERE scenario <> 'no_matching_invoice' AND invoice_id % 20 < 11 AND invoice_id % 7 <> 0)" + f"""
SELECT d.statement_ref, d.decision, p.payer_name_raw, array_to_string(numbers, ' ') AS numbers, c.legal_name, CAST(n AS INT) AS lines, CAST({_PLACED.replace('amount_paise', 'd.amount_paise')} AS BIGINT) AS placed_paise, x.statement_ref IS NOT NULL AS has_advice
FROM decided d JOIN payments p USING (statement_ref) JOIN customers c ON c.customer_id = d.owner LEFT JOIN documents_of x USING (statement_ref)""")
def result_details(spark, d):
    """Each result with its payment, its invoices and their customer, and whether advice is linked to it."""
    results, allocations = ledger.decisions(_by_reference(spark, d))
    out = metrics.result_detail(results, star.payments(spark, d), allocations, star.invoices(spark, d), star.customers(spark, d), star.remittances(spark, d))
    first = F.get("allocations", F.lit(0))
    placed = F.aggregate("allocations", F.lit(0).cast("bigint"), lambda t, a: t + a["allocated_amount_paise"])
    numbers = F.array_join(F.transform("allocations", lambda a: a["invoice_number"]), " ")
    return out.select("statement_ref", "decision", "payer_name_raw", numbers.alias("numbers"), first["legal_name"].alias("legal_name"), F.size("allocations").alias("lines"), placed.alias("placed_paise"), F.col("advice_text").isNotNull().alias("has_advice"))


_DEDUCTED = "(shape <> 'partial' AND gap > 0)"


@query(RESOLVED + f""", page AS (SELECT d.statement_ref, d.value_date, {_DEDUCTED} AS cut FROM decided d JOIN payments p USING (statement_ref) WHERE decision = 'auto_applied' AND round(c, 4) BETWEEN 0.9 AND 0.9999 AND (contains(lower(payer_name_raw), 'traders') OR contains(lower(narration), 'traders') OR contains(lower(statement_ref), 'traders')))
SELECT 'narrowed' AS paging, statement_ref, (SELECT count(*) FROM page WHERE cut) AS total FROM (SELECT * FROM page WHERE cut ORDER BY value_date DESC, statement_ref DESC LIMIT 30) UNION ALL
SELECT 'legacy', statement_ref, (SELECT count(*) FROM page) FROM (SELECT * FROM page ORDER BY value_date DESC, statement_ref DESC LIMIT 30) WHERE cut""")
def queue_filters(spark, d):
    """The queue narrowed by decision, confidence, text and deduction; beside it the older paging, which looks for deductions on the page alone."""
    results, allocations = ledger.decisions(_by_reference(spark, d))
    ask = {"decision": "auto_applied", "least": 0.9, "most": 0.9999, "text": "Traders", "has_deduction": True, "limit": 30}
    out = None
    for name, legacy in (("narrowed", False), ("legacy", True)):
        page, total = metrics.review_queue(results, star.payments(spark, d), allocations, legacy_paging=legacy, **ask)
        one = page.join(F.broadcast(total)).select(F.lit(name).alias("paging"), "statement_ref", "total")  # total is one row
        out = one if out is None else out.unionByName(one)
    return out


@query(_ADVICE + " SELECT invoice_id AS remittance_id, CASE WHEN invoice_id % 3 = 0 THEN 'INV' || (invoice_id + 1) WHEN invoice_id % 3 = 1 AND invoice_id % 2 = 0 THEN '' ELSE 'stored' END AS said FROM adv")
def advice_text_preferred(spark, d):
    """Which text of a document is read: its file's, else the stored one, else none."""
    k = F.col("remittance_id")
    stored = star.remittances(spark, d).withColumn("raw_text", F.when((k % 3 == 1) & (k % 2 == 0), F.lit(None)).otherwise("stored").cast("string"))
    files = star.remittances(spark, d).where("remittance_id % 3 <> 2").select("source_filename", F.when(k % 3 == 0, F.concat(F.lit("INV"), (k + 1).cast("string"))).otherwise("  ").alias("raw_text"))
    return statements.with_text(stored, files).select("remittance_id", F.col("raw_text").alias("said"))
