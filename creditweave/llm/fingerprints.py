"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame functions only.

A text's fingerprint is a sum of vectors, so equal multisets of paragraphs have equal fingerprints in any order, and
adding or removing a paragraph adds or subtracts its vector. A paragraph's vector has two parts: 32 wide lanes modulo
2**32 (1,024 bits, expanded by seeds from two 64-bit hashes of the paragraph), which decide equality, and 128 narrow lanes that count
the set bits of two hashes of each piece of up to 8 words, two lanes of 32 bits in a long: no text that Spark can hold has
2**31 pieces. Read as +1 and -1 a bit, the narrow lanes' distance estimates how many pieces two texts do not share;
likeness() is taken from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

WIDE, SEEDS, LANE_BITS = 16, (0, 1), 32
#: Up to 8 words of one paragraph; possessive, so that it takes time in proportion to the text.
_PIECE = r"[^ \t\n\x0B\f\r]++(?:[ \t\x0B\f\r]++[^ \t\n\x0B\f\r]++){0,7}+"
_LANE = (1 << LANE_BITS) - 1
_BITS = 1 | 1 << LANE_BITS
FINGERPRINT = "struct<wide: array<bigint>, narrow: array<bigint>, pieces: bigint>"


def _paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda p: p != "")


def _hashes(parts: str, seed: int) -> Column:
    return F.transform(parts, lambda part: F.xxhash64(F.lit(seed), part))


def _sum(values: Column, part) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda total, x: total + part(x))


def add_fingerprint(df: DataFrame, text: str, to: str) -> DataFrame:
    """df with a column `to` of FINGERPRINT type for the text column; null and empty texts have the zero vector.

    Each step is a projection of its own, so that a hash is computed once for all lanes. A task holds the lines and pieces of
    one text at a time as arrays, some 200 bytes a piece."""
    names = [c for c in df.columns if c != to]
    whole = F.coalesce(text, F.lit(""))
    df = df.withColumns({"_p": _paragraphs(whole), "_q": F.regexp_extract_all(whole, F.lit(_PIECE), 0)})
    hashes = [_hashes("_p", s).alias(f"_w{s}") for s in (0, 1)]
    pieces = [_hashes("_q", s).alias(f"_h{s}") for s in SEEDS]
    df = df.select(*names, *hashes, *pieces)
    lane = F.lit(_LANE)
    wide = [_sum(F.col(f"_w{i}"), lambda x, s=s, half=half: F.shiftrightunsigned(F.xxhash64(F.lit(s), x), half).bitwiseAND(lane)).bitwiseAND(lane) for i in (0, 1) for s in range(WIDE // 2) for half in (0, 32)]
    narrow = [_sum(F.col(f"_h{s}"), lambda x, j=j: F.shiftrightunsigned(x, j).bitwiseAND(F.lit(_BITS))) for s in SEEDS for j in range(LANE_BITS)]
    return df.select(*names, F.struct(F.array(*wide).alias("wide"), F.array(*narrow).alias("narrow"), F.size(f"_h{SEEDS[0]}").cast("bigint").alias("pieces")).alias(to))


def add(a: Column, b: Column) -> Column:
    """The fingerprint of both texts' paragraphs together."""
    return _combine(a, b, 1)


def subtract(a: Column, b: Column) -> Column:
    """The fingerprint of a's paragraphs without b's, which a must hold."""
    return _combine(a, b, -1)


def _combine(a: Column, b: Column, sign: int) -> Column:
    wide = F.zip_with(a["wide"], b["wide"], lambda x, y: (x + y * sign).bitwiseAND(F.lit((1 << 32) - 1)))
    narrow = F.zip_with(a["narrow"], b["narrow"], lambda x, y: x + y * sign)
    return F.struct(wide.alias("wide"), narrow.alias("narrow"), (a["pieces"] + b["pieces"] * sign).alias("pieces"))


def as_text(f: Column) -> Column:
    """Hexadecimal lanes; equal for equal fingerprints."""
    return F.concat(
        F.array_join(F.transform(f["wide"], lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""), F.lit(":"),
        F.array_join(F.transform(f["narrow"], lambda x: F.lower(F.hex(x))), "."),
    )


def _signed(f: Column) -> Column:
    one = lambda x: (x * 2 - f["pieces"]).cast("double")
    return F.flatten(F.transform(f["narrow"], lambda x: F.array(one(x.bitwiseAND(F.lit(_LANE))), one(F.shiftrightunsigned(x, LANE_BITS)))))


def add_likeness(df: DataFrame, a: str, b: str, to: str) -> DataFrame:
    """df with `to`: 1 for equal fingerprints, else 1 - |a-b|**2 / (|a|**2 + |b|**2) of the narrow lanes, 0 at least;
    about the share of pieces in common, with a deviation of about 0.1. Two empty texts are alike (1)."""
    df = df.withColumn("_a", _signed(F.col(a))).withColumn("_b", _signed(F.col(b)))
    norm = lambda v: F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x)
    apart, size = norm(F.zip_with("_a", "_b", lambda x, y: x - y)), norm(F.col("_a")) + norm(F.col("_b"))
    near = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("_apart") / F.col("_size"))
    df = df.withColumns({"_apart": apart, "_size": size})
    return df.withColumn(to, F.when(F.col(a) == F.col(b), 1.0).when(F.col("_size") == 0, 0.0).otherwise(near)).drop("_a", "_b", "_apart", "_size")


def with_next(df: DataFrame, key: str, tie: str, carry: list[str], rows_a_bucket: int = 500) -> DataFrame:
    """df with next_<c> for each c of carry: the row of the next smaller key, and after the smallest the largest.

    Keys are cut at up to 1,000 quantiles, and each of those ranges evenly into buckets, so no task sorts the table: a
    window leads inside a bucket, and each bucket's last row takes the first one of the next bucket that has rows. Which
    bucket follows which is worked out from bucket numbers alone. Null keys count as smallest; equal keys follow one
    another by the column `tie`, a long, inside one bucket. No rows give none."""
    least = -(2**63)
    total = df.count()
    ids = df.select(F.coalesce(key, F.lit(least)).alias("k"))
    cells = min(1000, max(1, total // (4 * rows_a_bucket)))
    cuts = sorted({max(least, min(-least - 1, int(x))) for x in ids.approxQuantile("k", [i / cells for i in range(1, cells)], 0.0005)}) if total and cells > 1 else []
    df = df.withColumn("_k", F.coalesce(key, F.lit(least)))
    cell = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("_k"))) if cuts else F.lit(0)
    df = df.withColumn("_cell", cell)
    sub = F.lit(0).cast("bigint")
    if cuts:
        wide = [max(1, (b - a) * rows_a_bucket * (len(cuts) + 1) // total) for a, b in zip(cuts, cuts[1:], strict=False)]
        step = F.element_at(F.array(*map(F.lit, [wide[0] if wide else 1 << 62, *wide, wide[-1] if wide else 1 << 62])), F.col("_cell") + 1)
        base = F.element_at(F.array(*map(F.lit, [cuts[0], *cuts])), F.col("_cell") + 1)
        far = F.lit(1 << 62).cast("decimal(20,0)")  # the outer ranges have no end: what is far out shares a bucket
        sub = F.floor((F.col("_k").cast("decimal(20,0)") - base.cast("decimal(20,0)")) / step.cast("decimal(20,0)"))
        sub = F.greatest(F.least(sub.cast("decimal(21,0)"), far), -far).cast("bigint")
    df = df.withColumn("_sub", sub)
    inside = Window.partitionBy("_cell", "_sub").orderBy(F.desc("_k"), F.desc(tie))
    led = df.withColumns({f"_n_{c}": F.lead(F.struct(c)).over(inside) for c in carry} | {"_rn": F.row_number().over(inside)})
    heads = led.where("_rn = 1").select("_cell", "_sub", *(F.struct(c).alias(f"_h_{c}") for c in carry))
    across = Window.partitionBy("_cell").orderBy(F.desc("_sub"))
    places = df.select("_cell", "_sub").distinct()
    places = places.withColumns({"_s2": F.lead("_sub").over(across), "_rn": F.row_number().over(across)})
    every = Window.orderBy(F.desc("_cell"))  # a row for each cell, so 1,001 at most
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = places.where("_rn = 1").select("_cell", F.struct("_cell", "_sub").alias("_top"))
    tops = tops.select("_cell", F.coalesce(F.lead("_top").over(every), F.first("_top").over(whole)).alias("_top"))
    after = places.join(tops, "_cell").select("_cell", "_sub", F.when(F.col("_s2").isNotNull(), F.struct("_cell", F.col("_s2").alias("_sub"))).otherwise(F.col("_top")).alias("_to"))
    after = after.select(F.col("_cell").alias("_c"), F.col("_sub").alias("_s"), F.col("_to._cell").alias("_cell"), F.col("_to._sub").alias("_sub")).join(heads, ["_cell", "_sub"])
    after = after.select(F.col("_c").alias("_cell"), F.col("_s").alias("_sub"), *(F.col(f"_h_{c}").alias(f"_z_{c}") for c in carry))
    out = led.join(after, ["_cell", "_sub"], "left")
    kept = [c for c in df.columns if c not in ("_k", "_cell", "_sub")]
    return out.select(*kept, *(F.coalesce(f"_n_{c}", f"_z_{c}")[c].alias(f"next_{c}") for c in carry))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """For each document its fingerprint, that of its text edited at the end, and how near both and the next text are.

    The edited text has its last third replaced by as much of the next document's start (descending doc_id; after the
    last the first). Null texts count as empty; other columns of docs play no part. Rows that repeat an id follow one
    another by a hash of their texts; a null id is the smallest."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_order", F.xxhash64("text"))
    both = with_next(base, "doc_id", "_order", ["text"])
    both = both.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("_k", F.expr("n_chars div 3"))
    both = both.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - _k as int)), substring(next_text, 1, cast(_k as int)))"))
    both = add_fingerprint(both.select("doc_id", "_order", "n_chars", "text", "edited"), "text", "f")
    both = add_fingerprint(both.select("doc_id", "_order", "n_chars", "edited", F.sha2("edited", 256).alias("edited_sha256"), "f"), "edited", "e")
    both = add_likeness(both.drop("edited"), "f", "e", "near_edited")
    both = both.withColumn("edited_fingerprint", as_text(F.col("e"))).drop("e")
    both = durable(both, "fingerprints")  # from here on without texts
    both = add_likeness(with_next(both, "doc_id", "_order", ["f"]), "f", "next_f", "near_next")
    return both.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("f")).alias("fingerprint"), "edited_fingerprint", "near_edited", "near_next")
