"""Language identification with bit-sliced Bloom filters of byte n-grams.

Slot s of the filter is a mask with one bit a language; the masks of an n-gram's slots, ANDed, are all languages
that hold it. Popcounts by language, less the expected false positives, decide."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import bounded, crc_mod, slices, utf8

SIZES, PROBES = (3, 5), 2
_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes, with blanks for all that isn't a letter in ASCII."""
    buf, off = utf8(pc.utf8_lower(column.cast(pa.large_string())))
    return _PLAIN[buf], off


def grams(buf: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` consecutive bytes."""
    if len(buf) < size:
        return np.zeros(0, np.uint64)
    x = np.zeros(len(buf) - size + 1, np.uint64)
    for i in range(size):
        x = (x << np.uint64(8)) | buf[i : len(buf) - size + 1 + i]
    return words.mix(x * np.uint64(2 * size + 1))


def positions(off: np.ndarray, size: int, n: int) -> np.ndarray:
    """The row of each n-gram; -1 where it crosses into the next row."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    return np.where(row[: n or 0] == row[size - 1 :], row[: n or 0], -1) if n else np.zeros(0, np.int64)


@dataclass(frozen=True)
class LanguageFilter:
    languages: list[str]
    slots: np.ndarray  # (number of slots, words of mask)
    false_rate: np.ndarray

    def hits(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the n-grams found by language, and the n-grams in all."""
        rows, some, bits = len(off) - 1, len(self.languages), self.slots.dtype.itemsize * 8
        found, total = np.zeros((rows, some)), np.zeros(rows)
        top = np.uint64(64 - int(np.log2(len(self.slots))))
        for size in SIZES:
            h = grams(buf, size)
            row = positions(off, size, len(h))
            ok = row >= 0
            h, row = h[ok], row[ok]
            total += np.bincount(row, minlength=rows)
            mask = self.slots[h >> top]
            for _ in range(PROBES - 1):
                mask = mask & self.slots[words.mix(h) >> top]
            if mask.shape[1] == 1 and bits == 8:
                count = np.bincount(row * 256 + mask[:, 0], minlength=rows * 256).reshape(rows, 256)
                found += count @ ((np.arange(256)[:, None] >> np.arange(some)) & 1)
            else:
                for i in range(some):
                    found[:, i] += np.bincount(row, (mask[:, i // bits] >> np.array(i % bits, mask.dtype)) & np.array(1, mask.dtype), rows)
        return found, total

    def predict(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and a score from 0 to 1: its share of all corrected popcounts above the lowest."""
        found, total = self.hits(buf, off)
        fixed = np.clip((found - total[:, None] * self.false_rate) / np.maximum(1e-9, 1 - self.false_rate), 0, None)
        best = fixed.argmax(1)
        share = fixed[np.arange(len(best)), best] / np.maximum(fixed.sum(1), 1e-9)
        return best, np.clip(share, 0, 1)


def train(docs: DataFrame, sample: int = 12_000, least: int = 5, grams_a_language: int = 1_000_000, log_slots: int = 22) -> LanguageFilter:
    """Learns from text and lang of the documents whose crc32(doc_id) mod 4 is not 2: a hash sample of about `sample`.

    Every n-gram that a language has `least` times or more in the sample is in its filter, whatever other languages have it too:
    popcounts decide. The filter has about eight slots for each n-gram of the largest language, 2**log_slots at most; its false positives
    are known and corrected. A sample of very long texts could have more than `grams_a_language` of them: then the commonest count. Nulls
    are left out."""
    known = bounded(docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", 4) != 2)), "doc_id", sample)

    def count(batches):
        for batch in batches:
            langs = batch.column(1).to_pylist()
            buf, off = lowered(batch.column(0))
            for lang in sorted(set(langs)):
                found = []
                for i in (i for i, x in enumerate(langs) if x == lang):
                    found += [grams(buf[off[i] : off[i + 1]], s) for s in SIZES]
                g, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(n)], names=["lang", "g", "n"])

    seen = known.select("text", "lang").mapInArrow(count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    ranked = seen.where(F.col("n") >= least).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "g")))
    rows = ranked.where(F.col("k") <= grams_a_language).select("lang", "g").toPandas()
    languages = sorted(set(rows["lang"]))
    some = len(languages)
    kind, width = (np.uint8, 1) if some <= 8 else (np.uint64, -(-some // 64))
    largest = int(rows.groupby("lang").size().max()) if some else 0
    log_slots = min(log_slots, max(10, (8 * largest).bit_length()))
    slots = np.zeros((1 << log_slots, width), kind)
    top, bits = np.uint64(64 - log_slots), np.dtype(kind).itemsize * 8
    for i, lang in enumerate(languages):
        h = rows["g"][rows["lang"] == lang].to_numpy().view(np.uint64)
        for _ in range(PROBES):
            np.bitwise_or.at(slots[:, i // bits], (h >> top).astype(np.int64), np.array(1, kind) << np.array(i % bits, kind))
            h = words.mix(h)
    filled = np.array([((slots[:, i // bits] >> np.array(i % bits, kind)) & np.array(1, kind)).mean() for i in range(some)])
    return LanguageFilter(languages, slots, filled**PROBES)


def identify_language(docs: DataFrame, known: LanguageFilter, keep: list[str] | None = None) -> DataFrame:
    """docs (or its `keep` columns) with lang_pred and score. A null text, or one without a letter, is `und` with score 0;
    so is every text if no language was learned. Whole texts count, of any length."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(known)  # at most 2**log_slots masks
    place = names.index("text") if "text" in names else len(names)

    def run(batches):
        filt = shared.value
        for batch in batches:
            text = batch.column(place)
            letter = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            buf, off = lowered(text)
            for a, b in slices(off):
                pred, score = np.full(b - a, "und", object), np.zeros(b - a)
                if filt.languages:
                    best, s = filt.predict(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                    yes = letter[a:b]
                    pred[yes], score[yes] = np.array(filt.languages, object)[best[yes]], s[yes]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(names))), pa.array(pred, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), "lang_pred string, score double"])
    return docs.select(*(F.col(f"`{c}`") for c in names), *([] if "text" in names else ["text"])).mapInArrow(run, schema)
