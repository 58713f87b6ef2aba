"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are byte-class shares, word and line counts and repetition; trees are complete, so a forest is
three arrays and scoring is a numpy traversal of all trees at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import add_columns, bounded, crc_mod

CLASSES = ["upper", "lower", "digit", "blank", "newline", "stop", "comma", "bang", "mark", "bracket", "other", "high"]
_CLASS = np.full(256, 10, np.uint8)
for _k, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b" \t", b"\n\r", b".", b",;:", b"!?", b"#$%&*@|~^_=+/\\", b"()[]{}<>")):
    _CLASS[list(_bytes)] = _k
_CLASS[128:] = 11
FEATURES = [*(f"share_{c}" for c in CLASSES), "log_bytes", "log_words", "word_bytes", "short_words", "long_words", "distinct_words", "top_word", "log_lines", "distinct_lines", "words_a_line"]


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; an empty text has zeros."""
    n, size = len(off) - 1, np.diff(off)
    which = np.repeat(np.arange(n, dtype=np.int64) * len(CLASSES), size)
    share = np.bincount(which + _CLASS[buf], minlength=n * len(CLASSES)).reshape(n, -1)
    out = np.zeros((n, len(FEATURES)))
    out[:, : len(CLASSES)] = share / np.maximum(size, 1)[:, None]
    starts, ends, at = words.spans(buf, off)
    h, length = words.word_hashes(buf, starts, ends), ends - starts
    breaks = np.flatnonzero(buf == 10)
    line = np.searchsorted(breaks, off)
    runs = words.Runs(h)
    c = len(CLASSES)
    for i in range(n):
        a, b = at[i], at[i + 1]
        if a == b:
            out[i, c] = np.log1p(size[i])
            continue
        counts = np.unique(h[a:b], return_counts=True)[1]
        cut = np.searchsorted(starts[a:b], breaks[line[i] : line[i + 1]]) + a
        edges = np.unique(np.concatenate(([a], cut, [b])))
        lines = len(edges) - 1
        distinct = len(np.unique(runs.of(edges[:-1], edges[1:])))
        some = length[a:b]
        out[i, c:] = (np.log1p(size[i]), np.log1p(b - a), some.mean(), (some <= 2).mean(), (some >= 12).mean(), len(counts) / (b - a), counts.max() / (b - a), np.log1p(lines), distinct / lines, (b - a) / lines)
    return out


@dataclass(frozen=True)
class Forest:
    """base + sum over trees of the leaf that a row ends in; node i has the children 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        at = np.zeros((len(x), trees), np.int64)
        t, row = np.arange(trees), np.arange(len(x))[:, None]
        for _ in range(int(np.log2(inner + 1)) if trees else 0):
            at = 2 * at + 1 + (x[row, self.feature[t, at]] > self.threshold[t, at])
        z = self.base + (self.leaf[t, at - inner].sum(1) if trees else 0.0)
        return 1 / (1 + np.exp(-z * np.ones(len(x))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, least: int = 20, l2: float = 1.0) -> Forest:
    """Logistic gradient boosting on quantile bins. One class only, or no rows: a constant (0.5 without rows)."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base, inner = float(np.log(share / (1 - share))), 2**depth - 1
    if len(y) == 0 or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)  # bin b: cuts[b-1] < x <= cuts[b]
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    z = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, w, at = y - p, p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            gain, best_f, best_b = np.full(nodes, 1e-9), np.zeros(nodes, np.int64), np.full(nodes, -1)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                width = len(c) + 1
                key = (at - first) * width + binned[:, j]
                sums = [np.bincount(key, v, nodes * width).reshape(nodes, width).cumsum(1) for v in (g, w, np.ones(len(y)))]
                (gl, wl, nl), (ga, wa, na) = (s[:, :-1] for s in sums), (s[:, -1:] for s in sums)
                rise = gl**2 / (wl + l2) + (ga - gl) ** 2 / (wa - wl + l2) - ga**2 / (wa + l2)
                rise[(nl < least) | (na - nl < least)] = 0
                k = rise.argmax(1)
                up = rise[np.arange(nodes), k] > gain
                gain[up], best_f[up], best_b[up] = rise[np.arange(nodes), k][up], j, k[up]
            for i in np.flatnonzero(best_b >= 0):
                feature[t, first + i], threshold[t, first + i] = best_f[i], cuts[best_f[i]][best_b[i]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[t, at]] > threshold[t, at])
        gs, ws = (np.bincount(at - inner, v, inner + 1) for v in (g, w))
        leaf[t] = rate * gs / (ws + l2)
        z += leaf[t, at - inner]
    return Forest(feature, threshold, leaf, base)


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, held_out_mod: int = 5) -> Forest:
    """Fits on labelled documents with crc32(doc_id) mod held_out_mod <> 0: a hash sample of about `sample` of them.

    Rows with a null id or a null quality take no part; repeated rows count as often as they stand there."""
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & (crc_mod("doc_id", held_out_mod) != 0))
    marked = bounded(marked, "doc_id", sample)
    text = docs.select("doc_id", "text").join(marked, "doc_id")
    rows = add_columns(text, lambda: lambda buf, off: [list(statistics(buf, off))], [("x", "array<double>")], ["doc_id", "quality"]).orderBy("doc_id", "quality").collect()
    return fit(np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([r["quality"] for r in rows], float))


def score_quality(docs: DataFrame, forest: Forest, threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """docs (or its `keep` columns) with score (probability of label 1) and predicted (1 if score >= threshold).

    A null or empty text is scored from zero statistics; any order, repeats and extra columns are fine."""

    def make():
        def of(buf, off):
            s = forest.score(statistics(buf, off))
            return [s, (s >= threshold).astype(np.int32)]

        return of

    return add_columns(docs, make, [("score", "double"), ("predicted", "int")], keep)
