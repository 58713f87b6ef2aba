"""Substring deduplication by De Bruijn compaction.

The edges of the graph are windows of 20 words. Consecutive windows with the same minimizer (the least hash of the
4-word runs inside) form one path; equal text cuts itself into equal paths, so a path is known by its minimizer and the hash
of all its words. A shuffle by path counts where each one stands and what follows it: a path with one successor that stands
as often as itself has an edge that does not branch. A join takes the repeated paths to their source, the first document
that holds them, where nonbranching ones follow each other, and so one join compacts a chain of any length: its head, its
number of words and a digest (BLAKE2) of the words at the source coordinates are what other documents are told. Each of
them holds its own words at its own coordinates against that digest before anything goes. Where several paths branch from a
minimizer, as at both ends of a passage, their windows are told apart one by one, each known by the digest of its words."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import drop, durable, lists, slices, utf8

WINDOW, ANCHOR = 20, 4


class Paths:
    """The compacted paths of a slice of texts: windows [first, last] of each, its row, minimizer and hash."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR):
        self.starts, self.ends, self.at = words.spans(buf, off)
        self.runs = words.Runs(words.word_hashes(buf, self.starts, self.ends))
        self.window, n, rows = window, len(self.starts), len(off) - 1
        m = max(0, n - window + 1)
        row = np.repeat(np.arange(rows), np.diff(self.at))
        inside = row[:m] == row[window - 1 :] if m else np.zeros(0, bool)
        least, width, size = self.runs.every(anchor), 1, window - anchor + 1
        while 2 * width <= size:  # minima of 1, 2, 4 ... runs, then of `size`
            least = np.minimum(least[: len(least) - width], least[width:]) if len(least) > width else least[:0]
            width *= 2
        least = np.minimum(least[:m], least[size - width : size - width + m])
        new = inside.copy()
        if m > 1:
            new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1] | (row[1:m] != row[: m - 1])
        stop = inside.copy()
        if m > 1:
            stop[:-1] &= (least[1:] != least[:-1]) | ~inside[1:] | (row[1:m] != row[: m - 1])
        self.first, self.last = np.flatnonzero(new), np.flatnonzero(stop)
        self.row, self.minimizer = row[self.first], least[self.first]
        self.hash = self.runs.of(self.first, self.last + window)
        self.offsets = np.searchsorted(self.row, np.arange(rows + 1))
        self.text = memoryview(joined(buf, self.starts, self.ends))
        self.place = np.concatenate(([0], np.cumsum(self.ends - self.starts + 1)))

    def after(self) -> np.ndarray:
        """The hash of the path that follows each one in its text, 0 behind the last."""
        out = np.zeros(len(self.hash), np.uint64)
        if len(out) > 1:
            out[:-1] = np.where(self.row[1:] == self.row[:-1], self.hash[1:], 0)
        return out

    def digests(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64 bits of a digest of the words [start, end) themselves, joined by a space."""
        found = [hashlib.blake2b(self.text[i:j], digest_size=8).digest() for i, j in zip(self.place[start].tolist(), (self.place[end] - 1).tolist())]
        return np.frombuffer(b"".join(found), np.uint64)

    def windows(self, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All windows of these paths: start words and minimizers."""
        size = self.last[paths] - self.first[paths] + 1
        start = np.repeat(self.first[paths] - np.concatenate(([0], size.cumsum()[:-1])), size) + np.arange(size.sum())
        return start, np.repeat(self.minimizer[paths], size)

    def spans(self, lo: int, hi: int, stop: int, head: np.ndarray, size: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words [start, end) of the paths [lo, hi), before word `stop`, that begin with a head and have its size and digest."""
        order = np.argsort(self.hash[lo:hi], kind="stable") + lo
        known = self.hash[order]
        first, times = np.searchsorted(known, head), np.searchsorted(known, head, "right") - np.searchsorted(known, head)
        which = np.repeat(np.arange(len(head)), times)
        start = self.first[order[np.arange(len(which)) - np.repeat(times.cumsum() - times, times) + first[which]]]
        end = start + size[which].astype(np.int64)
        fits = end <= stop
        start, end, which = start[fits], end[fits], which[fits]
        same = self.digests(start, end) == digest[which]
        return start[same], end[same]


def _longs(values: pa.Scalar) -> np.ndarray:
    """A row of a list column; null counts as empty."""
    return values.values.to_numpy(zero_copy_only=False).view(np.uint64) if values.is_valid else np.zeros(0, np.uint64)


def _member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _again(x: np.ndarray) -> np.ndarray:
    """True where the value stands earlier in x."""
    out = np.ones(len(x), bool)
    out[np.unique(x, return_index=True)[1]] = False
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """docs (or its `keep` columns) with n_words, n_removed, kept_sha256 and kept (the text that is left: the kept
    words joined by a space; null where nothing was removed).

    A word goes if a window of `window` words over it also starts earlier: in a smaller doc_id, or earlier in the same
    document. Null and empty texts have no words; texts of fewer words than a window lose none. Rows with a null
    doc_id come first. Rows that repeat a doc_id count as one document's copies: each is judged against smaller ids and
    against itself. Columns of docs named like a result are replaced. No rows give none. Paths meet by hashes, but words go
    only where a digest of the words themselves agrees with that of their source; inside one document, windows are compared by hash."""
    results = ("n_words", "n_removed", "kept_sha256", "kept")
    names = [c for c in (docs.columns if keep is None else keep) if c not in results]
    base = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"), F.col("text").alias("_text"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"))

    def cut(batches):
        for batch in batches:
            buf, off = utf8(batch.column(1))
            for a, b in slices(off):
                p = Paths(buf[off[a] : off[b]], off[a : b + 1] - off[a], window)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(lists(x, p.offsets) for x in (p.minimizer, p.hash, p.after()))], names=["_id", "g", "h", "after"])

    found = base.select("_id", "_text").mapInArrow(cut, "_id long, g array<long>, h array<long>, after array<long>")
    found = found.select("_id", F.explode(F.arrays_zip("g", "h", "after")).alias("p")).select("_id", "p.*")
    counted = found.groupBy("g", "h").agg(F.min("_id").alias("first"), F.max("_id").alias("last"), F.count("*").alias("n"), F.min("after").alias("after"), F.max("after").alias("other"))
    alone = F.when((F.col("first") < F.col("last")) & (F.col("after") == F.col("other")), F.col("after"))
    paths = durable(counted.select("g", "h", "first", F.when(F.col("first") < F.col("last"), F.col("n")).alias("n"), alone.alias("after")), "paths")
    branching = paths.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g", F.lit(True).alias("branch"))
    asked = paths.join(branching, "g", "left").where("branch or n is not null")
    asked = asked.groupBy(F.col("first").alias("_id")).agg(F.collect_list(F.struct("h", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("after", F.lit(0)).alias("after"), F.coalesce(F.col("branch").cast("long"), F.lit(0)).alias("branch"))).alias("p"))

    def tell(batches):
        for batch in batches:
            buf, off = utf8(batch.column(1))
            for a, b in slices(off):
                p = Paths(buf[off[a] : off[b]], off[a : b + 1] - off[a], window)
                edges, chains, sizes, counts = [], [], [0], [0]
                for i in range(b - a):
                    lo, hi = p.offsets[i], p.offsets[i + 1]
                    h, n, after, branch = (_longs(batch.column(c)[a + i]) for c in range(2, 6))
                    order = np.argsort(h)
                    h, n, after, branch = h[order], n[order], after[order], branch[order]
                    mine = np.flatnonzero(_member(p.hash[lo:hi], h)) + lo
                    mine = mine[np.unique(p.hash[mine], return_index=True)[1]]
                    at = np.searchsorted(h, p.hash[mine])
                    start, minimizer = p.windows(mine[branch[at] > 0])
                    w, one = np.unique(p.digests(start, start + window), return_index=True)
                    edges.append((minimizer[one], w))
                    sizes.append(len(w))
                    order = np.argsort(mine)
                    mine, at = mine[order][n[at[order]] > 0], at[order][n[at[order]] > 0]
                    linked = (mine[1:] == mine[:-1] + 1) & (after[at[:-1]] == p.hash[mine[1:]]) & (n[at[:-1]] == n[at[1:]])
                    head = np.flatnonzero(np.concatenate(([True], ~linked))) if len(mine) else mine
                    tail = np.concatenate((head[1:], [len(mine)]))[: len(head)] - 1
                    start, end = p.first[mine[head]], p.last[mine[tail]] + window
                    chains.append((p.minimizer[mine[head]], p.hash[mine[head]], (end - start).astype(np.uint64), p.digests(start, end)))
                    counts.append(len(head))
                columns = [lists(np.concatenate(x), np.cumsum(sizes)) for x in zip(*edges)] + [lists(np.concatenate(x), np.cumsum(counts)) for x in zip(*chains)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=["_id", "g", "w", "minimizer", "head", "size", "digest"])

    told = base.select("_id", "_text").join(asked, "_id").select("_id", "_text", *(F.col(f"p.{c}").alias(c) for c in ("h", "n", "after", "branch")))
    told = durable(told.mapInArrow(tell, "_id long, g array<long>, w array<long>, minimizer array<long>, head array<long>, size array<long>, digest array<long>"), "sources")
    edges = told.select("_id", F.explode(F.arrays_zip("g", "w")).alias("e")).select("_id", "e.g", "e.w")
    first = edges.groupBy("g", "w").agg(F.min("_id").alias("first"), F.max("_id").alias("last")).where("first < last").select("g", "w", "first")
    later = edges.join(first, ["g", "w"]).where("_id > first").groupBy("_id").agg(F.collect_set("g").alias("g"), F.collect_set("w").alias("w"))
    chains = told.select(F.col("_id").alias("source"), F.explode(F.arrays_zip("minimizer", "head", "size", "digest")).alias("c")).select("source", F.col("c.minimizer").alias("g"), F.col("c.head").alias("h"), "c.size", "c.digest")
    known = found.select("_id", "g", "h").join(chains, ["g", "h"]).where("_id > source").groupBy("_id").agg(F.collect_set(F.struct("h", "size", "digest")).alias("c"))
    gone = durable(later.join(known, "_id", "full").select("_id", "g", "w", F.col("c.h").alias("h"), F.col("c.size").alias("size"), F.col("c.digest").alias("digest")), "gone")
    drop(paths)
    drop(told)

    def judge(batches):
        for batch in batches:
            buf, off = utf8(batch.column(1))
            for a, b in slices(off):
                piece = buf[off[a] : off[b]]
                p = Paths(piece, off[a : b + 1] - off[a], window)
                n_words, n_removed, sha, kept = np.diff(p.at), [], [], []
                for i in range(b - a):
                    lo, hi, w0, w1 = p.offsets[i], p.offsets[i + 1], p.at[i], p.at[i + 1]
                    g, w, head, size, digest = (_longs(batch.column(c)[a + i]) for c in range(2, 7))
                    start, _ = p.windows(np.arange(lo, hi))
                    again = start[_again(p.runs.of(start, start + window))]
                    at, _ = p.windows(np.flatnonzero(_member(p.minimizer[lo:hi], np.sort(g))) + lo)
                    at = at[_member(p.digests(at, at + window), np.sort(w))]
                    place, end = p.spans(lo, hi, w1, head, size, digest)
                    cover = np.zeros(w1 - w0 + 1, np.int32)
                    for begin, stop in ((again, again + window), (at, at + window), (place, end)):
                        np.add.at(cover, begin - w0, 1)
                        np.add.at(cover, stop - w0, -1)
                    stay = np.flatnonzero(cover.cumsum()[: w1 - w0] == 0) + w0
                    text = joined(piece, p.starts[stay], p.ends[stay])
                    n_removed.append(w1 - w0 - len(stay))
                    sha.append(hashlib.sha256(text).hexdigest())
                    kept.append(text.decode() if len(stay) < w1 - w0 else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n_words.astype(np.int64)), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], names=["_row", *results])

    row = base.schema["_row"].dataType.simpleString()
    out = base.join(gone, "_id", "left").select("_row", "_text", "g", "w", "h", "size", "digest").mapInArrow(judge, f"_row {row}, n_words long, n_removed long, kept_sha256 string, kept string")
    return out.select("_row.*", *results)


def joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """These words, joined by a space."""
    if not len(starts):
        return b""
    size = ends - starts + 1
    place = np.repeat(starts - np.concatenate(([0], size.cumsum()[:-1])), size) + np.arange(size.sum())
    out = np.full(len(place), 0x20, np.uint8)
    real = np.ones(len(place), bool)
    real[size.cumsum() - 1] = False
    out[real] = buf[place[real]]
    return out[:-1].tobytes()
