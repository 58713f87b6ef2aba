"""Spelling variants: words of one edit, by a trie self-join with active-node sets.

The vocabulary's trie is partitioned by prefix: two words at distance one agree before their first difference and, read
backwards, after it. So a word stands in subtrees of the trie and of its mirror: in those of its length, and of a length one less (as the
longer word of a pair), with the half before or the half after the edit as their prefix. Inside a subtree the set of nodes
within distance one of a node follows from its parent's set, and words that end in such nodes are pairs. Each pair is given
by one subtree only, that of its common prefix. Subtrees of many words are partitioned again by a quarter, an eighth ..."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, durable

#: Words of a subtree before it is partitioned again; different words that a task counts before it passes them on.
GROUP, COUNTED = 5000, 200_000
# The letters of a word, once A-Z are lower-cased.
LETTERS = "[a-zÀ-ÿ]"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def vocabulary(docs: DataFrame, shortest: int = 5, least: int = 3, slip: int = 97) -> DataFrame:
    """(word, n): the words of at least `shortest` code points that whole texts hold `least` times or more.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, of which A-Z are lower-cased. Where `slip` divides the crc32 h of
    `<doc_id>:<word>`, the word loses its code point h modulo its length there (0: never; nor in rows with a null doc_id).
    Null and empty texts have no words; repeated rows count each; no rows give none. Counts are begun before rows move."""
    runs = re.compile(f"{LETTERS}{{{shortest},}}")

    def count(batches):
        seen: dict[str, int] = {}

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own: dict[str, int] = {}
                for word in runs.findall((text.as_py() or "").encode().translate(_LOWER).decode()):
                    own[word] = own.get(word, 0) + 1
                start = zlib.crc32(f"{doc_id}:".encode())
                for word, n in own.items():
                    if slip and doc_id is not None and not (h := zlib.crc32(word.encode(), start)) % slip:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < shortest:
                            continue
                    seen[word] = seen.get(word, 0) + n
                if len(seen) >= COUNTED:
                    yield rows()
        yield rows()

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Trie:
    """The words of a subtree by what is left of them; node 0 is the root."""

    def __init__(self, rests: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.word, self.below = [-1], [len(rests)]  # the word that ends in a node; how many end in or under it
        for i, rest in enumerate(rests):
            at = 0
            for c in rest:
                after = self.children[at].get(c)
                if after is None:
                    after = len(self.children)
                    self.children[at][c] = after
                    self.children.append({})
                    self.word.append(-1)
                    self.below.append(0)
                at = after
                self.below[at] += 1
            self.word[at] = i

    def pairs(self) -> list[tuple[int, int]]:
        """All i < j whose words are at distance one.

        near holds the nodes at distance one of a node (itself is at 0): its parent (a letter is deleted), its siblings (replaced),
        its children (inserted), and of its parent's near ones the children by its own letter."""
        children, word, below, out = self.children, self.word, self.below, []
        stack = [(0, list(children[0].values()))]
        if word[0] >= 0:
            out += [tuple(sorted((word[0], word[v]))) for v in children[0].values() if word[v] >= 0 and word[v] > word[0]]
        while stack:
            at, near = stack.pop()
            own = children[at]
            for c, node in own.items():
                under = children[node]
                found = {v[c] for v in map(children.__getitem__, near) if c in v}
                found.update(own.values(), under.values())
                found.discard(node)
                found.add(at)
                i = word[node]
                if i >= 0:
                    out += [(i, j) for j in map(word.__getitem__, found) if j > i]
                # A single word, whose near nodes are its own: nothing can join them further down.
                if under and (below[node] > 1 or below[at] > 1 or len(found) > 2):
                    stack.append((node, list(found)))
        return out


def _cut(words: DataFrame, of: Column) -> DataFrame:
    """Each row of words for each half of its window [lo, hi), in which the edit may begin, that holds a letter."""
    half = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    window = F.explode(F.filter(F.array(F.struct(F.col("lo").alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), F.col("hi").alias("hi"))), lambda w: w["lo"] < w["hi"]))
    out = words.select("word", "n", "size", window.alias("w")).select("word", "n", "size", "w.lo", "w.hi")
    return out.withColumns({"head": F.substring(F.col("word"), F.lit(1), F.col("lo")), "tail": F.expr("right(word, size - hi)")})


_KEY = ["size", "lo", "hi", "head", "tail"]


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, n, near, near_n): of distinct words (word, n) each ordered pair that differs by exactly one inserted, deleted or replaced
    code point, once. Null and empty words have no pairs; no words give none. Words are whole keys, so nothing is told apart by hashes.

    A subtree has `group` words at most, or, where one letter is all that its words differ in, at most as many as the alphabet gives."""
    length = F.char_length("word")
    both = words.where("word <> ''").select("word", "n", F.explode(F.array(length - 1, length)).alias("size")).where("size > 0")
    left = _cut(both.withColumns({"lo": F.lit(0), "hi": F.col("size")}), length)
    found: list[DataFrame] = []
    done: list[DataFrame] = []
    while True:
        left = durable(left, "subtrees")
        # A pair has a word of the size itself: the other has this size or one letter more.
        sizes = left.groupBy(*_KEY).agg(F.count("*").alias("m"), F.count_if(F.char_length("word") == F.col("size")).alias("short")).where("m > 1 and short > 0").drop("short")
        sizes = durable(sizes, "sizes")
        done += [left, sizes]
        final = (F.col("m") <= group) | (F.col("hi") - F.col("lo") < 2)
        own = left.join(sizes.where(final), _KEY).groupBy(*_KEY).agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("ns"))
        found.append(durable(own.select("size", "lo", "hi", "words", "ns").mapInArrow(_search, "word string, n long, near string, near_n long"), "near"))
        large = sizes.where(~final).drop("m")
        if not large.limit(1).count():
            break
        left = _cut(left.join(large, _KEY).select("word", "n", "size", "lo", "hi"), length)
    for used in done:
        drop(used)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _search(batches):
    for batch in batches:
        out: list[tuple[str, int, str, int]] = []
        for size, lo, hi, words, ns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            end = size - hi
            for i, j in Trie([w[lo : len(w) - end] for w in words]).pairs():
                a, b = words[i], words[j]
                if len(a) != size and len(b) != size:
                    continue
                if len(a) > len(b):
                    a, b, i, j = b, a, j, i
                first = next((k for k in range(lo, len(a)) if a[k] != b[k]), len(a))
                if first < hi or first == size == hi:  # its common prefix ends in this window
                    out += [(a, ns[i], b, ns[j]), (b, ns[j], a, ns[i])]
        cols = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64()) * 2, strict=True)], names=["word", "n", "near", "near_n"])


def group_variants(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n).

    A word's form is its near word of largest n (ties: the smallest in code-point order), if that is at least `times` its own n,
    which must exceed 1; else null. root is where forms lead to: as n grows `times`-fold with each, the way has at most
    log(largest n) steps, which pointers to the form of the form ... take in a few joins."""
    if times < 2:
        raise ValueError("times must be at least 2")
    words = durable(words.where("word <> ''").select("word", F.col("n").cast("long").alias("n")), "words")
    near = near_words(words)
    best = near.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best"))
    leads = -F.col("best.n") >= times * F.col("n")
    best = durable(best.select("word", "n_near", F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.n")).alias("form_n")), "forms")
    drop(near)
    most = words.agg(F.max("n")).first()[0] or 1
    steps, reach = int(np.log(most) / np.log(times)) + 1, 1
    roots = best.where("form is not null").select("word", F.col("form").alias("root"))
    while reach < steps:
        after = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = durable(roots.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        reach *= 2
    out = words.join(best, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
