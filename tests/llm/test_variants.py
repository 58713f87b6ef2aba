"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

from creditweave.llm import queries, variants
from creditweave.llm.common import table

SMALL = "/root/testdata/sf0.001"


def plain_words(rows, shortest=5, least=3):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if doc_id is not None and h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= shortest and n >= least}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(words):
    near = {w: set() for w in words}
    for w in words:  # words that lack one and the same letter, or lack one of the other's
        for i in range(len(w)):
            if (short := w[:i] + w[i + 1 :]) in words:
                near[w].add(short)
                near[short].add(w)
    lacks = {}
    for w in words:
        for i in range(len(w)):
            lacks.setdefault((w[:i], w[i + 1 :]), []).append(w)
    for own in lacks.values():
        for a in own:
            near[a].update(b for b in own if b != a)
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        yield w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_variants_follow_the_contract(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    got = queries.op12_variants(spark, SMALL)
    assert sorted(got.columns) == sorted(COLUMNS)
    want = sorted(plain_groups(plain_words(rows)), key=lambda r: r[0])
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=lambda r: r[0]) == want
    assert sum(r[1] is not None for r in want) > 10


def test_words_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "ÀÉÎ× ÷÷÷÷÷ Straßen STRASSEN"), (None, "hello Hello HELLO hellO"), (4, "a" * 30_000 + " b"), (4, "a" * 30_000), (5, "x1y2z3"), (6, "word_word word-word")]
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n int, word string").repartition(3)
    for least in (1, 3):
        got = {r["word"]: r["n"] for r in variants.vocabulary(docs, 4, least).collect()}
        assert got == plain_words(rows, 4, least)
    assert variants.vocabulary(docs.limit(0)).count() == 0
    assert variants.group_variants(variants.vocabulary(docs.limit(0))).count() == 0


def test_pairs_of_tight_vocabularies_at_every_size_of_a_subtree(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abß") for _ in range(rng.randint(1, 9))) for _ in range(900)} | {"a" * k for k in range(1, 40)} | {"y" * 4000 + c + "z" * 4000 for c in ("", "y", "q", "qq")}
    counted = {w: rng.randint(1, 50) for w in words}
    df = spark.createDataFrame(list(counted.items()), "word string, n long").repartition(4)
    want = sorted((a, counted[a], b, counted[b]) for a in words for b in words if abs(len(a) - len(b)) < 2 and a[:1] + b[:1] and one_edit(a, b))
    for group in (5000, 20, 2):
        assert sorted(tuple(r) for r in variants.near_words(df, group).collect()) == want
    assert sorted(map(tuple, variants.group_variants(df).select(*COLUMNS).collect()), key=lambda r: r[0]) == sorted(plain_groups(counted), key=lambda r: r[0])


def test_forms_are_followed_to_the_last(spark):
    chain = ["abcdefgh"[: i + 1] for i in range(8)]  # each one letter longer and twice as frequent
    df = spark.createDataFrame([(w, 3 * 2**i) for i, w in enumerate(chain)], "word string, n long")
    assert {r["word"]: r["root"] for r in variants.group_variants(df).collect()} == dict.fromkeys(chain, "abcdefgh")
