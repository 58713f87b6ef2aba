"""Each stage of the pipeline against brute force over what the stage before kept."""

import random
from collections import Counter

import numpy as np

import corpus_pipeline
from creditweave.llm import mixing, packing, quality, queries
from creditweave.llm.common import table

from .test_operators import SMALL, WORD, brute_jaccard, brute_substrings, check_pieces, low


def rows_of(df):
    return [tuple(r) for r in df.select(corpus_pipeline.COLUMNS).collect()]


def test_stages(spark, tmp_path):
    docs, kept = table(spark, SMALL, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
        path = str(tmp_path / name)
        out.write.parquet(path)
        kept[name], docs = (docs, spark.read.parquet(path)), spark.read.parquet(path)

    before, after = kept["quality"]
    forest = quality.train(before, table(spark, SMALL, "labels"))
    good = {r["doc_id"] for r in quality.score_quality(before, forest, 0.3).where("score >= 0.3").collect()}
    assert Counter(rows_of(after)) == Counter(r for r in rows_of(before) if r[0] in good) and 0 < len(good) <= before.count()

    before, after = kept["near_duplicates"]
    component = {i: c for i, _, c in brute_jaccard([r[:2] for r in rows_of(before)], 5, 80, 100)}
    assert Counter(rows_of(after)) == Counter(r for r in rows_of(before) if component[low(r[0])] == low(r[0]))

    before, after = kept["substrings"]
    cut = {i: (n, gone) for i, n, gone, _ in brute_substrings([r[:2] for r in rows_of(before)])}
    text = {r[0]: r[1] for r in rows_of(before)}
    got = {r[0]: r for r in rows_of(after)}
    for i, (n, gone) in cut.items():
        assert (i in got) == (n > gone or not gone)
        if i in got:
            assert len(WORD.findall(got[i][1] or "")) == n - gone and (gone or got[i][1] == text[i])

    before, after = kept["mixing"]
    assert Counter(rows_of(after)) == Counter(rows_of(before)) and set(mixing.tempered(before)) == {r[3] or "" for r in rows_of(before)}

    before, after = kept["packing"]
    assert check_pieces(after.collect(), [r[:2] for r in rows_of(before)]) > 0.95


def test_sequences_hold_the_target_mix(spark):
    """A hot source has three quarters of the text; runs of sequences have the target's shares until a source ends."""
    rng = random.Random(9)
    sizes, words = {"hot": 3000, "b": 600, "c": 400}, [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(400)), "en", s, 0) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    rows += [(10_000 + i, "", "en", "hot", 0) for i in range(50)] + [(20_000, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    weights = mixing.tempered(docs)
    source, got = {r[0]: r[3] or "" for r in rows}, corpus_pipeline.packing_stage(spark, docs, SMALL).collect()
    assert {r["doc_id"] for r in got} == set(source)
    assert packing.pack_mixed(mixing.mix(docs.limit(0), {}), queries.tokenizer()).count() == 0
    slot = {r["doc_id"]: r["slot"] for r in mixing.mix(docs, weights).collect()}
    got.sort(key=lambda r: (r["sequence_id"], r["offset"]))
    for lo in (0, 300_000, 600_000):  # shards of 2**19 tokens at most: what they hold in any order is the mix of their slots
        run, at = Counter(), 0
        for r in got:
            at += r["length"]
            if lo < at <= lo + 600_000:
                run[source[r["doc_id"]]] += r["length"]
        for s in sizes:
            assert abs(run[s] / sum(run.values()) - weights[s] / sum(weights.values())) < 0.1, (lo, s, run)
    half = {k: [slot[r["doc_id"]] for r in got[k * len(got) // 4 : (k + 1) * len(got) // 4]] for k in range(4)}
    assert all(np.mean(half[k]) < np.mean(half[k + 1]) for k in range(3))
