"""Approximate nearest neighbours against all distances."""

import numpy as np
import pytest

from creditweave.llm import adscan, queries
from creditweave.llm.common import table

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def plain(rows, k=10, mod=100):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for at in np.flatnonzero(ids % mod == 0):
        d = np.sqrt(((x - x[at]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if j != at][:k]
        out[int(ids[at])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    assert set(got) == set(want)
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


@pytest.mark.parametrize("where", [SMALL, LARGE])
def test_neighbours_of_the_given_vectors(spark, where):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, where, "embeddings").collect()]
    x, got, want = dict(rows), found(queries.op13_neighbours(spark, where)), plain(rows)
    assert recall(got, want) >= 0.93
    for q, own in got.items():
        assert len(own) == 10 and own == sorted(own, key=lambda t: (t[1], t[0]))
        for i, score in own:
            assert score == pytest.approx(np.sqrt(((np.array(x[i], float) - np.array(x[q], float)) ** 2).sum()), rel=1e-12)


def test_neighbours_in_clusters_with_a_hot_vector_and_ties(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 24)) * 8
    x = (centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 24))).astype(np.float32)
    x[rng.random(3000) < 0.33] = x[7]  # a third of all rows
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got, want = found(adscan.nearest(df, shard_rows=200, block_rows=7)), plain(rows)
    assert recall(got, want) >= 0.95
    hot = [q for q in want if (x[q] == x[7]).all()]
    assert hot and all(got[q] == want[q] for q in hot)  # ties go to the smallest ids


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (7, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 3.5]), (8, []), (9, [-0.0, 0.0]), (200, [0.0] * 2), (300, [5.0]), (-100, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, q string")
    got = found(adscan.nearest(df))
    assert got == {0: [(-100, 0.0), (6, 2.0)], 100: [(7, 0.5)], -100: [(0, 0.0), (6, 2.0)]}
    assert adscan.nearest(df.limit(0)).count() == 0


def test_tests_spare_columns_and_lose_little():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 64)) * 0.3
    x[:50] *= 0.1
    turn = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    q = rng.normal(size=64) * 0.02
    rows, d2, read = adscan.scan(np.ascontiguousarray((x @ turn).T), x, q @ turn, q, 10, np.inf)
    exact = ((x - q) ** 2).sum(1)
    assert len(set(rows[np.argsort(d2)][:10]) & set(np.argsort(exact)[:10])) >= 9
    assert read < 0.5 * x.size
