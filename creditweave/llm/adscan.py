"""Approximate nearest neighbours by adaptive dimension scans (Gao and Long, 2023) over inverted lists.

Vectors are rotated by one random orthogonal matrix, which keeps distances and makes the first d coordinates a random
projection. Every vector is in the list of its nearest centroid; long lists are cut into shards. A query probes its nearest lists:
the nearest first, and the k-th distance found there is the limit with which it goes to the others. In a shard, columns come in blocks:
after each, a candidate whose partial distance, carried on to all columns, would exceed the limit by more than chance allows is
abandoned. What stays to the last column gets its exact distance on the original vectors. Equal vectors are searched as one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, drop, durable

#: Lists at most, vectors of the sample that they are fitted on, vectors of a shard, queries of a block.
LISTS, SAMPLE, SHARD_ROWS, BLOCK_ROWS = 1024, 16_384, 4096, 4096
#: Columns of the first blocks (each following one is twice as wide) and candidates that share one limit.
COLUMNS, CHUNK = 8, 512
#: How far off a partial distance may be: a candidate within the limit is abandoned with a chance of about exp(-c * ERROR**2).
ERROR = 2.1
_HIT = "q long, g long, d2 double"


class Index:
    """Of one length of vectors: centroids, the rotation, and how many lists a query probes."""

    def __init__(self, sample: np.ndarray, lists: int, k: int, recall: float, seed: int = 0):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0] if dim else np.zeros((0, 0))
        self.centroids = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
        for _ in range(6):
            own = self.order(sample)[:, 0]
            self.centroids = np.stack([sample[own == i].mean(0) for i in np.unique(own)])
        self.probes = self._probes(sample, k, recall, rng)

    def order(self, x: np.ndarray) -> np.ndarray:
        """Of each row the lists, nearest first."""
        return np.argsort((self.centroids**2).sum(1) - 2.0 * x @ self.centroids.T, axis=1, kind="stable")

    def _probes(self, sample: np.ndarray, k: int, recall: float, rng) -> int:
        """The fewest lists that hold this share of the k nearest of some rows of the sample. In all vectors the k nearest are nearer,
        so their lists come no later."""
        own = self.order(sample)[:, 0]
        some = rng.choice(len(sample), min(400, len(sample)), replace=False)
        order = self.order(sample[some])
        rank = np.argsort(order, axis=1)
        ranks = []
        for i, row in enumerate(some.tolist()):
            d = ((sample - sample[row]) ** 2).sum(1)
            d[row] = np.inf
            ranks.append(rank[i, own[np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]]])
        ranks = np.concatenate(ranks)
        return int(np.quantile(ranks, recall, method="higher")) + 1 if len(ranks) else 1


def scan(rotated: np.ndarray, original: np.ndarray, q_rotated: np.ndarray, q: np.ndarray, k: int, limit2: float, error: float = ERROR) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows, squared distances, columns read) of one list's candidates, among them all that are the k nearest and within limit2,
    but for those that a test abandons by chance. rotated has a row for each column, original one for each candidate."""
    dim, n = rotated.shape
    rows, dists, read = [], [], 0
    best = np.full(k, np.inf)
    for at in range(0, n, CHUNK):
        alive = np.arange(at, min(n, at + CHUNK))
        part, done, wide = np.zeros(len(alive)), 0, COLUMNS
        limit = min(limit2, best[-1])
        while done < dim and len(alive):
            some = rotated[done : done + wide]
            read += len(alive) * len(some)
            part += ((some[:, alive] - q_rotated[done : done + wide, None]) ** 2).sum(0)
            done = min(dim, done + wide)
            wide *= 2
            # With all columns, rounding alone can be off.
            factor = (done / dim) * (1.0 + error / np.sqrt(done)) ** 2 if done < dim else 1.0 + 1e-6
            stay = part <= limit * factor + 1e-12
            alive, part = alive[stay], part[stay]
        if len(alive):
            exact = ((original[alive] - q) ** 2).sum(1)
            rows.append(alive)
            dists.append(exact)
            best = np.sort(np.concatenate([best, exact]))[:k]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0), read
    found, d2 = np.concatenate(rows), np.concatenate(dists)
    near = d2 <= min(limit2 * (1 + 1e-12), best[-1])
    return found[near], d2[near], read


def nearest(vectors: DataFrame, k: int = 10, query_mod: int = 100, recall: float = 0.97, lists: int = LISTS, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose vec_id is divisible by query_mod the k nearest of all others found.

    score is the Euclidean distance of the original vectors in double precision; ties go to the smaller vec_id. Rows with a null id, a
    null, empty or zero vector or a null, NaN or infinite component take no part; vectors of another length than the query's and
    its own row are no candidates. Of an id with several vectors only the least one takes part, so repeated rows count once. No
    rows give none; where there are fewer candidates than k all of the probed lists come.

    The search is approximate: lists are probed that hold `recall` of the k nearest of a sample of about SAMPLE vectors, and tests abandon a
    true neighbour seldom. Lists number about the square root of the vectors, `lists` at most. Of equal vectors k + 1 ids at most
    are looked at, as no more can be among the k nearest. A task holds a shard of about shard_rows vectors and block_rows queries."""
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    good = good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0)).alias("v"))
    once = durable(good.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    same = Window.partitionBy("v").orderBy("vec_id")
    # Only the k + 1 smallest ids of equal vectors move: Spark limits each partition's share before the shuffle.
    first = once.withColumn("rank", F.row_number().over(same)).where(F.col("rank") <= k + 1)
    groups = durable(first.groupBy("v").agg(F.min("vec_id").alias("g"), F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("v")), "groups")
    asking = once.where(F.col("vec_id") % query_mod == 0).select(F.col("vec_id").alias("query_id"), "v")
    asking = durable(asking.join(groups.select("v", "g"), "v").select("query_id", "g"), "asking")
    drop(once)
    queries = groups.join(asking.select("g").distinct(), "g", "left_semi").select(F.col("g").alias("q"), "v", "dim")

    spark = vectors.sparkSession
    known = {r["dim"]: r["n"] for r in groups.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row for each length of vector
    index: dict[int, Index] = {}
    drawn = bounded(groups.select("g", "v", "dim"), "g", SAMPLE).select("v", "dim").toArrow()
    dims = drawn["dim"].to_numpy()
    for dim, n in known.items():
        own = drawn["v"].combine_chunks().take(pa.array(np.flatnonzero(dims == dim))) if (dims == dim).any() else groups.where(F.col("dim") == dim).select("v").limit(64).toArrow()["v"].combine_chunks()
        index[dim] = Index(np.array(own.flatten(), float).reshape(-1, dim), max(1, min(lists, int(n**0.5))), k, recall)
    shared = spark.sparkContext.broadcast(index)  # at most `lists` centroids and a square rotation a length

    def arrays(batch: pa.RecordBatch):
        """For each length of vector in the batch: it, the rows, and their vectors."""
        dims = batch.column(2).to_numpy()
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            yield dim, rows, np.array(batch.column(1).take(pa.array(rows)).flatten(), float).reshape(len(rows), dim)

    def deal(batches):
        for batch in batches:
            own = np.zeros(batch.num_rows, np.int64)
            for dim, rows, x in arrays(batch):
                own[rows] = shared.value[dim].order(x)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=["g", "v", "dim", "list"])

    dealt = durable(groups.select("g", "v", "dim").mapInArrow(deal, "g long, v array<double>, dim int, list long"), "lists")
    long = dealt.groupBy("dim", "list").agg(F.expr(f"cast(ceil(count(*) / {shard_rows}) as int)").alias("shards"))
    long = durable(long, "shards")
    dealt = dealt.join(F.broadcast(long), ["dim", "list"]).withColumn("shard", F.pmod(F.xxhash64("g", F.lit(1)), "shards").cast("int"))  # `lists` rows a length

    def route(first: bool):
        """Queries with the lists that they probe: the nearest, or the others."""

        def run(batches):
            for batch in batches:
                at, found = [], []
                for dim, rows, x in arrays(batch):
                    ix = shared.value[dim]
                    order = ix.order(x)[:, : ix.probes]
                    order = order[:, :1] if first else order[:, 1:]
                    at.append(np.repeat(rows, order.shape[1]))
                    found.append(order.ravel())
                asked = pa.array(np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64))
                limit = batch.column(3).take(asked) if batch.num_columns > 3 else pa.nulls(len(asked), pa.float64())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(asked) for i in range(3)), limit, pa.array(np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64))], names=["q", "v", "dim", "limit2", "list"])

        return run

    def search(own: pa.Table, asking: pa.Table) -> pa.Table:
        cols: tuple[list, list, list] = ([], [], [])
        if own.num_rows and asking.num_rows:
            dim = own["dim"][0].as_py()
            ix = shared.value[dim]
            x, want = (np.array(t["v"].combine_chunks().flatten(), float).reshape(-1, dim) for t in (own, asking))
            rotated, turned, g = np.ascontiguousarray((x @ ix.rotation).T), want @ ix.rotation, own["g"].to_numpy()
            limits = asking["limit2"].to_numpy(zero_copy_only=False).astype(float)
            for q, limit2, one, one_turned in zip(asking["q"].to_pylist(), limits, want, turned, strict=True):
                rows, d2, _ = scan(rotated, x, one_turned, one, k + 1, np.inf if np.isnan(limit2) else limit2)
                cols[0].append(np.full(len(rows), q, np.int64))
                cols[1].append(g[rows])
                cols[2].append(d2)
        joined = [np.concatenate([*c, np.zeros(0, t)]).astype(t) for c, t in zip(cols, (np.int64, np.int64, float), strict=True)]
        return pa.Table.from_arrays([pa.array(c) for c in joined], names=["q", "g", "d2"])

    by = ["dim", "list", "shard", "block"]

    def hits(asked: DataFrame, name: str) -> DataFrame:
        """What the probed lists have for their queries; a shard that many queries probe is scanned in blocks of them."""
        asked = durable(asked, name)
        load = asked.groupBy("dim", "list").agg(F.expr(f"cast(ceil(count(*) / {block_rows}) as int)").alias("blocks")).join(long, ["dim", "list"])
        load = F.broadcast(durable(load, "load"))  # `lists` rows a length
        left = dealt.drop("shards").join(load.drop("shards"), ["dim", "list"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        right = asked.join(load, ["dim", "list"]).withColumn("block", F.pmod(F.xxhash64("q", F.lit(2)), "blocks").cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        found = left.select("g", "v", *by).groupBy(*by).cogroup(right.select("q", "v", "limit2", *by).groupBy(*by)).applyInArrow(search, _HIT)
        out = durable(found, "hits")
        drop(asked)
        return out

    # The query itself is among its candidates: its group may hold other ids, so k + 1 groups are kept.
    near = hits(queries.mapInArrow(route(True), "q long, v array<double>, dim int, limit2 double, list long"), "near")
    best = Window.partitionBy("q").orderBy("d2", "g")
    limits = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k + 1).select("q", F.col("d2").alias("limit2"))
    far = hits(queries.join(limits, "q", "left").select("q", "v", "dim", "limit2").mapInArrow(route(False), "q long, v array<double>, dim int, limit2 double, list long"), "far")
    within = F.rank().over(Window.partitionBy("q").orderBy("d2"))  # ties stay: their ids decide
    found = near.unionByName(far).withColumn("rank", within).where(F.col("rank") <= k + 1)
    ids = found.join(groups.select("g", "ids"), "g").select("q", "d2", F.explode("ids").alias("vec_id"))
    short = Window.partitionBy("q").orderBy("d2", "vec_id")
    ids = durable(ids.withColumn("rank", F.row_number().over(short)).where(F.col("rank") <= k + 1).drop("rank"), "found")
    out = asking.withColumnRenamed("g", "q").join(ids, "q").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "vec_id"))
    return out.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.sqrt("d2").alias("score"))
