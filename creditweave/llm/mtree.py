"""Exact top-k search by inner product, with M-trees searched best first.

With a further coordinate that gives all candidates one norm, the largest inner product is the least Euclidean distance,
which is a metric. The tree's top level is distributed: every candidate is dealt to the nearest of up to PIVOTS routing
points, whose covering rings (least and largest distance) are kept, and cells of many candidates are cut into shards. A
query first searches its nearest cells; the k-th score found there is the bound with which it goes on, only to shards
whose ring it can reach. Each shard is an M-tree of pages: a node holds routing points with covering radii and distances to
the parent's point. A search keeps a heap of pages by the least distance that they can hold. Stored distances give bounds
by the triangle inequality, so many distances are never computed. Scores are integers throughout; distances only prune,
with a margin for rounding."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, drop, durable

PAGE, FANOUT = 64, 8
PIVOTS, SAMPLE = 1024, 8192
HIT = "query_id long, vec_id long, score long"


class MTree:
    """Bulk-loaded over points x (float64, all of the squared norm norm2) with ids; leaves hold up to PAGE of them."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, norm2: float):
        self.x, self.ids, self.computed, self.norm2 = x, ids, 0, norm2
        self.leaf: list[np.ndarray | None] = []  # rows of a leaf, in order of distance to its routing point
        self.to_point: list[np.ndarray | None] = []  # these distances
        self.children: list[np.ndarray | None] = []
        self.radius: list[float] = []
        self.to_parent: list[float] = []
        self.point: list[int] = []
        rng = np.random.default_rng(0)
        rows = np.arange(len(x))
        self.root = self._build(rows, self._center(rows), None, rng) if len(x) else -1

    def _center(self, rows: np.ndarray) -> int:
        return int(rows[((self.x[rows] - self.x[rows].mean(0)) ** 2).sum(1).argmin()])

    def _build(self, rows: np.ndarray, point: int, parent: int | None, rng) -> int:
        here = len(self.leaf)
        d = np.sqrt(((self.x[rows] - self.x[point]) ** 2).sum(1))
        for a, v in ((self.leaf, None), (self.to_point, None), (self.children, None), (self.radius, d.max()), (self.point, point)):
            a.append(v)
        self.to_parent.append(0.0 if parent is None else float(np.sqrt(((self.x[point] - self.x[parent]) ** 2).sum())))
        if len(rows) <= PAGE or d.max() == 0:  # equal points stay one page
            order = np.lexsort((self.ids[rows], d))
            self.leaf[here], self.to_point[here] = rows[order], d[order]
            return here
        points = rng.choice(rows, min(FANOUT, len(rows)), replace=False)
        for _ in range(2):
            to = ((self.x[rows][:, None] - self.x[points]) ** 2).sum(2) if len(rows) * len(points) < 4096 else (self.x[rows] ** 2).sum(1)[:, None] - 2 * self.x[rows] @ self.x[points].T + (self.x[points] ** 2).sum(1)
            own = to.argmin(1)
            points = np.array([self._center(rows[own == i]) for i in np.unique(own)])
        groups = [rows[own == i] for i in np.unique(own)]
        if len(groups) == 1:  # too even to part by distance
            order = rows[np.argsort(d, kind="stable")]
            groups = np.array_split(order, FANOUT)
            points = [self._center(g) for g in groups]
        self.children[here] = np.array([self._build(g, int(p), point, rng) for g, p in zip(groups, points, strict=True)])
        return here

    def search(self, q: np.ndarray, score, k: int, skip: int | None, floor: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id) of q, ids ascending where scores tie, of those that score `floor` at least. score(rows) gives
        integer scores.

        A page is left out only if it can't even tie the k-th score so far."""
        if self.root < 0:
            return []
        slack = 1e-7 * (1.0 + float(np.abs(q).sum()))
        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        worst = np.inf if floor is None else self._reach(q, floor) + slack  # distance beyond which nothing can tie
        first = float(np.sqrt(((q - self.x[self.point[self.root]]) ** 2).sum()))
        pages = [(max(0.0, first - self.radius[self.root]), self.root, first)]
        while pages:
            bound, node, d = heapq.heappop(pages)
            if bound > worst:
                break
            rows = self.leaf[node]
            if rows is not None:
                a, b = np.searchsorted(self.to_point[node], (d - worst - slack, d + worst + slack)) if np.isfinite(worst) else (0, len(rows))
                rows = rows[a:b]
                self.computed += len(rows)
                got = score(rows)
                if floor is not None:
                    rows, got = rows[got >= floor], got[got >= floor]
                if len(best) == k:
                    near = got >= best[0][0]
                    rows, got = rows[near], got[near]
                for s, i in zip(got.tolist(), self.ids[rows].tolist(), strict=True):
                    if i == skip or len(best) == k and (s, -i) <= best[0]:
                        continue
                    (heapq.heapreplace if len(best) == k else heapq.heappush)(best, (s, -i))
                if len(best) == k:
                    worst = self._reach(q, best[0][0]) + slack
                continue
            for c in self.children[node]:
                if abs(d - self.to_parent[c]) - self.radius[c] > worst + slack:  # by the triangle inequality, uncomputed
                    continue
                dc = float(np.sqrt(((q - self.x[self.point[c]]) ** 2).sum()))
                self.computed += 1
                low = max(bound, dc - self.radius[c] - slack)
                if low <= worst:
                    heapq.heappush(pages, (low, int(c), dc))
        return sorted(((s, -i) for s, i in best), key=lambda t: (-t[0], t[1]))

    def _reach(self, q: np.ndarray, score: int) -> float:
        """The distance of points that score so."""
        return float(np.sqrt(max(0.0, (q**2).sum() + self.norm2 - 2.0 * score)))


def lift(v: np.ndarray, norm2: float) -> np.ndarray:
    """v with the coordinate that brings its squared norm to norm2."""
    own = (v.astype(float) ** 2).sum(1)
    return np.hstack([v.astype(float), np.sqrt(np.maximum(0.0, norm2 - own))[:, None]])


class Cells:
    """The top level: for each dimension its routing points in lifted space, and what is known of the candidates of each."""

    def __init__(self, points: dict[int, np.ndarray], norm2: dict[int, float]):
        self.points, self.norm2 = points, norm2
        self.of: dict[int, list[tuple[int, int, float, float, int]]] = {}  # dim: (cell, shards, least and largest distance, candidates)

    def distances(self, dim: int, x: np.ndarray) -> np.ndarray:
        """Of lifted points x to the routing points of this dimension."""
        p = self.points[dim]
        return np.sqrt(np.maximum(0.0, (x**2).sum(1)[:, None] - 2.0 * x @ p.T + (p**2).sum(1)))

    def margin(self, dim: int, q: np.ndarray) -> float:
        return 1e-6 * (1.0 + self.norm2[dim] ** 0.5 + float(np.abs(q).sum()))


def routing_points(x: np.ndarray, some: int, seed: int = 0) -> np.ndarray:
    """About `some` centres of x, by two rounds of Lloyd's algorithm."""
    points = x[np.random.default_rng(seed).choice(len(x), min(some, len(x)), replace=False)]
    for _ in range(2):
        own = ((x**2).sum(1)[:, None] - 2.0 * x @ points.T + (points**2).sum(1)).argmin(1)
        points = np.stack([x[own == i].mean(0) for i in np.unique(own)])
    return points


def top_k(vectors: DataFrame, k: int = 10, query_mod: int = 100, scale: int = 1024, shard_rows: int = 4096, block_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose vec_id is divisible by query_mod the k best of all others.

    Components become floor(scale * x); a score is the integer inner product, ties go to the smaller vec_id. Rows with a
    null id, a null vector or a null, NaN or infinite component take no part; vectors of other lengths than the query's
    are no candidates of it, nor are rows of its own vec_id. Repeated candidates count once each; of repeated queries the
    shortest, then least vector asks. No rows give none. Vectors whose squared norm reaches 2**62 raise ValueError, as their
    scores could leave 64 bits. A task holds a shard of about shard_rows candidates and a block of about block_rows queries.
    Routing points come from a sample of about SAMPLE rows and only steer the search; a vector length without any in the
    sample has one cell."""
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("bigint"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"), F.size("embedding").cast("long").alias("dim"))
    norm2 = F.aggregate("v", F.lit(0.0), lambda t, c: t + c.cast("double") * c.cast("double"))
    known = {r["dim"]: (r["n"], r["most"]) for r in good.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm2).alias("most")).collect()}  # a row for each length of vector
    if any(most >= 2.0**62 for _, most in known.values()):
        raise ValueError("a squared norm of 2**62 or more")
    spark, drawn = vectors.sparkSession, bounded(good, "vec_id", SAMPLE).select("v", "dim").toArrow()
    points = {}
    for dim, (n, most) in known.items():
        own = drawn.filter(pc.equal(drawn["dim"], dim))["v"].combine_chunks().flatten()
        sample = lift(np.array(own, np.int64).reshape(-1, dim) if dim and len(own) else np.zeros((1, dim), np.int64), most)
        points[dim] = routing_points(sample, min(PIVOTS, max(1, -(-n // shard_rows))))
    cells = Cells(points, {d: most for d, (_, most) in known.items()})
    top = spark.sparkContext.broadcast(cells)  # at most PIVOTS points a length

    def arrays(batch: pa.RecordBatch):
        """For each length of vector in the batch: it, the rows, and their vectors."""
        dims = batch.column(2).to_numpy()
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            yield dim, rows, np.array(batch.column(1).take(pa.array(rows)).flatten(), np.int64).reshape(len(rows), dim)

    def deal(batches):
        for batch in batches:
            cell, far = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for dim, rows, ints in arrays(batch):
                d = top.value.distances(dim, lift(ints, top.value.norm2[dim]))
                cell[rows] = d.argmin(1)
                far[rows] = d.min(1)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(cell), pa.array(far)], names=["vec_id", "v", "dim", "cell", "far"])

    dealt = durable(good.mapInArrow(deal, "vec_id long, v array<long>, dim long, cell long, far double"), "cells")
    for r in dealt.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi")).orderBy("dim", "cell").collect():  # at most PIVOTS a length
        cells.of.setdefault(r["dim"], []).append((r["cell"], -(-r["n"] // shard_rows), r["lo"], r["hi"], r["n"]))
    rings = spark.sparkContext.broadcast(cells)
    spread = spark.createDataFrame([(dim, c, n) for dim, own in cells.of.items() for c, n, *_ in own], "dim long, cell long, shards long")
    dealt = dealt.join(F.broadcast(spread), ["dim", "cell"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1), "v"), "shards")).select("vec_id", "v", "dim", "cell", "part")
    queries = good.where(F.col("vec_id") % query_mod == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q")).select("vec_id", "q.v", "q.dim")
    by = ["dim", "cell", "part"]
    ask = "vec_id long, v array<long>, dim long, floor long, cell long, part long"

    def route(first: bool):
        """Queries with the shards that they ask: the first parts of the nearest cells that have k candidates and a few more, or
        all others that can hold what ties their floor."""

        def run(batches):
            for batch in batches:
                at, cell, part = [], [], []
                for dim, rows, ints in arrays(batch):
                    q = np.hstack([ints.astype(float), np.zeros((len(ints), 1))])
                    own = rings.value.of.get(dim, [])
                    which, shards, lo, hi, n = (np.array(c) for c in zip(*own, strict=True)) if own else (np.zeros(0, int),) * 5
                    d = rings.value.distances(dim, q)[:, which]
                    low = np.maximum(0.0, np.maximum(d - hi, lo - d))
                    for i, row in enumerate(rows.tolist()):
                        order = np.lexsort((d[i], low[i]))
                        held = np.minimum(n, shard_rows)[order].cumsum()
                        near = order[: int(np.searchsorted(held, 2 * k + 2)) + 1]
                        if first:
                            chosen = [(int(c), 0) for c in near]
                        else:
                            floor, gone = batch.column(3)[row].as_py(), set(near.tolist())
                            reach = np.inf if floor is None else max(0.0, (q[i] ** 2).sum() + rings.value.norm2[dim] - 2.0 * floor) ** 0.5 + rings.value.margin(dim, q[i])
                            chosen = [(int(c), p) for c in order[low[i][order] <= reach] for p in range(int(c in gone), int(shards[c]))]
                        at += [row] * len(chosen)
                        cell += [int(which[c]) for c, _ in chosen]
                        part += [p for _, p in chosen]
                asked = pa.array(at, pa.int64())
                floors = batch.column(3).take(asked) if batch.num_columns > 3 else pa.nulls(len(at), pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(asked) for i in range(3)), floors, pa.array(cell, pa.int64()), pa.array(part, pa.int64())], names=["vec_id", "v", "dim", "floor", "cell", "part"])

        return run

    def search(own: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if own.num_rows and asking.num_rows:
            dim = own["dim"][0].as_py()
            ints, want = (np.array(t["v"].combine_chunks().flatten(), np.int64).reshape(-1, dim) for t in (own, asking))
            norm2 = float((ints.astype(float) ** 2).sum(1).max()) if dim else 0.0
            tree = MTree(lift(ints, norm2), own["vec_id"].to_numpy(), norm2)
            zero = np.zeros((len(want), 1))
            for i, floor, q, qi in zip(asking["vec_id"].to_pylist(), asking["floor"].to_pylist(), np.hstack([want.astype(float), zero]), want, strict=True):
                out += [(i, j, s) for s, j in tree.search(q, lambda r, qi=qi: ints[r] @ qi, k, i, floor)]
        cols = np.array(out, np.int64).reshape(-1, 3).T
        return pa.Table.from_arrays([pa.array(c) for c in cols], names=["query_id", "vec_id", "score"])

    def hits(asked: DataFrame, name: str) -> DataFrame:
        """What the asked shards have for their queries; a shard that many queries ask is searched in blocks of them."""
        asked = durable(asked, name)
        load = asked.groupBy(*by).agg(F.expr(f"cast(ceil(count(*) / {block_rows}) as int)").alias("blocks"))
        left = dealt.join(load, by).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        right = asked.join(load, by).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(2)), "blocks").cast("int"))
        keys = [*by, "block"]
        found = left.select("vec_id", "v", *keys).groupBy(*keys).cogroup(right.select("vec_id", "v", "floor", *keys).groupBy(*keys)).applyInArrow(search, HIT)
        out = durable(found, "hits")
        drop(asked)
        return out

    near = hits(queries.mapInArrow(route(True), ask), "near")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows a query of each shard that it asked
    floors = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    far = hits(queries.join(floors, "vec_id", "left").select("vec_id", "v", "dim", "floor").mapInArrow(route(False), ask), "far")
    rank = F.row_number().over(best).cast("int")
    return near.unionByName(far).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
