"""Bounded search for sets of open items whose total lies in a band.

The pool of a payment is one array of at most `max_pool` items, so a search is a small task of one row; Spark spreads the
rows. Sets meet in the middle: the sums of a set's first half are held against the sorted sums of all that its second half can be,
as whole arrays. Sets come in the order of a depth-first walk over items from the largest down."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, Row, SparkSession
from pyspark.sql import functions as F

from ..config import Search

FOUND = "struct<solutions: array<array<int>>, nodes: int, exhausted: boolean, capped: boolean>"
#: Pairs of halves that are looked at in one step.
STEP = 100_000


@lru_cache(maxsize=512)
def _combinations(n: int, size: int) -> np.ndarray:
    """All sets of `size` of n places, each ascending, in lexicographic order."""
    return np.array(list(combinations(range(n), size)), np.int16).reshape(comb(n, size), size)


def _of_size(a: np.ndarray, size: int, low: int, high: int, most: int, budget: int) -> tuple[list[list[int]], int, bool]:
    """The first `most` sets of this size in lexicographic order, how many sums were looked at, and whether the budget ended it."""
    left, right = _combinations(len(a), (size + 1) // 2), _combinations(len(a), size // 2)
    totals, rest = a[left].sum(1), a[right].sum(1)
    order = np.argsort(rest, kind="stable")
    rest = rest[order]
    begin, end = np.searchsorted(rest, low - totals, "left"), np.searchsorted(rest, high - totals, "right")
    cost = np.concatenate([[0], (1 + end - begin).cumsum()])
    found, at = [], 0
    while at < len(left) and len(found) < most:
        room = min(STEP, budget - int(cost[at]))
        upto = int(np.searchsorted(cost, cost[at] + room, "right")) - 1
        if upto == at:
            if cost[at + 1] > budget:
                return found, int(cost[at]), True
            upto = at + 1
        size_of = end[at:upto] - begin[at:upto]
        first = np.repeat(np.arange(at, upto), size_of)
        second = order[np.arange(len(first)) - np.repeat(size_of.cumsum() - size_of, size_of) + begin[first]]
        if size > 1:  # a set has one such pair only: its second half lies behind its first
            behind = right[second, 0] > left[first, -1]
            first, second = first[behind], second[behind]
        turn = np.lexsort((second, first))[: most - len(found)]
        found += np.hstack([left[first[turn]], right[second[turn]]]).tolist()
        at = upto
    return found, int(cost[at]), False


def find_sets(amounts: list[int], low: int, high: int, cfg: Search) -> tuple[list[list[int]], int, bool, bool]:
    """Index sets over amounts (descending) in the order of a depth-first walk, the sums looked at, whether the budget of these
    ran out (then sets may be missing), whether there are as many sets as the cap allows."""
    a, found, nodes = np.asarray(amounts, np.int64), [], 0
    for size in range(cfg.min_size, min(cfg.max_size, len(a)) + 1):
        own, some, exhausted = _of_size(a, size, low, high, cfg.max_solutions, cfg.budget - nodes)
        found += own
        nodes += some
        if exhausted:
            return sorted(found)[: cfg.max_solutions], nodes, True, False
    found = sorted(found)[: cfg.max_solutions]  # a set comes before those that it begins
    return found, nodes, False, len(found) == cfg.max_solutions


def search(amounts: Column, low: Column, high: Column, cfg: Search) -> Column:
    """FOUND for each row; no search where amounts is null or empty, or the band is null."""

    @F.pandas_udf(FOUND)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for pools, lows, highs in batches:
            out = []
            for pool, a, b in zip(pools, lows, highs, strict=True):
                empty = pool is None or len(pool) == 0 or pd.isna(a) or pd.isna(b) or not cfg.enabled
                out.append(([], 0, False, False) if empty else find_sets([int(x) for x in pool], int(a), int(b), cfg))
            yield pd.DataFrame(out, columns=["solutions", "nodes", "exhausted", "capped"])

    return run(amounts, low, high)


class FindSets:
    """The search as a table function: find_sets(TABLE(...) PARTITION BY statement_ref) over the items of payments' pools.

    Its table has statement_ref, amount_paise, invoice_number and open_amount_paise, in any order of rows; a partition is one payment's
    pool, of max_pool items at most. Gives each set with its place in the order of the search."""

    cfg, tolerance = Search(), 100

    def __init__(self) -> None:
        self.pool: list[tuple[int, str]] = []
        self.ref, self.amount = None, 0

    def eval(self, row: Row) -> None:
        self.ref, self.amount = row["statement_ref"], row["amount_paise"]
        self.pool.append((-row["open_amount_paise"], row["invoice_number"]))

    def terminate(self) -> Iterator[tuple[str, int, str, int]]:
        self.pool.sort()
        opens = [-o for o, _ in self.pool]
        found = find_sets(opens, self.amount - self.tolerance, self.amount + self.tolerance, self.cfg)[0] if self.cfg.enabled else []
        for place, s in enumerate(found, 1):
            yield self.ref, place, " ".join(sorted(self.pool[i][1] for i in s)), sum(opens[i] for i in s)


def register(spark: SparkSession, cfg: Search, tolerance: int, name: str = "find_sets") -> None:
    """Makes the search known to SQL under this name."""
    kind = type("FindSets", (FindSets,), {"cfg": cfg, "tolerance": tolerance})
    spark.udtf.register(name, F.udtf(kind, returnType="statement_ref string, place int, numbers string, total_paise bigint"))


def search_space(n: Column, max_size: int) -> Column:
    """Number of sets of 1 to max_size of n items (n up to 60)."""
    table = F.array(*(F.lit(sum(comb(k, i) for i in range(1, max_size + 1))).cast("bigint") for k in range(61)))
    return F.element_at(table, n.cast("int") + 1)
