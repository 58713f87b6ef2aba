"""String similarities from 0 to 100 for party names; each works on two short strings inside an Arrow batch."""

from __future__ import annotations

from bisect import insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit a character of a."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        hit = free & where.get(c, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def _edits(a: str, b: str) -> int:
    """Letters to insert, delete or replace to make b of a, with one bit a character of a."""
    if not a:
        return len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    more, less, out = full, 0, len(a)  # where the next cell of a column is one more, one less
    for c in b:
        hit = where.get(c, 0)
        down = hit | less
        over = (((hit & more) + more) ^ more) | hit
        up, back = less | ~(over | more) & full, more & over
        out += bool(up & last) - bool(back & last)
        up, back = (up << 1 | 1) & full, (back << 1) & full
        more, less = back | ~(down | up) & full, up & down
    return out


def ratio(a: str, b: str) -> float:
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a part of the longer one, at most as long."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    n = len(short)
    return max(ratio(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _sets(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    return both, f"{both} {' '.join(sorted(x - y))}".strip(), f"{both} {' '.join(sorted(y - x))}".strip()


def token_set_ratio(a: str, b: str) -> float:
    both, x, y = _sets(a, b)
    if not a.split() or not b.split():
        return 0.0
    return max(ratio(x, y), ratio(both, x) if both else 0.0, ratio(both, y) if both else 0.0)


def partial_token_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 100.0
    return partial_ratio(" ".join(sorted(x)), " ".join(sorted(y)))


@lru_cache(maxsize=65_536)
def wratio(a: str, b: str) -> float:
    """A weighted best of the ratios: token forms at 0.95; partial ones at 0.9 (0.6 for lengths 8 times apart) in place of
    whole ones where one string is 1.5 times as long as the other or more."""
    if not a or not b:
        return 0.0
    apart = max(len(a), len(b)) / min(len(a), len(b))
    base = ratio(a, b)
    if apart < 1.5:
        return max(base, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if apart <= 8 else 0.6
    return max(base, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


def levenshtein(a: str, b: str) -> float:
    """100 less the share of edits in the longer string."""
    longest = max(len(a), len(b))
    return 100.0 - _edits(a, b) * 100.0 / longest if longest else 100.0


#: Names of a leaf: those that a bound on letters leaves out or lets in together.
LEAF = 8
#: Leaves of a payer that are looked at first; counts of a letter that are compared by adding up.
FIRST, STEPS = 16, 6
#: Payers and pairs that are held in one step; no bound on what is compared.
PAYERS, PAIRS = 16, 400_000
SLACK = 1e-6


def _words(name: str) -> dict[str, int]:
    """The distinct words and what each adds to their length, joined by blanks: a letter more than it has."""
    return {w: len(w) + 1 for w in name.split()}


def _rarest(words: dict[str, int], times: dict[str, int], share: float) -> list[str]:
    """The rarest words that have more than 1 - share of the letters: strings that share so many of these letters share one of them."""
    out, spare = [], (1 - share) * sum(words.values()) + SLACK
    for w in sorted(words, key=lambda w: (times.get(w, 0), w)):
        if spare < 0:
            break
        out.append(w)
        spare -= words[w]
    return out


class Choices:
    """A block of names, laid out so that payers are held against all of them at once.

    The best `top` of a payer are found from bounds: letters in common, whatever their order, bound every score. Names of one length lie
    in leaves of similar letters, and a leaf is left out by the most that any of its names has of each letter. What a few shared words
    can lift beyond that bound is found by the rarest of these words. All that could be among the best is scored."""

    def __init__(self, names: list[str], owners: list[int] | None = None):
        self.given = names
        self.laid: tuple | None = None
        if owners is not None:
            self._lay(owners)

    def _lay(self, owners: list[int]) -> None:
        """Sorts the names by (name, owner), so that an index tells how ties fall, and deals them to leaves."""
        order = sorted(range(len(self.given)), key=lambda i: (self.given[i], owners[i]))
        self.order, self.names, self.laid = order, [self.given[i] for i in order], (id(owners),)
        self.arrays: dict[str, np.ndarray] = {}
        self.words = [_words(n) for n in self.names]
        self.picked_at: float | None = None
        self.holders: dict[str, list[int]] = defaultdict(list)
        for i, ws in enumerate(self.words):
            for w in ws:
                self.holders[w].append(i)
        self.times = {w: len(h) for w, h in self.holders.items()}
        self.size = np.array([len(n) for n in self.names], np.int64)
        self.its = np.maximum(0, np.array([sum(ws.values()) for ws in self.words], np.int64) - 1)
        self.at = self.size.cumsum() - self.size
        flat = np.frombuffer("".join(self.names).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = np.flatnonzero(np.bincount(flat)) if len(flat) else np.zeros(0, np.int64)
        self.code = {chr(c): i for i, c in enumerate(letters.tolist(), 1)}
        self.flat = np.searchsorted(letters, flat).astype(np.int64) + 1
        # over 64 letters some share a column, which only lifts the bound
        self.columns = -(-min(64, max(1, len(letters))) // 8) * 8
        self.kind = np.uint8 if self.size.max(initial=0) < 256 else np.int64
        row = np.repeat(np.arange(len(self.names)), self.size)
        bag = np.bincount(row * self.columns + (self.flat - 1) % self.columns, minlength=len(self.names) * self.columns).reshape(-1, self.columns).astype(self.kind)
        lengths = np.stack([self.size, self.its], 1)
        self.lengths, cls = np.unique(lengths, axis=0, return_inverse=True) if len(lengths) else (lengths, np.zeros(0, np.int64))
        cls = cls.reshape(-1)
        most_varied = np.argsort(bag.astype(np.float32).var(0))[-12:] if len(bag) else []
        order = np.lexsort([*(bag[:, c] for c in most_varied), cls])
        cls = cls[order]
        begins = np.flatnonzero(np.diff(cls, prepend=-1))
        within = np.arange(len(cls)) - np.repeat(begins, np.diff(begins, append=len(cls)))
        leaf = np.flatnonzero(within % LEAF == 0)
        place = np.cumsum(within % LEAF == 0) - 1
        self.leaf_class = cls[leaf]
        self.member = np.full((len(leaf), LEAF), -1, np.int64)
        self.member[place, within % LEAF] = order
        self.bag = np.zeros((len(leaf), LEAF, self.columns), self.kind)
        self.bag[place, within % LEAF] = bag[order]
        self.most = np.ascontiguousarray(self.bag.max(1, initial=0).T)
        self.steps = [(self.most >= k).astype(np.uint8) for k in range(1, min(STEPS, int(self.most.max(initial=0))) + 1)]

    def _pick(self, share: float) -> None:
        """The names by their rarest words: those that share `share` of their letters share one of these words."""
        self.picked, self.picked_at = defaultdict(list), share
        for i, ws in enumerate(self.words):
            for w in _rarest(ws, self.times, share):
                self.picked[w].append(i)

    def _level(self, word: str, la: int, top: int, far: bool) -> list[int]:
        """The first names with this word whose length is 1.5 to 8 times (far: over 8 times) apart from la."""
        if (key := (word, la, far)) not in self.levels:
            if word not in self.arrays:
                self.arrays[word] = np.array(self.holders.get(word, []), np.int64)
            own = self.arrays[word]
            low, high = np.minimum(self.size[own], la), np.maximum(self.size[own], la)
            self.levels[key] = own[(high > 8 * low) if far else (high >= 1.5 * low) & (high <= 8 * low)][:top].tolist()
        return self.levels[key]

    def _bags(self, payers: list[str]) -> np.ndarray:
        kind = np.uint8 if self.kind == np.uint8 and max(map(len, payers)) < 256 else np.int64
        out = np.zeros((len(payers), self.columns), kind)
        for p, a in enumerate(payers):
            for c in a:
                if c in self.code:
                    out[p, (self.code[c] - 1) % self.columns] += 1
        return out

    def _near_leaves(self, bags: np.ndarray) -> np.ndarray:
        """The most letters that any name of a leaf can have in common with each payer."""
        out = np.zeros((len(bags), len(self.most[0])), bags.dtype)
        for row, bag in zip(out, bags, strict=True):
            for c in np.flatnonzero(bag).tolist():
                for step in self.steps[: int(bag[c])]:
                    row += step[c]
                if bag[c] > STEPS:
                    row += np.minimum(np.maximum(self.most[c], STEPS) - STEPS, int(bag[c]) - STEPS).astype(bags.dtype)
        return out

    def _near(self, bags: np.ndarray, least: np.ndarray, payer: np.ndarray, leaf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Payer, name and letters in common of all pairs in these leaves with at least `least` (payer, class) of them."""
        for s in range(0, len(payer), PAIRS // LEAF):
            p, f = payer[s : s + PAIRS // LEAF], leaf[s : s + PAIRS // LEAF]
            both = np.minimum(self.bag[f], bags[p][:, None])
            if both.dtype == np.uint8:  # eight counts in a word; their sum is below 256, as the strings are
                words = both.view(np.uint64)
                shared = words[..., 0].copy()
                for k in range(1, words.shape[-1]):
                    shared += words[..., k]
                shared = ((shared * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int64)
            else:
                shared = both.sum(-1).astype(np.int64)
            i, k = np.nonzero((shared >= least[p, self.leaf_class[f]][:, None]) & (self.member[f] >= 0))
            yield p[i], self.member[f[i], k], shared[i, k]

    def _common(self, payers: list[str], p: np.ndarray, n: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences of pairs; of payers with over 64 letters the letters in common."""
        la = np.array([len(a) for a in payers])
        bits = np.zeros((len(payers), len(self.code) + 1), np.uint64)
        for i, a in enumerate(payers):
            for k, c in enumerate(a[:64]):
                if c in self.code:
                    bits[i, self.code[c]] |= np.uint64(1 << k)
        full = np.array([(1 << min(64, len(a))) - 1 for a in payers], np.uint64)
        turn = np.argsort(-self.size[n], kind="stable")
        own, at = p[turn], self.at[n[turn]]
        free, longer = full[own], -self.size[n[turn]]
        for j in range(int(-longer[0]) if len(longer) else 0):
            k = int(np.searchsorted(longer, -j, "left"))  # names with over j letters
            f = free[:k]
            hit = f & bits[own[:k], self.flat[at[:k] + j]]
            free[:k] = (f + hit) | (f - hit)
        out = np.empty(len(p), np.int64)
        out[turn] = la[own] - np.bitwise_count(free & full[own])
        return np.where(la[p] > 64, shared, out)

    def closest(self, payers: list[str], floors: list[float], scorer: str, top: int, floor: float) -> Iterator[tuple[int, int, float]]:
        """(payer, name, score) of the `top` best of each payer that score its own floor or more, which are `floor` at least; ties by
        name and owner. Indexes are those of the names as given."""
        if not self.names:
            return
        token = floor / {"wratio": 95, "token_set_ratio": 100}.get(scorer, 1)
        share = token / (2 - token) if token <= 1 + SLACK else 2.0
        by_words = scorer in ("wratio", "token_set_ratio")
        if by_words and (self.picked_at is None or self.picked_at > share):
            self._pick(share)
        self.levels: dict[tuple[str, int, bool], list[int]] = {}
        for s in range(0, len(payers), PAYERS):
            some = [_Best(self, a, t, scorer, top, t <= floor) for a, t in zip(payers[s : s + PAYERS], floors[s : s + PAYERS], strict=True)]
            if by_words:
                for b in some:
                    b.by_words()
            yield from ((s + k, self.order[i], x) for k, i, x in self._by_letters(some, scorer))

    def _by_letters(self, some: list[_Best], scorer: str) -> Iterator[tuple[int, int, float]]:
        texts = [b.text for b in some]
        bags = self._bags(texts)
        la, own = (np.array([getattr(b, k) for b in some], float)[:, None] for k in ("size", "own"))
        most = self._near_leaves(bags)
        fresh = np.array([b.fresh for b in some])
        for first in (True, False) if fresh.any() else (False,):
            t = np.array([b.least for b in some])[:, None]
            least = np.ceil(np.maximum(0, _letters(scorer, t, la, own, *self.lengths.T[:, None].astype(float)) - SLACK))
            if bags.dtype == np.uint8:
                least = np.minimum(least, 255).astype(np.uint8)
            near = most >= least[:, self.leaf_class]
            if first:  # the leaves that promise most, so that less is left to look at
                near &= fresh[:, None]
                lead = np.where(near, most / np.maximum(1.0, least)[:, self.leaf_class], 0)
                if lead.shape[1] > FIRST:
                    near &= lead >= np.partition(lead, -FIRST, axis=1)[:, [-FIRST]]
            for p, n, shared in self._near(bags, least, *np.nonzero(near)):
                whole = self._common(texts, p, n, shared)
                bound = _bound(scorer, whole, shared, la[p, 0], own[p, 0], self.size[n], self.its[n])
                turn = np.lexsort((n, -bound, p))
                p, n, bound, whole = p[turn], n[turn].tolist(), bound[turn].tolist(), whole[turn].tolist()
                edges = np.searchsorted(p, np.arange(len(some) + 1)).tolist()
                for b, i, j in zip(some, edges, edges[1:], strict=False):
                    for k in range(i, j):
                        if bound[k] < b.least - SLACK:
                            break
                        b.offer(n[k], whole[k])
        for k, b in enumerate(some):
            yield from ((k, i, -x) for x, i in b.found)

    def close(self, a: str, scorer: str, floor: float, top: int, owners: list[int]) -> list[tuple[int, float]]:
        """The `top` best (row, score) of at least `floor`, ties by name and owner."""
        if self.laid != (id(owners),):
            self._lay(owners)
        return [(i, x) for _, i, x in self.closest([a], [floor], scorer, top, floor)]


def _letters(scorer: str, t: np.ndarray, la: np.ndarray, own: np.ndarray, n: np.ndarray, its: np.ndarray) -> np.ndarray:
    """The letters that strings of la and n letters (own and its in distinct words) must have in common to score t, unless by shared words alone."""
    low, high, words = np.minimum(la, n), np.maximum(la, n), np.minimum(own, its)
    if scorer == "levenshtein":
        return t / 100 * high
    if scorer == "token_set_ratio":
        return t / 200 * (own + its)
    whole = t / 200 * (la + n)
    if scorer != "wratio":
        return whole
    scale = np.where(high <= 8 * low, 0.9, 0.6)
    part, tokens = t / 100 / scale, t / 95 / scale
    # a part has c letters in common and so c at least: 2 c >= part * (low + c)
    within = lambda x, size: np.where(x <= 1 + SLACK, np.minimum(x, 1) / (2 - np.minimum(x, 1)) * size, np.inf)
    return np.where(high < 1.5 * low, np.minimum(whole, t / 190 * (own + its)), np.minimum(whole, np.minimum(within(part, low), within(tokens, words))))


def _bound(scorer: str, whole: np.ndarray, shared: np.ndarray, la: np.ndarray, own: np.ndarray, n: np.ndarray, its: np.ndarray) -> np.ndarray:
    """The most that pairs can score, unless by shared words alone, given their common subsequence and letters."""
    low, high, words = np.minimum(la, n), np.maximum(la, n), np.minimum(own, its)
    if scorer == "levenshtein":
        return 100.0 * whole / np.maximum(1, high)
    ratio, sets = 200.0 * whole / np.maximum(1, la + n), np.minimum(100.0, 200.0 * shared / np.maximum(1, own + its))
    sort = 200.0 * shared / np.maximum(1, la + n)
    if scorer != "wratio":
        return {"ratio": ratio, "token_sort_ratio": sort, "token_set_ratio": sets}[scorer]
    scale = np.where(high <= 8 * low, 90.0, 60.0)
    parts = np.maximum(200.0 * whole / np.maximum(1, low + whole), 0.95 * np.minimum(100.0, 200.0 * shared / np.maximum(1, words + shared))) * scale / 100
    return np.maximum(ratio, np.where(high < 1.5 * low, 0.95 * np.maximum(sort, sets), parts))


class _Best:
    """The best names of one payer so far; `least` is what the next must score."""

    def __init__(self, known: Choices, text: str, least: float, scorer: str, top: int, fresh: bool):
        self.known, self.text, self.least, self.top, self.scorer, self.fresh = known, text, least, top, scorer, fresh
        self.words, self.size, self.score = _words(text), len(text), globals()[scorer]
        self.own = max(0, sum(self.words.values()) - 1)
        self.found: list[tuple[float, int]] = []  # (-score, index)
        self.seen: set[int] = set()

    def add(self, i: int, score: float) -> None:
        if score >= self.least:
            insort(self.found, (-score, i))
            del self.found[self.top :]
            if len(self.found) == self.top:
                self.least = max(self.least, -self.found[-1][0])

    def offer(self, i: int, whole: int) -> None:
        """whole: the length of the common subsequence with name i, or more."""
        if i in self.seen:
            return
        self.seen.add(i)
        name = self.known.names[i]
        if self.scorer == "wratio" and self._apart(i):
            part, alike = self._part(i, whole), self._alike(i)
            if alike is not None:
                if part <= alike - SLACK:
                    return  # as good as the names that by_words has added
            elif part < self.least - SLACK:
                x, y = " ".join(sorted(self.words)), " ".join(sorted(self.known.words[i]))
                if self._scale(i) * 0.95 * 200.0 * (c := _common(x, y)) / max(1, min(len(x), len(y)) + c) < self.least - SLACK:
                    return
        self.add(i, self.score(self.text, name))

    def _apart(self, i: int) -> bool:
        n = int(self.known.size[i])
        return max(n, self.size) >= 1.5 * min(n, self.size)

    def _scale(self, i: int) -> float:
        n = int(self.known.size[i])
        return 0.9 if max(n, self.size) <= 8 * min(n, self.size) else 0.6

    def _alike(self, i: int) -> float | None:
        """What a shared word gives to strings whose lengths are far apart."""
        return None if self.words.keys().isdisjoint(self.known.words[i]) else 0.95 * self._scale(i) * 100.0

    def _part(self, i: int, whole: int) -> float:
        """The most that the strings as they are and parts of them can give."""
        n = int(self.known.size[i])
        return max(200.0 * whole / (self.size + n), self._scale(i) * 200.0 * whole / max(1, min(n, self.size) + whole))

    def by_words(self) -> None:
        """Names that shared words alone can lift to the floor: all whose shared words are nearly one of the strings, and the first
        of those that a shared word gives one and the same score."""
        known, token = self.known, self.least / (95 if self.scorer == "wratio" else 100)
        if token <= 1 + SLACK:
            near: set[int] = set()
            for w in self.words:
                near.update(known.picked.get(w, ()))
            for w in _rarest(self.words, known.times, min(token, 1) / (2 - min(token, 1))):
                near.update(known.holders.get(w, ()))
            rated = []
            for i in near:
                s = max(0, sum(n for w, n in known.words[i].items() if w in self.words) - 1)
                rated.append((-200.0 * s / max(1, s + min(self.own, int(known.its[i]))) * (0.95 if self.scorer == "wratio" else 1), i))
            for bound, i in sorted(rated):
                if -bound < self.least - SLACK:
                    break
                if self.scorer != "wratio" or not self._apart(i):
                    self.seen.add(i)
                    self.add(i, self.score(self.text, known.names[i]))
        if self.scorer == "wratio":
            for far, score in ((False, 0.95 * 0.9 * 100.0), (True, 0.95 * 0.6 * 100.0)):
                if score >= self.least:
                    first = sorted({i for w in self.words for i in known._level(w, self.size, self.top, far)})[: self.top]
                    for i in first:
                        self.seen.add(i)
                        whole = _common(self.text, known.names[i])
                        self.add(i, score if self._part(i, whole) <= score - SLACK else wratio(self.text, known.names[i]))
