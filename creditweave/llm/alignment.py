"""Alignment of two tokenizers' tokens by a dangling-suffix transducer.

Both token sequences spell the same bytes. A state of the transducer is the side that leads and the bytes by which it leads;
the other side's next token either is covered by them, or covers them and takes the lead. The empty residual closes a group.
Transitions are memoised by residual and next token. Before a single space between two letters both tokenizers begin a token, so the
residual is empty there: the way through such a word, from empty residual to empty residual, is memoised as well.
What a link can be is bounded by the vocabularies: of two tokens that end together one is a suffix of the other."""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, durable
from .packing import PATTERN, _ranks

#: Transitions, words and tokens of words that a task remembers; text bytes that it aligns at once.
TRANSITIONS, WORDS, TOKENS, BATCH_BYTES = 500_000, 200_000, 4_000_000, 1 << 20
ALIGNED = "a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>"
_DIGEST = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<long>, times array<int>"
_SPACE, _SINGLE = "▁", re.compile(r"(?<=\S) (?=\S)")


class Tokenizers:
    """A byte-level BPE (A) and a sentence-piece model with byte fallback (B): ids of texts and bytes of every entry."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"]: t["id"] for t in model.get("added_tokens") or []}
        ranks = _ranks(model["model"]["vocab"], set(special))
        self.a = tiktoken.Encoding(a_path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.a_bytes[i] = token
        piece, n = self.b.id_to_piece, self.b.get_piece_size()
        # If no entry holds a space after another letter, none crosses the start of a word.
        self.by_words = all(_SPACE not in piece(i).lstrip(_SPACE) for i in range(n))
        self.b_bytes = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace(_SPACE, " ").encode() for i in range(n)]

    def most_links(self) -> int:
        """How many different pairs of ids can end together: a suffix of a token stands for at most `same` tokens of the other side."""
        out = 0
        for x, y in ((self.a_bytes, self.b_bytes), (self.b_bytes, self.a_bytes)):
            _, counts = np.unique(np.array([t.hex() for t in y]), return_counts=True)
            out += sum(map(len, x)) * int(counts.max())
        return out


class _Differ(ValueError):
    """The two sequences spell different bytes."""


class _State(dict):
    """The side that moves next, the residual that it meets, and the states after its tokens so far."""

    __slots__ = ("b_moves", "machine", "residual")

    def __missing__(self, token: int) -> _State:
        return self.machine.move(self, token)


class Transducer:
    """Cuts two token sequences where both end at the same byte."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.bytes_of = (a_bytes, b_bytes)
        self.forget()

    def forget(self) -> None:
        """Starts over with no transitions."""
        self.states: dict[tuple[bool, bytes], _State] = {}
        self.root, self.known = self._state(False, b""), 0

    def _state(self, b_moves: bool, residual: bytes) -> _State:
        key = (b_moves and residual != b"", residual)
        if key not in self.states:
            self.states[key] = new = _State()
            new.machine, (new.b_moves, new.residual) = self, key
        return self.states[key]

    def move(self, state: _State, token: int) -> _State:
        """The state after `token` of the side that moves."""
        t, residual = self.bytes_of[state.b_moves][token], state.residual
        if residual.startswith(t):
            after = self._state(state.b_moves, residual[len(t) :])
        elif t.startswith(residual):
            after = self._state(not state.b_moves, t[len(residual) :])
        else:
            raise _Differ
        state[token] = after
        self.known += 1
        return after

    def groups(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]] | None:
        """For each group how many tokens of a, and of b, end with it or before; None if the bytes of a and b differ."""
        if self.known > TRANSITIONS:
            self.forget()
        i = j = 0
        n, root = len(a), self.root
        a_ends, b_ends = [], []
        try:
            while i < n:
                state = root[a[i]]
                i += 1
                while state is not root:
                    if state.b_moves:
                        state = state[b[j]]
                        j += 1
                    else:
                        state = state[a[i]]
                        i += 1
                a_ends.append(i)
                b_ends.append(j)
        except (IndexError, _Differ):  # a side ends early, or the bytes differ
            return None
        return (a_ends, b_ends) if j == len(b) else None


class Ragged:
    """Rows of numbers of different lengths, one after the other."""

    def __init__(self, values: np.ndarray, at: np.ndarray):
        self.values, self.at = values, at

    @staticmethod
    def of(rows: list) -> Ragged:
        at = np.cumsum([0, *map(len, rows)], dtype=np.int64)
        return Ragged(np.fromiter(chain.from_iterable(rows), np.int32, int(at[-1])), at)

    def add(self, more: Ragged) -> Ragged:
        return Ragged(np.concatenate([self.values, more.values]), np.concatenate([self.at, more.at[1:] + self.at[-1]]))

    def take(self, rows: np.ndarray) -> Ragged:
        size = (self.at[1:] - self.at[:-1])[rows]
        at = np.concatenate([[0], size.cumsum()])
        place = np.repeat(self.at[rows] - at[:-1], size) + np.arange(at[-1])
        return Ragged(self.values[place], at)

    def joined(self, ends: np.ndarray) -> Ragged:
        """The same numbers in longer rows; ends are the first row behind each, from 0."""
        return Ragged(self.values, self.at[ends])

    def arrow(self) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(self.at.astype(np.int32)), pa.array(self.values.astype(np.int32)))


class Aligner:
    """Aligns texts by their words, each of which goes through tokenizers and transducer once, while it is remembered."""

    def __init__(self, a_path: str, b_path: str):
        self.both = Tokenizers(a_path, b_path)
        self.transducer = Transducer(self.both.a_bytes, self.both.b_bytes)
        self.a_size = np.array([len(t) for t in self.both.a_bytes])
        self.forget()

    def forget(self) -> None:
        self.row: dict[str, int] = {}
        self.kept = [Ragged.of([]) for _ in range(4)]  # a_ids, b_ids, a_ends, b_ends of every known word

    def _alone(self, word: str) -> tuple | None:
        """The tokens and group ends of space + word; None where either side does not spell it."""
        a, b = self.both.a.encode_ordinary(" " + word), self.both.b.encode(word)
        found = self.transducer.groups(a, b)
        return (a, b, *found) if found and self.both.a.decode_bytes(a) == (" " + word).encode() else None

    def _together(self, words: list[str]) -> list[Ragged] | None:
        """The same of many words, joined by single spaces; None where their ends don't show."""
        text = " ".join(words)
        found = self._alone(text) if words else None
        if not found:
            return None
        a, b, a_ends, b_ends = (np.array(x, np.int64) for x in found)
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        spelt = self.a_size[a].cumsum()[a_ends - 1]
        group = np.minimum(np.searchsorted(spelt, ends), len(spelt) - 1)
        if not np.array_equal(spelt[group], ends):
            return None
        g_at, a_at, b_at = (np.concatenate([[0], x]) for x in (group + 1, a_ends[group], b_ends[group]))
        size = np.diff(g_at)
        return [Ragged(a, a_at), Ragged(b, b_at), Ragged(a_ends - np.repeat(a_at[:-1], size), g_at), Ragged(b_ends - np.repeat(b_at[:-1], size), g_at)]

    def _learn(self, words: set[str]) -> None:
        """Adds words; those that are not spelt get a row without tokens."""
        plain = [w for w in words if w and _SPACE not in w and not w[0].isspace() and not w[-1].isspace()]
        many = self._together(plain)
        if many is None:
            plain = []
        rest = list(words.difference(plain))
        few = [() if _SPACE in w else self._alone(w) or () for w in rest]
        few = [Ragged.of([f[i] if f else [] for f in few]) for i in range(4)]
        for w in chain(plain, rest):
            self.row[w] = len(self.row)
        for part in ([many] if many else []) + [few]:
            self.kept = [k.add(p) for k, p in zip(self.kept, part, strict=True)]

    def align(self, texts: list[str]) -> tuple[Ragged, Ragged, Ragged, Ragged]:
        """Of each text the ids of A, the ids of B, and for each group how many tokens of A, and of B, end with it or before."""
        if len(self.row) > WORDS or len(self.kept[0].values) > TOKENS:
            self.forget()
        words = [([t] if not self.both.by_words else _SINGLE.split(t)) if t else [] for t in texts]
        every = list(chain.from_iterable(words))
        if new := set(every).difference(self.row):
            self._learn(new)
        rows = np.fromiter(map(self.row.__getitem__, every), np.int64, len(every))
        text = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        spelt = np.bincount(text, np.diff(self.kept[0].at)[rows] == 0, len(texts)) == 0
        rows, text = rows[spelt[text]], text[spelt[text]]
        a, b, a_ends, b_ends = (k.take(rows) for k in self.kept)
        ends = np.searchsorted(text, np.arange(len(texts) + 1))
        for each, side in ((a_ends, a), (b_ends, b)):  # from a word's own tokens to its text's
            before = side.at[:-1] - side.at[ends[:-1]][text]
            each.values = each.values + np.repeat(before, np.diff(each.at))
        return tuple(x.joined(ends) for x in (a, b, a_ends, b_ends))


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(a_path: str, b_path: str) -> Aligner:
    """Once a Python worker."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def _pieces(batch: pa.RecordBatch, column: int):
    """Row ranges of the batch of about BATCH_BYTES of text, or of one row."""
    sizes = batch.column(column).cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(sizes.buffers()[1], np.int64, len(sizes) + 1, 8 * sizes.offset)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(at, at[a] + BATCH_BYTES, "right")) - 1)
        yield a, min(b, batch.num_rows)
        a = b


def _map(docs: DataFrame, a_path: str, b_path: str, keep: list[str] | None, added: str, make) -> DataFrame:
    """docs' columns (only `keep`), and what make() gives of the alignment of some texts."""
    new = [c.split()[0] for c in added.split(", ")]
    names = [c for c in (docs.columns if keep is None else keep) if c not in new]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), added])

    def run(batches):
        aligner = _aligner(a_path, b_path)
        for batch in batches:
            for a, b in _pieces(batch, len(names)):
                part = batch.slice(a, b - a)
                got = make(*aligner.align([t or "" for t in part.column(len(names)).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), *got], names=[*names, *new])

    return docs.select(*(F.col(f"`{c}`") for c in names), F.col("text").alias("_text")).mapInArrow(run, schema)


def align(docs: DataFrame, a_path: str, b_path: str, keep: list[str] | None = None) -> DataFrame:
    """docs' columns (only `keep`, if given), and the tokens of space + text by A, of text by B (which adds the space itself), with
    the groups: a_ends and b_ends hold, for each group, how many tokens of either side end with it or before.

    No special tokens are added and their strings inside texts are plain text. All four arrays are empty where text is null or
    empty, or where either side's tokens don't spell space + text. Rows are independent: repeats give repeats, no rows give none.
    Columns of docs named like a result are replaced."""
    return _map(docs, a_path, b_path, keep, ALIGNED, lambda *parts: [p.arrow() for p in parts])


_figures: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each number of at most as many digits as `most`, its digits with room for a mark, and how many there are."""
    width = len(str(most))
    if width not in _figures:
        n = np.arange(10**width)
        digits = 1 + sum((n >= 10**k).astype(np.int64) for k in range(1, width))
        table = np.zeros((len(n), width + 1), np.uint8)
        for k in range(width):
            has = digits > k
            table[has, k] = 48 + n[has] // 10 ** (digits[has] - 1 - k) % 10
        _figures[width] = table, digits
    return _figures[width]


def _written(a: Ragged, b: Ragged, a_ends: Ragged, b_ends: Ragged) -> tuple[bytes, np.ndarray]:
    """`a1,a2|b1;a3|b2,b3;`: the ids of every group of every text, and where each text begins."""
    ends_a, ends_b = (e.values + np.repeat(s.at[:-1], np.diff(e.at)) for e, s in ((a_ends, a), (b_ends, b)))
    of_a, of_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
    n = len(a.values) + len(b.values)
    at_a = np.arange(len(a.values)) + np.repeat(ends_b - of_b, of_a)  # behind the ids of all groups before, and of its own before it
    at_b = np.arange(len(b.values)) + np.repeat(ends_a, of_b)
    ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[at_a], ids[at_b] = a.values, b.values
    mark[at_a[ends_a - 1]], mark[at_b[ends_b - 1]] = ord("|"), ord(";")
    table, digits = _decimals(int(ids.max(initial=0)))
    out, size = table[ids], digits[ids]
    out[np.arange(n), size] = mark
    begins = np.concatenate([[0], (size + 1).cumsum()])[a.at + b.at]
    return out[np.arange(out.shape[1]) <= size[:, None]].tobytes(), begins


def _digest(a: Ragged, b: Ragged, a_ends: Ragged, b_ends: Ragged) -> list[pa.Array]:
    """Sizes and digest of each text's alignment, and its different links (a_id << 32 | b_id) with how often."""
    text, at = _written(a, b, a_ends, b_ends)
    sha = [hashlib.sha256(text[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    last_a, last_b = (s.values[e.values + np.repeat(s.at[:-1], np.diff(e.at)) - 1].astype(np.int64) for e, s in ((a_ends, a), (b_ends, b)))
    pair, links, times = last_a << 32 | last_b, [], []
    for x, y in zip(a_ends.at[:-1].tolist(), a_ends.at[1:].tolist(), strict=True):
        own, often = np.unique(pair[x:y], return_counts=True)
        links.append(own)
        times.append(often)
    rows = pa.array(np.cumsum([0, *map(len, links)]).astype(np.int32))
    flat = [np.concatenate([*x, np.zeros(0, t)]).astype(t) for x, t in ((links, np.int64), (times, np.int32))]
    return [*(pa.array(np.diff(x.at)) for x in (a, b, a_ends, a_ends)), pa.array(sha, pa.string()), *(pa.ListArray.from_arrays(rows, pa.array(f)) for f in flat)]


def link_counts(linked: DataFrame) -> DataFrame:
    """(link, n): how many links of all rows are of this pair of ids; sums are begun before rows move."""
    each = linked.select(F.explode(F.arrays_zip("links", "times")).alias("x"))
    return each.groupBy(F.col("x.links").alias("link")).agg(F.sum("x.times").alias("n"))


def score_links(docs: DataFrame, a_path: str, b_path: str, keep: list[str] | None = None) -> DataFrame:
    """docs' columns (only `keep`), n_a, n_b (tokens), n_groups, n_links, n_best, count_sum and groups_sha256.

    A link is a pair of tokens that end at the same byte: one a group, as tokens have bytes. Its count is how many links of
    all docs join its two ids; n_best are the links with the highest count of their B id, ties included; count_sum adds the
    counts of all links. groups_sha256 is of `a1,a2|b1;a3|b2,b3` (empty without tokens). Rows without tokens have zeros. The
    counts go to every task: they can't be more than Tokenizers.most_links(), whatever the corpus, and more raise ValueError."""
    linked = durable(_map(docs, a_path, b_path, keep, _DIGEST, _digest), "links")
    table = durable(link_counts(linked), "counts")
    most = Tokenizers(a_path, b_path).most_links()
    if table.count() > most:
        raise ValueError("more pairs of ids than the two vocabularies allow")
    rows = table.orderBy("link").toArrow()
    drop(table)
    link, n = rows["link"].to_numpy(), rows["n"].to_numpy()
    highest = np.zeros(1 << 20, np.int64)
    ids = (link & 0xFFFFFFFF).astype(np.int64)
    if len(ids):
        highest = np.zeros(int(ids.max()) + 1, np.int64)
        np.maximum.at(highest, ids, n)
    known = linked.sparkSession.sparkContext.broadcast((link, n, n == highest[ids]))
    names = [c for c in linked.columns if c not in ("links", "times", "n_best", "count_sum")]
    schema = ", ".join([*(f"`{c}` {linked.schema[c].dataType.simpleString()}" for c in names), "n_best long, count_sum long"])

    def run(batches):
        link, n, best = known.value
        for batch in batches:
            at = batch.column(len(names)).offsets.to_numpy()
            pair, often = batch.column(len(names)).flatten().to_numpy(), batch.column(len(names) + 1).flatten().to_numpy().astype(np.int64)
            place = np.searchsorted(link, pair)
            sums = [np.concatenate(([0], np.cumsum(often * (v[place] if len(place) else 0)))) for v in (best.astype(np.int64), n)]
            at = at - at[0]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *(pa.array(s[at[1:]] - s[at[:-1]]) for s in sums)], names=[*names, "n_best", "count_sum"])

    return linked.select(*(F.col(f"`{c}`") for c in names), "links", "times").mapInArrow(run, schema)
