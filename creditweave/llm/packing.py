"""Lexical retrieval packing: sequences of a fixed length, filled from each seed document's nearest unused neighbours.

Documents are encoded once; how many documents have a term is counted over all of them. Shards are runs of documents sorted
by their rarest shared terms, or runs of the source mix; each keeps a BM25 inverted index over token ids. The best unused
neighbours of a seed fill its window; the one that does not fit whole goes on in the next window, whose seed it becomes.
So only the last sequence of a task has padding."""

from __future__ import annotations

import json
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, durable

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SHARD_DOCS, SHARD_TOKENS = 1000, 1 << 19


# How byte-level BPE cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranks(vocabulary: dict[str, int], special: set[str]) -> dict[bytes, int]:
    """Byte strings of a byte-level vocabulary, whose printable stand-ins for bytes are undone; ids are merge ranks."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t not in special}


class Encoder:
    """Token ids of whole texts, as little-endian 32-bit bytes.

    A byte-level tokenizer's own merges are run by tiktoken, several times as fast; texts that may hold a special token, and
    all texts of other tokenizers, are left to the tokenizer itself."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.merges = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.shape = _shape(self.tokenizer.get_vocab_size(with_added_tokens=True))
        self.special = [t["content"] for t in model.get("added_tokens") or []]
        if (model.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not model.get("normalizer") and not model["pre_tokenizer"].get("add_prefix_space"):
            self.merges = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=_ranks(model["model"]["vocab"], set(self.special)), special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        slow = [self.merges is None or any(s in t for s in self.special) for t in texts]
        whole = iter(self.tokenizer.encode_batch_fast([t for t, s in zip(texts, slow, strict=True) if s], add_special_tokens=False))
        return [array("I", next(whole).ids if s else self.merges.encode_ordinary(t)).tobytes() for t, s in zip(texts, slow, strict=True)]


_encoders: dict[str, Encoder] = {}


class Bm25:
    """An index of one shard: terms of over an eighth of its documents in one dense product, for all others an inverted list.

    df (documents of a term, by term) and mean (tokens a document) are those of the whole corpus of `total` documents; the
    shard's own stand in for them where they are not given."""

    def __init__(self, docs: list[np.ndarray], df: np.ndarray | None = None, total: int = 0, mean: float = 0.0, k1: float = 1.2, b: float = 0.75):
        n = len(docs)
        size = np.array([len(d) for d in docs])
        width = int(max((int(d.max()) for d in docs if len(d)), default=0)) + 1
        kind = np.uint32 if n * width < 1 << 32 else np.int64  # narrow numbers are sorted in half the time
        pairs, tf = np.unique(np.repeat(np.arange(n, dtype=kind) * kind(width), size) + np.concatenate([*docs, np.zeros(0, kind)]).astype(kind), return_counts=True)
        which, term = (pairs // kind(width)).astype(np.int64), (pairs % kind(width)).astype(np.int64)
        held = np.bincount(term, minlength=width)
        names = np.flatnonzero(held)
        own = held[names]
        df, total, mean = (own, n, size.mean() if n else 0.0) if df is None else (df[names], total, mean)
        idf = np.zeros(width)
        idf[names] = np.log1p((total - df + 0.5) / (df + 0.5))
        norm = k1 * (1 - b + b * size / max(mean, 1e-9))
        weight = idf[term] * tf * (k1 + 1) / (tf + norm[which])
        common = held > n / 8  # so the dense side has at most eight numbers for each pair of a document and a term of it
        dense = common[term]
        column = np.cumsum(common) - 1
        has, weighs = np.zeros((2, n, int(common.sum())))
        has[which[dense], column[term[dense]]] = 1
        weighs[which[dense], column[term[dense]]] = weight[dense]
        self.base = has @ weighs.T
        which, term, weight = which[~dense], term[~dense], weight[~dense]
        self.terms, self.term = np.searchsorted(which, np.arange(n + 1)), term  # of each document in `term`
        order = np.argsort(term.astype(np.uint16) if width <= 1 << 16 else term, kind="stable")
        self.held = np.where(common, 0, held)
        self.at = np.cumsum(self.held) - self.held
        self.docs, self.weight, self.n = which[order], weight[order], n

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard for all the seed's terms."""
        t = self.term[self.terms[seed] : self.terms[seed + 1]]
        if not len(t):
            return self.base[seed]
        some = self.held[t]
        post = np.repeat(self.at[t] - (some.cumsum() - some), some) + np.arange(some.sum())
        return self.base[seed] + np.bincount(self.docs[post], self.weight[post], self.n)


def fill_order(index: Bm25, sizes: list[int], at: int, length: int) -> list[int]:
    """All documents of a shard, in the order in which they fill windows of `length` tokens, the first of which has `at` already.

    A window's seed is the document that comes into it from the one before, or the first unused one; its best unused
    neighbours follow until the window is full, and unused ones in their order where it has no more."""
    n, order = index.n, []
    unused, first, seed = np.ones(n, bool), 0, None

    def take(d: int) -> None:
        nonlocal at, seed
        order.append(d)
        unused[d] = False
        at, seed = (at + sizes[d]) % length, (d if sizes[d] > length - at else None)

    while len(order) < n:
        if seed is None:
            while not unused[first]:
                first += 1
            own = first
            take(first)
        else:
            own = seed
        if at == 0:
            seed = None
            continue
        found = np.where(unused, index.scores(own), 0.0)
        seed = None
        while at and seed is None and found[best := int(found.argmax())] > 0:
            found[best] = 0.0
            take(best)
        while at and seed is None and len(order) < n:
            while not unused[first]:
                first += 1
            take(first)
    return order


def _shape(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def encode(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """docs with `text` replaced by `ids`: its token ids and end_id, as little-endian 16-bit numbers (32-bit ones where the
    vocabulary has over 65,536 entries). A null text is an empty one."""
    names = [c for c in docs.columns if c not in ("text", "ids")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), "ids binary"])

    def run(batches):
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        coder = _encoders[tokenizer]
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                ids = [np.append(np.frombuffer(c, "<u4"), end_id).astype(coder.shape).tobytes() for c in coder.encode(part.column(len(names)).to_pylist())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(ids, pa.binary())], names=[*names, "ids"])

    return docs.select(*(F.col(f"`{c}`") for c in names), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


class Corpus:
    """Documents of each term and mean length over all encoded documents; as many numbers as the vocabulary has."""

    def __init__(self, coded: DataFrame, shape: str):
        def count(batches):
            found, total, tokens = np.zeros(0, np.int64), 0, 0
            for batch in batches:
                for ids in batch.column(0):
                    own = np.frombuffer(ids.as_buffer(), shape)
                    if len(own) and own.max() >= len(found):
                        found = np.append(found, np.zeros(int(own.max()) + 1 - len(found), np.int64))
                    found[own] += 1  # once, however often the document has the term
                    total, tokens = total + 1, tokens + len(own)
            own = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(own, [-1, -2])), pa.array(np.append(found[own], [total, tokens]))], names=["term", "n"])

        rows = coded.select("ids").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # the vocabulary at most
        counts = {r["term"]: r["n"] for r in rows}
        self.total, tokens = counts.pop(-1, 0), counts.pop(-2, 0)
        self.mean = tokens / max(self.total, 1)
        self.df = np.zeros(1 + max(counts, default=0), np.int64)
        self.df[[*counts]] = [*counts.values()]
        shared = np.where(self.df > 1, self.df, np.iinfo(np.int64).max)
        self.rank = np.empty(len(self.df), np.int32)
        self.rank[np.lexsort((np.arange(len(shared)), shared))] = np.arange(len(shared))  # the rarest shared term first


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0) -> DataFrame:
    """A row for each piece (PIECE) of all documents, each ended by end_id, in sequences of `length` tokens.

    Null and empty texts are their end_id alone. Long texts are cut into as many pieces as they need. Repeated rows are
    packed as often as they stand there; a null doc_id is kept as null. No rows give no rows. Documents are sorted by their
    four rarest terms that others share, so shards (runs of that order) hold documents that share rare terms."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    coded, shape = durable(encode(base, tokenizer, end_id), "coded"), _shape(_vocabulary(tokenizer))
    corpus = Corpus(coded, shape)
    keyed = durable(_by_content(coded, corpus, shape), "keyed")  # else the keys are worked out twice: ranges are drawn from a sample of them
    drop(coded)
    return _fill(keyed, ["key", "doc_id"], corpus, shape, length)


def pack_mixed(mixed: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0) -> DataFrame:
    """As pack(), of documents with the slot and block_offset that mixing.mix gave them: shards are runs of that order, and
    sequence_id rises with it. So a run of sequences holds the mix of its slots."""
    base = mixed.select(F.col("doc_id").cast("long").alias("doc_id"), "slot", "block_offset", "text")
    coded, shape = durable(encode(base, tokenizer, end_id), "coded"), _shape(_vocabulary(tokenizer))
    return _fill(coded, ["slot", "block_offset", "doc_id"], Corpus(coded, shape), shape, length)


def _vocabulary(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True)


def _by_content(coded: DataFrame, corpus: Corpus, shape: str) -> DataFrame:
    """coded with `key`: the ranks of a document's four rarest shared terms (three, of a large vocabulary), the rarest first."""
    known = coded.sparkSession.sparkContext.broadcast(corpus.rank)  # a number for each term
    terms, bits = (4, 15) if len(corpus.rank) <= 1 << 15 else (3, 20)
    most = (1 << bits) - 1

    def run(batches):
        for batch in batches:
            keys = np.zeros(batch.num_rows, np.int64)
            for i, ids in enumerate(batch.column(1)):
                ranks, key = known.value[np.frombuffer(ids.as_buffer(), shape)], 0
                for _ in range(terms):
                    least = min(int(ranks.min(initial=most)), most)
                    key, ranks = key << bits | least, ranks[ranks > least]
                keys[i] = key
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys)], names=["doc_id", "ids", "key"])

    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, key long")


def _fill(coded: DataFrame, keys: list[str], corpus: Corpus, shape: str, length: int) -> DataFrame:
    """Pieces of the documents in the order of `keys`: a task packs a range of it, a shard of at most SHARD_DOCS documents and
    SHARD_TOKENS tokens (or one document) at a time. Only the last sequence of a task has padding."""
    known = coded.sparkSession.sparkContext.broadcast((corpus.df, corpus.total, corpus.mean))

    def run(batches):
        df, total, mean = known.value
        first, at, ids, names, tokens = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def shard():
            nonlocal at
            rows = []
            for d in fill_order(Bm25(ids, df, total, mean), [len(x) for x in ids], at % length, length):
                wide, size, start = memoryview(ids[d].astype("<u4").tobytes()), len(ids[d]), 0
                while start < size:
                    some = min(size - start, length - at % length)
                    rows.append((d, start, some, zlib.crc32(wide[4 * start : 4 * (start + some)]), size, first + at // length, at % length))
                    start, at = start + some, at + some
            cols = np.array(rows, np.int64).reshape(-1, 7).T
            owners = pa.concat_arrays(names).take(pa.array(cols[0]))
            return pa.RecordBatch.from_arrays([owners, *map(pa.array, cols[1:])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for i, x in enumerate(batch.column(1)):
                own = np.frombuffer(x.as_py(), shape)
                if ids and (len(ids) >= SHARD_DOCS or tokens + len(own) > SHARD_TOKENS):
                    yield shard()
                    ids, names, tokens = [], [], 0
                ids.append(own)
                names.append(batch.column(0).slice(i, 1))
                tokens += len(own)
        if ids:
            yield shard()

    ordered = coded.repartitionByRange(*keys).sortWithinPartitions(*keys, F.xxhash64("ids"))
    return ordered.select("doc_id", "ids").mapInArrow(run, PIECE)
