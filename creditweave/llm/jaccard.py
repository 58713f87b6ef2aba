"""N-gram Jaccard join by parity sketches.

A document's shingles are dealt by a hash to the parts of its size band, and each flips one of its part's bits. A part has
2**64 bits, so it is kept as the XOR of its set bits' hashes: shingles that two documents do not share don't meet by chance.
Two sketches of a band differ in at most as many bits, so in at most as many parts, as the sets differ in shingles.
A band has more parts than a linked pair may differ in, so by the pigeonhole principle a linked pair agrees in whole
parts: in `need` of them at least. Parts that no other document has are out; of the rest each document keeps all but
the need - 1 commonest (none, if it shares fewer than it needs), and these meet in a join. The pairs are held against
their sketches' Hamming distance and then verified by the sets themselves.

Three kinds of part keep that exact and selective. `rare` parts leave out the shingles that a sample finds common (any
set may be left out: what is left differs no more). A document with too few non-zero rare parts for the principle also
gives parts of all its shingles, and one with too few of these its shingles themselves (as short documents do: each
shingle is a part of its own). Both documents of a pair fall back alike.

Documents with the same set (two 64-bit hashes agree) are one node. Only components are asked for, so the nodes that share
a part are first held against one leader among them; pairs inside a group are compared only while their components differ.
A group of more than GROUP nodes is split by the next part that its nodes share, then by the one after, up to SPLITS parts in all.
A linked pair agrees in SPLITS parts of one kind at least, as a document with fewer than that to spare falls back to the next kind."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import bounded, drop, durable, lists, slices, utf8
from .components import connected_components

SHORT, RATIO = 48, 1.25
BROADCAST_IDS, FOLDED = 200_000, 64
#: Nodes that meet in one part before a further part must agree as well; parts by which groups are split; names that a task remembers.
GROUP, SPLITS, REMEMBERED = 1000, 4, 50_000
_RARE, _FULL, _EACH = 1, 2, 3
_NULL = -(2**63)


def band_edges(most: int) -> list[int]:
    """Smallest sizes of the bands, up to the one that holds `most`."""
    out = [SHORT]
    while out[-1] <= most:
        out.append(int(np.ceil(out[-1] * RATIO)))
    return out


def _word(tokens: np.ndarray, parts: int) -> np.ndarray:
    """The parity sketch: `parts` words of 64 bits, in which each token flips one bit."""
    out = np.zeros(parts, np.uint64)
    place = ((words.mix(tokens) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    np.bitwise_xor.at(out, place.astype(np.int64), np.uint64(1) << (tokens >> np.uint64(58)))
    return out


def _parts(tokens: np.ndarray, parts: int) -> np.ndarray:
    """The parity sketch of wide parts: of each, the XOR of the hashes of its set bits."""
    out = np.zeros(parts, np.uint64)
    h = words.mix(tokens)
    place = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    np.bitwise_xor.at(out, place.astype(np.int64), words.mix(h ^ np.uint64(0x2545F4914F6CDD1D)))
    return out


def set_names(u: np.ndarray) -> tuple[int, int]:
    """Two independent hashes of the whole set, in any order."""
    x = words.mix(u)
    y = words.mix(x ^ np.uint64(0x5851F42D4C957F2D))
    both = np.array([x.sum(dtype=np.uint64) + np.uint64(len(u)), y.sum(dtype=np.uint64) ^ np.uint64(len(u))])
    return tuple(words.mix(both).view(np.int64).tolist())


def _keys(sketch: np.ndarray, tag: int) -> np.ndarray:
    """A key for each non-zero part; the low byte is the tag."""
    part = np.flatnonzero(sketch)
    return (words.mix(sketch[part] ^ words.mix(part.astype(np.uint64) + np.uint64(tag << 40))) & ~np.uint64(255)) | np.uint64(tag)


def part_keys(u: np.ndarray, common: np.ndarray, num: int, den: int) -> tuple[np.ndarray, list[int], list[int]]:
    """Join keys of a set of shingle hashes, and by tag (band and kind) in how many of them a linked set agrees at least."""
    n = len(u)
    if n == 0:
        return u, [], []
    often = common[np.minimum(np.searchsorted(common, u), len(common) - 1)] == u if len(common) else np.zeros(n, bool)
    out, tags, needs = [], [], []

    def each() -> None:
        out.append((words.mix(u) & ~np.uint64(255)) | np.uint64(_EACH))
        tags.append(_EACH)
        needs.append(max(1, -(-num * n // den)))

    if num * n <= den * (SHORT - 1) or n < SHORT:
        each()
    if n >= SHORT:
        edges = band_edges(n)
        rare, band = u[~often], len(edges) - 2
        while True:
            limit = (edges[band + 1] - 1) * (den - num) // num  # a pair of this band differs in no more shingles
            for kind, tokens in ((_RARE, rare), (_FULL, u)):
                sketch = _parts(tokens, limit + limit // 4 + 8)
                more = np.count_nonzero(sketch) - limit
                out.append(_keys(sketch, 4 * band + kind))
                tags.append(4 * band + kind)
                needs.append(max(1, int(more)))
                if more >= SPLITS:
                    break
            else:
                if _EACH not in tags:
                    each()
            band -= 1
            if band < 0 or num * n > den * (edges[band + 1] - 1):
                break
    return np.unique(np.concatenate(out)), tags, needs


def _texts(batch: pa.RecordBatch, size: int):
    """The distinct shingle hashes of each row's text (column 1), by row."""
    buf, off = utf8(batch.column(1))
    for a, b in slices(off):
        piece = words.LOWER[buf[off[a] : off[b]]]
        starts, ends, at = words.spans(piece, off[a : b + 1] - off[a])
        runs = words.Runs(words.word_hashes(piece, starts, ends))
        grams = runs.every(size)
        yield a, b, [words.shingles(runs, at[i], at[i + 1], size, grams) for i in range(b - a)]


def _common(base: DataFrame, size: int, sample: int = 5000, share: float = 0.002, most: int = 200_000) -> np.ndarray:
    """Shingles in `share` or more of a hash sample of about `sample` documents, the `most` commonest: they only steer
    which keys are tried, so any answer gives the same links."""

    def run(batches):
        for batch in batches:
            for _a, _b, sets in _texts(batch, size):
                yield pa.RecordBatch.from_arrays([lists(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))], names=["u"])

    some = bounded(base, "_id", sample)
    counts = some.mapInArrow(run, "u array<long>").select(F.explode("u").alias("u")).groupBy("u").agg(F.count("*").alias("n"))
    rows = counts.where(F.col("n") >= max(10, int(share * sample))).orderBy(F.desc("n"), "u").limit(most).toPandas()
    return np.sort(rows["u"].to_numpy(np.int64).view(np.uint64))


def similar_documents(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100, name_bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    Words are runs other than white space of ASCII, A-Z lower-cased; a set has the distinct `size`-word shingles, or the
    whole sequence as one where there are fewer words. Two documents link when den * |both| >= num * |either|; a component
    has the smallest doc_id reachable. Documents without words (null or empty texts too) are linked with nothing: their
    component is their own. Rows that repeat a doc_id are judged by their own texts. A null id is the smallest and stays null.
    No rows give none. Shingles are told apart by 64-bit hashes, sets by 128 bits. name_bits are the bits
    of the first hash (fewer only make clashes, for tests). Raises if components do not settle in the 60 rounds of
    connected_components."""
    base = docs.select(F.coalesce("doc_id", F.lit(_NULL)).alias("_id"), F.col("text").alias("_text"))
    common = base.sparkSession.sparkContext.broadcast(_common(base, size))  # at most 200,000 hashes

    def sketch(batches):
        done: set[int] = set()  # sets that this task has given keys for of late
        for batch in batches:
            for a, b, sets in _texts(batch, size):
                names, cols = [], ([], [], [], [])
                for u in sets:
                    s, t = set_names(u)
                    names.append((s >> 64 - name_bits, t))
                    new = len(u) > 0 and names[-1][1] not in done
                    keys, tags, needs = part_keys(u if new else u[:0], common.value, num, den)
                    whole = _word(u, 1 << max(0, (len(u) - 1).bit_length() - 6)) if new else u[:0]
                    for c, v in zip(cols, (keys, np.array(tags, np.int64), np.array(needs, np.int64), whole), strict=True):
                        c.append(v)
                    if len(done) >= REMEMBERED:
                        done.clear()
                    done.add(names[-1][1])
                n = np.array([len(u) for u in sets], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n), *(pa.array(np.array(x, np.int64)) for x in zip(*names, strict=True)), *(lists(np.concatenate(c), np.cumsum([0, *map(len, c)])) for c in cols)],
                    names=["_id", "n", "s", "t", "keys", "tags", "needs", "whole"],
                )

    kind = base.schema["_id"].dataType.simpleString()
    raw = durable(base.mapInArrow(sketch, f"_id {kind}, n long, s long, t long, keys array<long>, tags array<long>, needs array<long>, whole array<long>"), "sets")
    nodes = durable(raw.where("n > 0").groupBy("s", "t").agg(F.min("_id").alias("id"), F.min("n").alias("n")), "nodes")
    # Where two sets have one s, their nodes are named by both hashes; that is so rare that mostly nothing is to be done.
    clash = durable(nodes.groupBy("s").agg(F.count("*").alias("m")).where("m > 1").select("s", F.lit(True).alias("clash")), "clash")
    if clash.limit(1).count():
        named_by = lambda x: x.join(clash, "s", "left").withColumn("s", F.when(F.col("clash"), F.xxhash64("s", "t")).otherwise(F.col("s"))).drop("clash")
    else:
        named_by = lambda x: x
    sets, node = named_by(raw), named_by(nodes)
    rows = durable(sets.select("_id", "n", "s"), "rows")

    found = sets.select("s", F.explode("keys").alias("k"))
    shared = durable(found.groupBy("k").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.count("*").alias("m")).where("lo < hi").select("k", "m"), "shared")
    met = durable(found.join(shared, "k").distinct(), "met")
    drop(shared)
    need = sets.select("s", F.explode(F.arrays_zip("tags", "needs")).alias("t")).select("s", F.col("t.tags").alias("tag"), F.col("t.needs").alias("need")).distinct()
    # A linked set agrees in `need` keys at least, so in one of all but the need - 1 commonest, and in i of all but need - i.
    own = Window.partitionBy("s", "tag")
    ranked = met.withColumn("tag", F.expr("k & 255")).withColumns({"rank": F.row_number().over(own.orderBy("m", "k")), "all": F.count("*").over(own)})
    ranked = ranked.join(need, ["s", "tag"]).where(F.expr("all >= need") & (F.col("rank") <= F.col("all") - F.col("need") + SPLITS))
    rare = durable(ranked.select("k", "s", "all", "need", "rank", F.expr("rank <= all - need + 1").alias("first")), "rare")
    drop(met)
    # The leader of a group is what shares most of its parts: an original that the others were edited from, if it is there.
    lead = rare.where("first").groupBy("k").agg(F.max(F.struct("all", "s"))["s"].alias("lead"), F.count("*").alias("m")).where("m > 1")
    met = durable(rare.where("first").select("k", "s", "need", "rank").join(durable(lead, "leaders"), "k"), "met")

    wholes = durable(sets.where("size(whole) > 0").select("s", "n", "whole"), "wholes")
    drop(raw)
    shrunk = lambda x: F.transform(F.sequence(F.lit(0), (F.size(x) / 2 - 1).cast("int")), lambda i: F.get(x, (i * 2).cast("int")).bitwiseXOR(F.get(x, (i * 2 + 1).cast("int"))))

    def near(n_a: str, n_b: str, w_a: str, w_b: str) -> Column:
        """Whether sizes and sketches allow a link; of sketches of two lengths the longer one is folded."""
        x = F.when(F.size(w_a) > F.size(w_b), shrunk(F.col(w_a))).otherwise(F.col(w_a))
        y = F.when(F.size(w_b) > F.size(w_a), shrunk(F.col(w_b))).otherwise(F.col(w_b))
        apart = F.aggregate(F.zip_with(x, y, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, c: t + c)
        return apart * (den + num) <= (F.col(n_a) + F.col(n_b)) * (den - num)

    def sketched(some: DataFrame) -> DataFrame:
        """One row of wholes for each of these nodes."""
        return wholes.join(some.select("s").distinct(), "s", "left_semi").dropDuplicates(["s"])

    def possible(pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b), those whose sizes and sketches allow a link, with both sizes."""
        its = durable(sketched(pairs.select(F.explode(F.array("a", "b")).alias("s"))), "sketches")
        both = pairs.join(its.select(F.col("s").alias("a"), F.col("n").alias("n_a"), F.col("whole").alias("w_a")), "a")
        both = both.join(its.select(F.col("s").alias("b"), F.col("n").alias("n_b"), F.col("whole").alias("w_b")), "b")
        both = both.where(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
        out = durable(both.where(near("n_a", "n_b", "w_a", "w_b")).select("a", "b", "n_a", "n_b"), "possible")
        drop(its)
        return out

    def read(batches):
        for batch in batches:
            names, want = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for a, b, own in _texts(batch, size):
                own = [(s, u) for s, t, u in zip(names[a:b].tolist(), want[a:b].tolist(), own, strict=True) if set_names(u)[1] == t]  # another row may repeat the id
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in own], pa.int64()), lists(np.concatenate([u for _, u in own]), np.cumsum([0, *(len(u) for _, u in own)]))], names=["s", "u"])

    def linked(pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b), those whose sets link."""
        pairs = possible(pairs)
        ids = durable(pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct().join(node, "s").select("s", "t", F.col("id").alias("_id")), "ids")
        few = ids.count() <= BROADCAST_IDS  # 24 bytes each; beyond, the join moves the texts
        text = base.join(F.broadcast(ids) if few else ids, "_id").select("s", "_text", "t")
        own = durable(text.mapInArrow(read, "s long, u array<long>").dropDuplicates(["s"]), "shingles")
        both = pairs.join(own.select(F.col("s").alias("a"), F.col("u").alias("ua")), "a").join(own.select(F.col("s").alias("b"), F.col("u").alias("ub")), "b")
        both = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("ua", "ub")).cast("long").alias("x"))
        out = durable(both.where(F.col("x") * den >= (F.col("n_a") + F.col("n_b") - F.col("x")) * num).select("a", "b"), "links")
        for used in (own, ids, pairs):
            drop(used)
        return out

    links = linked(met.where("s <> lead").select(F.col("s").alias("a"), F.col("lead").alias("b")).distinct())
    parts = durable(connected_components(links), "parts")

    # Groups that share a part and are not of one component yet: their pairs that no leader has tied.
    group = met.where("m > 2 and s <> lead").select("k", "s", "need", "rank", "m")
    group = group.join(parts.select(F.col("node").alias("s"), "component"), "s", "left").withColumn("component", F.coalesce("component", "s"))
    apart = group.groupBy("k").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("k")
    group = durable(group.join(durable(apart, "apart"), "k"), "open")
    drop(met)
    later = rare.select(F.col("k").alias("next"), "s", F.col("rank").alias("rank_next"), F.expr("k & 255").alias("tag"))
    large = group.withColumns({"tag": F.expr("k & 255"), "path": F.array("k")}).drop("k")
    split = []
    for deep in range(1, SPLITS + 1):
        # Shingles have nothing to fall back to, so documents that need no more of them than this stay here as well.
        stays = (F.col("m") <= GROUP) | (F.lit(deep) == SPLITS) | ((F.col("tag") == _EACH) & (F.col("need") <= deep))
        split.append(large.where(stays).select(F.xxhash64("path").alias("k"), F.lit(deep).alias("deep"), "s", "tag", "component"))
        large = large.where(F.col("m") > GROUP)
        if deep == SPLITS or not large.limit(1).count():
            break
        large = large.drop("m").join(later, ["s", "tag"]).where("rank_next > rank")
        large = large.select("s", "tag", "need", "component", F.concat("path", F.array("next")).alias("path"), F.col("rank_next").alias("rank"))
        large = durable(large, f"split-{deep}")
        sizes = large.groupBy("path").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
        large = durable(large.join(sizes.select("path", "m"), "path"), f"large-{deep}")
    group = durable(reduce(DataFrame.unionByName, split), "groups")
    apart = group.groupBy("k").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("k")
    group = group.join(apart, "k")
    # Each pair counts at its first shared part (or first few, where its group is split) only, so it is given once however many parts it shares.
    own_keys = rare.withColumn("tag", F.expr("k & 255")).join(group.select("s", "tag").distinct(), ["s", "tag"], "left_semi")
    own_keys = durable(own_keys.groupBy("s", "tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "k"))), lambda x: x["k"]).alias("keys")), "keys")
    # Sketches go with the groups (of long texts folded to FOLDED words), so the join itself gives only pairs that they allow.
    chunk = (F.size("whole") / FOLDED).cast("int")
    folded = F.transform(F.sequence(F.lit(0), F.lit(FOLDED - 1)), lambda i: F.aggregate(F.slice("whole", i * chunk + 1, chunk), F.lit(0).cast("bigint"), lambda t, w: t.bitwiseXOR(w)))
    inside = durable(sketched(group).select("s", "n", F.when(F.size("whole") > FOLDED, folded).otherwise(F.col("whole")).alias("w")), "sketches")
    group = group.join(inside, "s").join(own_keys, ["s", "tag"])
    a, b = (group.select("k", *(F.col(c).alias(f"{c}_{x}") for c in ("s", "component", "n", "w", "keys", "deep"))) for x in "ab")
    met_first = F.xxhash64(F.slice(F.array_intersect("keys_a", "keys_b"), F.lit(1), F.col("deep_a"))) == a["k"]
    fits = (F.col("s_a") < F.col("s_b")) & (F.col("component_a") != F.col("component_b")) & (F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
    rest = durable(a.join(b, (a["k"] == b["k"]) & fits & near("n_a", "n_b", "w_a", "w_b") & met_first).select(F.col("s_a").alias("a"), F.col("s_b").alias("b")).distinct(), "rest")
    for used in (inside, own_keys, rare):
        drop(used)
    more = linked(rest)
    drop(wholes)
    if more.limit(1).count():
        parts = durable(connected_components(links.unionByName(more)), "parts")

    named = parts.join(node.select(F.col("s").alias("node"), "id"), "node")
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    label = node.select("s", "id").join(named.join(least, "component").select(F.col("node").alias("s"), "least"), "s", "left")
    label = durable(label.select("s", F.coalesce("least", "id").alias("component_id")), "label")
    out = rows.join(label, "s", "left")
    bare = lambda c: F.nullif(c, F.lit(_NULL))
    return out.select(bare(F.col("_id")).alias("doc_id"), F.col("n").alias("n_shingles"), bare(F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id"))).alias("component_id"))
