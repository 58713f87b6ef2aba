"""Alignment of two tokenizers against a plain count of byte offsets."""

import hashlib
import re
from collections import Counter

import pytest

from creditweave.llm import alignment, queries
from creditweave.llm.common import table

SMALL = "/root/testdata/sf0.001"
ODD = [
    (1, ""), (2, None), (3, " "), (4, "\n\t x  y "), (5, "<|endoftext|> <s> </s> <unk> <0x41>"), (6, "Füße ▁ und ça"), (7, "日本語 テキスト 🙂🙂"),
    (8, "nul \0 inside"), (9, "x" * 30_000), (10, "the cat " * 4000), (None, "the end"), (11, "the end"), (11, "the end"), (12, "‎‏ ﬁ ½ Å Å"), (13, "a\r\nb"),
]


def plain(rows, a_path, b_path):
    """The contract, with Hugging Face's tokenizer for A and sets of byte offsets."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(c): c for c in visible} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in visible)}
    size_b = lambda i: 1 if re.fullmatch("<0x..>", b.id_to_piece(i)) else len(b.id_to_piece(i).replace("▁", " ").encode())
    spelt_b = lambda i: bytes.fromhex(b.id_to_piece(i)[3:5]) if re.fullmatch("<0x..>", b.id_to_piece(i)) else b.id_to_piece(i).replace("▁", " ").encode()
    out = []
    for doc_id, text in rows:
        own = None
        if text:
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ta = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ia]
            if b"".join(ta) == b"".join(map(spelt_b, ib)) == (" " + text).encode():
                ends_a, ends_b, n = [], [], 0
                for t in ta:
                    ends_a.append(n := n + len(t))
                n = 0
                for i in ib:
                    ends_b.append(n := n + size_b(i))
                own = ia, ib, ends_a, ends_b
        out.append((doc_id, own))
    links = Counter()
    for _, own in out:
        if own:
            ia, ib, ea, eb = own
            at = {e: i for e, i in zip(eb, ib, strict=True)}
            links.update((i, at[e]) for e, i in zip(ea, ia, strict=True) if e in at)
    best = Counter()
    for (_, y), n in links.items():
        best[y] = max(best[y], n)
    for doc_id, own in out:
        if not own:
            yield doc_id, 0, 0, 0, 0, 0, 0, ""
            continue
        ia, ib, ea, eb = own
        both = sorted(set(ea) & set(eb))
        at = {e: i for e, i in zip(eb, ib, strict=True)}
        pairs = [(i, at[e]) for e, i in zip(ea, ia, strict=True) if e in at]
        low, groups = 0, []
        for e in both:
            groups.append(",".join(str(i) for i, x in zip(ia, ea, strict=True) if low < x <= e) + "|" + ",".join(str(i) for i, x in zip(ib, eb, strict=True) if low < x <= e))
            low = e
        if len(both) > 2000:  # quadratic above; these are checked by size only
            groups = None
        yield doc_id, len(ia), len(ib), len(both), len(pairs), sum(links[p] == best[p[1]] for p in pairs), sum(links[p] for p in pairs), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else None


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("odd", [True, False])
def test_alignment_follows_the_contract(spark, odd):
    import public_tokenizers as p

    a_path, b_path = p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model")
    if odd:
        docs = spark.createDataFrame([(i, t, "own", 1) for i, t in ODD], "doc_id long, text string, links string, n_best int").repartition(3)
        rows, got = ODD, alignment.score_links(docs, a_path, b_path, ["doc_id"])
    else:
        rows = [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect() if len(r["text"] or "") < 8000]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = alignment.score_links(docs, a_path, b_path, ["doc_id"])
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r[:7])
    got = sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=key)
    want = sorted(plain(rows, a_path, b_path), key=key)
    assert [g[:7] for g in got] == [w[:7] for w in want]
    assert all(w[7] is None or g[7] == w[7] for g, w in zip(got, want, strict=True))
    assert any(w[1] for w in want)


def test_alignment_of_no_rows_and_of_the_whole_table(spark):
    import public_tokenizers as p

    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.score_links(none, p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model")).count() == 0
    got = queries.op11_alignment(spark, SMALL)
    assert sorted(got.columns) == sorted(COLUMNS)
    assert got.where("n_links <> n_groups or n_best > n_links or n_groups > n_a or n_groups > n_b").count() == 0
    assert got.count() == table(spark, SMALL, "documents").count()


def test_transducer_sees_bytes_that_differ():
    t = alignment.Transducer([b"ab", b"c", b"abc"], [b"a", b"bc", b"x"])
    assert t.groups([0, 1], [0, 1]) == ([2], [2])
    assert t.groups([2], [0, 1]) == ([1], [2])
    assert t.groups([0, 1], [0, 2]) is None  # other bytes
    assert t.groups([0], [0, 1]) is None and t.groups([2], [0]) is None  # one side is longer
    assert t.groups([], [0]) is None and t.groups([], []) == ([], [])
