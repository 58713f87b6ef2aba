"""The best names of a payer: all of them, and few strings scored to find them."""

import random

import pytest

from creditweave.config import Identification
from creditweave.functions import similarity
from creditweave.operators import identity

SYLLABLES = ["ka", "ri", "mo", "tu", "ben", "sha", "dev", "lal", "gor", "nim", "pat", "sur"]


def book(n: int) -> tuple[list[str], list[int]]:
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(5))
    names = [f"{word()} {rng.choice(['traders', 'stores', 'foods'])}" + rng.choice(["", f" nation {rng.randrange(25)}"]) for _ in range(n)]
    return names, [rng.randrange(n) for _ in names]


def scored(monkeypatch, scorer: str, names: list[str], owners: list[int], payers: list[str], floor: float, top: int = 5):
    """Holds close() against scoring every name; how many names it scored for a payer."""
    known, of, asked = similarity.Choices(names), getattr(similarity, scorer), []
    monkeypatch.setattr(similarity, scorer, lambda a, b: asked.append((a, b)) or of(a, b))
    got = [known.close(p, scorer, floor, top, owners) for p in payers]
    monkeypatch.undo()
    for p, rows in zip(payers, got, strict=True):
        every = [(i, of(p, n)) for i, n in enumerate(names)]
        assert rows == sorted(((i, s) for i, s in every if s >= floor), key=lambda t: (-t[1], names[t[0]], owners[t[0]]))[:top], p
    return len(asked) / len(payers)


def test_few_names_are_held_against_a_payer_letter_by_letter(monkeypatch):
    names, owners = book(12_000)
    payers = [names[i] + tail for i, tail in zip(range(0, 1200, 60), (" nation 7", " br", "", " nation 22 br") * 5, strict=True)] + ["cash deposit 1234567"]
    known, pairs, whole = similarity.Choices(names), [], similarity.Choices._common
    monkeypatch.setattr(similarity.Choices, "_common", lambda self, payers, p, n, shared: pairs.append(len(n)) or whole(self, payers, p, n, shared))
    got = {p: known.close(p, "wratio", 81.0, 5, owners) for p in payers}
    assert all(got[p] for p in payers[:-1]) and not got[payers[-1]]
    assert sum(pairs) < 0.05 * len(payers) * len(names), sum(pairs)


def test_few_of_the_names_with_the_letters_of_the_floor_are_scored(monkeypatch):
    names, owners = book(3000)
    payers = [names[i] + tail for i, tail in zip(range(0, 600, 60), (" nation 7", " br", "", " nation 22 br", "x") * 2, strict=True)]
    alike = sum(similarity._common(p, n) * 100 >= 65 * max(len(p), len(n)) for p in payers for n in names) / len(payers)
    assert scored(monkeypatch, "levenshtein", names, owners, payers, 65.0) < 35 < alike


@pytest.mark.parametrize("scorer", ["wratio", "levenshtein", "ratio", "token_sort_ratio", "token_set_ratio"])
def test_odd_names_are_found(monkeypatch, scorer):
    """Repeated words, equal names of several owners, one word in long names, names over 64 and over 255 letters, letters outside ASCII."""
    names, owners = book(80)
    names += [names[0]] * 7 + ["foods", "traders traders", "foods foods foods", "süd händler", "süd-händler 𝒳", "a", "a b", "stores " * 9 + "z", "x" * 70, "y" * 300, "kamo " * 70 + "stores"] + [f"{c} stores" for c in "abcdefg"]
    owners += list(range(len(names) - len(owners)))
    payers = [names[0], "traders", "foods foods", "sud handler", "süd händler gmbh", "a", "b a", "stores", "x" * 66, "y" * 280, "kamo " * 68 + "stores nation", "unknown", "kamo stores", "é"]
    for floor in (0.0, 50.0, 57.0, 60.0, 81.0, 85.5, 90.0, 100.0):
        scored(monkeypatch, scorer, names, owners, payers, floor)


def test_blocks_of_any_size_give_the_same(spark):
    """A payer brings its fifth score from the first block to all others."""
    names, owners = book(150)
    rows = spark.createDataFrame(sorted(dict(zip(names, owners, strict=True)).items()), "normalized_name string, customer_id long")
    none = spark.createDataFrame([], "normalized_alias string, customer_id long")
    payers = spark.createDataFrame([(f"{n} br",) for n in names[:30]] + [("cash deposit 1",)], "payer string")
    one, many = (identity.similar_names(payers, rows, none, Identification(), choice_rows=n).collect() for n in (1000, 40))
    assert sorted(map(str, one)) == sorted(map(str, many)) and len(one) == 31
