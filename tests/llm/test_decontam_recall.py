from __future__ import annotations

import random

import numpy as np
import pytest

from archidex.llm import decontam
from tests.llm.test_duplicates import table

SF = "/root/testdata/sf0.1"


def edited(rng, text, rate, evenly):
    count, shown = int(rate * len(text) + 1e-9), list(text)
    at = [int((i + 0.5) * len(text) / count) for i in range(count)] if evenly else sorted(rng.sample(range(len(text)), count))
    for a in reversed(at):
        kind, letter = rng.randrange(3), rng.choice("abcdefgh ")
        if kind == 0:
            shown[a] = letter
        elif kind == 1:
            shown.insert(a, letter)
        else:
            del shown[a]
    return "".join(shown)


def recall(spark, size, rate, evenly):
    """Share found of the items, cut to a size, that edits leave within the distance."""
    given = [r.text for r in table(spark, "benchmark", SF).orderBy("item_id").collect()][::2]
    around = [r.text for r in table(spark, "documents", SF).orderBy("doc_id").limit(50).collect()]
    index, rng = decontam.Index([decontam.normal(t)[:size] for t in given]), random.Random(17)
    copies = [edited(rng, t, rate, evenly) for t in index.items]
    near = [k for k, c in enumerate(copies) if decontam.least_distance(index.items[k], decontam.normal(c), index.allowed[k]) is not None]
    found = index.search([f"{around[k % 50][:300]} {copies[k]} {around[-1 - k % 50][:300]}" for k in near])
    assert len(near) > 80
    return sum(k in dict(hits) for k, hits in zip(near, found, strict=True)) / len(near)


@pytest.mark.parametrize("rate", [0.15, 0.2])
@pytest.mark.parametrize("size", [25, 30, 40, 50, 60, 80])
def test_recall_by_length(spark, size, rate):
    assert recall(spark, size, rate, evenly=False) >= 0.97


@pytest.mark.parametrize("rate", [0.15, 0.18, 0.2])
@pytest.mark.parametrize("size", [50, 80, 400])
def test_recall_of_evenly_spread_edits(spark, size, rate):
    assert recall(spark, size, rate, evenly=True) >= 0.99


def test_search_by_parts_equals_the_table():
    rng = random.Random(4)
    for _ in range(2000):
        item, text = ("".join(rng.choice("abé ") for _ in range(rng.randrange(1, n))) for n in (25, 60))
        for most in (0, 1, 3, len(item) // 5):
            if most < len(item):
                assert decontam.least_anywhere(item, text, most) == decontam.least_distance(item, text, most)


def test_seeds_in_long_and_wide_texts(monkeypatch):
    monkeypatch.setattr(decontam, "STRETCH", 300)
    monkeypatch.setattr(decontam, "WINDOWS_AT_ONCE", 64)
    item = "съешь же ещё этих мягких французских булок да выпей чаю, сказал он тихо"
    index, rng = decontam.Index([item, "x" * 50, ""]), random.Random(2)
    for before in range(0, 2000, 37):
        text = "щ " * before + edited(rng, item, 0.18, True) + " ю" * 500
        assert [i for i, _ in index.search([text, "", "words"])[0]] == [0]


def test_places_without_enough_grams_are_not_read(monkeypatch):
    rng = random.Random(8)
    for _ in range(1000):
        item, text = ("".join(rng.choice("abé ") for _ in range(n)) for n in (rng.randrange(1, 40), 60))
        text = text[:20] + edited(rng, item, rng.choice([0, 0.1, 0.2]), False) + text[20:]
        grams = {size: decontam.grams_of(item, size) for size in decontam.SURE_GRAMS}
        for most in (0, 1, len(item) // 5):
            if most < len(item) and decontam.least_distance(item, text, most) is not None:
                assert decontam.may_be_near(grams, text, most)
    item = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(20))
    index, read = decontam.Index([item]), []
    monkeypatch.setattr(decontam, "least_distance", lambda *given: read.append(given))
    assert index.verified(" ".join(item.split()[:3]) + " klmnopq" * 40, 0, [0]) is None and not read


def test_places_verified_together_have_their_least_distances():
    rng, items, places, codes = random.Random(5), [], [], []
    for size in (1, 20, 63, 64, 65, 128, 129, 200, 400):
        for letters in ("ab", "abcdeé \U0001f600"):
            items.append("".join(rng.choice(letters) for _ in range(size)))
    for n in range(600):
        item = rng.randrange(len(items))
        copy = edited(rng, items[item], rng.choice([0, 0.1, 0.2, 0.3]), bool(n % 2)) if len(items[item]) > 1 else "b"
        around = ["".join(rng.choice("abcé \0") for _ in range(rng.choice([0, 5, 300, 2500]))) for _ in range(2)]
        places.append((item, len("".join(codes)), around[0] + copy + around[1]))
        codes.append(places[-1][2])
    most = [len(t) // 5 for t in items]
    together = decontam.Together(decontam.letters("".join(codes)), [decontam.letters(t) for t in items], np.array(most))
    item, begin, end = (np.array(x) for x in zip(*((i, a, a + len(t)) for i, a, t in places), strict=True))
    want = [decontam.least_distance(items[i], t, most[i]) for i, _, t in places]
    got = together.distances(item, begin, end)
    assert [int(d) if d <= most[i] else None for d, (i, _, _) in zip(got, places, strict=True)] == want
    assert None in want and len(set(want)) > 20
    assert not len(together.distances(item[:0], begin[:0], end[:0]))


@pytest.mark.parametrize("words", [1, 40, decontam.WORDS_AT_ONCE])
def test_places_are_not_verified_one_by_one(monkeypatch, words):
    monkeypatch.setattr(decontam, "WORDS_AT_ONCE", words)
    rng = random.Random(9)
    items = [" ".join("".join(rng.choice("abcdefghijé") for _ in range(rng.randrange(2, 9))) for _ in range(n)) for n in (12, 20, 40, 60)]
    index = decontam.Index(items)
    want, texts = [], []
    for _ in range(60):
        some = rng.sample(range(4), 2)
        texts.append(" ü ".join(edited(rng, items[i], 0.1, True) + " and" * rng.randrange(300) for i in some))
        shown = decontam.normal(texts[-1])
        found = [(i, decontam.least_distance(items[i], shown, index.allowed[i])) for i in range(4)]
        want.append([(i, d) for i, d in found if d is not None])
    monkeypatch.setattr(decontam, "least_distance", lambda *given: pytest.fail("one place alone"))
    assert index.search(texts) == want and index.search([]) == [] and index.search(["", "ü"]) == [[], []]


def test_long_items_are_verified_as_short_ones(monkeypatch):
    rng = random.Random(12)
    items = [" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(30)) for _ in range(3)]
    texts = [f"é {edited(rng, items[n % 3], 0.15, False)} ö {items[n % 2][:70]}" for n in range(30)]
    want = decontam.Index(items).search(texts)
    monkeypatch.setattr(decontam, "TOGETHER_LETTERS", 100)
    assert decontam.Index(items).search(texts) == want and all(want)
