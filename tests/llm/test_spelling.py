"""The index against all pairs, the operator against a plain version, and odd rows."""
import random

import brute
import numpy as np
import pytest

from rallygrid.llm import spelling


def one_apart(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    short, long = sorted((u, v), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


@pytest.fixture(scope="module")
def crowded():
    """Words of three letters that stand close together, runs of one letter, and long ones."""
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(6, 11))) for _ in range(500)}
    words |= {"a" * k for k in range(6, 30)} | {"b" * 300, "b" * 301, "b" * 150 + "c" + "b" * 150}
    words = sorted(words)
    rng.shuffle(words)
    return words


@pytest.mark.parametrize("narrow", [0, 5, 64])
@pytest.mark.parametrize("side", ["left", "right"])
def test_searches_find_all_pairs_with_an_exact_half(crowded, narrow, side, monkeypatch):
    monkeypatch.setattr(spelling, "NARROW", narrow)
    got = {(crowded[i], crowded[k]) for a, b in spelling.answers(crowded, crowded, side) for i, k in zip(a, b)}
    want = {(u, v) for u in crowded for v in crowded if u != v and one_apart(u, v)}
    half = (lambda u, v: v.startswith(u[:len(u) // 2])) if side == "left" else (lambda u, v: v.endswith(u[len(u) // 2:]))
    assert {p for p in want if half(*p)} <= got <= want


def test_letters_that_the_index_does_not_have(crowded):
    found = [crowded[k] for a, b in spelling.answers(crowded, ["aaaaaaaaaz", "zzzzzzzzz"], "left") for k in b]
    assert set(found) == {w for w in crowded if one_apart("aaaaaaaaaz", w) and w.startswith("aaaaa")}
    index = spelling.FMIndex(["abcdef"])
    assert index.codes(np.array(["az"]))[0, 1] == len(index.letters)


@pytest.mark.parametrize("part", [spelling.PART, 20])
def test_pairs_do_not_depend_on_parts(spark, crowded, part, monkeypatch):
    """With small parts, halves that many words share are dealt over tasks."""
    monkeypatch.setattr(spelling, "PART", part)
    words = spark.createDataFrame([(w, k) for k, w in enumerate(crowded)], "word string, n long")
    got = {(r.word, r.near, r.n) for r in spelling.near_words(words).collect()}
    at = {w: k for k, w in enumerate(crowded)}
    assert got == {(u, v, at[v]) for u in crowded for v in crowded if u != v and one_apart(u, v)}


def test_variants_equal_plain_version(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdeéÿß") for _ in range(rng.randrange(5, 9))) for _ in range(40)]
    docs = []
    for i in range(400):
        words = [rng.choice(base[:1 + rng.randrange(40)]) for _ in range(60)]
        for _ in range(6):
            k = rng.randrange(60)
            at = rng.randrange(len(words[k]))
            words[k] = words[k][:at] + rng.choice(["", "a", "É", "x"]) + words[k][at + rng.randrange(2):]
        docs.append((i, rng.choice([" ", ", ", "1", "—", "İ", "K"]).join(w.upper() if rng.random() < .05 and "ß" not in w and "ÿ" not in w else w for w in words)))
    docs += [(None, " ".join(base)), (None, None), (7, None), (7, ""), (8, " ".join(base)), (8, " ".join(base)), (9, "long" * 10 ** 5)]
    table = spark.createDataFrame([(*d, 1, "x", True) for d in docs], "doc_id long, text string, n long, word string, asks boolean").repartition(3)
    got = sorted((tuple(r) for r in spelling.spelling_variants(table).collect()), key=repr)
    assert got == sorted(brute.spelling(docs), key=repr) and any(r[1] for r in got)
    assert spelling.spelling_variants(table.limit(0)).count() == 0


def test_ties_and_chains(spark):
    words = [("bcdefg", 5), ("bcdefh", 25), ("bcdefi", 25), ("bcdexi", 125), ("lonely", 6), ("abcdef", 10), ("abcdeg", 49)]
    got = {r.word: tuple(r)[1:] for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got["bcdefg"] == ("bcdefh", "bcdefh", 5, 2, 25)  # the smaller of two
    assert got["bcdefi"] == ("bcdexi", "bcdexi", 25, 3, 125)
    assert got["bcdefh"] == (None, "bcdefh", 25, 2, None)
    assert got["lonely"] == (None, "lonely", 6, 0, None) and got["abcdef"] == (None, "abcdef", 10, 1, None)
    chain = [("aaaaaa" + "b" * k, 5 ** (k + 1)) for k in range(9)]
    got = {r.word: r.root for r in spelling.variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert set(got.values()) == {chain[-1][0]}
