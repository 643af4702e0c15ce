import random
from difflib import SequenceMatcher

import pytest

from textloom.operators import blocks, evidence


def brute_blocks(a, b):
    """Blocks of two token lists: the longest run of equal tokens, then those before and behind it."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            if k > best[2]:
                best = (i, j, k)
    i, j, k = best
    if not k:
        return []
    return brute_blocks(a[:i], b[:j]) + [best] + [(i + k + x, j + k + y, n) for x, y, n in brute_blocks(a[i + k :], b[j + k :])]


def some_pairs(rng, n):
    rows = []
    for _ in range(n):
        words = [f"w{x}" for x in range(rng.randint(1, 6))]
        a = [rng.choice(words) for _ in range(rng.randint(0, 25))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = [rng.choice(words)] * rng.randint(0, 2)
        if rng.random() < 0.2:
            rng.shuffle(b)
        rows.append((a, b))
    return rows


def content(tokens):
    """A text of these tokens, and where each begins and ends."""
    text, at = "«", []
    for t in tokens:
        at.append((len(text), len(text) + len(t)))
        text += t + ", "
    return text, at


@pytest.mark.parametrize("cells, rounds, n", [(1 << 16, 3, 80), (60, 3, 12)])
def test_blocks_equal_brute_force(spark, cells, rounds, n):
    rows = some_pairs(random.Random(5), n)
    sides = [spark.createDataFrame([(k, content(r[side])[0]) for k, r in enumerate(rows)], "id long, content string") for side in (0, 1)]
    pairs = spark.createDataFrame([(k, k) for k in range(len(rows))] + [(0, 0), (1, 999)], "l long, r long")
    want = set()
    for k, (a, b) in enumerate(rows):
        found = brute_blocks(a, b)
        assert found == [tuple(m) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
        (_, x), (_, y) = content(a), content(b)
        want |= {(k, k, x[i][0], x[i + n - 1][1], y[j][0], y[j + n - 1][1], n) for i, j, n in found}
    got = [tuple(r) for r in blocks.token_blocks(pairs, *sides, cells=cells, rounds=rounds).collect()]
    assert len(got) == len(want) and set(got) == want


def test_long_texts_of_one_token(spark):
    left = spark.createDataFrame([(1, "a " * 100_000)], "id long, content string")
    pairs = spark.createDataFrame([(1, 1)], "l long, r long")
    right = spark.createDataFrame([(1, "b " + "A " * 99_000)], "id long, content string")
    assert [tuple(r)[4:] for r in blocks.token_blocks(pairs, left, right).collect()] == [(2, 198_001, 99_000)]


def test_blocks_of_no_pairs_and_no_words(spark):
    side = spark.createDataFrame([(1, "..."), (2, None), (3, ""), (4, "İki üç")], "id long, content string")
    pairs = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 1), (4, 4)], "l long, r long")
    assert [tuple(r) for r in evidence.token_blocks(pairs, side, side).collect()] == [(4, 4, 0, 6, 0, 6, 2)]
    assert evidence.token_blocks(pairs.limit(0), side, side).collect() == []
