import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import blocks, evidence, held
from textloom.operators import similarity as S
from textloom.operators.index import SourceIndex
from textloom.plans import texts as plans

WORDS = "ada elma su yol ev göl taş kuş".split()


def frames(spark, seed=4):
    rng = random.Random(seed)
    right = [(i, " ".join(rng.choice(WORDS) if rng.random() < 0.3 else f"w{rng.randrange(40)}" for _ in range(9))) for i in range(12)]
    left = []
    for i in range(60):
        words = rng.choice(right)[1].split()
        left.append((i, " ".join(w if rng.random() < 0.8 else f"yeni{rng.randrange(500)}" for w in words)))
    left += [(100, "THE!!"), (101, "tek"), (102, ""), (103, "?!"), (104, None)]
    right += [(50, "the."), (51, "The")]
    return (spark.createDataFrame(rows, "id long, text string") for rows in (left, right))


def copied(df, times, key="id"):
    copies = df.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return copies.withColumn(key, F.col(key) + 1000 * F.col("n")).drop("n")


@pytest.fixture
def kept(monkeypatch):
    """Rows of every kept table by its name."""
    rows, old = {}, S.keep

    def keep(df, name):
        out = old(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    for module in (S, blocks, SourceIndex.match.__globals__):
        monkeypatch.setitem(module, "keep", keep) if isinstance(module, dict) else monkeypatch.setattr(module, "keep", keep)
    return rows


def pairs_of(df):
    return sorted((r["l"], r["r"], r["score"]) for r in df.collect())


def test_copies_are_matched_once_and_lose_no_pair(spark, kept):
    left, right = frames(spark)
    want = pairs_of(S.match_pairs(left, right))
    assert {(100, 50), (100, 51)} <= {x[:2] for x in want}
    once = dict(kept)
    kept.clear()
    got = pairs_of(S.match_pairs(copied(left, 20), copied(right, 2)))
    assert got == sorted((a + 1000 * i, b + 1000 * j, x) for a, b, x in want for i in range(20) for j in range(2))
    assert kept["pairs"] == once["pairs"] and kept["prefixes"] == once["prefixes"] and kept["scored"] == once["scored"]


def test_copies_have_the_blocks_of_the_first(spark, kept):
    left, right = (df.withColumnRenamed("text", "content") for df in frames(spark))
    pairs = left.select(F.col("id").alias("l")).crossJoin(right.select(F.col("id").alias("r")))
    want = sorted(map(tuple, blocks.token_blocks(pairs, left, right).collect()))
    spans = kept["spans"]
    kept.clear()
    found = blocks.token_blocks(copied(pairs, 5, "l"), copied(left, 5), right)
    assert sorted(map(tuple, found.collect())) == sorted((a + 1000 * i, *x) for a, *x in want for i in range(5))
    assert want and kept["spans"] == spans


def test_only_texts_that_hold_enough_pass(spark, monkeypatch):
    left, right = (S.streams(df) for df in frames(spark))

    def grams(text, low, high):
        w = text.split(" ")
        return [" ".join(w[i : i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)]

    texts = {r["id"]: r["stream"] for r in left.collect()}
    for low, high, squares in ((1, 3, True), (1, 1, False), (2, 3, True)):
        there = {g for r in right.collect() for g in grams(r["stream"], low, high)}
        counts = {i: {g: (x.count(g) ** 2 if squares else 1) for g in x} for i, t in texts.items() if (x := grams(t, low, high))}
        want = {i for i, x in counts.items() if (part := sum(n for g, n in x.items() if g in there)) and part >= 0.4 * sum(x.values()) - 1e-9}
        got = held.likely(left, held.gram_map(right, low, high), low, high, 0.4, squares)
        assert {r["id"] for r in got.collect()} == want
    assert 0 < len(want) < len(texts)


def test_index_matches_copies_once(spark, tmp_path, kept):
    left, right = frames(spark)
    index = SourceIndex(spark, str(tmp_path / "i"), buckets=2)
    chunks = right.select("id", F.col("id").alias("source_id"), F.col("text").alias("content"), F.lit(0).cast("long").alias("char_start"))
    index.create(chunks.where("id < 6"))
    index.merge(chunks.where("id >= 6"))
    want = pairs_of(S.match_pairs(left, right))
    kept.clear()
    assert pairs_of(index.match(left.withColumnRenamed("text", "content"))[0]) == want
    once = kept["pairs"]
    kept.clear()
    found, _ = index.match(copied(left, 5).withColumnRenamed("text", "content"))
    assert pairs_of(found) == sorted((a + 1000 * i, b, x) for a, b, x in want for i in range(5))
    assert kept["pairs"] == once


def test_only_chunks_that_can_match_are_kept(spark):
    sf_dir = "/root/testdata/sf0.001"
    every = plans.chunked(spark, sf_dir, "documents", "doc_id").select("id", "doc_id", "content", "char_start", "char_end")
    for overlap in (None, 0.5):
        left, right = plans.sides(spark, sf_dir, overlap)
        assert 0 < left.count() < every.count() / 2
        assert left.exceptAll(every).isEmpty()
        match = S.match_pairs if overlap is None else lambda a, b: S.overlap_pairs(a, b, 0.5)
        want = pairs_of(match(plans.as_text(every), plans.as_text(right)))
        assert want and pairs_of(match(plans.as_text(left), plans.as_text(right))) == want


def test_pairs_below_the_cosine_are_told_without_grams(spark, kept):
    left, right = frames(spark)
    a, b = S.streams(left), S.streams(right)
    every = a.select(F.col("id").alias("l"), F.col("stream").alias("ls")).crossJoin(b.select(F.col("id").alias("r"), F.col("stream").alias("rs")))
    exact = S.pair_cosine(every.select("l", "r"), S.word_counts(left), S.word_counts(right), "word").collect()
    for least in (0.1, 0.5, 1.0):
        got = {tuple(r) for r in held.reaching(every, 1, 3, S.K2, least).collect()}
        assert got == {(r["l"], r["r"]) for r in exact if r["word"] >= least} and got
    # more kinds of grams than 64 bits tell apart: nothing is left out
    assert held.reaching(every, 1, 40, S.K2, 1.0).count() == every.count()
    want = pairs_of(S.match_pairs(left, right))
    assert want and kept["pairs"] < kept["candidates"]


def test_streams_that_chunks_carry_are_not_told_again(spark, kept):
    sf_dir = "/root/testdata/sf0.001"
    left, right = plans.streamed_sides(spark, sf_dir)
    kept.clear()
    got = pairs_of(S.match_pairs(plans.as_text(left), plans.as_text(right)))
    assert "streams" not in kept and "texts" not in kept
    assert got and got == pairs_of(S.match_pairs(*(x.select("id", F.col("content").alias("text")) for x in (left, right))))


def test_a_replay_weighs_known_signals(spark, kept):
    left, right = frames(spark)
    snapshot = {"algorithm_version": "hybrid-v1", "word_tfidf_weight": "0.50", "character_tfidf_weight": "0.30", "word_overlap_weight": "0.20", "similarity_threshold": "0.8000"}
    found = S.keep(S.match_pairs(left, right), "matches")
    want = pairs_of(evidence.replay_snapshot(found.select("l", "r"), left, right, snapshot))
    kept.clear()
    got = pairs_of(evidence.replay_snapshot(found, left, right, snapshot))
    assert not kept and want and got == want
    # signals of other grams are told anew
    evidence.replay_snapshot(found, left, right, snapshot, S.Config(word_range=(1, 2)))
    assert "scored" in kept


def test_overlaps_of_few_pairs_are_told_from_texts(spark, kept):
    left, right = frames(spark)
    sets = [{r["id"]: set(r["stream"].split(" ")) for r in S.streams(x).collect()} for x in (left, right)]
    want = {(a, b, len(x & y), len(x | y), len(x & y) / len(x | y)) for a, x in sets[0].items() for b, y in sets[1].items() if len(x & y) >= 0.5 * len(x | y)}
    kept.clear()
    assert {tuple(r) for r in S.overlap_pairs(left, right, 0.5).collect()} == want and want
    assert "texts" not in kept and kept["pairs"] >= kept["found"] > 0
