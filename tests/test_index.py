import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import similarity as S
from textloom.operators.index import SourceIndex


def sentence(rng, own):
    return " ".join([*(rng.choice("ada elma su yol ev göl taş kuş".split()) for _ in range(6)), *(f"{own}{i}" for i in range(6))])


def rows_of(rng, ids):
    return [(f"{i}:{k}", i, sentence(rng, f"s{i}k{k}x"), 10 * k) for i in ids for k in range(2)]


def pairs_of(df):
    return sorted((r["l"], r["r"], float(r["score"])) for r in df.collect())


def test_index_equals_all_sources_after_every_change(spark, tmp_path):
    rng = random.Random(1)
    schema = "id string, source_id int, content string, char_start int"
    rows = rows_of(rng, range(9))
    documents = spark.createDataFrame([(f"d{n}", " ".join(w if rng.random() > 0.05 else "başka" for w in r[2].split())) for n, r in enumerate(rows)], "id string, content string")
    path, state = str(tmp_path / "index"), {r[0]: r for r in rows if r[1] < 6}
    index = SourceIndex(spark, path, buckets=4)
    index.create(spark.createDataFrame(list(state.values()), schema), cells=16)

    def check():
        # as another session would open it
        other = SourceIndex(spark, path, buckets=4)
        texts = spark.createDataFrame([(r[0], r[2]) for r in state.values()], "id string, text string")
        found, met = other.match(documents)
        got = pairs_of(found)
        assert got == pairs_of(S.match_pairs(documents.select("id", F.col("content").alias("text")), texts))
        assert {r["id"]: (r["content"], r["char_start"]) for r in other.chunks().collect()} == {k: r[2:] for k, r in state.items()}
        assert {r["id"] for r in met.collect()} >= {r for _, r, _ in got}
        return got

    more = [r for r in rows if r[1] >= 4]
    index.merge(spark.createDataFrame(more, schema))
    state |= {r[0]: r for r in more}
    first = check()
    # a source with other chunks, and fewer; two are gone, one of them changed at once and stays
    changed = [("3:0", 3, rows[16][2], 5), ("5:0", 5, rows[10][2], 0)]
    index.merge(spark.createDataFrame(changed, schema), spark.createDataFrame([(5,), (7,), (99,)], "source_id int"))
    state = {k: r for k, r in state.items() if r[1] not in (3, 5, 7)} | {r[0]: r for r in changed}
    index.merge(gone=spark.createDataFrame([(2,)], "source_id int"))
    state = {k: r for k, r in state.items() if r[1] != 2}
    assert first != check()


def test_broken_merge_leaves_the_index(spark, tmp_path, monkeypatch):
    schema = "id long, source_id long, content string, char_start long"
    index = SourceIndex(spark, str(tmp_path / "i"), buckets=2)
    index.create(spark.createDataFrame([(1, 1, "bir iki üç dört", 0)], schema))
    documents = spark.createDataFrame([(7, "bir iki üç dört"), (8, "beş altı yedi sekiz")], "id long, content string")
    changed = spark.createDataFrame([(1, 1, "beş altı yedi sekiz", 0)], schema)
    with monkeypatch.context() as m:
        m.setattr(SourceIndex, "live", lambda self: spark.createDataFrame([(2, "v")], "source_id long, version string").withColumn("version", F.raise_error("stopped")))
        with pytest.raises(Exception, match="stopped"):
            index.merge(changed)
    assert [(r["l"], r["r"]) for r in index.match(documents)[0].collect()] == [(7, 1)]
    index.merge(changed)
    assert [(r["l"], r["r"]) for r in index.match(documents)[0].collect()] == [(8, 1)]


def test_stored_postings_are_not_shuffled(spark, tmp_path):
    rng = random.Random(2)
    index = SourceIndex(spark, str(tmp_path / "i"), buckets=4)
    index.create(spark.createDataFrame(rows_of(rng, range(5)), "id string, source_id int, content string, char_start int"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        documents = spark.createDataFrame([("d", sentence(rng, "s1k1x"))], "id string, content string")
        plan = index.candidates(documents)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # only the batch is dealt by gram
    assert any("postings" in line and "Bucketed: true" in line for line in plan.split("\n"))
    assert plan.count("Exchange hashpartitioning(gram") == 1


@pytest.mark.parametrize("cells", [7, 1 << 17])
def test_every_gram_has_a_rank_and_no_match_is_lost(spark, cells):
    rng = random.Random(3)
    left = spark.createDataFrame([(i, sentence(rng, f"s{i % 20}x")) for i in range(60)], "id long, text string")
    right = spark.createDataFrame([(i, sentence(rng, f"s{i}x")) for i in range(20)], "id long, text string")
    a, b = S.word_counts(left), S.word_counts(right)
    order = S.sketch(b, cells)
    ranked = S.with_frequency(b, order)
    exact = {r["gram"]: r["df"] for r in S.document_frequency(b).collect()}
    known = {r["gram"]: r["df"] for r in ranked.collect()}
    assert all(known[g] >= n > 0 for g, n in exact.items()) and (cells < 1 << 17 or known == exact)
    halves = S.merge_sketches(S.sketch(b.where("id < 9"), cells), S.sketch(b.where("id >= 9"), cells))
    assert sorted(map(tuple, halves.collect())) == sorted(map(tuple, order.collect()))
    every = left.select(F.col("id").alias("l")).crossJoin(right.select(F.col("id").alias("r")))
    want = pairs_of(S.score_pairs(every, left, right, prune=False).where("score >= 0.75"))
    found = S.candidate_pairs(a, b, cells=cells)
    assert want and {(x, y) for x, y, _ in want} <= {tuple(r) for r in found.collect()}
    assert pairs_of(S.score_pairs(found, left, right).where("score >= 0.75")) == want
