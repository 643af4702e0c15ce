"""Exact self-join of documents on the Jaccard similarity of their word shingles.

The global order of shingles is cut into ranges (vertical fragments): partial
overlaps are counted in each range by itself and summed per pair. Which pairs
to count is found without listing the pairs inside a group:

1. shingles that one document alone holds are found range by range; documents
   with too many of them can link with nothing and go no further;
2. each remaining document is compared with one typical and one large document
   with which it shares most of its least fingerprints, which joins most
   groups by links to a few leaders;
3. of the rest, all pairs in different components that share a prefix shingle
   and pass the length and position bounds are compared. Links inside a
   component change nothing, so none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, connected_components, read
from textloom.llm.shingles import chunks, scramble, shingle_sets

WORDS = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Eighths of the fingerprint space searched for shingles held by one document.
EIGHTHS = 3
#: Fingerprints that one range task sorts, about.
PER_RANGE = 1_500_000
#: Ranges in which the overlaps of a pair are counted separately.
FRAGMENTS = 8
#: Least fingerprints by which leaders are found.
LEADER_GRAMS = 8
#: Cells of the frequency sketch that orders shingles from rare to frequent.
CELLS = 1 << 18


def _least_overlap(n: int | np.ndarray, percent: int):
    """Shingles that a set of n must share with any partner."""
    return -(-(n * percent) // 100)


def own_shingles(docs: DataFrame, words: int = WORDS, per_range: int = PER_RANGE) -> DataFrame:
    """``doc_id, own``: shingles in the searched part of the space that no other document holds.

    A task first merges what repeats in its own rows, so a frequent shingle
    reaches its range once per batch of rows, not once per document.
    """
    ranges = max(1, int((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6 * EIGHTHS / 8 / per_range) + 1)
    width = (EIGHTHS << 61) // ranges + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, texts in chunks(batch, 1):
                gram, owner = shingle_sets(texts, words)
                keep = gram < np.uint64(EIGHTHS << 61)
                gram, owner = gram[keep], owner[keep]
                order = np.argsort(gram, kind="stable")
                gram, owner = gram[order], owner[order]
                cut = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.zeros(0, np.int64)
                times = np.diff(np.concatenate((cut, [len(gram)])))
                gram, once = gram[cut], times == 1
                part, local = (gram // np.uint64(width)).astype(np.int64), owner[cut]
                # by range, then by document, whose id is then written once
                order = np.argsort(part * (len(texts) + 1) + np.where(once, local, len(texts)), kind="stable")
                gram, local, once, part = gram[order], local[order], once[order], part[order]
                rows: tuple[list, ...] = ([], [], [], [], [])
                # only the ranges that these texts reach, however many there are
                met, start = np.unique(part, return_index=True)
                for k, begin, end in zip(met.tolist(), start, [*start[1:], len(part)][: len(start)], strict=True):
                    s = slice(begin, end)
                    single = once[s]
                    docs_here, times = np.unique(local[s][single], return_counts=True)
                    for column, value in zip(rows, (k, gram[s][single].tobytes(), ids[first + docs_here].tobytes(), times.astype(np.int32).tobytes(), gram[s][~single].tobytes()), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(x, pa.binary()) for x in rows[1:])], names=["part", "single", "doc", "times", "several"])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        single = np.frombuffer(b"".join(pdf["single"]), np.uint64)
        doc = np.repeat(np.frombuffer(b"".join(pdf["doc"]), np.int64), np.frombuffer(b"".join(pdf["times"]), np.int32))
        several = np.frombuffer(b"".join(pdf["several"]), np.uint64)
        order = np.argsort(single, kind="stable")
        single, doc = single[order], doc[order]
        alone = np.ones(len(single), bool)
        alone[1:] &= single[1:] != single[:-1]
        alone[:-1] &= single[:-1] != single[1:]
        several = np.unique(several)
        if len(several):
            at = np.minimum(np.searchsorted(several, single), len(several) - 1)
            alone &= several[at] != single
        ids, own = np.unique(doc[alone], return_counts=True)
        if not len(ids):
            return pd.DataFrame({"bucket": [], "ids": [], "own": []})
        # one row for each bucket of documents, not for each document
        bucket = (scramble(ids.view(np.uint64)) % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ids, own, bucket = ids[order], own[order], bucket[order]
        name, start = np.unique(bucket, return_index=True)
        ends = [*start[1:], len(ids)]
        return pd.DataFrame({"bucket": name, "ids": [ids[s:e].tobytes() for s, e in zip(start, ends, strict=True)], "own": [own[s:e].astype(np.int64).tobytes() for s, e in zip(start, ends, strict=True)]})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(np.frombuffer(b"".join(pdf["ids"]), np.int64), return_inverse=True)
        return pd.DataFrame({"doc_id": ids, "own": np.bincount(at, weights=np.frombuffer(b"".join(pdf["own"]), np.int64)).astype(np.int64)})

    dealt = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(deal, "part int, single binary, doc binary, times binary, several binary")
    # as many tasks as ranges, so that none grows with the data
    return dealt.repartition(ranges, "part").groupBy("part").applyInPandas(count, "bucket long, ids binary, own binary").groupBy("bucket").applyInPandas(total, "doc_id long, own long")


def linkable_sets(docs: DataFrame, own: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n, grams``: set size of every row; the sorted fingerprints only where a link is possible."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alone = batch.column(2).to_numpy(zero_copy_only=False)
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            sizes, sets = [], []
            for first, texts in chunks(batch, 1):
                gram, owner = shingle_sets(texts, words)
                bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
                n = np.diff(bounds)
                at = slice(first, first + len(texts))
                keep = known[at] & (n > 0) & (n - alone[at] >= _least_overlap(n, percent))
                sizes.append(n)
                sets += [gram[bounds[i] : bounds[i + 1]].tobytes() if keep[i] else None for i in range(len(texts))]
            n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sets, pa.binary())], names=["doc_id", "n", "grams"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(own.hint("merge"), "doc_id", "left")
    return rows.select("doc_id", "text", F.coalesce("own", F.lit(0)).alias("own")).mapInArrow(build, "doc_id long, n long, grams binary")


def _each_set(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        for doc_id, grams in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield doc_id, np.frombuffer(grams.as_py(), np.uint64)


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (zip(*rows, strict=True) if rows else [()] * len(names))]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64), pa.int64()) for c in columns], names=names)


def _batched(rows: Iterator[tuple], names: list[str], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[0])
        if size >= most:
            yield _table(held, names)
            held, size = [], 0
    if held:
        yield _table(held, names)


def frequency_sketch(sets: DataFrame, cells: int = CELLS) -> np.ndarray:
    """How many sets' shingles fall into each cell; its size is fixed, whatever the data."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for _, gram in _each_set(batches):
            total += np.bincount((gram % np.uint64(cells)).astype(np.int64), minlength=cells) if len(gram) > cells else 0
            if len(gram) <= cells:
                np.add.at(total, (gram % np.uint64(cells)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield _table([(at, total[at])], ["cell", "n"])

    out = np.zeros(cells, np.int64)
    for cell, n in sets.select("doc_id", "grams").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        out[cell] = n
    return out


def leader_pairs(sets: DataFrame, sketch: np.ndarray, typical: bool, component: DataFrame | None = None) -> DataFrame:
    """``a, b``: each document b with the leader a with which it shares most of its least fingerprints.

    The leader of a shingle is its ``typical`` document, the one whose
    shingles are the most frequent by the sketch: the text that others were
    made from has none of their changes. Then only the rarer half of a set
    counts, so that a passage that unlike documents share chooses no leaders.
    Otherwise the leader is the largest document and the whole set counts.
    With ``component``, leaders that b is already in one component with do
    not count.
    """
    held = sets.sparkSession.sparkContext.broadcast(sketch.astype(np.int32))  # CELLS numbers

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc_id, gram in _each_set(batches):
                rank = -len(gram)
                if typical:
                    often = held.value[(gram % np.uint64(len(held.value))).astype(np.int64)]
                    rank = -int(1000 * often.mean())
                    gram = gram[often <= np.median(often)]
                key = scramble(gram ^ np.uint64(0 if typical else 0x5851F42D4C957F2D))
                pick = np.argpartition(key, LEADER_GRAMS - 1)[:LEADER_GRAMS] if len(gram) > LEADER_GRAMS else np.arange(len(gram))
                yield gram[pick].view(np.int64), np.full(len(pick), doc_id), np.full(len(pick), rank)

        yield from _batched(rows(), ["gram", "doc_id", "rank"])

    posted = sets.select("doc_id", "grams").mapInArrow(least, "gram long, doc_id long, rank long")
    lead = posted.groupBy("gram").agg(F.min(F.struct("rank", "doc_id")).alias("lead"), F.count("*").alias("rows")).where("rows > 1")
    votes = posted.join(lead, "gram").where("doc_id <> lead.doc_id").groupBy("doc_id", F.col("lead.doc_id").alias("a")).count()
    if component is not None:
        for key, name in (("doc_id", "of_b"), ("a", "of_a")):
            votes = votes.join(component.select(F.col("id").alias(key), F.col("component").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))
        votes = votes.where("of_a <> of_b")
    return votes.groupBy("doc_id").agg(F.max(F.struct("count", (-F.col("a")).alias("back"))).alias("x")).select((-F.col("x.back")).alias("a"), F.col("doc_id").alias("b"))


def prefix_pairs(sets: DataFrame, component: DataFrame, sketch: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """``a, b``: pairs in different components that share a prefix shingle and may reach the threshold.

    Shingles go from rare to frequent by the sketch, then by fingerprint. A
    link's first common shingle lies in both prefixes, and after it enough of
    both sets must be left. Only sets of like length meet.
    """
    held = sets.sparkSession.sparkContext.broadcast(sketch.astype(np.int32))  # CELLS numbers

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = held.value

        def rows() -> Iterator[tuple]:
            for doc_id, gram in _each_set(batches):
                n = len(gram)
                size = n - _least_overlap(n, percent) + 1
                pick = np.argsort(order[(gram % np.uint64(len(order))).astype(np.int64)], kind="stable")[:size]
                yield gram[pick].view(np.int64), np.full(size, doc_id), np.full(size, n), np.arange(size)

        yield from _batched(rows(), ["gram", "doc_id", "n", "pos"])

    posted = sets.select("doc_id", "grams").mapInArrow(prefix, "gram long, doc_id long, n long, pos long")
    posted = posted.join(component.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = posted.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("gram")
    posted = posted.join(mixed, "gram").withColumn("band", F.floor(F.log("n") / F.log(F.lit(100.0 / percent))).cast("int"))
    a = posted.alias("a")
    b = posted.withColumn("band", F.explode(F.array("band", F.col("band") - 1, F.col("band") - 2))).alias("b")
    after = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    like = (
        (F.col("a.gram") == F.col("b.gram"))
        & (F.col("a.band") == F.col("b.band"))
        & (F.col("a.component") != F.col("b.component"))
        & ((F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.doc_id") < F.col("b.doc_id"))))
        & (F.col("a.n") * 100 >= F.col("b.n") * percent)
        & (after * (100 + percent) >= (F.col("a.n") + F.col("b.n")) * percent)
    )
    return a.join(b, like).select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")).distinct()


def _common(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(left, right, strict=True)], dtype="int64")


def linked(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``u, v``: the pairs whose overlaps, counted fragment by fragment and summed, reach the threshold."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [])
            for doc_id, gram in _each_set(iter([batch])):
                bounds = np.searchsorted(gram, np.arange(1, FRAGMENTS, dtype=np.uint64) << np.uint64(61))
                for k, part in enumerate(np.split(gram, bounds)):
                    for column, value in zip(rows, (doc_id, len(gram), k, part.tobytes()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.binary())], names=["id", "n", "part", "grams"])

    parts = sets.select("doc_id", "grams").mapInArrow(cut, "id long, n long, part int, grams binary")
    left = parts.select(F.col("id").alias("a"), F.col("n").alias("na"), "part", F.col("grams").alias("ga"))
    right = parts.select(F.col("id").alias("b"), F.col("n").alias("nb"), "part", F.col("grams").alias("gb"))
    # neither the pairs nor the sets have a bound: never a broadcast
    met = pairs.hint("merge").join(left, "a").hint("merge").join(right, ["b", "part"]).withColumn("common", F.pandas_udf(_common, "long")("ga", "gb"))
    total = met.groupBy("a", "b").agg(F.sum("common").alias("common"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return total.where((100 + percent) * F.col("common") >= percent * (F.col("na") + F.col("nb"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def set_sizes(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, n``: set size of every row."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.diff(np.searchsorted(shingle_sets(texts, words)[1], np.arange(len(texts) + 1))) for _, texts in chunks(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64), pa.int64())], names=["doc_id", "n"])

    return docs.select("doc_id", "text").mapInArrow(build, "doc_id long, n long")


def set_links(sets: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """``u, v``: links between sets that connect all that any links connect; no id may repeat among the sets."""
    live = sets.where("grams is not null")
    sketch = frequency_sketch(live)
    near = scratch.save(linked(leader_pairs(live, sketch, True), live, percent), "typical")
    # every document has one leader here, so the links themselves tell who is surely together
    component = near.select(F.col("v").alias("id"), F.col("u").alias("component"))
    near = near.union(scratch.save(linked(leader_pairs(live, sketch, False, component), live, percent), "large"))
    component = connected_components(near, scratch, "near")
    rest = scratch.save(prefix_pairs(live, component, sketch, percent), "rest")
    return near.union(scratch.save(linked(rest, live, percent), "far"))


def jaccard_components(docs: DataFrame, scratch: Scratch, words: int = WORDS, percent: int = PERCENT, per_range: int = PER_RANGE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``doc_id, text``.

    A component holds the documents that links reach from each other; its id
    is its smallest document. A row without words, or with a null id, links
    with nothing and has its own id. Rows with one id count as one document
    once linked: each of its different texts is compared by itself, and equal
    rows once. Documents of equal sets, and ties of leaders, go to the smaller
    id and change no component. Other columns are left out; no rows give none.
    Shingles are compared as 64-bit fingerprints.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where("doc_id is not null")
    if known.groupBy("doc_id").count().where("count > 1").isEmpty():
        sets = scratch.save(linkable_sets(docs, scratch.save(own_shingles(docs, words, per_range), "own"), words, percent), "sets")
        sizes, links = sets.select("doc_id", "n"), set_links(sets, scratch, percent)
    else:
        # each text of an id under a name of its own, written once so that names stay
        named = scratch.save(known.distinct().withColumn("name", F.monotonically_increasing_id()), "named")
        texts = named.select(F.col("name").alias("doc_id"), "text")
        sets = scratch.save(linkable_sets(texts, scratch.save(own_shingles(texts, words, per_range), "own"), words, percent), "sets")
        sizes, links = set_sizes(docs, words), set_links(sets, scratch, percent)
        for end in ("u", "v"):
            ids = named.select(F.col("name").alias(end), F.col("doc_id").alias("_id"))
            links = links.join(ids.hint("merge"), end).drop(end).withColumnRenamed("_id", end)
    final = connected_components(links, scratch, "all")
    scratch.drop("own", "typical", "large", "rest", "far", "named")
    return sizes.select("doc_id", F.col("n").alias("n_shingles")).join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op8_vertical_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of Jaccard similarity 0.75 of 5-word shingles."""
    return jaccard_components(read(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "op8"))


#: Pairs that share a shingle, counted in plain SQL; links spread step by step.
OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4])) END AS s FROM w
), g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
shared AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN shared USING (g) JOIN g b USING (g)
  WHERE a.doc_id < b.doc_id AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT a AS id, a AS z FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.z = e.a),
c AS (SELECT id, min(z) AS c FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.c, s.doc_id) AS component_id
FROM s LEFT JOIN c ON s.doc_id = c.id
"""
