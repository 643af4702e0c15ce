"""Mix sources to target weights by entropy balancing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import WORD, Scratch, read

#: Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
#: No source and no document gives more than so many times its size.
MOST = 3
#: Sources, with their totals, that the driver holds; more are refused.
MAX_SOURCES = 100_000
#: Documents of a source that one bucket of their hashes holds, about, and hexadecimal digits of it, at most.
BUCKET_ROWS, MOST_DIGITS = 50_000, 6


def source_targets(sizes: list[tuple[str | None, int]], weights: tuple = WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Share all words by weight; what exceeds ``most`` times a source's size is shared anew.

    ``sizes``: source and its words. Weights go round the sources by code
    point, null last. Ends when no target is above its limit or all are at it.
    """
    order = sorted((s for s, _ in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * any(s is None for s, _ in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    size = dict(sizes)
    total, full = float(sum(size.values())), set()
    while True:
        open_ = [s for s in order if s not in full]
        rest = total - sum(most * size[s] for s in full)
        share = rest / sum(weight[s] for s in open_) if open_ else 0.0
        above = {s for s in open_ if share * weight[s] > most * size[s]}
        if not above:
            return {s: float(most * size[s]) if s in full else share * weight[s] for s in order}
        full |= above


def entropy_balance(cells: DataFrame, targets: dict, tolerance: float = 1e-11, most_steps: int = 100) -> dict:
    """Rates ``exp(tilt)`` nearest to even rates whose words meet each source's target.

    ``cells``: ``source, words``. Each Newton step of the convex dual is one
    distributed sum of the tilted words, which are gradient and curvature at
    once since a document lies in one source. A target or source of 0 words
    has rate 0.
    """
    total = {r["source"]: r["words"] for r in cells.groupBy("source").agg(F.sum("words").alias("words")).collect()}
    live = [s for s in total if total[s] and targets[s] > 0]
    start = np.log(sum(targets[s] for s in live) / sum(total[s] for s in live)) if live else 0.0
    tilt = dict.fromkeys(live, float(start))
    spark = cells.sparkSession
    for _ in range(most_steps):
        if not live:
            break
        now = spark.createDataFrame([(s, tilt[s]) for s in live], "source string, tilt double")
        a, b = cells.alias("a"), F.broadcast(now).alias("b")  # at most MAX_SOURCES rows
        sums = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).groupBy("b.source").agg(F.sum(F.col("a.words") * F.exp("b.tilt")).alias("mass"))
        mass = {r["source"]: r["mass"] for r in sums.collect()}
        if max(abs(mass[s] - targets[s]) / targets[s] for s in live) <= tolerance:
            break
        for s in live:
            tilt[s] += float(np.clip((targets[s] - mass[s]) / mass[s], -1.0, 1.0))
    return {s: float(np.exp(tilt[s])) if s in tilt else 0.0 for s in total}


def mix(docs: DataFrame, scratch: Scratch, weights: tuple = WEIGHTS, most: int = MOST, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``size, source_size, target, copies`` to documents with ``doc_id, source, text``.

    A document's rate is its source's; the whole part is copied outright and
    the fraction rounded by systematic choice: in the order of the document
    id's hash, documents get one more copy until their words meet the rest of
    the target, so one last hash tells each source's documents apart. Words
    are summed by buckets of hashes, and only the bucket in which the rest is
    met is ordered, without its texts. Rows with the same id share their fate,
    null ids as one. A null text has size 0 and no copies, a null source is a
    source. Columns of ``docs`` with the added names are replaced; no rows
    give none.
    """
    spark = docs.sparkSession
    docs = docs.drop("size", "source_size", "target", "copies")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    largest = docs.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    digits = next(d for d in range(1, MOST_DIGITS + 1) if largest <= bucket_rows * 16**d or d == MOST_DIGITS)
    keyed = docs.select("source", key.alias("key"), F.substring(key, 1, digits).alias("bucket"), "text")
    cells = scratch.save(keyed.groupBy("source", "bucket").agg(F.sum(size).alias("words")), "cells")
    n_sources = cells.select("source").distinct().count()
    if n_sources > MAX_SOURCES:
        raise ValueError(f"{n_sources} sources; at most {MAX_SOURCES} can be mixed at once")
    sums = {r["source"]: r["words"] for r in cells.groupBy("source").agg(F.sum("words").alias("words")).collect()}
    targets = source_targets(list(sums.items()), weights, most)
    rates = {s: round(r, 9) for s, r in entropy_balance(cells, targets).items()}
    rows = [(s, sums[s], targets[s], int(rates[s]), (rates[s] - int(rates[s])) * sums[s]) for s in sums]
    plan = spark.createDataFrame(rows, "source string, source_size long, target double, whole long, rest double")

    def of_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        # at most MAX_SOURCES rows
        return left.alias("a").join(F.broadcast(right.alias("b")), F.col("a.source").eqNullSafe(F.col("b.source")), how)

    # the bucket in which the rest of a source's target is met, and the words before it
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    run = cells.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    met = of_source(run, plan).where("a.before < b.rest").groupBy("b.source").agg(F.max(F.struct("a.bucket", "a.before")).alias("x"), F.first("b.rest").alias("rest"))
    met = scratch.save(met.select("source", "x.bucket", "x.before", "rest"), "met")
    # its last hash whose middle lies before the rest; without any, all earlier buckets
    near = of_source(keyed, met).where("a.bucket = b.bucket").groupBy("b.source", "a.key").agg(F.sum(F.coalesce(F.regexp_count("a.text", F.lit(WORD)), F.lit(0))).cast("long").alias("words"), F.first("b.before").alias("before"), F.first("b.rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("words").over(upto) - F.col("words") / 2
    last = near.withColumn("middle", middle).where("middle < rest").groupBy("source").agg(F.max("key").alias("last"))
    ends = of_source(met.select("source", "bucket"), last, "left").select("a.source", F.coalesce("b.last", "a.bucket").alias("last"))
    plan = scratch.save(of_source(plan, ends, "left").select("a.*", F.coalesce("b.last", F.lit("")).alias("last")), "plan")
    more = F.when(key <= F.col("b.last"), 1).otherwise(0)
    copies = F.when(size > 0, F.col("b.whole") + more).otherwise(0).cast("long")
    return of_source(docs, plan).select(*(F.col(f"a.`{c}`") for c in docs.columns), size.alias("size"), F.col("b.source_size"), F.col("b.target"), copies.alias("copies"))


def op6_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mix(docs, Scratch(spark, "op6"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source
), steps AS (
  SELECT 0 AS step, source, source_size, w, false AS held FROM s
  UNION ALL
  SELECT step + 1, source, source_size, w, held OR
    w * (sum(source_size) OVER () - coalesce(sum(CASE WHEN held THEN 3 * source_size END) OVER (), 0))
      / sum(CASE WHEN held THEN 0 ELSE w END) OVER () > 3 * source_size
  FROM steps WHERE step < 30
), last AS (SELECT * FROM steps WHERE step = 30),
t AS (
  SELECT source, source_size,
    CASE WHEN held THEN 3.0 * source_size ELSE
      w * CAST(sum(source_size) OVER () - coalesce(sum(CASE WHEN held THEN 3 * source_size END) OVER (), 0) AS DOUBLE)
        / sum(CASE WHEN held THEN 0 ELSE w END) OVER () END AS target
  FROM last
), r AS (
  SELECT *, round(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END, 9) AS rate FROM t
), m AS (
  SELECT d.doc_id, d.size, r.source_size, CAST(r.target AS DOUBLE) AS target, floor(r.rate) AS whole,
    (r.rate - floor(r.rate)) * r.source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      - sum(d.size) OVER (PARTITION BY d.source, d.k) / 2.0 AS middle
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (whole + CASE WHEN middle < rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM m
"""
