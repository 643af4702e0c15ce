"""Scores of text pairs and the lossless candidate join.

The word and character cosines are those of TF-IDF fitted on the two texts of
a pair. With two texts the smoothed IDF is 1 for a shared gram and
k = ln(1.5) + 1 for any other, so sums over shared grams and each text's sum
of squared counts are all that a pair needs.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.config import Config
from textloom.functions import text as T
from textloom.operators.held import gram_map, likely, reaching
from textloom.tables import dealt, keep

K2 = (math.log(1.5) + 1) ** 2
#: Rows, and bytes of text in them, that a small side may have and still be sent to every task.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Cells of each row of a frequency sketch, which every task gets, and its rows.
CELLS, SKETCH_ROWS = 1 << 17, 2


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if the side has at most ``rows`` rows of plain columns and ``size`` bytes of text; else it stays a shuffle join."""
    if any("<" in kind for _, kind in df.dtypes):
        return df
    texts = [F.coalesce(F.octet_length(name), F.lit(0)) for name, kind in df.dtypes if kind in ("string", "binary")]
    held = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(reduce(Column.__add__, texts, F.lit(0))).alias("size")).first()
    return F.broadcast(df) if held["n"] <= rows and (held["size"] or 0) <= size else df


def streams(texts: DataFrame) -> DataFrame:
    """``id, stream``: the folded words of each text, from which alone its scores come; texts without words are left out.

    Rows that carry their ``stream`` are of a kept table, and are not folded again.
    """
    if "stream" in texts.columns:
        return texts.select("id", "stream").where("stream <> ''")
    return keep(texts.select("id", T.char_stream(F.col("text")).alias("stream")).where("stream <> ''"), "streams")


def with_stream(rows: DataFrame) -> DataFrame:
    """Add the ``stream`` of ``content``, empty without words."""
    return rows.withColumn("stream", F.coalesce(T.char_stream(F.col("content")), F.lit("")))


def text_rows(rows: DataFrame) -> DataFrame:
    """``id, text`` of ``id, content``, and the ``stream`` if the rows carry it."""
    return rows.select("id", F.col("content").alias("text"), *(c for c in ("stream",) if c in rows.columns))


def words_of(texts: DataFrame) -> Column:
    """Words of each row's ``stream``, which is their list, or else of its ``text``."""
    return F.split("stream", " ") if "stream" in texts.columns else T.words(F.col("text"))


def firsts(rows: DataFrame) -> DataFrame:
    """``id, stream``: the least id of each word sequence, which stands for all its copies."""
    return rows.groupBy("stream").agg(F.min("id").alias("id")).select("id", "stream")


def likely_firsts(left: DataFrame, right: DataFrame, low: int, high: int, share: float, squares: bool = True) -> tuple[DataFrame, DataFrame]:
    """Firsts of the ``streams`` of both sides; left ones that hold too few of the right side's grams for any match are left out."""
    b = keep(firsts(right), "firsts")
    a = firsts(left)
    return keep(likely(a, gram_map(b, low, high), low, high, share, squares) if share > 0 else a, "firsts"), b


def matchable(left: DataFrame, right: DataFrame, low: int, high: int, share: float, squares: bool = True) -> DataFrame:
    """The rows of ``left`` (``content``, any columns) with their ``stream`` that hold enough grams of ``right`` (``id, content``) for any match, or all at a share of 0.

    Told where the rows are made, before anything is written or shuffled: all
    that follows reads these rows alone. Copies pass or fail together.
    """
    # no filter on the stream here: it would be computed twice, and one without words holds no gram
    named = with_stream(left)
    return likely(named, gram_map(streams(text_rows(right)), low, high), low, high, share, squares) if share > 0 else named


def texts_of(texts: DataFrame, some: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose id is among ``some``, kept."""
    return keep(texts.join(small(some.select("id")), "id", "left_semi"), "texts")


def spread(found: DataFrame, side: str, first: DataFrame, rows: DataFrame) -> DataFrame:
    """``found`` with each first id of a ``side`` replaced by those of all its copies."""
    named = found.join(first.withColumnRenamed("id", side), side).drop(side)
    return rows.withColumnRenamed("id", side).join(small(named), "stream").drop("stream").select(found.columns)


def spread_pairs(found: DataFrame, a: DataFrame, b: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of ``firsts`` as pairs of all ids of both sides' ``streams``."""
    return spread(spread(keep(found, "found"), "r", b, right), "l", a, left)


def by_firsts(pairs: DataFrame, left: DataFrame, right: DataFrame, key: Callable[[DataFrame], Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``l, r, l0, r0``: pairs with the least ids of texts of the same ``key``, and the rows of these ids on both sides."""
    pairs = keep(pairs.select("l", "r"), "pairs")
    named, some = pairs, []
    for texts, side in ((left, "l"), (right, "r")):
        texts = keep(texts.join(small(pairs.select(F.col(side).alias("id")).distinct()), "id", "left_semi"), "texts")
        rows = keep(texts.select("id", key(texts).alias("stream")), "streams")
        first = keep(firsts(rows), "firsts")
        some.append(texts_of(texts, first))
        alike = keep(rows.join(small(first.withColumnRenamed("id", f"{side}0")), "stream").select(F.col("id").alias(side), f"{side}0"), "alike")
        named = named.join(small(alike), side)
    return keep(named.select("l", "r", "l0", "r0"), "named"), *some


def gram_counts(texts: DataFrame, grams: Column) -> DataFrame:
    """``id, gram, tf, norm2``: counts of each text's grams and their sum of squares.

    The texts are dealt by id before they are cut, so the grams, many times
    the text, need no shuffle to be counted and summed.
    """
    counts = dealt(texts, "id").select("id", F.explode(grams).alias("gram")).groupBy("id", "gram").agg(F.count("*").cast("double").alias("tf"))
    return counts.withColumn("norm2", F.sum(F.col("tf") * F.col("tf")).over(Window.partitionBy("id")))


def word_counts(texts: DataFrame, config: Config = Config()) -> DataFrame:
    return gram_counts(texts, T.ngrams(words_of(texts), *config.word_range))


def char_counts(texts: DataFrame, config: Config = Config()) -> DataFrame:
    stream = F.col("stream") if "stream" in texts.columns else T.char_stream(F.col("text"))
    return gram_counts(texts, T.char_ngrams(stream, *config.char_range))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("gram").agg(F.count("*").alias("df"))


def global_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the place of each row in the whole order, from 0: a range sort, then one offset per partition."""
    placed = df.orderBy(*order).withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()})
    placed = keep(placed, "placed")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first")).select("_p", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_before") + F.col("_m") - F.col("_first")).drop("_p", "_m", "_first", "_before")


def corpus_tfidf(fit_on: DataFrame, transform: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vocabulary ``gram, idx, df, idf`` fitted on counts, and unit vectors ``id, idx, weight`` of others.

    The index goes by gram size, then value; unseen grams are dropped and a
    text without any has no rows.
    """
    n = fit_on.select("id").distinct().count()
    vocabulary = document_frequency(fit_on).withColumn("idf", F.log((F.lit(1.0) + n) / (1 + F.col("df"))) + 1)
    vocabulary = global_index(vocabulary, [F.size(F.split("gram", "\x01")), F.split("gram", "\x01")], "idx")
    weighted = transform.join(vocabulary, "gram").select("id", "idx", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return vocabulary.select("gram", "idx", "df", "idf"), weighted.select("id", "idx", (F.col("w") / norm).alias("weight"))


def _cell(row: int, gram: Column, cells: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(row), gram), F.lit(cells)).cast("int")


def sketch(counts: DataFrame, cells: int = CELLS) -> DataFrame:
    """``row, cell, n, cells``: how many texts hold the grams of each cell; of one size however many grams there are.

    Sketches of parts of a corpus are merged by adding them up cell by cell.
    """
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("row"), _cell(r, F.col("gram"), cells).alias("cell")) for r in range(SKETCH_ROWS)))).alias("x")
    return counts.select(each).groupBy("x.row", "x.cell").agg(F.count("*").alias("n")).withColumn("cells", F.lit(cells))


def merge_sketches(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, parts).groupBy("row", "cell", "cells").agg(F.sum("n").alias("n")).select("row", "cell", "n", "cells")


def with_frequency(rows: DataFrame, order: DataFrame, gram: str = "gram") -> DataFrame:
    """Add ``df``, an upper bound of how many texts hold the gram: the least of its cells in the sketch, 0 if it is in none."""
    size = order.select("cells").first()
    if size is None:
        return rows.withColumn("df", F.lit(0).cast("long"))
    for r in range(SKETCH_ROWS):
        row = F.broadcast(order.where(F.col("row") == r).select(F.col("cell").alias(f"_c{r}"), F.col("n").alias(f"_n{r}")))
        rows = rows.withColumn("_c", _cell(r, F.col(gram), size[0])).join(row, F.col("_c") == F.col(f"_c{r}"), "left").drop("_c", f"_c{r}")
    known = [F.coalesce(f"_n{r}", F.lit(0)) for r in range(SKETCH_ROWS)]
    return rows.withColumn("df", F.least(*known)).drop(*(f"_n{r}" for r in range(SKETCH_ROWS)))


def prefixes(counts: DataFrame, order: DataFrame, share: float, held: bool = False) -> DataFrame:
    """``id, gram`` of each text's rare grams, without the frequent tail that no match can live on.

    Any order that both sides follow is lossless. Here grams go by their
    frequency in the sketch ``order``, then by value, so each has its place.
    With ``held``, grams that the sketch does not hold are left out before
    they are ranked: they come first, so no other gram's tail changes.
    """
    tail = Window.partitionBy("id").orderBy(F.desc("df"), F.desc("gram")).rowsBetween(Window.unboundedPreceding, 0)
    known = with_frequency(counts, order)
    ranked = (known.where("df > 0") if held else known).withColumn("below", F.sum(F.col("tf") * F.col("tf")).over(tail))
    # the slack keeps a text whose tail sum meets the bound but for rounding
    return ranked.where(F.col("below") >= share * F.col("norm2") * (1 - 1e-9)).select("id", "gram")


def candidate_pairs(left: DataFrame, right: DataFrame, config: Config = Config(), chars: tuple[DataFrame, DataFrame] | None = None, cells: int = CELLS) -> DataFrame:
    """``l, r``: pairs of word counts that may reach the threshold; no match is missing.

    If a match needs a word cosine, only rare grams are joined; if it needs
    just a common word, any gram. If the threshold is no more than the weight
    of characters, a match may have no common word at all: then ``chars``,
    the character counts of both sides, bring those by their rare grams.
    """
    if config.threshold == 0:
        raise ValueError("every pair matches at threshold 0; there is nothing to prune")

    def met(a: DataFrame, b: DataFrame, share: float) -> DataFrame:
        if share > 0:
            # the right side's frequencies: what it does not hold joins with nothing
            order = keep(sketch(b, cells), "order")
            a, b = prefixes(a, order, share, held=True), keep(prefixes(b, order, share), "prefixes")
        a, b = a.select(F.col("id").alias("l"), "gram"), b.select(F.col("id").alias("r"), "gram")
        return a.join(small(b), "gram").select("l", "r")

    pairs = met(left, right, config.prefix_share(config.least_word_cosine))
    if config.threshold <= config.char_weight:
        if chars is None:
            raise ValueError("a threshold within the weight of characters needs the character counts")
        pairs = pairs.union(met(*chars, config.prefix_share(float(config.threshold / config.char_weight))))
    return pairs.distinct()


def overlap_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``l, r, shared, total, score``: pairs of ``id, text`` rows with word Jaccard at or above the threshold (> 0).

    Words go by their frequency on the right side; two such sets share one of their first
    n - ceil(threshold * n) + 1 words, and neither is larger than the other
    by more than the threshold allows, so only such sets meet. Texts of the
    same words are compared once.
    """
    every = streams(left), streams(right)
    first = likely_firsts(*every, 1, 1, threshold, squares=False)
    found = _overlap_pairs(*first, threshold)
    return spread_pairs(found, *first, *every)


def _overlap_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """As ``overlap_pairs``, of ``id, stream`` rows."""

    def sets(texts: DataFrame) -> DataFrame:
        return texts.select("id", F.array_distinct(words_of(texts)).alias("words")).where(F.size("words") > 0)

    a, b = sets(left), sets(right)
    order = keep(sketch(b.select(F.explode("words").alias("gram"))), "order")

    def prefix(side: DataFrame, name: str) -> DataFrame:
        # dealt by id before they are cut, so ranking needs no further shuffle
        rows = dealt(side, "id").select("id", F.size("words").alias("n"), F.explode("words").alias("word"))
        rows = with_frequency(rows, order, "word")
        place = F.row_number().over(Window.partitionBy("id").orderBy("df", "word"))
        first = rows.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
        return first.select(F.col("id").alias(name), F.col("n").alias(f"n{name}"), "word")

    alike = (F.col("nl") >= F.col("nr") * threshold - 1e-9) & (F.col("nr") >= F.col("nl") * threshold - 1e-9)
    pairs = prefix(a, "l").join(small(keep(prefix(b, "r"), "prefixes")), "word").where(alike).select("l", "r").distinct()
    # joined as texts, far smaller than arrays, of which a small side goes to every task
    both = keep(pairs, "pairs").join(small(right.select(F.col("id").alias("r"), F.col("stream").alias("sr"))), "r").join(small(left.select(F.col("id").alias("l"), F.col("stream").alias("sl"))), "l")
    both = both.withColumns({"wl": F.array_distinct(F.split("sl", " ")), "wr": F.array_distinct(F.split("sr", " "))})
    both = both.select("l", "r", F.size(F.array_intersect("wl", "wr")).cast("long").alias("shared"), (F.size("wl") + F.size("wr")).cast("long").alias("both"))
    total = F.col("both") - F.col("shared")
    return both.select("l", "r", "shared", total.alias("total"), (F.col("shared") / total).alias("score")).where(F.col("score") >= threshold)


def pair_cosine(pairs: DataFrame, left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Add the pair-fitted cosine; pairs without a common gram get 0. Rounded to 12 decimals against summation order."""
    a = left.select(F.col("id").alias("l"), "gram", F.col("tf").alias("ta"), F.col("norm2").alias("na"))
    b = right.select(F.col("id").alias("r"), "gram", F.col("tf").alias("tb"), F.col("norm2").alias("nb"))
    met = pairs.select("l", "r").join(a, "l").join(b, ["r", "gram"])
    sums = met.groupBy("l", "r").agg(
        F.sum(F.col("ta") * F.col("tb")).alias("dot"), F.sum(F.col("ta") * F.col("ta")).alias("sa"), F.sum(F.col("tb") * F.col("tb")).alias("sb"), F.max("na").alias("na"), F.max("nb").alias("nb")
    )
    norm = (K2 * F.col("na") - (K2 - 1) * F.col("sa")) * (K2 * F.col("nb") - (K2 - 1) * F.col("sb"))
    cosine = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(F.col("dot") / F.sqrt(norm), 12)))
    return pairs.join(sums.select("l", "r", cosine.alias(name)), ["l", "r"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def word_overlap(left: Column, right: Column) -> Column:
    """Jaccard of two word arrays with its parts, as a struct."""
    shared, union = F.array_sort(F.array_intersect(left, right)), F.array_union(left, right)
    return F.struct(
        F.when(F.size(union) > 0, F.size(shared) / F.size(union)).otherwise(0.0).alias("score"),
        F.size(shared).alias("shared"),
        F.size(union).alias("total"),
        shared.alias("shared_words"),
        F.array_sort(F.array_except(left, right)).alias("left_only"),
        F.array_sort(F.array_except(right, left)).alias("right_only"),
        F.concat_ws(" / ", F.size(shared).cast("string"), F.size(union).cast("string")).alias("label"),
    )


def _exact(score: Column) -> Column:
    return score.cast("string").cast("decimal(38,18)")


def with_cosine(pairs: DataFrame, left: DataFrame, right: DataFrame, config: Config, least: float) -> DataFrame:
    """The ``pairs`` whose word cosine is ``least`` or more but for rounding, told from the texts' ``id, stream`` without a row per gram."""
    if least <= 0:
        return pairs
    a, b = (x.select(F.col("id").alias(i), F.col("stream").alias(f"{i}s")) for x, i in ((left, "l"), (right, "r")))
    texts = keep(pairs, "candidates").join(small(b), "r").join(small(a), "l")
    return reaching(texts, *config.word_range, K2, least)


def hybrid_score(word: Column, char: Column, overlap: Column, config: Config = Config()) -> Column:
    """Weighted sum of the signals in exact decimals, within [0, 1]."""
    def part(signal: Column, weight) -> Column:
        return (_exact(signal) * F.lit(weight).cast("decimal(5,4)")).cast("decimal(38,18)")

    total = part(word, config.word_weight) + part(char, config.char_weight) + part(overlap, config.overlap_weight)
    return F.least(F.lit(1).cast("decimal(38,18)"), F.greatest(F.lit(0).cast("decimal(38,18)"), total.cast("decimal(38,18)")))


def score_components(word: Column, char: Column, overlap: Column, config: Config = Config()) -> Column:
    """Score, weight and contribution of each signal."""
    def signal(score: Column, weight) -> Column:
        w = F.lit(weight).cast("decimal(5,4)")
        return F.struct(_exact(score).alias("score"), w.alias("weight"), (_exact(score) * w).cast("decimal(38,18)").alias("contribution"))

    return F.struct(F.lit("chunk_pair").alias("scope"), F.lit(config.version).alias("algorithm_version"), signal(word, config.word_weight).alias("word_tfidf"), signal(char, config.char_weight).alias("character_tfidf"), signal(overlap, config.overlap_weight).alias("word_overlap"))


def score_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, config: Config = Config(), prune: bool = True) -> DataFrame:
    """``l, r, word, char, overlap, score`` of pairs of ``id, text`` rows.

    Grams are counted only for the texts that occur in a pair, and once for
    texts of the same words. With ``prune``, pairs that cannot reach the
    threshold are dropped before the character grams, the dearest signal, are
    counted.
    """
    named, a, b = by_firsts(pairs, left, right, lambda texts: F.coalesce(T.char_stream(F.col("text")), F.lit("")))
    scored = _score_pairs(named.select(F.col("l0").alias("l"), F.col("r0").alias("r")).distinct(), a, b, config, prune)
    scored = keep(scored, "found").withColumnsRenamed({"l": "l0", "r": "r0"})
    return named.join(small(scored), ["l0", "r0"]).select("l", "r", "word", "char", "overlap", "score")


def _score_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, config: Config, prune: bool) -> DataFrame:
    pairs = keep(pairs, "pairs")

    def met(texts: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
        return texts.join(small(pairs.select(F.col(side).alias("id")).distinct()), "id", "left_semi")

    a, b = met(left, pairs, "l"), met(right, pairs, "r")
    scored = pair_cosine(pairs, word_counts(a, config), word_counts(b, config), "word")
    if prune:
        # before words are compared, which costs more than to look at the cosine
        scored = keep(scored.where(hybrid_score(F.col("word"), F.lit(1.0), F.lit(1.0), config) >= F.lit(config.threshold)), "cosines")
    a = a.select(F.col("id").alias("l"), F.array_distinct(words_of(a)).alias("wl"))
    b = b.select(F.col("id").alias("r"), F.array_distinct(words_of(b)).alias("wr"))
    scored = scored.join(a, "l").join(b, "r").withColumn("overlap", word_overlap(F.col("wl"), F.col("wr"))["score"]).drop("wl", "wr")
    if prune:
        best = hybrid_score(F.col("word"), F.lit(1.0), F.col("overlap"), config)
        scored = scored.where(best >= F.lit(config.threshold))
    scored = keep(scored, "scored")
    a, b = met(left, scored, "l"), met(right, scored, "r")
    chars = pair_cosine(scored.select("l", "r"), char_counts(a, config), char_counts(b, config), "char")
    scored = scored.join(chars, ["l", "r"])
    return scored.select("l", "r", "word", "char", "overlap", hybrid_score(F.col("word"), F.col("char"), F.col("overlap"), config).alias("score"))


def match_pairs(left: DataFrame, right: DataFrame, config: Config = Config()) -> DataFrame:
    """Scored pairs at or above the threshold, unrounded and inclusive.

    At a threshold of 0 every pair is a match, so all are listed; at any other
    only candidates are. Texts of the same words score alike, so the first of
    them is matched and its matches are theirs.
    """
    if config.threshold == 0:
        pairs = left.select(F.col("id").alias("l")).crossJoin(right.select(F.col("id").alias("r")))
        return score_pairs(pairs, left, right, config).where(F.col("score") >= F.lit(config.threshold))
    every = streams(left), streams(right)
    first = likely_firsts(*every, *config.word_range, config.prefix_share(config.least_word_cosine))
    a, b = first
    chars = (char_counts(a, config), char_counts(b, config)) if config.threshold <= config.char_weight else None
    pairs = candidate_pairs(word_counts(a, config), word_counts(b, config), config, chars)
    pairs = with_cosine(pairs, *first, config, config.least_word_cosine)
    found = _score_pairs(pairs, a, b, config, True).where(F.col("score") >= F.lit(config.threshold))
    return spread_pairs(found, *first, *every)


def word_pairs(left: DataFrame, right: DataFrame, config: Config = Config(), least: float | None = None) -> DataFrame:
    """``l, r`` of ``candidate_pairs`` of ``id, text`` rows; with ``least`` those of at least that cosine ``word``. Copies are compared once."""
    every = streams(left), streams(right)
    first = likely_firsts(*every, *config.word_range, config.prefix_share(config.least_word_cosine))
    a, b = (word_counts(x, config) for x in first)
    found = candidate_pairs(a, b, config)
    if least is not None:
        # few pairs are left, so grams are counted for their texts alone
        found = keep(with_cosine(found, *first, config, least), "pairs")
        a, b = (word_counts(texts_of(x, found.select(F.col(i).alias("id")).distinct()), config) for x, i in zip(first, "lr", strict=True))
        found = pair_cosine(found, a, b, "word").where(F.col("word") >= least)
    return spread_pairs(found, *first, *every)
