"""Matching token blocks of matched chunk pairs, as evidence with offsets on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.config import Config
from textloom.functions import text as T
from textloom.operators import similarity as S
from textloom.operators.blocks import token_blocks
from textloom.tables import keep


def eligible_sources(sources: DataFrame, today: Column) -> DataFrame:
    """Ready, approved sources whose license covers ``today``, both ends included."""
    begun = F.col("license_valid_from").isNull() | (F.col("license_valid_from") <= today)
    open_ = F.col("license_valid_until").isNull() | (F.col("license_valid_until") >= today)
    return sources.where((F.col("status") == "ready") & (F.col("license_status") == "approved") & begun & open_)


def match_evidence(documents: DataFrame, sources: DataFrame, config: Config = Config(), today: Column | None = None, scored: DataFrame | None = None) -> DataFrame:
    """Evidence rows of document chunks against eligible source chunks.

    Both inputs: ``id, doc_id, content, char_start``; sources also carry the
    license columns if ``today`` is given. Offsets are of the whole texts.
    ``scored``: the matches, where they are known already, as of an index.
    """
    sources = sources if today is None else eligible_sources(sources, today)
    if scored is None:
        scored = S.match_pairs(S.text_rows(documents), S.text_rows(sources), config)
    # read by both sides' tokens and by the last join
    scored = keep(scored, "matches")
    found = token_blocks(scored, documents.select("id", "content"), sources.select("id", "content"))
    d = documents.select(F.col("id").alias("l"), F.col("doc_id").alias("document_id"), F.col("char_start").alias("d0"))
    s = sources.select(F.col("id").alias("r"), F.col("doc_id").alias("source_id"), F.col("char_start").alias("s0"))
    rows = found.join(scored, ["l", "r"]).join(d, "l").join(s, "r")
    return rows.select(
        "document_id", "source_id", F.col("l").alias("document_chunk_id"), F.col("r").alias("source_chunk_id"),
        T.score_round(F.col("score")).alias("similarity_score"),
        S.score_components(F.col("word"), F.col("char"), F.col("overlap"), config).alias("score_components"),
        (F.col("d0") + F.col("doc_from")).alias("document_match_start"), (F.col("d0") + F.col("doc_to")).alias("document_match_end"),
        (F.col("s0") + F.col("src_from")).alias("source_match_start"), (F.col("s0") + F.col("src_to")).alias("source_match_end"),
        F.col("tokens").alias("matched_token_count"),
    )


def replay_snapshot(pairs: DataFrame, left: DataFrame, right: DataFrame, snapshot: dict[str, str], known: Config = Config()) -> DataFrame:
    """Rescore pairs under the settings stored with an earlier run.

    Pairs that carry their signals ``word, char, overlap``, told by the gram
    ranges of ``known``, are weighed anew if the stored run had the same ranges; for pairs of ids alone they are found first.
    """
    config = Config.from_snapshot(snapshot)
    if {"word", "char", "overlap"} <= set(pairs.columns) and (config.word_range, config.char_range) == (known.word_range, known.char_range):
        found = pairs.select("l", "r", "word", "char", "overlap", S.hybrid_score(F.col("word"), F.col("char"), F.col("overlap"), config).alias("score"))
    else:
        found = S.score_pairs(pairs, left, right, config, prune=False)
    return found.where(F.col("score") >= F.lit(config.threshold))
