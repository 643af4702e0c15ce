"""Ingesting and reindexing sources of the licensed corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import chunks, lifecycle
from textloom.operators.similarity import small
from textloom.sources import files
from textloom.tables import dealt, keep


def filter_sources(sources: DataFrame, status: str | None = None, license_status: str | None = None) -> DataFrame:
    """Sources of a status and license status, as far as these are given."""
    for column, wanted in (("status", status), ("license_status", license_status)):
        sources = sources if wanted is None else sources.where(F.col(column) == wanted)
    return sources


def scan_order(source_chunks: DataFrame) -> DataFrame:
    """Chunks by source, then place: for output only."""
    return source_chunks.orderBy("source_id", "chunk_index")


def chunk_sources(contents: DataFrame) -> DataFrame:
    """Chunks of ``source_id, content``: decoded, normalized and cut, with the source's id.

    Contents are looked at several times, so they should be rows of a table.
    """
    texts = T.nfc(files.decode_text(contents).where("decode_error is null"), "text").select(F.col("source_id").alias("doc_id"), "text")
    # dealt before they are cut, so that few large row groups keep all tasks busy
    texts = dealt(texts, "doc_id").withColumn("text", T.normalize_text(F.col("text")))
    parts = texts.withColumns({"part_no": F.lit(0), "page_number": F.lit(None).cast("int")})
    return chunks.chunk_corpus(parts).withColumnRenamed("doc_id", "source_id")


def _finished(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """Rows without a ``code`` get the status that their chunks give them."""
    counts = cut.groupBy("source_id").agg(F.count("*").alias("chunks"))
    out = rows.join(counts, "source_id", "left").withColumn("chunks", F.when(F.col("code").isNull(), F.coalesce("chunks", F.lit(0))))
    code = F.coalesce("code", F.when(F.col("chunks") == 0, "no_extractable_text"))
    return out.withColumn("code", code).withColumn("status", F.when(code.isNull(), "ready").when(code == "no_extractable_text", "failed").otherwise("refused"))


def ingest_sources(raw: DataFrame, known: DataFrame, required: list[str], optional: list[str]) -> tuple[DataFrame, DataFrame]:
    """New sources with ``status``, ``code`` and ``chunks``, and their chunks.

    ``raw``: ``source_id, filename, content_type, content, size_bytes, sha256``,
    the license range and the metadata fields. The first rule that a source
    breaks is its code: metadata, admission, checksum, a digest that ``known``
    (``sha256``) or a smaller id has. What passes is cut; a source without
    chunks has failed. The content itself goes no further.
    """
    clean = lifecycle.normalize_metadata(raw, required, optional)
    admitted = lifecycle.admission_code(F.col("filename"), F.col("content_type"), F.col("content"))
    intact = (F.octet_length("content") == F.col("size_bytes")) & (F.sha2("content", 256) == F.col("sha256"))
    refused = F.coalesce("reject", F.nullif(admitted, F.lit("accepted")), F.when(~F.coalesce(intact, F.lit(False)), "checksum_mismatch"))
    # digests and samples are told once; the digests, the rows and the texts are read from this table
    checked = keep(clean.withColumn("code", refused), "checked")
    # only digests are compared, not contents
    sound = checked.where("code is null").select("source_id", "sha256").join(known.select("sha256").distinct().withColumn("held", F.lit(True)), "sha256", "left")
    first = F.min("source_id").over(Window.partitionBy("sha256"))
    twice = sound.withColumn("first", first).where("held or source_id <> first").select("source_id", F.lit("duplicate").alias("again"))
    rows = checked.join(small(keep(twice, "again")), "source_id", "left").withColumn("code", F.coalesce("code", "again")).drop("again", "reject")
    cut = chunk_sources(rows.where("code is null").select("source_id", "content"))
    return _finished(rows.drop("content"), cut), cut


def reindex_sources(sources: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ``wanted`` (``source_id``) sources with ``status``, ``code`` and ``chunks``, and their chunks cut anew.

    ``sources``: ``source_id, status, content, size_bytes, sha256``. Disabled
    sources, those at work and those whose content has changed are refused.
    Chunks replace those of the same source by ``files.replace_partitions``.
    """
    rows = sources.join(wanted.select("source_id").distinct(), "source_id", "left_semi")
    intact = (F.octet_length("content") == F.col("size_bytes")) & (F.sha2("content", 256) == F.col("sha256"))
    code = F.when(F.col("status") == "disabled", "source_disabled").when(F.col("status") == "processing", "source_busy").when(~F.coalesce(intact, F.lit(False)), "checksum_mismatch")
    rows = keep(rows.withColumn("code", code), "checked")
    cut = chunk_sources(rows.where("code is null").select("source_id", "content"))
    return _finished(rows.drop("content", "status"), cut), cut


def corpus_cosine(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``l, r, cosine`` of pairs by corpus-fitted unit vectors ``id, idx, weight``; 0 for an empty side."""
    a = left.select(F.col("id").alias("l"), "idx", F.col("weight").alias("wl"))
    b = right.select(F.col("id").alias("r"), "idx", F.col("weight").alias("wr"))
    dots = pairs.join(a, "l").join(b, ["r", "idx"]).groupBy("l", "r").agg(F.sum(F.col("wl") * F.col("wr")).alias("dot"))
    cosine = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("dot", F.lit(0.0))))
    return pairs.select("l", "r").join(dots, ["l", "r"], "left").select("l", "r", cosine.alias("cosine"))


def retry_at(failed: Column, key: Column, attempt: Column) -> Column:
    """When a failed attempt is due again: a share of its bound, drawn from key and attempt, after it failed."""
    share = F.pmod(F.xxhash64(key, attempt), F.lit(1_000_000)) / 1_000_000
    return F.timestamp_micros((F.unix_micros(failed) + share * T.retry_bound(attempt) * 1_000_000).cast("long"))
