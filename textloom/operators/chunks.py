"""Documents from parts, and their sentence chunks with exact offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T


def place_parts(parts: DataFrame) -> DataFrame:
    """Add ``part_start``: where a part begins in the parts joined by line ends. Empty parts count their line end."""
    before = Window.partitionBy("doc_id").orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("part_start", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long"))


def join_parts(parts: DataFrame) -> DataFrame:
    """``doc_id, text``: the parts of each document in order, one line end between."""
    ordered = F.array_sort(F.collect_list(F.struct("part_no", F.coalesce("text", F.lit("")).alias("text"))))
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"))


def chunk_corpus(parts: DataFrame) -> DataFrame:
    """Sentence chunks of ``doc_id, part_no, page_number, text`` (normalized, null as empty).

    ``char_start`` and ``char_end`` are code points of the joined document and
    ``content`` is exactly that range. A chunk lies in one line and one part;
    blank pieces give none.
    """
    placed = place_parts(parts.withColumn("text", F.coalesce("text", F.lit(""))))
    cut = placed.select("doc_id", "part_no", "page_number", "part_start", F.posexplode(T.sentence_pieces(F.col("text"))).alias("at", "piece"))
    before = Window.partitionBy("doc_id", "part_no").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    lead = F.length("piece") - F.length(F.ltrim("piece", F.lit(T.BLANKS)))
    content = F.btrim("piece", F.lit(T.BLANKS))
    cut = cut.withColumn("start", F.col("part_start") + F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + lead).withColumn("content", content).where("content <> ''")
    index = Window.partitionBy("doc_id").orderBy("part_no", "at")
    return cut.select(
        "doc_id",
        (F.row_number().over(index) - 1).cast("long").alias("chunk_index"),
        "content",
        F.col("start").cast("long").alias("char_start"),
        (F.col("start") + F.length("content")).cast("long").alias("char_end"),
        T.token_count(F.col("content")).alias("token_count"),
        "page_number",
        F.sha2("content", 256).alias("content_sha256"),
    )


def constraint_audit(chunks: DataFrame) -> DataFrame:
    """Add ``valid`` and the first broken rule of each chunk, repeated indexes included."""
    times = F.count("*").over(Window.partitionBy("doc_id", "chunk_index"))
    broken = (
        F.when(F.col("char_start") < 0, "negative_start")
        .when(F.col("char_end") <= F.col("char_start"), "empty_range")
        .when(F.col("page_number") <= 0, "bad_page")
        .when(times > 1, "repeated_index")
    )
    return chunks.withColumn("broken", broken).withColumn("valid", F.col("broken").isNull())
