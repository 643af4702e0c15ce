"""Coverage, merged sections and paging of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.lifecycle import owned
from textloom.operators.similarity import small
from textloom.tables import keep

#: Ranges of one key that one task merges at most.
HEAVY = 1 << 20
#: Rows of a file of a stored report, about, and files that files of fewer rows may come to.
REPORT_ROWS, REPORT_FILES = 1 << 18, 64


def islands(ranges: DataFrame, key: str, start: str = "start", end: str = "end", merge_adjacent: bool = True, heavy: int = HEAVY) -> DataFrame:
    """Add ``island``: number, within ``key``, of the group of overlapping ranges.

    With ``merge_adjacent`` ranges that only touch are one group (coverage),
    else they stay apart (report sections). A key of more than ``heavy``
    ranges is cut into segments in order, which tasks of their own merge.
    """
    ranges = keep(ranges, "ranges")
    large = ranges.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > heavy)
    cut = large.agg(F.sum(F.ceil(F.col("count") / heavy))).first()[0]
    if not cut:
        return _whole_islands(ranges, key, start, end, merge_adjacent)
    keys = small(large.select(key))
    few = _whole_islands(ranges.join(keys, key, "left_anti"), key, start, end, merge_adjacent)
    return few.unionByName(_cut_islands(ranges.join(keys, key, "left_semi"), key, start, end, merge_adjacent, int(cut)))


def _opens(start: str, reach: Column, merge_adjacent: bool) -> Column:
    return F.coalesce((F.col(start) > reach) if merge_adjacent else (F.col(start) >= reach), F.lit(True)).cast("int")


def _whole_islands(ranges: DataFrame, key: str, start: str, end: str, merge_adjacent: bool) -> DataFrame:
    order = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return ranges.withColumn("_opens", _opens(start, reach, merge_adjacent)).withColumn("island", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def _cut_islands(ranges: DataFrame, key: str, start: str, end: str, merge_adjacent: bool, segments: int) -> DataFrame:
    """As ``_whole_islands``, by range partitions: what a segment's ranges must pass is carried over from those before."""
    placed = keep(ranges.repartitionByRange(segments, key, start, end).withColumn("_p", F.spark_partition_id()), "placed")
    earlier = Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy(key, "_p").orderBy(start, end)
    # a row for each segment of a key
    ends = placed.groupBy(key, "_p").agg(F.max(end).alias("_end")).select(key, "_p", F.max("_end").over(earlier).alias("_carried"))
    reach = F.greatest(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), "_carried")
    marked = placed.join(small(ends), [key, "_p"]).withColumn("_opens", _opens(start, reach, merge_adjacent))
    marked = keep(marked.withColumn("_local", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))), "marked")
    opened = marked.groupBy(key, "_p").agg(F.sum("_opens").alias("_n")).select(key, "_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return marked.join(small(opened), [key, "_p"]).withColumn("island", F.col("_local") + F.col("_before")).select(*ranges.columns, "island")


def interval_union(ranges: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """``key, start, end`` of the merged ranges, touching ones joined."""
    return islands(ranges, key, start, end).groupBy(key, "island").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("island")


def invalid_ranges(ranges: DataFrame, key: str, lengths: DataFrame) -> DataFrame:
    """Ranges that are empty, begin below 0 or pass their document's end."""
    return ranges.join(lengths, key, "left").where((F.col("start") < 0) | (F.col("end") <= F.col("start")) | F.col("length").isNull() | (F.col("end") > F.col("length")) | (F.col("length") < 0))


def document_coverage(ranges: DataFrame, lengths: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, covered, length, ratio, percentage, raw_count, merged`` of every document in ``lengths``."""
    merged = interval_union(ranges, key).groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("merged"))
    raw = ranges.groupBy(key).agg(F.count("*").alias("raw_count"))
    ratio = F.when(F.col("length") > 0, F.col("covered") / F.col("length")).otherwise(0.0)
    out = lengths.join(merged, key, "left").join(raw, key, "left").withColumns({"covered": F.coalesce("covered", F.lit(0)), "raw_count": F.coalesce("raw_count", F.lit(0))})
    return out.withColumn("ratio", ratio).withColumn("percentage", F.col("ratio") * 100).select(key, "covered", "length", "ratio", "percentage", "raw_count", F.coalesce("merged", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("merged"))


def report_sections(matches: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Strictly overlapping evidence as one section: range, best score, pages in order, text, members.

    ``matches``: ``key, match_id, start, end, score, page_number``;
    ``texts``: ``key, text`` of the whole documents.
    """
    groups = islands(matches, key, merge_adjacent=False).groupBy(key, "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score"),
        F.array_sort(F.collect_list(F.struct("start", "end", "match_id", "page_number"))).alias("rows"),
    )
    pages = F.array_distinct(F.transform("rows", lambda r: r["page_number"]))
    out = groups.join(texts, key).withColumn("section_text", F.substr("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))
    return out.select(key, "start", "end", "score", T.score_level(F.col("score")).alias("level"), pages.alias("pages"), "section_text", F.transform("rows", lambda r: r["match_id"]).alias("members"))


def filter_matches(matches: DataFrame, source_id: int | None = None, minimum: float = 0.0) -> DataFrame:
    """Report filter, before merging."""
    kept = matches.where(F.col("score") >= minimum)
    return kept if source_id is None else kept.where(F.col("source_id") == source_id)


def evidence_page(matches: DataFrame, offset: int = 0, limit: int = 20) -> DataFrame:
    """One page of evidence: best score, then place, then id."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1 to 100 and offset not negative")
    return matches.orderBy(F.desc("score"), "start", "match_id").offset(offset).limit(limit)


def _place(row: tuple | None = None) -> Column:
    """What pages are ordered by: of a row's columns, or of a key's values."""
    score, start, match_id = map(F.lit, row) if row else map(F.col, ("score", "start", "match_id"))
    return F.struct((-score.cast("double")).alias("score"), start.cast("long").alias("start"), match_id.cast("string").alias("match_id"))


def report_files(n: int, rows: int = REPORT_ROWS) -> int:
    """Files of a stored report of ``n`` rows: of ``rows`` each, or of up to ``REPORT_ROWS`` where those would be more than ``REPORT_FILES``."""
    return max(1, min(-(-n // rows), max(REPORT_FILES, -(-n // REPORT_ROWS))))


def store_report(matches: DataFrame, path: str, rows: int = REPORT_ROWS) -> None:
    """Write evidence in the order of its pages, with the bounds of every file.

    The list of files is written last. ``matches``: ``match_id, source_id,
    score, start, ...``; match ids are unique. See ``report_files`` for
    ``rows``: a file costs as much time as thousands of rows.
    """
    matches = keep(matches, "report")
    order = [F.desc("score"), "start", "match_id"]
    sorted_rows = matches.repartitionByRange(report_files(matches.count(), rows), *order).sortWithinPartitions(*order)
    sorted_rows.write.mode("overwrite").parquet(f"{path}/rows")
    stored = matches.sparkSession.read.schema(matches.schema).parquet(f"{path}/rows")
    bounds = stored.groupBy(F.input_file_name().alias("file")).agg(F.min(_place()).alias("first"), F.max(_place()).alias("last"), F.count("*").alias("n"))
    bounds.coalesce(1).write.mode("overwrite").parquet(f"{path}/files")


def next_page(spark: SparkSession, path: str, after: tuple | None = None, limit: int = 20, source_id: int | None = None, minimum: float = 0.0) -> DataFrame:
    """The page of a stored report that follows the row of key ``after`` (``score, start, match_id``), the first without.

    Rows are as of ``evidence_page`` on the filtered matches. Only files that
    can hold them are read: those from the key on whose rows fill the page,
    more where a filter leaves too few.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    files = spark.read.parquet(f"{path}/files").where(F.col("first.score") <= -minimum)
    beyond = F.lit(True)
    if after is not None:
        key = _place(after)
        files, beyond = files.where(F.col("last") > key), _place() > key
    # every file has a row: of the files from the key on, so many fill any page without a filter
    wanted, page = limit + 1, None
    while True:
        listed = files.orderBy("first").limit(wanted).collect()
        if not listed:
            schema = spark.read.parquet(f"{path}/rows").schema
            return spark.createDataFrame([], schema)
        take, held = 1, 0
        while take < len(listed) and (held < limit or source_id is not None):
            held += listed[take]["n"]
            take += 1
        read = spark.read.parquet(*(r["file"] for r in listed[:take])).where(beyond)
        page = filter_matches(read, source_id, minimum).orderBy(F.desc("score"), "start", "match_id").limit(limit)
        if source_id is None or len(listed) < wanted or page.count() == limit:
            return page
        wanted *= 4


def evidence_join(matches: DataFrame, analyses: DataFrame, documents: DataFrame, document_chunks: DataFrame, source_chunks: DataFrame, sources: DataFrame, owner: Column) -> DataFrame:
    """Matches of an owner's documents with their chunks and sources.

    ``matches``: ``match_id, analysis_id, document_chunk_id, source_chunk_id``;
    ``analyses``: ``analysis_id, document_id``; ``documents``: ``id, owner_id,
    status``; chunks: their id, ``document_id`` or ``source_id`` and content.
    A match whose chunk is of another document than its analysis is left out.
    Documents are filtered first, so the owner's share alone is joined.
    """
    runs = owned_analyses(analyses, documents, owner).select("analysis_id", "document_id")
    rows = matches.join(runs, "analysis_id").join(document_chunks, ["document_chunk_id", "document_id"])
    return rows.join(source_chunks, "source_chunk_id").join(sources, "source_id")


def owned_analyses(analyses: DataFrame, documents: DataFrame, owner: Column) -> DataFrame:
    """Analyses of an owner's documents that are not deleted."""
    return analyses.join(owned(documents, owner).select(F.col("id").alias("document_id"), F.col("status").alias("document_status")), "document_id")


def evidence_report(rows: DataFrame, source_id: int | None = None, minimum: float = 0.0, offset: int = 0, limit: int = 20) -> DataFrame:
    """One page of joined evidence with its texts and the counts of the whole report.

    ``rows`` as of ``evidence_join`` with ``score``, the range ``start, end``
    in the document and ``chunk_start, content`` of its chunk.
    """
    # both counts and the page read them
    rows = keep(rows, "evidence")
    kept = filter_matches(rows, source_id, minimum)
    totals = rows.agg(F.count("*").alias("total")).crossJoin(kept.agg(F.count("*").alias("filtered"), F.count_distinct("source_id").alias("sources")))
    text = T.text_slice(F.col("content"), F.col("chunk_start"), F.col("start"), F.col("end"))
    page = evidence_page(kept, offset, limit).withColumns({"evidence": text, "level": T.score_level(F.col("score"))})
    return page.crossJoin(totals)  # one row


def report_sources(matches: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per source of a report with its matches and best score; see ``by_title`` for the order."""
    best = matches.groupBy("source_id").agg(F.count("*").alias("matches"), F.max("score").alias("best_score"))
    return best.join(sources, "source_id")


def by_title(sources: DataFrame) -> DataFrame:
    """Titles in Turkish alphabetical order."""
    return sources.orderBy(F.collate("title", "tr"), "source_id")


def report_header(matches: DataFrame, sections: DataFrame, minimum: float) -> DataFrame:
    """``total, filtered, sections`` of a report."""
    counts = matches.agg(F.count("*").alias("total"), F.count_if(F.col("score") >= minimum).alias("filtered"))
    return counts.crossJoin(sections.agg(F.count("*").alias("sections")))


def repeated_evidence(matches: DataFrame) -> DataFrame:
    """Evidence keys that occur more than once."""
    return matches.groupBy("doc_id", "source_id", "start", "source_start").agg(F.count("*").alias("times")).where("times > 1")
