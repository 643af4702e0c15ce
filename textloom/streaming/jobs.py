"""Streaming forms of the continuous jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators import chunks, evidence
from textloom.operators.index import SourceIndex
from textloom.sources import files

#: Rows that ``analyse_arrivals`` publishes.
EVIDENCE = "document_id long, source_id long, document_chunk_id string, source_chunk_id string, similarity_score double, document_match_start long, document_match_end long, source_match_start long, source_match_end long, matched_token_count long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def quota_stream(events: DataFrame, identity: str = "user_id", seconds: int = 300, most: int = 10, late: str = "1 second") -> DataFrame:
    """Fixed-window counts of a stream with ``ts``; use update mode."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds").alias("w"), identity).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), identity, "n", (F.col("n") > most).alias("over"))


def first_deliveries(arrivals: DataFrame, redelivery: str) -> DataFrame:
    """Rows ``doc_id, arrived, ...`` of a stream without those of a document that came again within ``redelivery``.

    An id is held from its first delivery until the watermark has passed it by
    that period; then its state goes. Later than that it is a new delivery.
    """
    return arrivals.withWatermark("arrived", redelivery).dropDuplicatesWithinWatermark(["doc_id"])


def analyse_arrivals(spark: SparkSession, incoming: str, index: SourceIndex, published: str, checkpoint: str, redelivery: str = "1 day", every: str | None = "15 seconds", name: str = "analyses", files_per_batch: int | None = None) -> StreamingQuery:
    """Analyse documents (``doc_id, text``) as their files arrive, against a stored index of the sources.

    A document that arrives again within ``redelivery`` is skipped; that state
    is kept in RocksDB and does not grow with the documents ever seen. Each
    micro-batch's evidence is published once (``files.publish``), however
    often it is run; ``files.read_published`` with ``EVIDENCE`` reads it. The
    sources are neither counted nor shuffled by a batch. Without ``every`` all
    present files are taken, then the query ends.
    """
    source = spark.readStream.schema("doc_id long, text string")
    source = source.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else source
    arriving = source.parquet(incoming).select("doc_id", "text", F.col("_metadata.file_modification_time").alias("arrived"))

    def analyse(batch: DataFrame, number: int) -> None:
        parts = batch.select("doc_id", F.lit(0).alias("part_no"), F.lit(None).cast("int").alias("page_number"), "text")
        cut = chunks.chunk_corpus(parts)
        cut = cut.withColumn("id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))
        scored, met = index.match(cut.select("id", "content"))
        found = evidence.match_evidence(cut, met.withColumnRenamed("source_id", "doc_id"), index.config, scored=scored)
        kinds = [c.strip().split(" ") for c in EVIDENCE.split(",")]
        files.publish(found.select(*(F.col(c).cast(kind).alias(c) for c, kind in kinds)), published, name, number)

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        writer = first_deliveries(arriving, redelivery).writeStream.queryName(name).foreachBatch(analyse).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    finally:
        spark.conf.set(_PROVIDER, before)
