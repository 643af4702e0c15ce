import os

import pytest
from pyspark.sql import functions as F

from textloom.operators.index import SourceIndex
from textloom.sources import files
from textloom.streaming import jobs

TEXT = "Bir iki üç dört beş altı yedi."


def deliver(spark, folder, n, rows, day=0):
    """A file of documents that arrived on a day."""
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{folder}/new{n}")
    [name] = [f for f in os.listdir(f"{folder}/new{n}") if f.endswith(".parquet")]
    os.makedirs(f"{folder}/in", exist_ok=True)
    os.rename(f"{folder}/new{n}/{name}", f"{folder}/in/{n}.parquet")
    os.utime(f"{folder}/in/{n}.parquet", (1_700_000_000 + 86_400 * day,) * 2)


def test_stream_publishes_once_over_breaks_and_restarts(spark, tmp_path, monkeypatch):
    folder, out = str(tmp_path), str(tmp_path / "out")
    index = SourceIndex(spark, f"{folder}/index", buckets=2)
    index.create(spark.createDataFrame([(10, 1, TEXT, 0), (11, 2, "Bambaşka şeyler yazan uzun bir cümle.", 5)], "id long, source_id long, content string, char_start long"))

    def run(name="analyses"):
        jobs.analyse_arrivals(spark, f"{folder}/in", index, out, f"{folder}/{name}", every=None, name=name, files_per_batch=1).awaitTermination(300)

    def rows():
        return sorted((r["document_id"], r["source_id"], r["document_match_start"], r["document_match_end"], r["batch"]) for r in files.read_published(spark, out, jobs.EVIDENCE).collect())

    assert rows() == []
    deliver(spark, folder, 1, [(1, f"Önce. {TEXT}"), (1, f"Önce. {TEXT}"), (2, "Hiç benzemeyen bir metin.")])
    real = files.publish

    def breaks(*args):
        # all is written and committed, but the stream does not learn of it
        real(*args)
        raise RuntimeError("stopped")

    def stops(batch, path, *args):
        # the rows are written, the ledger is not
        with monkeypatch.context() as m:
            m.setattr(files, "_ledger", lambda spark, path: None)
            m.setattr(spark.__class__, "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("stopped")))
            real(batch, path, *args)

    for broken, seen in ((stops, []), (breaks, [(1, 1, 6, 35, 0)])):
        monkeypatch.setattr(files, "publish", broken)
        with pytest.raises(Exception, match="stopped"):
            run()
        assert rows() == seen
    monkeypatch.setattr(files, "publish", real)
    # the document again, and a new one: after a restart the first batch is skipped, then the second is published
    deliver(spark, folder, 2, [(1, f"Önce. {TEXT}"), (3, TEXT)])
    run()
    assert rows() == [(1, 1, 6, 35, 0), (3, 1, 0, 29, 1)]
    attempts = spark.read.parquet(f"{out}/rows").select("batch", "attempt").distinct().groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in attempts} == {0: 2, 1: 1}


def test_state_of_redelivery_stays_flat(spark, tmp_path):
    folder, seen = str(tmp_path), []
    # each document comes on two days in a row, the first ones also at the end
    for day in range(10):
        deliver(spark, folder, day, [(k, "x") for k in {day, max(0, day - 1), 0 if day == 9 else day}], day)
    before = spark.conf.get(jobs._PROVIDER)
    spark.conf.set(jobs._PROVIDER, jobs._ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        totals = []
        for _ in range(2):
            # the second run goes on from the checkpoint and finds nothing new
            source = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").withColumn("arrived", F.col("_metadata.file_modification_time"))
            first = jobs.first_deliveries(source, "36 hours")
            query = first.writeStream.foreachBatch(lambda df, n: seen.extend((n, r["doc_id"]) for r in df.collect())).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
            query.awaitTermination(300)
            totals += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    finally:
        spark.conf.set(jobs._PROVIDER, before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    ids = [d for _, d in seen]
    assert sorted(ids) == [0, 0, *range(1, 10)] and max(totals) <= 5, (seen, totals)
