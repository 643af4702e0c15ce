import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from textloom.config import Config
from textloom.operators import chunks, corpus, evaluate, lifecycle, report
from textloom.operators import similarity as S
from textloom.sources import files
from textloom.streaming import jobs

# Text pairs with their scores under both stored profiles.
LEARNING = "Makine öğrenmesi, verilerden örüntüler çıkararak tahmin üreten yöntemler bütünüdür."
GOLDEN = [
    (LEARNING, LEARNING, 1.0, 1.0),
    (LEARNING, LEARNING.replace("tahmin", "doğru tahmin"), 0.800889, 0.801247),
    (
        "Bu çalışmanın amacı, üniversite öğrencilerinin çevrim içi öğrenme deneyimlerini incelemektir. Araştırmada nitel yöntem kullanılmıştır.",
        "Bu çalışmanın amacı, belediye çalışanlarının iş doyumu düzeylerini incelemektir. Araştırmada nicel yöntem kullanılmıştır.",
        0.294988,
        0.291041,
    ),
    ("Fotosentez sırasında bitkiler ışık enerjisini kimyasal enerjiye dönüştürür.", "Osmanlı mimarisinde kubbe ve kemerler yapıların taşıyıcı düzeninde önemli yer tutar.", None, 0.003651),
]


def sides(spark, pairs):
    return [spark.createDataFrame([(i, p[side]) for i, p in enumerate(pairs)], "id long, text string") for side in (0, 1)]


def test_golden_scores(spark):
    left, right = sides(spark, GOLDEN)
    pairs = spark.createDataFrame([(i, i) for i in range(4)], "l long, r long")
    first = Config(Decimal("0.50"), Decimal("0.30"), Decimal("0.20"), Decimal("0.8000"), version="hybrid-v1")
    for config, column in ((first, 2), (Config(), 3)):
        got = {r["l"]: float(r["score"]) for r in S.score_pairs(pairs, left, right, config, prune=False).collect()}
        for i, row in enumerate(GOLDEN):
            assert row[column] is None or got[i] == pytest.approx(row[column], abs=1e-6)
        assert [got[i] >= config.threshold for i in range(4)] == [True, True, False, False]


def test_golden_chunks(spark):
    # A text of two lines and its chunks
    parts = spark.createDataFrame([(1, 0, None, "Türkçe içerik korunur.\nİkinci cümle!")], "doc_id long, part_no int, page_number int, text string")
    got = [(r["chunk_index"], r["content"], r["char_start"], r["char_end"], r["token_count"], r["content_sha256"][:8]) for r in chunks.chunk_corpus(parts).orderBy("chunk_index").collect()]
    assert got == [(0, "Türkçe içerik korunur.", 0, 22, 3, "de17ef3c"), (1, "İkinci cümle!", 23, 36, 2, "d654cbe3")]


def test_low_thresholds_lose_no_match(spark):
    rows = [("karşılaştırmalar", "karşılaştırmaları"), ("elma armut", "armut kiraz"), ("bir iki", "üç dört"), ("", "kitaplar"), ("kitaplık rafı", "kitaplığın rafları"), ("ve ve ve", "ve")]
    left, right = sides(spark, rows)
    every = left.select(F.col("id").alias("l")).crossJoin(right.select(F.col("id").alias("r")))
    for threshold in ("0.0000", "0.0500", "0.2000", "0.3000", "0.6000"):
        config = Config(threshold=Decimal(threshold))
        want = {(r["l"], r["r"]): r["score"] for r in S.score_pairs(every, left, right, config, prune=False).where(F.col("score") >= F.lit(config.threshold)).collect()}
        assert {(r["l"], r["r"]): r["score"] for r in S.match_pairs(left, right, config).collect()} == want
        assert ((0, 0) in want) == (threshold <= "0.2000") and (threshold != "0.0000" or len(want) == 36)


def test_ingest_refuses_by_the_first_rule_and_replaces(spark, tmp_path):
    def row(i, title, content, size=None, kind="text/plain"):
        return (i, "a.txt", kind, content, len(content) if size is None else size, title)

    rows = [row(1, " A ", b"Bir. Iki."), row(2, "B", b"Bir. Iki."), row(3, " ", b"x"), row(4, "D", b"x", kind="image/png"), row(5, "E", b"abc", size=9), row(6, "F", b" \n "), row(7, "G", "şey.".encode("cp1254")), row(8, "H", b"known")]
    raw = spark.createDataFrame(rows, "source_id long, filename string, content_type string, content binary, size_bytes int, title string")
    raw = raw.withColumns({"sha256": F.sha2("content", 256), "license_valid_from": F.lit(None).cast("date"), "license_valid_until": F.lit(None).cast("date")})
    done, cut = corpus.ingest_sources(raw, raw.where("source_id = 8").select("sha256"), ["title"], [])
    got = {r["source_id"]: (r["status"], r["code"], r["chunks"]) for r in done.collect()}
    assert got == {1: ("ready", None, 2), 2: ("refused", "duplicate", None), 3: ("refused", "missing_title", None), 4: ("refused", "unsupported_file_type", None), 5: ("refused", "checksum_mismatch", None), 6: ("failed", "no_extractable_text", 0), 7: ("ready", None, 1), 8: ("refused", "duplicate", None)}
    assert [(r["source_id"], r["content"]) for r in corpus.scan_order(cut).collect()] == [(1, "Bir."), (1, "Iki."), (7, "şey.")]
    again, fresh = corpus.reindex_sources(raw.withColumn("status", F.when(F.col("source_id") == 1, "disabled").when(F.col("source_id") == 2, "processing").otherwise("ready")), raw.where("source_id < 3 OR source_id IN (5, 7)").select("source_id"))
    assert {r["source_id"]: r["code"] for r in again.collect()} == {1: "source_disabled", 2: "source_busy", 5: "checksum_mismatch", 7: None}
    files.replace_partitions(cut, str(tmp_path / "chunks"), "source_id")
    files.replace_partitions(fresh.withColumn("content", F.lit("new")), str(tmp_path / "chunks"), "source_id")
    assert {(r["source_id"], r["content"]) for r in spark.read.parquet(str(tmp_path / "chunks")).collect()} == {(1, "Bir."), (1, "Iki."), (7, "new")}
    listed = spark.createDataFrame([(1, "ready", "approved"), (2, "ready", "pending"), (3, "failed", "approved")], "source_id int, status string, license_status string")
    assert corpus.filter_sources(listed, "ready").count() == 2 and corpus.filter_sources(listed, "ready", "approved").count() == 1 and corpus.filter_sources(listed).count() == 3


def test_undecodable_bytes_are_refused(spark):
    rows = [(1, "Şişli'de yağmur yağıyor, çok güzel.".encode("cp1254")), (2, bytes(range(128, 256)) + b"\x81\x8d"), (3, bytes([0xA2, 0xA5, 0xB1, 0xBF] * 30)), (4, b"\xff\xfe\x00")]
    got = {r["id"]: (r["text"], r["decode_error"]) for r in files.decode_text(spark.createDataFrame(rows, "id int, content binary")).collect()}
    assert got[1] == ("Şişli'de yağmur yağıyor, çok güzel.", None) and all(got[i] == (None, "undecodable") for i in (2, 3, 4))


def test_matches_show_once_their_run_has_completed(spark, tmp_path):
    path = str(tmp_path / "store")

    def store(analysis, attempt, texts, status):
        files.replace_matches(spark.createDataFrame([(analysis, attempt, t) for t in texts], "analysis_id int, attempt int, text string"), spark.createDataFrame([(analysis, attempt, status)], "analysis_id int, attempt int, status string"), path)

    store(1, 1, ["old"], "completed")
    store(2, 1, ["half"], "failed")
    store(3, 1, ["x", "y"], "completed")
    store(3, 2, [], "completed")
    store(1, 2, ["new", "newer"], "completed")
    assert {(r["analysis_id"], r["text"]) for r in files.read_matches(spark, path).collect()} == {(1, "new"), (1, "newer")}
    files.export_json(files.read_matches(spark, path), str(tmp_path / "j"))
    files.export_csv(files.read_matches(spark, path), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_evidence_stays_with_its_owner_and_document(spark):
    matches = spark.createDataFrame([("a", 1, 10, 90, 0.9), ("b", 2, 10, 90, 0.8), ("c", 3, 30, 90, 0.7), ("d", 4, 40, 90, 0.6)], "match_id string, analysis_id int, document_chunk_id int, source_chunk_id int, score double")
    analyses = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4)], "analysis_id int, document_id int")
    documents = spark.createDataFrame([(1, 7, "completed"), (2, 7, "completed"), (3, 8, "completed"), (4, 7, "deleted")], "id int, owner_id int, status string")
    chunk = spark.createDataFrame([(10, 1, 5, "abcdef"), (30, 3, 0, "x"), (40, 4, 0, "y")], "document_chunk_id int, document_id int, chunk_start int, content string")
    rows = report.evidence_join(matches, analyses, documents, chunk, spark.createDataFrame([(90, 9)], "source_chunk_id int, source_id int"), spark.createDataFrame([(9, "İz"), (8, "Ad")], "source_id int, title string"), F.lit(7))
    page = report.evidence_report(rows.withColumns({"start": F.lit(6), "end": F.lit(8)}), minimum=0.5).collect()
    assert [(r["match_id"], r["evidence"], r["total"], r["filtered"], r["level"]) for r in page] == [("a", "bc", 1, 1, "high")]
    titles = spark.createDataFrame([(1, "Çiçek"), (2, "Cam"), (3, "Dağ"), (4, "ılık"), (5, "ince")], "source_id int, title string")
    assert [r["title"] for r in report.by_title(titles).collect()] == ["Cam", "Çiçek", "Dağ", "ılık", "ince"]


def test_sweep_over_many_partitions_and_decisions(spark):
    rows = [(i, (i * 37 % 101) / 101, "match" if i % 3 else "no_match") for i in range(400)]
    scored = spark.createDataFrame(rows, "case_id int, score double, label string")
    got = {r["threshold"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in evaluate.threshold_sweep(scored, evaluate.threshold_set(scored)).collect()}
    exact = [(Decimal(repr(s)).quantize(Decimal("1e-12"), "ROUND_HALF_UP"), label == "match") for _, s, label in rows]
    for t, counts in got.items():
        assert counts == tuple(sum((s >= t) == hit and y == truth for s, y in exact) for hit, truth in ((True, True), (True, False), (False, True), (False, False)))
    at = spark.createDataFrame([(Decimal("0.5"),)], "threshold decimal(20,12)")
    assert {r["case_id"]: r["decision"] for r in evaluate.decisions(scored, at).collect()} == {i: "match" if s >= 0.5 else "no_match" for i, s, _ in rows}


def test_sweep_of_retention_and_retries(spark):
    day = lambda d: datetime.datetime(2024, 1, d)
    documents = spark.createDataFrame([(1, "completed", day(1), day(1), None), (2, "queued", day(1), day(1), None), (3, "deleted", day(30), day(2), None), (4, "completed", day(30), day(1), None), (5, "completed", day(1), day(1), day(3))], "id int, status string, expires_at timestamp, updated_at timestamp, cleaned_at timestamp")
    turns = spark.createDataFrame([(i, k) for i in range(1, 6) for k in range(2)], "doc_id int, turn int")
    swept = lifecycle.retention_sweep(documents, {"turns": turns}, F.lit(day(15)))
    assert sorted(r["id"] for r in swept["tombstones"].collect()) == [1, 3] and {r["doc_id"] for r in swept["turns"].collect()} == {2, 4, 5}
    assert sorted((r["resource_id"], r["outcome"]) for r in swept["audit"].collect()) == [(1, "started"), (1, "succeeded"), (3, "started"), (3, "succeeded")]
    due = spark.createDataFrame([(i, i % 6 + 1, day(1)) for i in range(60)], "id int, attempt int, failed timestamp")
    waits = due.select("attempt", (corpus.retry_at(F.col("failed"), F.col("id"), F.col("attempt")) - F.col("failed")).cast("long").alias("wait")).collect()
    assert all(0 <= r["wait"] <= min(10 * 2 ** (r["attempt"] - 1), 120) for r in waits) and len({r["wait"] for r in waits}) > 20


def test_quota_of_a_stream_equals_its_batch(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, 1, 0, i % 12, i), i % 3) for i in range(60)]
    events = spark.createDataFrame(rows, "ts timestamp, user_id int")
    events.write.parquet(str(tmp_path / "in"))
    stream = jobs.quota_stream(spark.readStream.schema("ts timestamp, user_id int").parquet(str(tmp_path / "in")), most=8, late="1 hour")
    query = stream.writeStream.format("memory").queryName("quota_rows").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = {(r["window_start"], r["user_id"]): (r["n"], r["over"]) for r in spark.table("quota_rows").collect()}
    assert last == {(r["window_start"], r["user_id"]): (r["n"], r["over"]) for r in lifecycle.quota(events, most=8).collect()} and any(over for _, over in last.values())


def test_sources_are_digested_once(spark):
    raw = spark.createDataFrame([(i, f"Metin {i % 3}.".encode()) for i in range(6)], "source_id long, content binary").select(
        "*", F.lit("a.txt").alias("filename"), F.lit("text/plain").alias("content_type"), F.octet_length("content").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.lit("t").alias("title"),
        F.lit(None).cast("date").alias("license_valid_from"), F.lit(None).cast("date").alias("license_valid_until"),
    )
    rows, cut = corpus.ingest_sources(raw, raw.where("source_id = 1").select("sha256"), ["title"], [])
    for df in (rows, cut.select("source_id", "content")):
        assert "sha2(" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["source_id"], r["code"], r["chunks"]) for r in rows.collect()) == [(i, None, 1) if i in (0, 2) else (i, "duplicate", None) for i in range(6)]
