"""Queries on sources, joined evidence and retention, with DuckDB twins.

``documents`` stand in for uploaded files and, with owners and status derived
from ids, for users' documents; ``benchmark`` is the licensed corpus.
"""

from __future__ import annotations

import uuid
from decimal import Decimal

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import corpus, evaluate, lifecycle, report
from textloom.operators import similarity as S
from textloom.operators.index import SourceIndex
from textloom.plans import tables, texts
from textloom.plans.texts import read
from textloom.tables import shared_folder


def _joined(spark, sf_dir):
    """Evidence of one owner's documents; every match also stands under the next document's analysis, wrongly."""
    left, right = texts.streamed_sides(spark, sf_dir)
    found = S.match_pairs(texts.as_text(left), texts.as_text(right)).select(F.col("l").alias("document_chunk_id"), F.col("r").alias("source_chunk_id"), T.score_round(F.col("score")).cast("double").alias("score"))
    shifted = F.explode(F.array(F.lit(0), F.lit(1))).alias("wrong")
    matches = found.select("*", shifted).select("*", F.concat_ws("-", "document_chunk_id", "source_chunk_id", "wrong").alias("match_id"), ((F.expr("document_chunk_id div 1000000") + F.col("wrong")) * 10 + 1).alias("analysis_id"))
    ids = read(spark, sf_dir, "documents").select("doc_id")
    analyses = ids.select((F.col("doc_id") * 10 + 1).alias("analysis_id"), F.col("doc_id").alias("document_id"))
    documents = ids.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3).alias("owner_id"), F.when(F.col("doc_id") % 5 == 0, "deleted").otherwise("completed").alias("status"))
    document_chunks = left.select(F.col("id").alias("document_chunk_id"), F.col("doc_id").alias("document_id"), F.col("char_start").alias("chunk_start"), (F.col("char_start") + 1).alias("start"), F.col("char_end").alias("end"), "content")
    source_chunks = right.select(F.col("id").alias("source_chunk_id"), F.col("doc_id").alias("source_id"))
    sources = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("source_id"), F.concat(F.lit("Kaynak "), F.col("item_id").cast("string")).alias("title"))
    return report.evidence_join(matches, analyses, documents, document_chunks, source_chunks, sources, F.lit(1))


def evidence_join(spark, sf_dir):
    return _joined(spark, sf_dir).select("match_id", "analysis_id", "document_id", "source_id", "title", "score")


def evidence_report(spark, sf_dir):
    page = report.evidence_report(_joined(spark, sf_dir), minimum=0.8, offset=5, limit=50)
    return page.select("match_id", "source_id", "score", "level", "start", "end", "evidence", "total", "filtered", "sources")


def _uploads(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", F.encode("text", "UTF-8").alias("content"))
    return rows.select(
        F.col("doc_id").alias("source_id"), F.lit("a.txt").alias("filename"), F.lit("text/plain; charset=utf-8").alias("content_type"), "content",
        (F.octet_length("content") + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)).alias("size_bytes"), F.sha2("content", 256).alias("sha256"),
        F.when(F.col("doc_id") % 13 > 0, F.concat(F.lit("  Belge "), F.col("doc_id").cast("string"))).otherwise("  ").alias("title"), F.lit(" ").alias("author"),
        F.lit("2024-01-01").cast("date").alias("license_valid_from"), F.lit("2024-12-31").cast("date").alias("license_valid_until"),
    )


def ingest_sources(spark, sf_dir):
    raw = _uploads(spark, sf_dir)
    known = raw.where("source_id % 17 = 0").select(F.sha2("content", 256).alias("sha256"))
    rows, _ = corpus.ingest_sources(raw.where("source_id % 17 <> 0"), known, ["title"], ["author"])
    return rows.select("source_id", "title", "author", "status", "code", "chunks")


def reindex_sources(spark, sf_dir):
    rows = _uploads(spark, sf_dir).withColumn("status", F.when(F.col("source_id") % 10 == 3, "disabled").when(F.col("source_id") % 10 == 4, "processing").otherwise("ready"))
    done, _ = corpus.reindex_sources(rows, rows.where("source_id % 2 = 0 OR source_id % 3 = 0").select("source_id"))
    return done.select("source_id", "status", "code", "chunks")


def corpus_cosine(spark, sf_dir):
    counts = S.gram_counts(texts.normalized(spark, sf_dir, "benchmark", "item_id").withColumnRenamed("doc_id", "id"), T.ngrams(T.words(F.col("text")), 1, 1))
    _, vectors = S.corpus_tfidf(counts, counts)
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("l"))
    pairs = items.withColumn("r", F.explode(F.sequence(F.col("l"), F.col("l") + 4)))
    return corpus.corpus_cosine(pairs, vectors, vectors).withColumn("cosine", F.round("cosine", 8))


def threshold_decisions(spark, sf_dir):
    at = spark.createDataFrame([(Decimal(x),) for x in ("0.3000", "0.5000", "0.7500")], "threshold decimal(20,12)")
    return evaluate.decisions(tables._scored(spark, sf_dir), at).withColumn("threshold", F.col("threshold").cast("double"))


def retention_sweep(spark, sf_dir):
    """What a sweep leaves: tombstones, audit rows and kept turns, counted by kind."""
    turns = read(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "doc_id")
    swept = lifecycle.retention_sweep(tables._documents(spark, sf_dir), {"turns": turns}, tables._now())
    kinds = {"tombstones": F.col("status"), "audit": F.concat_ws(":", "action", "outcome"), "turns": F.lit("kept")}
    out = [swept[name].groupBy(F.lit(name).alias("kept_table"), kind.alias("kind")).agg(F.count("*").alias("n")) for name, kind in kinds.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def indexed_matches(spark, sf_dir):
    """Matches with a stored index of sources: some come later, some are corrected, some taken out."""
    left, right = texts.sides(spark, sf_dir)
    chunks = right.withColumnRenamed("doc_id", "source_id")
    index = SourceIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", buckets=8)
    wrong = F.when(F.col("source_id") % 4 == 0, F.reverse("content")).otherwise(F.col("content"))
    index.create(chunks.where("source_id % 2 = 0").withColumn("content", wrong))
    index.merge(chunks.where("source_id % 2 = 1 OR source_id % 4 = 0"), chunks.where("source_id % 14 = 0").select("source_id").distinct())
    index.merge(gone=chunks.where("source_id % 7 = 0").select("source_id").distinct())
    found, _ = index.match(left)
    return found.select("l", "r", T.score_round(F.col("score")).cast("double").alias("score"))


QUERIES = {f.__name__: f for f in (indexed_matches, evidence_join, evidence_report, ingest_sources, reindex_sources, corpus_cosine, threshold_decisions, retention_sweep)}

_J = (
    texts._MATCHES
    + """, j AS (SELECT CAST(m.l AS BIGINT) || '-' || CAST(m.r AS BIGINT) || '-0' AS match_id, d.doc_id * 10 + 1 AS analysis_id, d.doc_id AS document_id,
  CAST(floor(m.r / 1000000) AS BIGINT) AS source_id, round(m.score, 4) AS score, d.char_start + 1 AS start, d.char_end AS stop, substr(d.content, 2) AS evidence
  FROM m JOIN d ON d.id = m.l WHERE d.doc_id % 3 = 1 AND d.doc_id % 5 <> 0)"""
)
_NC = texts._chunks("d", "documents", "doc_id") + ", n AS (SELECT doc_id, count(*) AS chunks FROM d GROUP BY doc_id)"
_DONE = "CASE WHEN code IS NULL THEN coalesce(chunks, 0) END AS chunks, coalesce(code, CASE WHEN coalesce(chunks, 0) = 0 THEN 'no_extractable_text' END) AS code, CASE WHEN code IS NOT NULL THEN 'refused' WHEN coalesce(chunks, 0) = 0 THEN 'failed' ELSE 'ready' END AS status"

SQL = {
    "indexed_matches": "WITH " + texts._MATCHES + " SELECT m.l, m.r, round(score, 4) AS score FROM m JOIN b ON b.id = m.r WHERE b.doc_id % 7 <> 0",
    "evidence_join": "WITH " + _J + " SELECT match_id, analysis_id, document_id, source_id, 'Kaynak ' || source_id AS title, score FROM j",
    "evidence_report": "WITH " + _J + """ SELECT match_id, source_id, score, 'high' AS level, start, stop AS "end", evidence, (SELECT count(*) FROM j) AS total,
  (SELECT count(*) FROM j WHERE score >= 0.8) AS filtered, (SELECT count(DISTINCT source_id) FROM j WHERE score >= 0.8) AS sources
FROM j WHERE score >= 0.8 ORDER BY score DESC, start, match_id LIMIT 50 OFFSET 5""",
    "ingest_sources": "WITH " + _NC + f""", u AS (
  SELECT doc_id, text, CASE WHEN doc_id % 13 = 0 THEN 'missing_title' WHEN coalesce(text, '') = '' THEN 'empty_file' WHEN doc_id % 11 = 0 THEN 'checksum_mismatch' END AS code
  FROM documents WHERE doc_id % 17 <> 0),
k AS (SELECT DISTINCT text FROM documents WHERE doc_id % 17 = 0),
f AS (SELECT text, min(doc_id) AS first FROM u WHERE code IS NULL GROUP BY text),
z AS (SELECT u.doc_id, coalesce(code, CASE WHEN k.text IS NOT NULL OR u.doc_id <> f.first THEN 'duplicate' END) AS code FROM u LEFT JOIN k ON k.text = u.text LEFT JOIN f ON f.text = u.text)
SELECT doc_id AS source_id, CASE WHEN doc_id % 13 > 0 THEN 'Belge ' || doc_id END AS title, NULL AS author, {_DONE} FROM z LEFT JOIN n USING (doc_id)""",
    "reindex_sources": "WITH " + _NC + f""", z AS (
  SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'source_disabled' WHEN doc_id % 10 = 4 THEN 'source_busy' WHEN doc_id % 11 = 0 OR text IS NULL THEN 'checksum_mismatch' END AS code
  FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0)
SELECT doc_id AS source_id, {_DONE} FROM z LEFT JOIN n USING (doc_id)""",
    "corpus_cosine": texts.SQL["corpus_tfidf"].split("SELECT id, g AS gram")[0] + """, v2 AS (SELECT id, idx, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM z),
p AS (SELECT item_id AS l, item_id + unnest(range(0, 5)) AS r FROM benchmark),
s AS (SELECT p.l, p.r, sum(a.weight * b.weight) AS dot FROM p JOIN v2 a ON a.id = p.l JOIN v2 b ON b.id = p.r AND b.idx = a.idx GROUP BY p.l, p.r)
SELECT p.l, p.r, round(least(1.0, greatest(0.0, coalesce(dot, 0))), 8) AS cosine FROM p LEFT JOIN s ON s.l = p.l AND s.r = p.r""",
    "threshold_decisions": f"WITH {tables._S} SELECT CAST(t AS DOUBLE) AS threshold, case_id, CASE WHEN score >= t THEN 'match' ELSE 'no_match' END AS decision FROM x, (SELECT unnest([0.3, 0.5, 0.75]) AS t)",
    "retention_sweep": f"""WITH {tables._D} SELECT 'tombstones' AS kept_table, 'deleted' AS kind, count(*) AS n FROM x
UNION ALL SELECT 'audit', 'document.expire:' || o, count(*) FROM x, (SELECT unnest(['started', 'succeeded']) AS o) GROUP BY o
UNION ALL SELECT 'turns', 'kept', count(*) FROM conversations WHERE conv_id NOT IN (SELECT id FROM x)""",
}
