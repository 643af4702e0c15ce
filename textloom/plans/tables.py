"""Queries on report ranges, labelled scores and lifecycle rows, with DuckDB twins.

``events`` stands in for status history, runs, quota and audit rows,
``labels`` for gold decisions, ``benchmark`` and ``documents`` for sources;
status and license columns derive from ids.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import evaluate, lifecycle, report
from textloom.plans.texts import read
from textloom.sources import files

NOW = "2024-01-20 00:00:00"
_STATUS = {"view": "queued", "click": "extracting", "error": "failed", "purchase": "completed", "signup": "analyzing"}


def _map(column: str, pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for p in pairs.items() for x in p))[F.col(column)]


def _now():
    return F.lit(NOW).cast("timestamp")


def _history(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value", "props", "event_type", _map("event_type", _STATUS).alias("status"))


def _ranges(spark, sf_dir):
    """Ranges of seconds by user, as stand-in evidence."""
    start = F.unix_timestamp(F.col("ts").cast("timestamp")) - 1704067200
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("match_id"), start.alias("start"), (start + F.ceil(F.col("value") * 40).cast("long") + 1).alias("end"), F.round(F.col("value") / 500, 4).alias("score"), (F.col("event_id") % 5 + 1).cast("int").alias("page_number"))


def interval_union(spark, sf_dir):
    return report.interval_union(_ranges(spark, sf_dir), "doc_id")


def range_coverage(spark, sf_dir):
    ranges = _ranges(spark, sf_dir)
    lengths = ranges.select("doc_id").distinct().withColumn("length", F.lit(4_000_000).cast("long"))
    return report.document_coverage(ranges, lengths).select("doc_id", "covered", "length", F.round("ratio", 9).alias("ratio"), F.round("percentage", 7).alias("percentage"), "raw_count", F.size("merged").cast("long").alias("ranges"))


def report_sections(spark, sf_dir):
    groups = report.islands(_ranges(spark, sf_dir), "doc_id", merge_adjacent=False).groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score"), F.count("*").alias("members"))
    return groups.drop("island").withColumn("level", T.score_level(F.col("score")))


def invalid_ranges(spark, sf_dir):
    ranges = _ranges(spark, sf_dir)
    lengths = ranges.select("doc_id").distinct().withColumn("length", F.lit(2_000_000).cast("long"))
    return report.invalid_ranges(ranges, "doc_id", lengths).select("doc_id", "match_id", "start", "end")


def filtered_matches(spark, sf_dir):
    rows = _ranges(spark, sf_dir).withColumn("source_id", F.col("page_number").cast("long"))
    return report.filter_matches(rows, 3, 0.5).select("match_id", "doc_id", "start", "end", "score")


def report_header(spark, sf_dir):
    ranges = _ranges(spark, sf_dir)
    sections = report.islands(ranges, "doc_id", merge_adjacent=False).select("doc_id", "island").distinct()
    return report.report_header(ranges, sections, 0.5)


def repeated_evidence(spark, sf_dir):
    rows = _ranges(spark, sf_dir).select("doc_id", F.col("page_number").alias("source_id"), F.expr("start div 3600").alias("start"), F.lit(0).alias("source_start"))
    return report.repeated_evidence(rows).select("doc_id", F.col("source_id").cast("long").alias("source_id"), "start", "times")


def _scored(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    score = F.round(F.col("n_chars") / (F.col("n_chars") + 1500), 4)
    return read(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("case_id"), score.alias("score"), F.when(F.col("quality") == 1, "match").otherwise("no_match").alias("label"))


def threshold_sweep(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    swept = evaluate.threshold_sweep(scored, evaluate.threshold_set(scored, ["0.005", "0.2949", "0.8009"]))
    return swept.select(F.col("threshold").cast("double").alias("threshold"), "tp", "fp", "fn", "tn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "specificity", "accuracy")))


def confusion_matrix(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("threshold", F.lit(0.5))
    return evaluate.confusion(rows, ["threshold"]).select("threshold", "tp", "fp", "fn", "tn", F.round("f1", 9).alias("f1"))


def class_margins(spark, sf_dir):
    return evaluate.class_margins(_scored(spark, sf_dir)).withColumn("class_gap", F.round("class_gap", 9))


def label_faults(spark, sf_dir):
    return evaluate.label_faults(_scored(spark, sf_dir))


def score_faults(spark, sf_dir):
    rows = _ranges(spark, sf_dir).select(F.col("match_id").alias("case_id"), (F.col("score") * 1.2).alias("score"), F.when(F.col("page_number") == 5, "other").otherwise("match").alias("label"))
    return evaluate.score_faults(rows).select("case_id", "label")


def golden_drift(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    expected = scored.select("case_id", (F.col("score") + F.when(F.col("case_id") % 7 == 0, 0.01).otherwise(0.0)).alias("expected"))
    return evaluate.golden_drift(scored.select("case_id", "score"), expected).select("case_id")


def weight_calibration(spark, sf_dir):
    toxic, k = F.col("toxic"), F.col("doc_id") % 10 / 100
    signals = read(spark, sf_dir, "labels").select((0.2 + 0.6 * toxic + k).alias("word"), (0.3 + 0.5 * toxic + k).alias("char"), (0.1 + 0.4 * toxic + k).alias("overlap"), F.when(toxic == 1, "match").otherwise("no_match").alias("label"))
    out = evaluate.calibrate(signals, (Decimal("0.50"), Decimal("0.25"), Decimal("0.25")), 0.75)
    return out.select("place", *(F.round(c, 9).alias(c) for c in ("w1", "w2", "w3", "threshold", "f1", "max_negative", "min_positive", "class_gap")))


def run_summary(spark, sf_dir):
    runs = read(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("size"), F.col("value").alias("seconds"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"))
    return evaluate.run_summary(runs, "size").withColumn("median", F.round("median", 6))


def transition_audit(spark, sf_dir):
    return lifecycle.invalid_transitions(_history(spark, sf_dir), "user_id", "ts", "event_id").select("event_id", "user_id", "previous", "status")


def latest_run(spark, sf_dir):
    return lifecycle.latest(_history(spark, sf_dir).select("user_id", "event_id", "ts", "status"), "user_id", "ts", "event_id").select("user_id", "event_id", "status")


def _runs(spark, sf_dir):
    reason = F.when(F.col("status") == "failed", F.when(F.col("event_id") % 3 == 0, "invalid_pdf").otherwise("processing_failed"))
    rows = _history(spark, sf_dir).select(F.col("event_id").alias("run_id"), F.concat_ws("-", "user_id", (F.col("event_id") % 20).cast("string")).alias("doc_id"), F.col("ts").alias("created_at"), "status", reason.alias("failure_reason"))
    return rows.withColumn("document_status", F.lit("failed"))


def retry_decision(spark, sf_dir):
    return lifecycle.retry_decision(_runs(spark, sf_dir))


def run_counts(spark, sf_dir):
    return _runs(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("runs"))


def due_work(spark, sf_dir):
    rows = _history(spark, sf_dir).select(F.col("event_id").alias("id"), "status", F.col("ts").alias("next_attempt_at"))
    return lifecycle.due_work(rows, _now()).select("id", "status", "task")


def _documents(spark, sf_dir):
    days = F.when(F.col("event_id") % 2 == 0, 7).otherwise(30)
    rows = _history(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("user_id").alias("owner_id"), F.when(F.col("event_id") % 11 == 0, "deleted").otherwise(F.col("status")).alias("status"), F.col("ts").alias("updated_at"), days.alias("retention_days"), F.when(F.col("event_id") % 13 == 0, F.col("ts")).alias("cleaned_at"))
    return rows.withColumn("expires_at", lifecycle.expires_at(F.col("updated_at"), F.col("retention_days")))


def expiry_candidates(spark, sf_dir):
    return lifecycle.expiry_candidates(_documents(spark, sf_dir), _now()).select("id", "status")


def cascade_keep(spark, sf_dir):
    """Turns that stay when the conversations of expired documents go."""
    gone = lifecycle.expiry_candidates(_documents(spark, sf_dir), _now()).select(F.col("id").alias("conv_id"))
    return lifecycle.cascade(read(spark, sf_dir, "conversations"), gone, "conv_id")[1].select("conv_id", "turn")


def cleanup_counts(spark, sf_dir):
    gone = lifecycle.expiry_candidates(_documents(spark, sf_dir), _now()).select(F.col("id").alias("conv_id"))
    removed, kept = lifecycle.cascade(read(spark, sf_dir, "conversations"), gone, "conv_id")
    left = kept.join(gone, "conv_id", "left_semi").agg(F.count("*").alias("left_over"))
    return removed.agg(F.count("*").alias("removed")).crossJoin(kept.agg(F.count("*").alias("kept"))).crossJoin(left)


def owned_documents(spark, sf_dir):
    return lifecycle.owned(_documents(spark, sf_dir), F.lit(8)).select("id", "status")


def document_list(spark, sf_dir):
    return _documents(spark, sf_dir).orderBy(F.desc("updated_at"), F.desc("id")).offset(20).limit(20).select("id", "status")


def failure_codes(spark, sf_dir):
    code = F.when(F.col("event_id") % 4 == 0, "invalid_pdf").when(F.col("event_id") % 4 == 1, "boom").otherwise("processing_timeout")
    return read(spark, sf_dir, "events").where("event_type = 'error'").select(lifecycle.failure_code(code).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def _contexts():
    return F.create_map(F.lit("http_status"), (F.col("value").cast("int") * 2).cast("string"), F.lit("stage"), F.when(F.col("event_id") % 2 == 0, "extract").otherwise("other"), F.lit("email"), F.lit("a@b.example"), F.lit("attempt"), (F.col("event_id") % 1500).cast("string"), F.lit("secret"), F.lit("x"), F.lit("document_id"), F.col("event_type"))


def redaction(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", lifecycle.redact(_contexts()).alias("m"))
    return rows.select("event_id", *(F.col("m")[k].alias(k) for k in ("http_status", "stage", "email", "attempt", "secret", "document_id", "redacted_fields")))


def audit_validation(spark, sf_dir):
    action = _map("event_type", {"view": "source.list", "click": "document.open", "error": "nonsense", "purchase": "source.create", "signup": "user.provision"})
    rows = read(spark, sf_dir, "events").select("event_id", action.alias("action"), F.when(F.col("event_id") % 2 == 0, "user").otherwise("system").alias("actor_kind"), F.when(F.col("event_id") % 3 > 0, F.col("user_id")).alias("actor_id"), F.when(F.col("event_id") % 5 > 0, F.col("event_id")).alias("resource_id"), F.lit("succeeded").alias("outcome"))
    return lifecycle.audit_reject(rows, ("source.list", "document.open", "source.create", "user.provision")).select("event_id", "resource_type", "reject")


def status_backfill(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("id", F.when(F.col("status") == "completed", "ready").when(F.col("status") == "queued", "processing").otherwise(F.col("status")).alias("status"), F.when(F.col("id") % 3 > 0, F.col("retention_days")).alias("retention_days"), F.lit(None).cast("timestamp").alias("expires_at"))
    return lifecycle.backfill_status(rows, _now()).groupBy("status", "retention_days", F.date_format("expires_at", "yyyy-MM-dd").alias("expires")).agg(F.count("*").alias("n"))


def admission(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    name = F.concat(F.lit("page"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, ".TXT").when(F.col("page_id") % 3 == 1, ".pdf").otherwise(".exe"))
    kind = F.when(F.col("page_id") % 2 == 0, "Text/Plain; charset=utf-8").otherwise("application/pdf")
    return pages.select("page_id", lifecycle.admission_code(name, kind, F.encode("html", "UTF-8")).alias("code"))


def source_dedup(spark, sf_dir):
    return lifecycle.first_by_digest(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.sha2("text", 256).alias("sha256")))


def seed_antijoin(spark, sf_dir):
    new = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return lifecycle.absent(new, new.where("doc_id % 2 = 0"), "sha256").select("doc_id")


def _sources(spark, sf_dir):
    day = F.lit("2024-01-01").cast("date")
    return read(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 7 == 0, "failed").otherwise("ready").alias("status"), F.when(F.col("item_id") % 5 == 0, "pending").otherwise("approved").alias("license_status"), F.when(F.col("item_id") % 3 > 0, F.date_add(day, (F.col("item_id") % 30).cast("int"))).alias("license_valid_from"), F.when(F.col("item_id") % 2 > 0, F.date_add(day, (F.col("item_id") % 40).cast("int"))).alias("license_valid_until"))


def eligible_sources(spark, sf_dir):
    from textloom.operators.evidence import eligible_sources as eligible

    return eligible(_sources(spark, sf_dir), F.lit("2024-01-16").cast("date")).select("item_id")


def ingest_status(spark, sf_dir):
    rows = _sources(spark, sf_dir).withColumns({"title": F.concat(F.lit(" Kaynak "), F.when(F.col("item_id") % 6 > 0, F.col("item_id").cast("string"))), "author": F.lit("  ")})
    return lifecycle.normalize_metadata(rows, ["title"], ["author"]).select("item_id", "title", "author", "reject")


def fixed_window_quota(spark, sf_dir):
    return lifecycle.quota(read(spark, sf_dir, "events"), "event_type", 3600, 3).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", "over", F.date_format("lives_until", "yyyy-MM-dd HH:mm:ss").alias("lives_until"))


def quota_keys(spark, sf_dir):
    window = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 300)
    return read(spark, sf_dir, "events").select("event_id", T.quota_key("salt", F.col("user_id"), window).alias("quota_key"))


def retry_backoff(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", T.retry_bound(F.col("event_id") % 8 + 1).alias("seconds"))


def corpus_manifest(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return files.manifest(rows)


def decoded_texts(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return files.decode_text(rows).select("doc_id", "text", "decode_error")


def legacy_texts(spark, sf_dir):
    """Documents as bytes of a Western encoding, and digests as noise, decoded."""
    docs = read(spark, sf_dir, "documents")
    # letters that Windows-1254 has in their places, and those signs of Latin-1 that it has others for
    latin = docs.where(~F.col("text").rlike(r"[^\x00-\x7F\xA0-\xFF]|[ÐÝÞðýþ]")).select("doc_id", F.lit("text").alias("kind"), F.encode("text", "ISO-8859-1").alias("content"))
    noise = F.unhex(F.concat(*(F.sha2(F.concat_ws("-", F.lit(str(k)), "doc_id"), 512) for k in range(4))))
    return files.decode_text(latin.union(docs.select("doc_id", F.lit("noise"), noise))).select("doc_id", "kind", "text", "decode_error")


def checksum_faults(spark, sf_dir):
    body = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.encode(body, "UTF-8").alias("content"), F.octet_length("text").alias("size_bytes"), F.sha2("text", 256).alias("sha256"))
    return lifecycle.checksum_faults(rows).select("doc_id")


def page_links(spark, sf_dir):
    address = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("javascript:"), F.col("url"))).otherwise(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", T.safe_url(address).alias("url"), T.clean_filename(F.split_part("url", F.lit("?"), F.lit(1))).alias("filename"))


def report_dates(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", T.local_date(F.col("ts")).alias("local"))


QUERIES = {f.__name__: f for f in (interval_union, range_coverage, report_sections, invalid_ranges, filtered_matches, report_header, repeated_evidence, threshold_sweep, confusion_matrix, class_margins, label_faults, score_faults, golden_drift, weight_calibration, run_summary, transition_audit, latest_run, retry_decision, run_counts, due_work, expiry_candidates, cascade_keep, cleanup_counts, owned_documents, document_list, failure_codes, redaction, audit_validation, status_backfill, admission, source_dedup, seed_antijoin, eligible_sources, ingest_status, fixed_window_quota, quota_keys, retry_backoff, corpus_manifest, decoded_texts, legacy_texts, checksum_faults, page_links, report_dates)}

_R = """r AS (SELECT user_id AS doc_id, event_id AS match_id, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS s,
  CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 + CAST(ceil(value * 40) AS BIGINT) + 1 AS e, round(value / 500, 4) AS score, event_id % 5 + 1 AS page FROM events)"""


def _islands(adjacent: bool) -> str:
    return f"""{_R}, o AS (SELECT *, CASE WHEN s {'>' if adjacent else '>='} max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM r),
i AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM o),
u AS (SELECT doc_id, min(s) AS s, max(e) AS e, max(score) AS score, count(*) AS n FROM i GROUP BY doc_id, g)"""


_S = "x AS (SELECT l.doc_id AS case_id, round(n_chars / (n_chars + 1500), 4) AS score, quality = 1 AS pos FROM labels l JOIN documents d USING (doc_id))"
_M = "round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1, round(tn / nullif(tn + fp, 0), 9) AS specificity, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 9) AS accuracy"
_H = "h AS (SELECT event_id, ts, user_id, value, event_type, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'extracting' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'analyzing' END AS status FROM events)"
_D = _H + """, d AS (SELECT event_id AS id, user_id AS owner_id, CASE WHEN event_id % 11 = 0 THEN 'deleted' ELSE status END AS status, ts AS updated_at, CASE WHEN event_id % 2 = 0 THEN 7 ELSE 30 END AS retention_days, CASE WHEN event_id % 13 = 0 THEN ts END AS cleaned_at FROM h),
x AS (SELECT id, status FROM d WHERE cleaned_at IS NULL AND status NOT IN ('queued', 'extracting', 'analyzing') AND (updated_at + to_days(CAST(retention_days AS INTEGER)) <= TIMESTAMP '2024-01-20' OR status = 'deleted') ORDER BY updated_at, id LIMIT 100)"""
_RUN = _H + ", q AS (SELECT event_id AS run_id, user_id || '-' || (event_id % 20) AS doc_id, ts, status, CASE WHEN event_id % 3 = 0 THEN 'invalid_pdf' ELSE 'processing_failed' END AS reason FROM h)"
_SRC = "s AS (SELECT item_id, CASE WHEN item_id % 7 = 0 THEN 'failed' ELSE 'ready' END AS status, CASE WHEN item_id % 5 = 0 THEN 'pending' ELSE 'approved' END AS license, CASE WHEN item_id % 3 > 0 THEN DATE '2024-01-01' + CAST(item_id % 30 AS INTEGER) END AS f, CASE WHEN item_id % 2 > 0 THEN DATE '2024-01-01' + CAST(item_id % 40 AS INTEGER) END AS u FROM benchmark)"

SQL = {
    "interval_union": f'WITH {_islands(True)} SELECT doc_id, s AS start, e AS "end" FROM u',
    "range_coverage": f"WITH {_islands(True)}, c AS (SELECT doc_id, sum(e - s) AS covered, count(*) AS ranges, sum(n) AS n FROM u GROUP BY doc_id) SELECT doc_id, CAST(covered AS BIGINT) AS covered, CAST(4000000 AS BIGINT) AS length, round(covered / 4000000, 9) AS ratio, round(covered / 4000000 * 100, 7) AS percentage, CAST(n AS BIGINT) AS raw_count, ranges FROM c",
    "report_sections": f"WITH {_islands(False)} SELECT doc_id, s AS start, e AS \"end\", score, n AS members, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM u",
    "invalid_ranges": f'WITH {_R} SELECT doc_id, match_id, s AS start, e AS "end" FROM r WHERE e > 2000000',
    "filtered_matches": f'WITH {_R} SELECT match_id, doc_id, s AS start, e AS "end", score FROM r WHERE page = 3 AND score >= 0.5',
    "report_header": f"WITH {_islands(False)} SELECT (SELECT count(*) FROM r) AS total, (SELECT count(*) FROM r WHERE score >= 0.5) AS filtered, (SELECT count(*) FROM u) AS sections",
    "repeated_evidence": f"WITH {_R} SELECT doc_id, page AS source_id, s // 3600 AS start, count(*) AS times FROM r GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "threshold_sweep": f"""WITH {_S}, c AS (SELECT CAST(score AS DECIMAL(20,12)) AS score, pos FROM x),
t AS (SELECT DISTINCT t FROM (SELECT CAST(i AS DECIMAL(20,12)) / 100 AS t FROM range(101) AS g(i) UNION ALL SELECT score FROM c UNION ALL SELECT score + CAST('0.000000000001' AS DECIMAL(20,12)) FROM c UNION ALL SELECT unnest([0.005, 0.2949, 0.8009])) WHERE t BETWEEN 0 AND 1),
m AS (SELECT CAST(t AS DECIMAL(20,12)) AS threshold, count(*) FILTER (WHERE score >= CAST(t AS DECIMAL(20,12)) AND pos) AS tp, count(*) FILTER (WHERE score >= CAST(t AS DECIMAL(20,12)) AND NOT pos) AS fp, count(*) FILTER (WHERE score < CAST(t AS DECIMAL(20,12)) AND pos) AS fn, count(*) FILTER (WHERE score < CAST(t AS DECIMAL(20,12)) AND NOT pos) AS tn FROM (SELECT DISTINCT CAST(t AS DECIMAL(20,12)) AS t FROM t) CROSS JOIN c GROUP BY t)
SELECT CAST(threshold AS DOUBLE) AS threshold, tp, fp, fn, tn, {_M} FROM m""",
    "confusion_matrix": f"WITH {_S}, m AS (SELECT count(*) FILTER (WHERE score >= 0.5 AND pos) AS tp, count(*) FILTER (WHERE score >= 0.5 AND NOT pos) AS fp, count(*) FILTER (WHERE score < 0.5 AND pos) AS fn, count(*) FILTER (WHERE score < 0.5 AND NOT pos) AS tn FROM x) SELECT CAST(0.5 AS DOUBLE) AS threshold, tp, fp, fn, tn, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM m",
    "class_margins": f"WITH {_S} SELECT max(score) FILTER (WHERE NOT pos) AS max_negative, min(score) FILTER (WHERE pos) AS min_positive, round(min(score) FILTER (WHERE pos) - max(score) FILTER (WHERE NOT pos), 9) AS class_gap FROM x",
    "label_faults": f"WITH {_S} SELECT (SELECT count(*) FROM (SELECT case_id FROM x GROUP BY 1 HAVING count(*) > 1)) AS repeated_ids, CAST(0 AS BIGINT) AS unknown_labels, count(*) FILTER (WHERE pos) AS matches, count(*) FILTER (WHERE NOT pos) AS non_matches FROM x",
    "score_faults": f"WITH {_R} SELECT match_id AS case_id, CASE WHEN page = 5 THEN 'other' ELSE 'match' END AS label FROM r WHERE score * CAST(1.2 AS DOUBLE) > 1 OR page = 5",
    "golden_drift": f"WITH {_S} SELECT case_id FROM x WHERE case_id % 7 = 0",
    "weight_calibration": """WITH x AS (SELECT 0.2 + 0.6 * toxic + doc_id % 10 / 100 AS w, 0.3 + 0.5 * toxic + doc_id % 10 / 100 AS c, 0.1 + 0.4 * toxic + doc_id % 10 / 100 AS o, toxic = 1 AS pos FROM labels),
d AS (SELECT unnest([-0.05, 0.0, 0.05]) AS d), g AS (SELECT 0.5 + a.d AS w1, 0.25 + b.d AS w2, 0.25 - a.d - b.d AS w3, abs(a.d) + abs(b.d) + abs(a.d + b.d) AS l1, row_number() OVER (ORDER BY a.d, b.d) AS g FROM d a, d b WHERE abs(a.d + b.d) <= 0.051),
s AS (SELECT g, w1, w2, w3, l1, max(round(w * w1 + c * w2 + o * w3, 12)) FILTER (WHERE NOT pos) AS lo, min(round(w * w1 + c * w2 + o * w3, 12)) FILTER (WHERE pos) AS hi FROM x, g GROUP BY ALL),
k AS (SELECT s.*, i / 100 AS t FROM s, range(101) AS r(i) WHERE round(hi - i / 100, 12) >= 0.05 AND round(i / 100 - lo, 12) >= 0.05),
b AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(abs(t - 0.75), 12), t DESC) AS r FROM k)
SELECT row_number() OVER (ORDER BY hi - lo DESC, round(l1, 12), g) AS place, round(CAST(w1 AS DOUBLE), 9) AS w1, round(CAST(w2 AS DOUBLE), 9) AS w2, round(CAST(w3 AS DOUBLE), 9) AS w3, t AS threshold, CAST(1 AS DOUBLE) AS f1, round(CAST(lo AS DOUBLE), 9) AS max_negative, round(CAST(hi AS DOUBLE), 9) AS min_positive, round(CAST(hi - lo AS DOUBLE), 9) AS class_gap FROM b WHERE r = 1""",
    "run_summary": "SELECT user_id % 10 AS size, round(quantile_cont(value, 0.5), 6) AS median, min(value) AS least, max(value) AS most, count(*) FILTER (WHERE event_type <> 'error') AS completed, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY 1",
    "transition_audit": f"WITH {_H}, m AS (SELECT event_id, user_id, status, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM h) SELECT event_id, user_id, previous, status FROM m WHERE previous IS NOT NULL AND (previous, status) NOT IN (('uploaded', 'queued'), ('queued', 'extracting'), ('queued', 'failed'), ('extracting', 'analyzing'), ('extracting', 'failed'), ('analyzing', 'completed'), ('analyzing', 'failed'), ('failed', 'queued'))",
    "latest_run": f"WITH {_H} SELECT user_id, event_id, status FROM h QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "retry_decision": f"""WITH {_RUN}, z AS (SELECT *, row_number() OVER o AS r, count(*) OVER (PARTITION BY doc_id) AS runs, first_value(status) OVER o AS last FROM q WINDOW o AS (PARTITION BY doc_id ORDER BY ts DESC, run_id DESC))
SELECT run_id, doc_id, runs, CASE WHEN r > 1 THEN CASE WHEN last IN ('queued', 'processing', 'completed') THEN 'return_latest' ELSE 'analysis_retry_conflict' END WHEN reason <> 'processing_failed' THEN 'analysis_retry_not_allowed' WHEN runs - 1 >= 2 THEN 'analysis_retry_limit' ELSE 'enqueue' END AS decision FROM z WHERE status = 'failed'""",
    "run_counts": f"WITH {_RUN} SELECT doc_id, count(*) AS runs FROM q GROUP BY doc_id",
    "due_work": f"WITH {_H} SELECT event_id AS id, status, CASE WHEN status = 'analyzing' THEN 'analyze' ELSE 'extract' END AS task FROM h WHERE status IN ('queued', 'extracting', 'analyzing') AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 100",
    "expiry_candidates": f"WITH {_D} SELECT id, status FROM x",
    "cascade_keep": f"WITH {_D} SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT id FROM x)",
    "cleanup_counts": f"WITH {_D} SELECT count(*) FILTER (WHERE conv_id IN (SELECT id FROM x)) AS removed, count(*) FILTER (WHERE conv_id NOT IN (SELECT id FROM x)) AS kept, CAST(0 AS BIGINT) AS left_over FROM conversations",
    "owned_documents": f"WITH {_D} SELECT id, status FROM d WHERE owner_id = 8 AND status <> 'deleted'",
    "document_list": f"WITH {_D} SELECT id, status FROM d ORDER BY updated_at DESC, id DESC LIMIT 20 OFFSET 20",
    "failure_codes": "SELECT CASE event_id % 4 WHEN 0 THEN 'invalid_pdf' WHEN 1 THEN 'processing_failed' ELSE 'processing_timeout' END AS code, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1",
    "redaction": "SELECT event_id, CASE WHEN trunc(value) * 2 BETWEEN 100 AND 599 THEN CAST(CAST(trunc(value) * 2 AS INTEGER) AS VARCHAR) END AS http_status, CASE WHEN event_id % 2 = 0 THEN 'extract' END AS stage, '[REDACTED]' AS email, CASE WHEN event_id % 1500 <= 1000 THEN CAST(event_id % 1500 AS VARCHAR) END AS attempt, NULL AS secret, '[REDACTED]' AS document_id, 'true' AS redacted_fields FROM events",
    "audit_validation": """SELECT event_id, CASE event_type WHEN 'click' THEN 'document' WHEN 'signup' THEN 'user' ELSE 'source' END AS resource_type,
CASE WHEN event_type = 'error' THEN 'not_allow_listed' WHEN (event_id % 2 = 0) <> (event_id % 3 > 0) THEN 'actor_rule' WHEN event_id % 5 = 0 AND event_type <> 'view' THEN 'resource_required' END AS reject FROM events""",
    "status_backfill": f"WITH {_D} SELECT status, CASE WHEN id % 3 > 0 THEN retention_days ELSE 30 END AS retention_days, '2024-02-19' AS expires, count(*) AS n FROM d GROUP BY 1, 2",
    "admission": "SELECT page_id, CASE WHEN html IS NULL OR html = '' THEN 'empty_file' WHEN page_id % 3 = 2 THEN 'unsupported_file_type' WHEN (page_id % 3 = 0) <> (page_id % 2 = 0) THEN 'unsupported_file_type' WHEN page_id % 3 = 0 AND regexp_matches(html, '\\x00') THEN 'signature_mismatch' ELSE 'accepted' END AS code FROM pages",
    "source_dedup": "SELECT sha256(text) AS sha256, min(doc_id) AS source_id, count(*) AS copies FROM documents GROUP BY 1",
    "seed_antijoin": "SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)",
    "eligible_sources": f"WITH {_SRC} SELECT item_id FROM s WHERE status = 'ready' AND license = 'approved' AND (f IS NULL OR f <= DATE '2024-01-16') AND (u IS NULL OR u >= DATE '2024-01-16')",
    "ingest_status": f"WITH {_SRC} SELECT item_id, CASE WHEN item_id % 6 > 0 THEN 'Kaynak ' || item_id END AS title, NULL AS author, CASE WHEN item_id % 6 = 0 THEN 'missing_title' WHEN u < f THEN 'license_range' END AS reject FROM s",
    "fixed_window_quota": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, count(*) > 3 AS over, strftime(time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 3601 SECOND, '%Y-%m-%d %H:%M:%S') AS lives_until FROM events GROUP BY time_bucket(INTERVAL 1 HOUR, ts), event_type",
    "quota_keys": "SELECT event_id, sha256('salt:' || user_id || ':' || CAST(floor(epoch(ts) / 300) AS BIGINT)) AS quota_key FROM events",
    "retry_backoff": "SELECT event_id, CAST(least(10 * power(2, event_id % 8), 120) AS DOUBLE) AS seconds FROM events",
    "corpus_manifest": "SELECT 'documents/' || doc_id || '.txt' AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, sha256(text) AS sha256 FROM documents",
    "decoded_texts": "SELECT doc_id, text, CASE WHEN text = '' THEN 'empty' END AS decode_error FROM documents",
    "legacy_texts": r"""SELECT doc_id, 'text' AS kind, text, CASE WHEN text = '' THEN 'empty' END AS decode_error FROM documents WHERE NOT regexp_matches(text, '[^\x{00}-\x{7F}\x{A0}-\x{FF}]') AND NOT regexp_matches(text, '[ÐÝÞðýþ]')
UNION ALL SELECT doc_id, 'noise', NULL, 'undecodable' FROM documents""",
    "checksum_faults": "SELECT doc_id FROM documents WHERE doc_id % 9 = 0",
    "page_links": "SELECT page_id, CASE WHEN page_id % 4 > 0 AND regexp_matches(url, '^https?:') THEN url END AS url, regexp_extract(split_part(url, '?', 1), '([^/]*)$', 1) AS filename FROM pages",
    "report_dates": "SELECT event_id, strftime(ts + INTERVAL 3 HOUR, '%d.%m.%Y %H:%M') AS local FROM events",
}
