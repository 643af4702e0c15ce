"""Admission, licenses, retries, retention and audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T

MAX_BYTES, SAMPLE_BYTES, CONTROL_SHARE = 20 * 1024 * 1024, 8192, 0.02
# Allowed edges of a document's status, failure codes and which of them may be retried.
EDGES = (("uploaded", "queued"), ("queued", "extracting"), ("queued", "failed"), ("extracting", "analyzing"), ("extracting", "failed"), ("analyzing", "completed"), ("analyzing", "failed"), ("failed", "queued"))
PUBLIC_CODES = ("processing_timeout", "ocr_required", "invalid_pdf", "invalid_docx", "no_extractable_text", "stored_document_changed", "missing_document_chunks", "missing_algorithm_snapshot", "unsupported_algorithm_version")
RETRYABLE = ("processing_failed", "processing_timeout")
# Names of diagnostic fields, stages and methods.
SENSITIVE = ("email", "ip", "name", "phone", "password", "cookie", "token", "content", "body", "text", "document_text", "storage_key", "headers", "params")
UUID_FIELDS = ("document_id", "analysis_id", "task_id")
STAGES = ("extract", "analyze", "dispatch", "retention_cleanup")
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
REDACTED = "[REDACTED]"


def admission_code(filename: Column, content_type: Column, content: Column) -> Column:
    """Why an upload of binary ``content`` is refused, or ``accepted``."""
    extension = F.lower(F.regexp_extract(F.trim(filename), r"\.([^./\\]+)$", 1))
    kind = F.create_map(*(F.lit(x) for pair in T.MEDIA_TYPES.items() for x in pair))[extension]
    sample = F.hex(F.substring(content, 1, SAMPLE_BYTES))
    controls = F.length(F.regexp_replace(F.regexp_replace(sample, "(..)", "$1 "), "(?:(?![01][0-9A-F])[0-9A-F]{2}|09|0A|0C|0D) ", "")) / 3
    size = F.octet_length(content)
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, "empty_file")
        .when(size > MAX_BYTES, "file_too_large")
        .when(kind.isNull(), "unsupported_file_type")
        .when(~F.coalesce(T.media_type(content_type) == kind, F.lit(False)), "unsupported_file_type")
        .when((extension == "txt") & (sample.rlike("^(?:..)*?00") | (controls / F.least(size, F.lit(SAMPLE_BYTES)) > CONTROL_SHARE)), "signature_mismatch")
        .otherwise("accepted")
    )


def normalize_metadata(rows: DataFrame, required: list[str], optional: list[str]) -> DataFrame:
    """Strip fields, empty optional ones to null, and say why a row is refused in ``reject``."""
    clean = rows.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c in [*required, *optional]})
    missing = F.coalesce(*(F.when(F.col(c).isNull(), F.lit(f"missing_{c}")) for c in required))
    return clean.withColumn("reject", F.coalesce(missing, F.when(F.col("license_valid_until") < F.col("license_valid_from"), "license_range")))


def checksum_faults(objects: DataFrame) -> DataFrame:
    """Objects whose content no longer has the registered size and digest."""
    return objects.where(~((F.octet_length("content") == F.col("size_bytes")) & (F.sha2("content", 256) == F.col("sha256"))))


def first_by_digest(sources: DataFrame) -> DataFrame:
    """One source per digest: the smallest id."""
    return sources.groupBy("sha256").agg(F.min("source_id").alias("source_id"), F.count("*").alias("copies"))


def absent(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows to insert: those whose key is not there yet."""
    return new.join(known.select(key).distinct(), key, "left_anti")


def failure_code(error: Column) -> Column:
    """A safe public code; anything unknown is ``processing_failed``."""
    return F.when(error.isin(*PUBLIC_CODES), error).otherwise("processing_failed")


def edges(spark) -> DataFrame:
    return spark.createDataFrame(list(EDGES), "previous string, status string")


def invalid_transitions(history: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Status changes along no allowed edge; ``history``: ``key, at, tie, status``."""
    order = Window.partitionBy(key).orderBy(at, tie)
    moves = history.withColumn("previous", F.lag("status").over(order)).where("previous is not null")
    return moves.join(F.broadcast(edges(history.sparkSession)), ["previous", "status"], "left_anti")


def latest(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The last row of each key: latest time, then largest ``tie``."""
    columns = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(at, tie)).alias("x"))
    return best.select(key, *(F.col(f"x.{c}").alias(c) for c in columns))


def retry_decision(runs: DataFrame, limit: int = 2) -> DataFrame:
    """What a retry of each failed run does: ``enqueue``, ``return_latest`` or the refusal.

    ``runs``: ``run_id, doc_id, created_at, status, failure_reason, document_status``.
    """
    order = Window.partitionBy("doc_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    whole = Window.partitionBy("doc_id")
    seen = runs.withColumns({"r": F.row_number().over(order), "runs": F.count("*").over(whole), "latest_status": F.first("status").over(order)})
    decision = (
        F.when(F.col("r") > 1, F.when(F.col("latest_status").isin("queued", "processing", "completed"), "return_latest").otherwise("analysis_retry_conflict"))
        .when(F.coalesce(F.col("document_status"), F.lit("")) != "failed", "analysis_retry_conflict")
        .when(~F.coalesce(F.col("failure_reason").isin(*RETRYABLE), F.lit(False)), "analysis_retry_not_allowed")
        .when(F.col("runs") - 1 >= limit, "analysis_retry_limit")
        .otherwise("enqueue")
    )
    return seen.where("status = 'failed'").select("run_id", "doc_id", "runs", decision.alias("decision"))


def due_work(documents: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    """The next tasks to hand out: oldest attempt first, routed by status."""
    active = documents.where(F.col("status").isin("queued", "extracting", "analyzing") & (F.col("next_attempt_at") <= now))
    task = F.when(F.col("status") == "analyzing", "analyze").otherwise("extract")
    return active.orderBy("next_attempt_at", "id").limit(limit).select("id", "status", "next_attempt_at", task.alias("task"))


def expiry_candidates(documents: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    """Documents to clean: expired or deleted, not active, not cleaned; longest untouched first."""
    idle = F.col("cleaned_at").isNull() & ~F.col("status").isin("queued", "extracting", "analyzing")
    return documents.where(idle & ((F.col("expires_at") <= now) | (F.col("status") == "deleted"))).orderBy("updated_at", "id").limit(limit)


def expires_at(uploaded: Column, days: Column) -> Column:
    """End of retention; only 7 or 30 days are allowed, else null."""
    return F.when(days.isin(7, 30), uploaded + F.make_dt_interval(days))


def cascade(children: DataFrame, deleted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows to delete and rows to keep when the parents in ``deleted`` go."""
    gone = deleted.select(key).distinct()
    return children.join(gone, key, "left_semi"), children.join(gone, key, "left_anti")


def retention_sweep(documents: DataFrame, children: dict[str, DataFrame], now: Column, limit: int = 100) -> dict[str, DataFrame]:
    """Tombstones of what expires, the children that stay, and the audit rows of the sweep."""
    gone = expiry_candidates(documents, now, limit)
    kept = {name: cascade(rows, gone.select(F.col("id").alias("doc_id")), "doc_id")[1] for name, rows in children.items()}
    audit = gone.select(F.col("id").alias("resource_id"), F.explode(F.array(F.lit("started"), F.lit("succeeded"))).alias("outcome")).withColumn("action", F.lit("document.expire"))
    return {"tombstones": gone.select("id", F.lit("deleted").alias("status"), now.alias("cleaned_at")), "audit": audit, **kept}


def owned(documents: DataFrame, owner: Column) -> DataFrame:
    """A user's documents that are not deleted."""
    return documents.where((F.col("owner_id") == owner) & (F.col("status") != "deleted"))


def redact(context: Column) -> Column:
    """A map of diagnostic fields without private values; unknown keys only leave a flag."""
    known = (*UUID_FIELDS, "http_status", "attempt", "stage", "method", "route", *SENSITIVE)

    def value(k: Column, v: Column) -> Column:
        return F.when(k.isin(*UUID_FIELDS), F.when(F.lower(v).rlike(UUID), F.lower(v)).otherwise(F.when(v.isNotNull(), REDACTED))).when(k.isin(*SENSITIVE), REDACTED).otherwise(v)

    def good(k: Column, v: Column) -> Column:
        whole = F.when(v.rlike(r"^\d{1,4}$"), v.cast("int"))
        return (
            k.isin(*UUID_FIELDS, *SENSITIVE)
            | ((k == "http_status") & F.coalesce(whole.between(100, 599), F.lit(False)))
            | ((k == "attempt") & F.coalesce(whole.between(0, 1000), F.lit(False)))
            | ((k == "stage") & F.coalesce(v.isin(*STAGES), F.lit(False)))
            | ((k == "method") & F.coalesce(v.isin(*METHODS), F.lit(False)))
            | ((k == "route") & v.isNull())
        )

    kept = F.transform_values(F.map_filter(context, good), value)
    flagged = F.map_concat(kept, F.create_map(F.lit("redacted_fields"), F.lit("true")))
    return F.when(F.size(F.map_keys(F.map_filter(context, lambda k, v: ~good(k, v)))) > 0, flagged).otherwise(kept)


def audit_reject(events: DataFrame, actions: tuple[str, ...]) -> DataFrame:
    """Add the derived ``resource_type`` and why a row is refused, if it is."""
    reject = (
        F.when(~F.coalesce(F.col("action").isin(*actions), F.lit(False)) | ~F.coalesce(F.col("actor_kind").isin("user", "system"), F.lit(False)) | ~F.coalesce(F.col("outcome").isin("started", "succeeded", "failed"), F.lit(False)), "not_allow_listed")
        .when((F.col("actor_kind") == "user") != F.col("actor_id").isNotNull(), "actor_rule")
        .when(F.col("resource_id").isNull() & (F.col("action") != "source.list"), "resource_required")
    )
    kind = F.when(F.col("action").startswith("document."), "document").when(F.col("action") == "user.provision", "user").otherwise("source")
    return events.withColumns({"resource_type": kind, "reject": reject})


def backfill_status(documents: DataFrame, now: Column) -> DataFrame:
    """Old rows under the present scheme: status names, and 30 days from now where no end was set."""
    status = F.when(F.col("status") == "processing", "queued").when(F.col("status") == "ready", "completed").otherwise(F.col("status"))
    return documents.withColumns({"status": status, "retention_days": F.coalesce("retention_days", F.lit(30)), "expires_at": F.coalesce("expires_at", now + F.expr("INTERVAL 30 DAYS"))})


def quota(events: DataFrame, identity: str = "user_id", seconds: int = 300, most: int = 10) -> DataFrame:
    """Events per identity and fixed window, whether over the quota, and until when the row lives."""
    window = F.window("ts", f"{seconds} seconds")
    return events.groupBy(window.alias("w"), identity).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), identity, "n", (F.col("n") > most).alias("over"), (F.col("w.end") + F.expr("INTERVAL 1 SECOND")).alias("lives_until")
    )
