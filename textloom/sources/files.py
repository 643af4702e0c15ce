"""Reading raw texts and writing results."""

from __future__ import annotations

import unicodedata
import uuid

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte order marks, U+FEFF as each encoding writes it, and the codec that reads marked text; longer marks first.
_MARKS = sorted((("\ufeff".encode(form), codec) for codec, forms in (("utf-16", ("utf-16-le", "utf-16-be")), ("utf-32", ("utf-32-le", "utf-32-be")), ("utf-8-sig", ("utf-8",))) for form in forms), key=lambda m: -len(m[0]))
#: Encodings that bytes may be text in; text that is in any of them is read as the first.
LEGACY = ("cp1254", "iso8859-9", "cp1252", "koi8-r", "cp1251")
#: Log-odds of text over noise for each pair of bytes that a text reaches in some encoding.
LEAST_ODDS = -0.5
#: Kinds of signs, and the log-odds that one kind follows another in text rather than in noise.
_KINDS = "lower upper digit blank plain other none".split()
_ODDS = {
    "lower": (1.5, -3.0, -1.0, 1.0, 0.8, -2.5, -6.0),
    "upper": (0.8, 0.5, -1.0, 0.5, 0.3, -2.5, -6.0),
    "digit": (-1.0, -1.0, 1.0, 1.0, 1.0, -1.5, -6.0),
    "blank": (0.8, 0.8, 1.0, 0.5, 0.8, -1.0, -6.0),
    "plain": (0.3, 0.3, 0.5, 1.0, 0.3, -1.0, -6.0),
    "other": (-2.5, -2.0, -1.5, -0.5, -1.0, -2.5, -6.0),
    "none": (-6.0,) * 7,
}
_WEIGHTS = np.array([_ODDS[kind] for kind in _KINDS])


def _kind(raw: int, encoding: str) -> int:
    try:
        sign = bytes([raw]).decode(encoding)
    except UnicodeDecodeError:
        return _KINDS.index("none")
    # quotation marks and dashes are as plain beyond ASCII as within
    kind = "digit" if sign.isdigit() and raw < 128 else "upper" if sign.isupper() else "lower" if sign.isalpha() and sign not in "ªº" else "blank" if sign.isspace() else "plain" if "!" <= sign <= "~" or unicodedata.category(sign) in ("Pd", "Pi", "Pf") else "other"
    return _KINDS.index("none" if unicodedata.category(sign) == "Cc" and not sign.isspace() else kind)


_TABLES = [np.array([_kind(raw, encoding) for raw in range(256)]) for encoding in LEGACY]


def text_odds(raw: bytes) -> float:
    """Log-odds for each pair of bytes that they are text, in the encoding that suits them best.

    Pairs of ASCII signs tell little and count 0; pairs with a byte beyond
    ASCII or a control sign count.
    """
    values = np.frombuffer(raw, np.uint8)
    beyond = values >= 128
    best = -np.inf
    for table in _TABLES:
        kinds = table[values]
        counted = beyond[:-1] | beyond[1:] | (kinds[:-1] == 6) | (kinds[1:] == 6)
        odds = _WEIGHTS[kinds[:-1], kinds[1:]][counted]
        best = max(best, float(odds.sum()) / max(1, len(values) - 1))
    return best


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, modificationTime, length, content`` of all files below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def decode_text(files: DataFrame) -> DataFrame:
    """Add ``text`` and ``decode_error`` (``empty``, ``undecodable`` or null).

    A byte order mark decides first, then strict UTF-8, then Turkish
    Windows-1254, if pairs of bytes are likely in any of the ``LEGACY``
    encodings and all are defined in that one. Clean UTF-8 is decoded by
    Spark; only the rest reaches Python.
    """
    def legacy(contents: pd.Series) -> pd.Series:
        def one(raw: bytes) -> str | None:
            codec = next((codec for mark, codec in _MARKS if raw.startswith(mark)), None)
            if codec is None and text_odds(raw) < LEAST_ODDS:
                return None
            try:
                return raw.decode(codec or LEGACY[0])
            except UnicodeDecodeError:
                return None

        return contents.map(one)

    head = F.hex(F.substring("content", 1, 4))
    marked = head.rlike("^(?:EFBBBF|FFFE|FEFF|0000FEFF)")
    plain = F.coalesce(~marked & F.is_valid_utf8(F.col("content").cast("string")), F.lit(True))
    good = files.where(plain).withColumn("text", F.col("content").cast("string"))
    rest = files.where(~plain).withColumn("text", F.pandas_udf(legacy, "string")("content"))
    out = good.unionByName(rest)
    empty = F.coalesce(F.octet_length("content"), F.lit(0)) == 0
    return out.withColumn("decode_error", F.when(empty, "empty").when(F.col("text").isNull(), "undecodable"))


def replace_partitions(df: DataFrame, path: str, key: str) -> None:
    """Write ``df`` so that exactly the partitions whose ``key`` it holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def replace_matches(matches: DataFrame, runs: DataFrame, path: str) -> None:
    """Store the matches of finished analyses, then their status, which alone makes them visible.

    ``matches``: ``analysis_id, attempt, ...``; ``runs``: ``analysis_id,
    attempt, status``. Rows of earlier or broken attempts are never read, so
    a writer may stop anywhere and try again.
    """
    replace_partitions(matches, f"{path}/matches", "analysis_id")
    replace_partitions(runs, f"{path}/runs", "analysis_id")


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """Matches of completed analyses, of the attempt that completed each."""
    done = spark.read.parquet(f"{path}/runs").where("status = 'completed'").select("analysis_id", "attempt")
    return spark.read.parquet(f"{path}/matches").join(done, ["analysis_id", "attempt"], "left_semi")


def publish(rows: DataFrame, path: str, query: str, batch: int) -> bool:
    """Add the rows of a stream's micro-batch to a sink, once however often the batch is run.

    Each try writes below an attempt of its own; one row of the ledger, written
    last, makes it visible. A batch that the ledger holds is left alone, so
    whatever breaks, before or after that row, a new run changes nothing that
    readers have seen. Returns whether rows were written.
    """
    spark = rows.sparkSession
    known = _ledger(spark, path)
    if known is not None and not known.where((F.col("query") == query) & (F.col("batch") == batch)).isEmpty():
        return False
    attempt = uuid.uuid4().hex
    marked = rows.withColumns({"query": F.lit(query), "batch": F.lit(batch).cast("long"), "attempt": F.lit(attempt)})
    marked.write.mode("append").partitionBy("query", "batch", "attempt").parquet(f"{path}/rows")
    row = spark.createDataFrame([(query, batch, attempt)], "query string, batch long, attempt string").withColumn("committed_at", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(f"{path}/ledger")
    return True


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("query string, batch long, attempt string, committed_at timestamp").parquet(f"{path}/ledger")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_published(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a sink with ``query``, ``batch`` and ``attempt``: of each batch the attempt that was committed first.

    ``schema`` is that of the rows, so that a sink without any can be read.
    """
    known = _ledger(spark, path)
    schema = f"{schema}, query string, batch long, attempt string"
    if known is None:
        return spark.createDataFrame([], schema)
    first = known.groupBy("query", "batch").agg(F.min_by("attempt", F.struct("committed_at", "attempt")).alias("attempt"))
    return spark.read.schema(schema).parquet(f"{path}/rows").join(first, ["query", "batch", "attempt"], "left_semi")


def manifest(files: DataFrame) -> DataFrame:
    """``path, size_bytes, sha256`` of each file."""
    return files.select("path", F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
