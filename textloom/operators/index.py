"""Prefix postings of source chunks, kept between runs.

Postings are bucketed by gram under one order of the grams, fixed when the
index is made: any order is lossless, so sources that come, change or go
never move what is stored. A batch of documents is cut and dealt like the
buckets; the sources are neither counted nor shuffled again.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.config import Config
from textloom.operators import held
from textloom.operators import similarity as S
from textloom.tables import keep

#: Buckets of postings and chunks.
BUCKETS = 64
_CHUNKS = ["id", "source_id", "content", "char_start"]


class SourceIndex:
    """Chunks ``id, source_id, content, char_start`` of sources below ``path``.

    Every merge writes rows of a version of its own, then the list of all
    sources with their versions, then one commit row, which alone makes it
    visible; a merge that breaks anywhere leaves the index as it was. One
    writer at a time; ids, source ids and contents are not null.
    """

    def __init__(self, spark: SparkSession, path: str, config: Config = Config(), buckets: int = BUCKETS):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config
        self.share = config.prefix_share(config.least_word_cosine)
        if self.share <= 0:
            raise ValueError("without a word cosine that every match needs, there are no prefixes to store")
        self.buckets = buckets

    def _table(self, kind: str, key: str, columns: str) -> str:
        """The bucketed table of a kind; its definition lives in the session, its rows below ``path``."""
        name = f"textloom_{kind}_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{kind}'")
        return name

    def _tables(self) -> tuple[str, str]:
        kinds = {r["name"]: r["kind"] for r in self.spark.read.parquet(f"{self.path}/kinds").collect()}
        return (
            self._table("postings", "gram", f"gram string, id {kinds['id']}, source_id {kinds['source_id']}, version string"),
            self._table("chunks", "id", f"id {kinds['id']}, source_id {kinds['source_id']}, content string, char_start long, version string"),
        )

    def create(self, chunks: DataFrame, cells: int = S.CELLS) -> None:
        """Fix the order of grams by these chunks and store them."""
        kinds = [(name, kind) for name, kind in chunks.select("id", "source_id").dtypes]
        self.spark.createDataFrame(kinds, "name string, kind string").coalesce(1).write.parquet(f"{self.path}/kinds")
        S.sketch(S.word_counts(_texts(chunks), self.config), cells).coalesce(1).write.parquet(f"{self.path}/order")
        self.spark.createDataFrame([], held.MAP).coalesce(1).write.parquet(f"{self.path}/held")
        self.merge(chunks)

    def _held(self) -> DataFrame | None:
        """The bits of all grams that any chunk ever stored holds; none for an index made before there were any."""
        try:
            return held.merged(self.spark.read.schema(held.MAP).parquet(f"{self.path}/held"))
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def _last(self) -> int:
        try:
            commits = self.spark.read.parquet(f"{self.path}/commits")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return 0
            raise
        return commits.agg(F.max("seq")).first()[0] or 0

    def live(self) -> DataFrame:
        """``source_id, version`` of the sources that count."""
        return self.spark.read.parquet(f"{self.path}/live/seq={self._last()}")

    def merge(self, chunks: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Store all chunks of new or changed sources, and take the ``source_id``s of ``gone`` out.

        What a changed source had before no longer counts; a source in both
        stays with its new chunks, one without chunks belongs to ``gone``.
        """
        version, last = uuid.uuid4().hex, self._last()
        postings, stored = self._tables()
        live = self.live() if last else None
        if chunks is not None:
            chunks = keep(chunks.select(*_CHUNKS), "delta")
            if self._held() is not None:
                held.gram_map(S.firsts(S.streams(_texts(chunks))), *self.config.word_range).coalesce(1).write.mode("append").parquet(f"{self.path}/held")
            order = self.spark.read.parquet(f"{self.path}/order")
            rows = S.prefixes(S.word_counts(_texts(chunks), self.config), order, self.share).join(chunks.select("id", "source_id"), "id")
            rows.select("gram", "id", "source_id", F.lit(version).alias("version")).repartition(self.buckets, "gram").write.insertInto(postings)
            chunks.withColumn("char_start", F.col("char_start").cast("long")).withColumn("version", F.lit(version)).repartition(self.buckets, "id").write.insertInto(stored)
            fresh = chunks.select("source_id").distinct().withColumn("version", F.lit(version))
            live = fresh if live is None else live.join(fresh, "source_id", "left_anti").union(fresh)
            gone = gone and gone.select("source_id").join(fresh, "source_id", "left_anti")
        if gone is not None and live is not None:
            live = live.join(gone.select("source_id"), "source_id", "left_anti")
        if live is None:
            return
        # a broken try of the same number is overwritten, and only the commit row names it
        live.write.mode("overwrite").parquet(f"{self.path}/live/seq={last + 1}")
        self.spark.createDataFrame([(last + 1,)], "seq int").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def chunks(self) -> DataFrame:
        """All chunks that count."""
        return self.spark.table(self._tables()[1]).join(self.live(), ["source_id", "version"], "left_semi").select(*_CHUNKS)

    def candidates(self, documents: DataFrame) -> DataFrame:
        """``l, r, version``: pairs of document chunks ``id, content`` and stored chunks that may reach the threshold."""
        order = self.spark.read.parquet(f"{self.path}/order")
        batch = S.prefixes(S.word_counts(_texts(documents), self.config), order, self.share).withColumnRenamed("id", "l")
        met = batch.join(self.spark.table(self._tables()[0]), "gram").select("l", F.col("id").alias("r"), "source_id", "version").distinct()
        return met.join(self.live(), ["source_id", "version"], "left_semi").select("l", "r", "version")

    def match(self, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Scored pairs of document chunks with the index, at or above the threshold, and the stored chunks met.

        As ``similarity.match_pairs`` with all chunks that count. Chunks of the
        same words are matched once, and only those that hold enough grams of
        the index are dealt.
        """
        texts, known = _texts(documents), self._held()
        every = S.streams(texts)
        first = S.firsts(every)
        first = keep(first if known is None else held.likely(first, known, *self.config.word_range, self.share), "firsts")
        some = S.texts_of(texts, first)
        pairs = keep(self.candidates(some.withColumnRenamed("text", "content")), "pairs")
        wanted = pairs.select(F.col("r").alias("id"), "version").distinct()
        met = keep(self.spark.table(self._tables()[1]).join(wanted, ["id", "version"], "left_semi").select(*_CHUNKS), "met")
        scored = S._score_pairs(pairs.select("l", "r"), some, _texts(met), self.config, True).where(F.col("score") >= F.lit(self.config.threshold))
        return S.spread(keep(scored, "found"), "l", first, every), met


def _texts(chunks: DataFrame) -> DataFrame:
    return chunks.select("id", F.col("content").alias("text"))
