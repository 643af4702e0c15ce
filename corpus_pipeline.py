"""Raw documents to packed training sequences.

Each stage works on all that the one before it kept and hands on the columns
of ``documents``; the last one returns the packed pieces. Copies in the mix
keep the id of their document, so the pieces of one document may stand
several times. No documents give no pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, fresh, read
from textloom.llm.jaccard import jaccard_components
from textloom.llm.lines import dedup_passages
from textloom.llm.mixing import mix
from textloom.llm.packing import pack_documents
from textloom.llm.toxicity import CHAIN, toxicity


def _set_aside(docs: DataFrame, added: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``docs`` without columns called as ``added``, under other names, and what selects all as they were."""
    names = {c: fresh(f"kept_{c}", docs.columns) for c in docs.columns if c.lower() in added}
    return docs.withColumnsRenamed(names), [F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject; those without words or labels stay."""
    docs, columns = _set_aside(docs, (*(name for name, _ in CHAIN), "rejected"))
    scored = toxicity(docs, read(spark, sf_dir, "labels"), Scratch(spark, "stage-toxicity"))
    return scored.where(~F.col("rejected")).select(*columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the multi-line passages and long lines that stand earlier; ``n_chars`` follows the text.

    Every row stays, with a null text or id as it was, with an empty text if
    all of it stands earlier.
    """
    docs, columns = _set_aside(docs, ("removed_chunks", "removed_lines"))
    cleaned = dedup_passages(docs, Scratch(spark, "stage-lines"))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near copies.

    Of rows with one id, the one of the least text stays; rows without an id,
    and documents without words, are no copies of anything.
    """
    found = jaccard_components(docs.select("doc_id", "text"), Scratch(spark, "stage-jaccard")).where("doc_id is not null")
    counted = found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows"))
    counted = counted.where("rows > 1 or doc_id <> component_id")
    others, twice = counted.where("doc_id <> component_id").select("doc_id"), counted.where("doc_id = component_id").select("doc_id")
    kept = docs.join(others, "doc_id", "left_anti").select(*docs.columns)
    if twice.isEmpty():
        return kept
    place = fresh("place", docs.columns)
    order = Window.partitionBy("doc_id").orderBy("text", *(c for c in docs.columns if c not in ("doc_id", "text")))
    single = kept.join(twice, "doc_id", "left_anti").select(*docs.columns)
    return single.union(kept.join(twice, "doc_id", "left_semi").select(*docs.columns).withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without words are not taken."""
    docs, columns = _set_aside(docs, ("size", "source_size", "target", "copies"))
    mixed = mix(docs, Scratch(spark, "stage-mix")).where("copies > 0")
    times = F.array_repeat(F.struct(*columns), F.col("copies").cast("int"))
    return mixed.select(F.explode(times).alias("row")).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens."""
    return pack_documents(docs, Scratch(spark, "stage-pack"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier, the joins' fingerprints and the tokenizer have no SQL twin; tests/llm/test_pipeline.py
#: compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
