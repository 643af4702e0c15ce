"""Removal of passages that repeat, by content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines picks the chunk borders,
so that a passage falls into the same chunks wherever it stands. Chunks of two
or more lines that occur again are removed, all but their first occurrence,
once their bytes have been compared (``dedup_lines``).

A passage's first and last lines share chunks with whatever stands around it,
and short passages hold no whole chunk. ``dedup_passages`` goes on from the
chunks to whole passages: of every run of lines that stands earlier too, it
removes all that has several lines or a line of many words. Only lines outside
the repeated chunks are looked at for that.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import WORD, Scratch, fresh, read

#: Lines over which the hash rolls, one border in so many windows, and fewest lines of a chunk that can go.
WINDOW, ONE_IN, LEAST_LINES = 2, 2, 2
#: Repeats of one chunk that meet its first occurrence in one group, about.
REPEATS_PER_GROUP = 10_000
#: Rows of one record batch that tasks hand on.
ROWS_PER_BATCH = 5_000
#: Base and modulus of the rolling hash of 28-bit line hashes.
BASE, MODULUS = 1_000_003, (1 << 31) - 1
#: Words above which a single line is a passage.
LONE_WORDS = 50
_WORD = re.compile(WORD)


def _hash(line: str) -> int:
    return int(hashlib.md5(line.encode()).hexdigest()[:7], 16)


_short_hash = lru_cache(1 << 14)(_hash)


def line_hash(line: str) -> int:
    return _short_hash(line) if len(line) < 40 else _hash(line)


def chunk_lines(lines: list[str]) -> list[tuple[int, int]]:
    """Half-open line ranges of the chunks.

    A chunk ends after a line where the hash of the last ``WINDOW`` lines is 0
    modulo ``ONE_IN``; what was the border depends on those lines alone.
    """
    hashes = [line_hash(line) for line in lines]
    out, start, rolling, drop = [], 0, 0, pow(BASE, WINDOW, MODULUS)
    for i, h in enumerate(hashes):
        rolling = (rolling * BASE + h) % MODULUS
        if i >= WINDOW:
            rolling = (rolling - hashes[i - WINDOW] * drop) % MODULUS
        if i >= WINDOW - 1 and rolling % ONE_IN == 0:
            out.append((start, i + 1))
            start = i + 1
    if start < len(lines):
        out.append((start, len(lines)))
    return out


def _could_go(lines: list[str]) -> Iterator[tuple[int, int]]:
    """Line ranges of the chunks that could go: several lines, not all blank."""
    for start, end in chunk_lines(lines):
        if end - start >= LEAST_LINES and any(line.strip() for line in lines[start:end]):
            yield start, end


def _batches(rows: Iterator[tuple], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded size."""
    schema = pa.schema(kinds.items())
    while held := list(islice(rows, ROWS_PER_BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def passage_windows(lines: list[str]) -> Iterator[tuple[int, int, int, bytes]]:
    """``(start, end, blanks, digest)`` of the smallest passages, as half-open line ranges.

    These are two neighbouring lines with text, a line of more than
    ``LONE_WORDS`` words, and a line with the blank ones next to it on one
    side. Every run of several lines, not all blank, is made of such windows
    alone, so a run that occurs again is found whole by its windows, at any
    length and between any lines. Digests are SHA-256 of the lines' bytes.

    Of equal blank lines in a row, ``blanks`` of them, only the longest window
    is named: its digest is that of what goes before them and of one of them,
    so that windows of fewer are found by grouping. ``blanks`` is 0 for other
    windows, and negative if the blank lines come first.
    """

    def grown(kind: bytes, line: str):
        return hashlib.sha256(kind + line.encode())

    blank = [not line.strip() for line in lines]
    # where a row of equal blank lines ends, and begins
    last, first = list(range(len(lines))), list(range(len(lines)))
    for i in range(1, len(lines)):
        if blank[i] and lines[i] == lines[i - 1]:
            first[i] = first[i - 1]
    for i in range(len(lines) - 2, -1, -1):
        if blank[i] and lines[i] == lines[i + 1]:
            last[i] = last[i + 1]
    for i, line in enumerate(lines):
        if blank[i]:
            continue
        if i and not blank[i - 1]:
            yield i - 1, i + 1, 0, grown(b"2", lines[i - 1] + "\n" + line).digest()
        if len(line) > 2 * LONE_WORDS and len(_WORD.findall(line)) > LONE_WORDS:
            yield i, i + 1, 0, grown(b"1", line).digest()
        if i + 1 < len(lines) and blank[i + 1]:
            forth, k = grown(b">", line), i + 1
            while k < len(lines) and blank[k]:
                forth.update(b"\n" + lines[k].encode())
                yield i, last[k] + 1, last[k] + 1 - k, forth.digest()
                forth.update(b" %d" % (last[k] + 1 - k))
                k = last[k] + 1
        if i and blank[i - 1]:
            back, k = grown(b"<", line), i - 1
            while k >= 0 and blank[k]:
                back.update(b"\n" + lines[k].encode())
                yield first[k], i + 1, first[k] - 1 - k, back.digest()
                back.update(b" %d" % (k + 1 - first[k]))
                k = first[k] - 1


def repeated_ranges(docs: DataFrame, scratch: Scratch, whole: bool) -> DataFrame:
    """``doc_id, mark, start, end, chunk``: line ranges of ``doc_id, mark, text`` equal to ones that stand earlier.

    Earlier is by document, mark and line. Chunks are equal byte for byte:
    only their digests are grouped, and the texts of repeated ones alone are
    compared, each with its first occurrence. With ``whole``, the smallest
    passages that no repeated chunk holds follow, compared by SHA-256. What
    such a chunk holds stands in the chunk's first occurrence as well, so the
    first occurrence of any passage is always among those looked at.
    """
    place = F.struct("doc_id", "mark", "start")
    key = {"doc_id": pa.int64(), "mark": pa.int64(), "start": pa.int32(), "end": pa.int32(), "digest": pa.binary()}
    parts = key | {"head": pa.bool_(), "salts": pa.int32(), "body": pa.string(), "blanks": pa.int32()}

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for d, m, t in zip(*batch.columns, strict=True):
                    lines = t.as_py().split("\n")
                    for start, end in _could_go(lines):
                        yield d.as_py(), m.as_py(), start, end, hashlib.sha256("\n".join(lines[start:end]).encode()).digest()

        return _batches(rows(), key)

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for d, m, t, w in zip(*batch.columns, strict=True):
                    d, m, lines, wanted = d.as_py(), m.as_py(), t.as_py().split("\n"), w.as_py() or ()
                    held = []
                    for c in wanted:
                        yield d, m, c["start"], c["end"], c["digest"], c["head"], c["salts"], "\n".join(lines[c["start"] : c["end"]]), None
                        if not c["head"]:
                            held.append((c["start"], c["end"]))
                    held.sort()
                    for start, end, blanks, digest in passage_windows(lines) if whole else ():
                        k = bisect_right(held, (start, len(lines) + 1)) - 1
                        if k < 0 or held[k][1] < end:
                            yield d, m, start, end, digest, None, None, None, blanks

        return _batches(rows(), parts)

    columns = "doc_id long, mark long, start int, end int, digest binary"
    found = scratch.save(docs.mapInArrow(digests, columns), "digests")
    first = found.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1")
    # a first occurrence stands once for so many of its repeats, which then meet it in as many groups
    first = scratch.save(first.select("digest", "first", F.ceil(F.col("times") / REPEATS_PER_GROUP).cast("int").alias("salts")), "first")
    repeated = found.join(first, "digest").select("doc_id", "mark", "start", "end", "digest", (place == F.col("first")).alias("head"), "salts")
    wanted = repeated.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "end", "digest", "head", "salts")).alias("wanted"))
    joined = docs.join(wanted.hint("merge"), ["doc_id", "mark"], "left" if whole else "inner").select("doc_id", "mark", "text", "wanted")
    compared = scratch.save(joined.mapInArrow(bodies, columns + ", head boolean, salts int, body string, blanks int"), "parts")
    heads = compared.where("head").select("digest", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "body")
    heads = heads.groupBy("digest", "salt").agg(F.min("body").alias("first_body"))
    others = compared.where("not head").withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark", "start"), F.col("salts")).cast("int"))
    chunks = others.join(heads, ["digest", "salt"]).where(F.col("body") == F.col("first_body")).select("doc_id", "mark", "start", "end", F.lit(True).alias("chunk"))
    if not whole:
        return chunks
    windows = compared.where("head is null").select("doc_id", "mark", "start", "end", "digest", F.abs("blanks").alias("blanks"), (F.col("blanks") < 0).alias("back"))
    plain, rows = windows.where("blanks = 0"), windows.where("blanks > 0")
    first = plain.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    first = scratch.save(first.select("digest", "first"), "first-windows")
    later = plain.join(first, "digest").where(place != F.col("first")).select("doc_id", "mark", "start", "end", F.lit(False))
    # a window of so many blank lines is also one of fewer: its first occurrence is the least of all with as many or more
    counted = rows.groupBy("digest", "blanks").agg(F.min(place).alias("place"), F.max(place).alias("last"))
    counted = counted.withColumns({"first": F.min("place").over(Window.partitionBy("digest").orderBy(F.desc("blanks"))), "sorts": F.count("*").over(Window.partitionBy("digest"))}).where("place <> last or sorts > 1")
    # what is first with so many may be a later one with fewer
    levels = counted.groupBy("digest", "first").agg(F.max("blanks").alias("reach"))
    levels = levels.withColumn("fewer", F.lag("reach").over(Window.partitionBy("digest").orderBy("reach"))).drop("reach")
    first = scratch.save(counted.select("digest", "blanks", "first").join(levels, ["digest", "first"]), "first-blanks")
    spare = F.when(place == F.col("first"), F.col("blanks") - F.col("fewer")).otherwise(F.lit(0))
    met = rows.join(first, ["digest", "blanks"]).withColumn("spare", spare).where("spare is not null")
    start = F.when(F.col("back"), F.col("start") + F.col("spare")).otherwise(F.col("start"))
    end = F.when(F.col("back"), F.col("end")).otherwise(F.col("end") - F.col("spare"))
    return chunks.union(later).union(met.select("doc_id", "mark", start.cast("int"), end.cast("int"), F.lit(False)))


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open ranges joined where they overlap or touch, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def _without_repeats(docs: DataFrame, scratch: Scratch, whole: bool) -> DataFrame:
    docs = docs.drop("removed_chunks", "removed_lines")
    mark = F.xxhash64("text")
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), mark.alias("mark"), "text")
    of_id, of_mark, of_gone = (fresh(n, docs.columns) for n in ("_id", "_mark", "_gone"))
    gone = scratch.save(repeated_ranges(texts, scratch, whole), "gone").groupBy(F.col("doc_id").alias(of_id), F.col("mark").alias(of_mark)).agg(F.collect_set(F.struct("start", "end", "chunk")).alias(of_gone))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, chunks, dropped = [], [], []
            for text, drop in zip(batch.column(batch.schema.get_field_index("text")), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                text, out = text.as_py(), merged((w["start"], w["end"]) for w in drop or ())
                if out:
                    lines, kept, at = text.split("\n"), [], 0
                    for start, end in out:
                        kept += lines[at:start]
                        at = end
                    text = "\n".join(kept + lines[at:])
                texts.append(text)
                chunks.append(sum(w["chunk"] for w in drop or ()))
                dropped.append(sum(end - start for start, end in out))
            arrays = [pa.array(texts, pa.string()) if f.name == "text" else batch.column(i) for i, f in enumerate(batch.schema)][:-1]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(chunks, pa.int64()), pa.array(dropped, pa.int64())], names=[*batch.schema.names[:-1], "removed_chunks", "removed_lines"])

    # what is removed grows with the corpus: never a broadcast
    joined = docs.join(gone.hint("merge"), (F.col("doc_id") == F.col(of_id)) & (mark == F.col(of_mark)), "left").drop(of_id, of_mark)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", removed_chunks long, removed_lines long"
    return joined.mapInArrow(clean, schema)


def dedup_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """All columns of ``docs``, ``text`` without the chunks that repeat, plus ``removed_chunks`` and ``removed_lines``.

    Earlier is in a smaller document, or further up in the same. Every row
    stays, even if nothing of its text does. Rows with a null id or text are
    unchanged; equal rows of one id count as one document, other texts of that
    id as documents of their own. Columns with the added names are replaced.
    """
    return _without_repeats(docs, scratch, whole=False)


def dedup_passages(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """As ``dedup_lines``, but passages go whole, at their ends and short ones too.

    A passage is a run of several lines, not all blank, or a line of more than
    ``LONE_WORDS`` words; the first occurrence of any line stays.
    ``removed_chunks`` counts the repeated chunks among what goes.
    """
    return _without_repeats(docs, scratch, whole=True)


def op9_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that stand earlier."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_passages(docs, Scratch(spark, "op9")).select("doc_id", "text", "removed_chunks", "removed_lines")


#: Chunks are numbered as above for the count of repeated ones. Passages are stated by themselves: two lines
#: with text, or one and blank lines next to it, or a long one; all lines of one that stands earlier go.
OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), l AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM t
), h AS (
  SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h FROM l
), e AS (
  SELECT *, CASE WHEN i > 1 AND ((lag(h) OVER w * 1000003 + h) % 2147483647) % 2 = 0 THEN 1 ELSE 0 END AS ends FROM h
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), c AS (
  SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM e
), b AS (
  SELECT doc_id, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM c GROUP BY doc_id, k
), g AS (
  SELECT *, n >= 2 AND regexp_matches(body, '\S') AND row_number() OVER (PARTITION BY body, n >= 2 ORDER BY doc_id, k) > 1 AS gone FROM b
), x AS (
  SELECT doc_id, i, line, lag(i) OVER w AS back, lead(i) OVER w AS forth FROM l WHERE regexp_matches(line, '\S')
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), p AS (
  SELECT doc_id, i AS a, unnest(range(i + 1, CASE WHEN forth = i + 1 THEN i + 2 ELSE coalesce(forth, len(ls) + 1) END)) AS z FROM x JOIN t USING (doc_id)
  UNION ALL SELECT doc_id, unnest(range(coalesce(back, 0) + 1, i)), i FROM x
  UNION ALL SELECT doc_id, i, i FROM x WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > 50
), q AS (
  SELECT doc_id, a, z, row_number() OVER (PARTITION BY array_to_string(ls[a:z], chr(10)) ORDER BY doc_id, a) > 1 AS gone FROM p JOIN t USING (doc_id)
), r AS (
  SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS i FROM q WHERE gone
), s AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE r.i IS NULL) AS text, count(r.i) AS removed FROM l LEFT JOIN r USING (doc_id, i) GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(s.text, '') END AS text,
  (SELECT count(*) FROM g WHERE g.doc_id = d.doc_id AND gone) AS removed_chunks, coalesce(s.removed, 0) AS removed_lines
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id
"""
