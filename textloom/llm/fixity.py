"""Merkle fixity audit of replicas of WARC files.

Records are hashed, then ordered ranges of offsets, then ranges of files, up
to one root, and a second one for the files of records without an id. Where
two replicas' roots differ, only the branches that differ are followed down to
the damaged records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, read

#: Page ids of one WARC file, bytes of the least offset range, and children of a node.
IDS_PER_FILE, RANGE_BYTES, FAN_OUT = 1000, 1 << 16, 16
#: Hexadecimal digits of the digest that deal records without a page id over files -1, -2, ...
NO_ID_DIGITS = 3


def warc_record(url: Column, page_id: Column, body: Column) -> Column:
    """A response record as text: header lines, blank line, body, two line ends."""
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(">\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def warc_records(pages: DataFrame) -> DataFrame:
    """``file, offset, size, page_id, digest``: the records of ``page_id, url, html`` laid out in files.

    A file holds ``IDS_PER_FILE`` page ids in order; rows without an id are
    dealt by digest over 16^``NO_ID_DIGITS`` files with negative numbers; a
    null url or html is empty. Rows with one id follow by url, then digest;
    equal ones, in whatever order, give equal records at the same offsets. No
    pages give no records; other columns are left out.
    """
    record = warc_record(F.col("url"), F.col("page_id"), F.coalesce("html", F.lit("")))
    rows = pages.select("page_id", "url", F.sha2(record, 256).alias("digest"), F.octet_length(record).cast("long").alias("size"))
    dealt = -1 - F.conv(F.substring("digest", 1, NO_ID_DIGITS), 16, 10).cast("long")
    rows = rows.withColumn("file", F.coalesce(F.expr(f"floor(page_id / {IDS_PER_FILE})").cast("long"), dealt))
    end = F.expr("sum(size) OVER (PARTITION BY file ORDER BY page_id, url, digest ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    return rows.select("file", (end - F.col("size")).alias("offset"), "size", "page_id", "digest")


def _parents(level: int, ranges: int) -> tuple[Column, Column]:
    """Key of a level's nodes: file and offset range, above the ranges groups of files; negative files stay apart."""
    if level <= ranges:
        return F.col("file"), F.floor(F.col("place") / F.lit(RANGE_BYTES if level == 1 else FAN_OUT)).cast("long")
    return F.floor(F.col("file") / FAN_OUT).cast("long"), F.lit(0).cast("long")


def merkle_tree(records: DataFrame, ranges: int, groups: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """The levels of a replica's tree, leaves first: ``file, place, up_file, up_place, digest``.

    A node's digest covers its children's places and digests in order; each
    level is one grouping of at most ``FAN_OUT`` children, or of the records
    of a range. Of the records' columns only ``page_id`` may be null. No
    records give empty levels.
    """
    level = records.select("file", F.col("offset").alias("place"), "digest", "page_id")
    out = []
    for k in range(1, ranges + groups + 1):
        up_file, up_place = _parents(k, ranges)
        level = scratch.save(level.withColumns({"up_file": up_file, "up_place": up_place}), f"{name}{k}")
        out.append(level)
        text = F.array_join(F.transform(F.array_sort("children"), lambda c: F.concat_ws(":", c["file"].cast("string"), c["place"].cast("string"), c["digest"])), "\n")
        level = level.groupBy("up_file", "up_place").agg(F.collect_list(F.struct("file", "place", "digest")).alias("children")).select(F.col("up_file").alias("file"), F.col("up_place").alias("place"), F.sha2(text, 256).alias("digest"))
    out.append(scratch.save(level.withColumns({"up_file": F.lit(0).cast("long"), "up_place": F.lit(0).cast("long")}), f"{name}root"))
    return out


def audit(first: DataFrame, second: DataFrame, scratch: Scratch) -> DataFrame:
    """``file, offset, page_id, status, first_digest, second_digest`` of each record that differs.

    ``status``: ``changed``, or ``missing`` or ``extra`` in the second replica.
    Equal or empty replicas give no rows. Both replicas are read once; below
    the roots only children of differing nodes are compared.
    """
    sizes = first.select("file", "offset").union(second.select("file", "offset"))
    top_offset, low, high = sizes.agg(F.max("offset"), F.min("file"), F.max("file")).first()
    ranges, groups = 1, 0
    while top_offset and RANGE_BYTES * FAN_OUT ** (ranges - 1) <= top_offset:
        ranges += 1
    # two roots at most: -1 above the negative files, 0 above the others
    while high is not None and low != high and (low, high) != (-1, 0):
        low, high = low // FAN_OUT, high // FAN_OUT
        groups += 1
    trees = [merkle_tree(records, ranges, groups, scratch, name) for records, name in ((first, "a"), (second, "b"))]
    suspects = None
    for k in range(ranges + groups, -1, -1):
        sides = []
        for tree in trees:
            side = tree[k]
            if suspects is not None:
                side = side.join(suspects, ["up_file", "up_place"], "left_semi")
            sides.append(side)
        a, b = (s.alias(n) for s, n in zip(sides, "ab", strict=True))
        same_place = (F.col("a.file") == F.col("b.file")) & (F.col("a.place") == F.col("b.place"))
        met = a.join(b, same_place, "full").where(~F.col("a.digest").eqNullSafe(F.col("b.digest")))
        if k:
            found = met.select(F.coalesce("a.file", "b.file").alias("up_file"), F.coalesce("a.place", "b.place").alias("up_place"))
            suspects = scratch.save(found.distinct(), f"suspects{k}")
    status = F.when(F.col("b.digest").isNull(), "missing").when(F.col("a.digest").isNull(), "extra").otherwise("changed")
    return met.select(
        F.coalesce("a.file", "b.file").alias("file"),
        F.coalesce("a.place", "b.place").alias("offset"),
        F.coalesce("a.page_id", "b.page_id").alias("page_id"),
        status.alias("status"),
        F.col("a.digest").alias("first_digest"),
        F.col("b.digest").alias("second_digest"),
    )


def damaged(pages: DataFrame, records: DataFrame) -> DataFrame:
    """A second replica's records as a bad disk would give them, by the hash of the page id.

    One record in 256 has its body's first character overwritten, one is
    lost, and one stands twice, a byte further on. Rows without an id are
    never overwritten and otherwise share the fate of an empty one. Rows of
    one id that repeats are told apart by no more than their place, so each
    is overwritten by each. No pages give no records.
    """
    fate = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 1, 2)
    body = F.coalesce("html", F.lit(""))
    hurt = pages.where(fate == "00").select(F.col("page_id").alias("hurt_id"), F.sha2(warc_record(F.col("url"), F.col("page_id"), F.concat(F.lit("#"), F.substring(body, 2, 2**31 - 1))), 256).alias("hurt"))
    kept = records.where(fate != "01").join(hurt, F.col("page_id") == F.col("hurt_id"), "left")
    kept = kept.select("file", "offset", "size", "page_id", F.coalesce("hurt", "digest").alias("digest"))
    twice = records.where(fate == "02").select("file", (F.col("offset") + 1).alias("offset"), "size", "page_id", "digest")
    return kept.union(twice)


def op5_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the WARC files of all pages against a damaged replica."""
    scratch = Scratch(spark, "op5")
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    records = scratch.save(warc_records(pages), "records")
    return audit(records, scratch.save(damaged(pages, records), "replica"), scratch)


OP5_SQL = r"""
WITH r AS (
  SELECT page_id, url, coalesce(html, '') AS html, substr(md5(coalesce(CAST(page_id AS VARCHAR), '')), 1, 2) AS fate,
    CAST(floor(page_id / 1000) AS BIGINT) AS id_file FROM pages
), t AS (
  SELECT *, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
    || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), 'none') || '>' || chr(13) || chr(10) || 'Content-Length: ' AS head,
    chr(13) || chr(10) || chr(13) || chr(10) AS gap FROM r
), d AS (
  SELECT *, head || CAST(octet_length(encode(html)) AS VARCHAR) || gap || html || gap AS rec,
    head || CAST(octet_length(encode('#' || substr(html, 2))) AS VARCHAR) || gap || '#' || substr(html, 2) || gap AS hurt FROM t
), f AS (
  SELECT *, sha256(rec) AS digest, coalesce(id_file, -1 - CAST('0x' || substr(sha256(rec), 1, 3) AS BIGINT)) AS file FROM d
), o AS (
  SELECT *,
    CAST(sum(octet_length(encode(rec))) OVER (PARTITION BY file ORDER BY page_id, url ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - octet_length(encode(rec)) AS BIGINT) AS o
  FROM f
)
SELECT file, o AS "offset", page_id, 'changed' AS status, digest AS first_digest, sha256(hurt) AS second_digest FROM o WHERE fate = '00' AND hurt <> rec
UNION ALL SELECT file, o, page_id, 'missing', digest, NULL FROM o WHERE fate = '01'
UNION ALL SELECT file, o + 1, page_id, 'extra', NULL, digest FROM o WHERE fate = '02'
"""
