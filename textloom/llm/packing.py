"""Shortest-pack-first packing of token sequences over the length histogram."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, read

MAX_LEN = 1024
#: Ends each document.
END_ID = 0
#: Pieces of one length that one window task ranks, about.
ROWS_PER_RANK_TASK = 200_000
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: The tokenizer's split pattern without its look-ahead, which needs a stack as
#: deep as a blank run is long. With it, a run of blanks before a word leaves its
#: last blank to the word; texts are cut there first, so both split alike.
_SIMPLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
# The characters of Unicode's White_Space property.
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(f"[{_BLANK}](?=[{_BLANK}][^{_BLANK}])")


def _encoder(tokenizer: str):
    """Encode one text to its ids, as the ``tokenizers`` file of the same vocabulary does."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(tokenizer.replace(".json", ".tiktoken")), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    simple = tiktoken.Encoding("simple", pat_str=_SIMPLE, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def plain(text: str) -> list[int]:
        ids, at = [], 0
        for m in _CUT.finditer(text):
            ids += simple(text[at : m.end()])
            at = m.end()
        return ids + simple(text[at:]) if at else simple(text)

    def encode(text: str) -> list[int]:
        if SPECIAL not in text:
            return plain(text)
        head, *rest = text.split(SPECIAL)
        ids = plain(head)
        for part in rest:
            ids.append(SPECIAL_ID)
            ids += plain(part)
        return ids

    return encode


def cut_documents(docs: DataFrame, max_len: int = MAX_LEN, tokenizer: str = "byte_bpe_50k.json", keep_ids: bool = False) -> DataFrame:
    """Tokenize ``doc_id, text`` and cut each document into pieces of at most ``max_len`` ids.

    Each document ends with ``END_ID``, so a null or empty text is one piece of
    one id. Returns ``doc_id, start, length, ids_crc32, doc_tokens`` and, if
    asked for, ``ids``; the checksum is of the ids as little-endian unsigned
    32-bit numbers.
    """
    kind = dict(docs.dtypes)["doc_id"]

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            owners: list[int] = []
            for i, text in enumerate(batch.column(1)):
                # four bytes an id, and none of them held once they are counted
                ids = array("I", encode(text.as_py() or ""))
                ids.append(END_ID)
                for start in range(0, len(ids), max_len):
                    piece = ids[start : start + max_len]
                    owners.append(i)
                    rows.append((start, len(piece), zlib.crc32(piece), len(ids), piece if keep_ids else None))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            arrays = [batch.column(0).take(pa.array(owners, pa.int64())), *(pa.array(x, pa.int64()) for x in columns[:4])]
            if keep_ids:
                arrays.append(pa.array([list(x) for x in columns[4]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def packing_patterns(histogram: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, int, int, int, int]]:
    """Place lengths, longest first, into the shortest open pack, counting packs by pattern.

    Returns intervals ``(length, first_rank, count, first_sequence, offset)``:
    of the pieces of that length, those with ranks from ``first_rank`` go one
    each to the sequences from ``first_sequence``, at ``offset``. The result
    depends on the histogram alone and is bounded by ``max_len``, not by rows.
    """
    # groups of packs alike: free space -> list of [packs, parts], parts a linked list (rest, length, offset)
    groups: dict[int, list[list]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for space in range(max_len, length - 1, -1):
            while left and groups.get(space):
                packs, parts = groups[space].pop()
                used = min(left, packs)
                if used < packs:
                    groups[space].append([packs - used, parts])
                groups.setdefault(space - length, []).append([used, (parts, length, max_len - space)])
                left -= used
            if not left:
                break
        # fresh packs take as many as they hold, the last one what remains
        most = max_len // length
        for packs, each in ((left // most, most), (1, left % most)):
            if packs and each:
                parts = None
                for k in range(each):
                    parts = (parts, length, k * length)
                groups.setdefault(max_len - each * length, []).append([packs, parts])
    intervals, ranks, sequence = [], dict.fromkeys(histogram, 0), 0
    for space in sorted(groups):
        for packs, parts in groups[space]:
            while parts:
                parts, length, offset = parts
                intervals.append((length, ranks[length], packs, sequence, offset))
                ranks[length] += packs
            sequence += packs
    return intervals


def rank_within_length(pieces: DataFrame, rows_per_task: int = ROWS_PER_RANK_TASK) -> DataFrame:
    """Add ``rank``, from 0 within each length, without a task that sees a whole length."""
    salts = max(1, -(-pieces.count() // rows_per_task))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("length", "salt").count()
    offsets = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1)
    return ranked.join(offsets, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).drop("salt", "before")


def pack(pieces: DataFrame, max_len: int = MAX_LEN, rows_per_task: int = ROWS_PER_RANK_TASK) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``doc_id, start, length, ids_crc32``.

    Only the histogram (at most ``max_len`` rows) comes to the driver. Equal
    pieces are interchangeable; no pieces give no sequences.
    """
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    table = packing_patterns(histogram, max_len)
    by_length = {}
    for length in histogram:
        rows = sorted(x[1:] for x in table if x[0] == length)
        by_length[length] = tuple(np.array(c, np.int64) for c in zip(*rows, strict=True))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        lengths, ranks = lengths.to_numpy(), ranks.to_numpy()
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            first, _, start, off = by_length[length]
            k = np.searchsorted(first, ranks[at], side="right") - 1
            sequence[at], offset[at] = start[k] + ranks[at] - first[k], off[k]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    ranked = rank_within_length(pieces, rows_per_task)
    return ranked.withColumn("at", place("length", "rank")).select(*pieces.columns, "at.sequence_id", "at.offset")


def pack_documents(docs: DataFrame, scratch: Scratch, max_len: int = MAX_LEN) -> DataFrame:
    """Tokenize, cut and pack whole documents.

    Null and empty texts are one piece of one id, rows of one id are packed
    each by itself, other columns are left out, and no rows give no pieces.
    """
    return pack(scratch.save(cut_documents(docs, max_len), "pieces"), max_len)


def op4_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return pack_documents(read(spark, sf_dir, "documents"), Scratch(spark, "op4"))
