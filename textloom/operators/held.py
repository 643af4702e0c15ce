"""Which texts hold enough grams of another side to meet any of its texts, told from hashes in Arrow batches.

The other side's grams are bits of one map of fixed size. A gram whose bit is
not set is not on that side; one that only shares a bit lets a text pass that
a later join drops. So the map saves work and never loses a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the map: 2 MB, whatever the other side's size.
BITS = 1 << 24
#: Bytes of text that are hashed at a time; a text longer than that passes as it is.
STEP = 4 << 20
MAP = "place long, bits long"


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _grams(streams: pa.Array, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Row number and 64-bit hash of every gram of ``low`` to ``high`` words of texts with one space between words."""
    cut = pc.split_pattern(streams, " ")
    row = np.repeat(np.arange(len(streams)), pc.list_value_length(cut).to_numpy(zero_copy_only=False))
    coded = cut.flatten().dictionary_encode()
    word = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)[coded.indices.to_numpy(zero_copy_only=False)]
    rows, names, name = [], [], word
    for n in range(1, high + 1):
        if n > 1:
            name = _mixed(name[:-1], word[n - 1 :]) if len(name) > 1 else name[:0]
        if n >= low:
            whole = row[: len(name)] == row[n - 1 : n - 1 + len(name)]
            rows.append(row[: len(name)][whole])
            names.append(name[whole])
    return np.concatenate(rows), np.concatenate(names)


def _steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of about ``STEP`` bytes of its text; a longer text is a piece of its own."""
    size = np.cumsum(pc.binary_length(batch.column("stream")).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + STEP, "right")))
        yield batch.slice(at, end - at)
        at = end


def gram_map(streams: DataFrame, low: int, high: int) -> DataFrame:
    """``place, bits``: the map of all grams of ``stream`` rows, 64 bits a row. Maps of parts are merged by ``merged``."""

    def mark(batches):
        for batch in batches:
            for step in _steps(batch):
                cell = np.unique(_grams(step.column("stream"), low, high)[1] & np.uint64(BITS - 1))
                if len(cell):
                    place, first = np.unique(cell >> np.uint64(6), return_index=True)
                    bits = np.bitwise_or.reduceat(np.uint64(1) << (cell & np.uint64(63)), first)
                    yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int64)), pa.array(bits.view(np.int64))], ["place", "bits"])

    return merged(streams.select("stream").mapInArrow(mark, MAP))


def merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy("place").agg(F.bit_or("bits").alias("bits"))


def likely(texts: DataFrame, held: DataFrame, low: int, high: int, share: float, squares: bool = True) -> DataFrame:
    """Rows with a ``stream`` of which grams in the map ``held`` have at least ``share`` of all: of the sum of squared counts, or of the distinct grams."""
    known = held.toArrow()
    bits = np.zeros(BITS >> 6, np.uint64)
    bits[known.column("place").to_numpy()] = known.column("bits").to_numpy().view(np.uint64)
    sent = texts.sparkSession.sparkContext.broadcast(bits.view(np.uint8))  # BITS bits

    def passes(streams: pa.Array) -> np.ndarray:
        row, name = _grams(streams, low, high)
        order = np.lexsort((name, row))
        row, name = row[order], name[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (name[1:] != name[:-1])
        first = np.flatnonzero(new)
        weight = np.diff(np.append(first, len(row))).astype(float) ** 2 if squares else np.ones(len(first))
        row, cell = row[first], (name[first] & np.uint64(BITS - 1)).astype(np.int64)
        there = (sent.value[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1
        total, part = (np.bincount(row, w, len(streams)) for w in (weight, weight * there))
        return (part > 0) & (part >= share * total * (1 - 1e-9))

    def go(batches):
        for batch in batches:
            for step in _steps(batch):
                longer = step.num_rows == 1 and pc.binary_length(step.column("stream"))[0].as_py() > STEP
                yield step if longer else step.filter(pa.array(passes(step.column("stream"))))

    return texts.mapInArrow(go, texts.schema)


def _exact_grams(sides: tuple[pa.Array, ...], low: int, high: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], bool]:
    """As ``_grams`` for several columns of texts, by numbers that equal grams alone share; and whether 64 bits suffice for them."""
    cut = [pc.split_pattern(x, " ") for x in sides]
    coded = pa.concat_arrays([c.flatten() for c in cut]).dictionary_encode()
    base = len(coded.dictionary) + 1
    if base**high >= 1 << 63:
        return [], False
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    out, at = [], 0
    for c in cut:
        length = pc.list_value_length(c).to_numpy(zero_copy_only=False)
        row, word = np.repeat(np.arange(len(c)), length), codes[at : at + length.sum()]
        at += len(word)
        rows, names, name = [], [], word
        for n in range(1, high + 1):
            if n > 1:
                # without a zero digit, numbers of unlike lengths differ
                name = name[:-1] * base + word[n - 1 :]
            if n >= low:
                whole = row[: len(name)] == row[n - 1 : n - 1 + len(name)]
                rows.append(row[: len(name)][whole])
                names.append(name[whole])
        out.append((np.concatenate(rows), np.concatenate(names)))
    return out, True


def reaching(pairs: DataFrame, low: int, high: int, k2: float, least: float) -> DataFrame:
    """``l, r`` of rows ``l, r, ls, rs`` (ids and streams) whose pair-fitted cosine of grams is ``least`` or more but for rounding.

    Longer texts than ``STEP``, and batches whose grams no 64-bit number tells
    apart, pass as they are.
    """

    def passes(left: pa.Array, right: pa.Array) -> np.ndarray:
        grams, fits = _exact_grams((left, right), low, high)
        if not fits:
            return np.ones(len(left), bool)
        row, name = (np.concatenate(x) for x in zip(*grams, strict=True))
        if not len(row):
            return np.zeros(len(left), bool)
        mine = np.arange(len(row)) < len(grams[0][0])
        order = np.lexsort((name, row))
        row, name, mine = row[order], name[order], mine[order]
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (name[1:] != name[:-1])))
        ta, tb = (np.add.reduceat(x.astype(float), first) for x in (mine, ~mine))
        row, both = row[first], (ta > 0) & (tb > 0)
        na, nb, sa, sb, dot = (np.bincount(row, w, len(left)) for w in (ta * ta, tb * tb, ta * ta * both, tb * tb * both, ta * tb))
        norm = (k2 * na - (k2 - 1) * sa) * (k2 * nb - (k2 - 1) * sb)
        return (dot > 0) & (dot * dot >= least * least * norm * (1 - 1e-9))

    def go(batches):
        for batch in batches:
            size = [pc.binary_length(batch.column(name)).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("ls", "rs")]
            ends, at = np.cumsum(size[0] + size[1]), 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right")))
                step = batch.slice(at, end - at)
                if end > at + 1 or ends[at] - (ends[at - 1] if at else 0) <= STEP:
                    step = step.filter(pa.array(passes(step.column("ls"), step.column("rs"))))
                yield step.select(["l", "r"])
                at = end

    kinds = dict(pairs.dtypes)
    return pairs.select("l", "r", "ls", "rs").mapInArrow(go, f"l {kinds['l']}, r {kinds['r']}")
