"""Periodic runs of words from Lyndon arrays by the grouping phase of a suffix sorter.

Grouping orders the suffixes of a text by their longest Lyndon prefixes, and
so gives each suffix's prefix length and which suffixes share a prefix. Under
an order of the words or its reverse, the Lyndon roots of a run are such
prefixes: equal ones that follow each other are extended by longest common
extensions to the run.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import WORD, read

#: Words and periods that a run has at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Code points of a text whose words are numbered in one step.
STEP = 1 << 20
#: Words joined at once for the digest of what is kept.
JOINED = 1 << 16
_WORD = re.compile(WORD)
_BLANK = re.compile(r"[\x20\x09-\x0D]")


def word_numbers(text: str) -> tuple[np.ndarray, list[str]]:
    """The words of a text as numbers in order of first occurrence, and the words themselves."""
    number: defaultdict[str, int] = defaultdict()
    number.default_factory = number.__len__
    out = array("i")
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + STEP)
        end = blank.start() if blank else len(text)
        out.extend(map(number.__getitem__, _WORD.findall(text, at, end)))
        at = end
    return np.frombuffer(out, np.int32).astype(np.int64), list(number)


def repeat_end(words: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The words with the periodic end that the contract gives to some ids; a null id has none."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    words = words.copy()
    words[a:] = words[a + np.arange(n - a) % p]
    return words


def group_suffixes(text: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Longest Lyndon prefix of each suffix: its length, and a number that equal prefixes share.

    Groups of suffixes with a common prefix, at first their letter, are taken
    from the greatest down. Each suffix of a group is what the nearest earlier
    suffix of a lower group goes on with; those that go on with more copies of
    the group's prefix move, behind those with fewer, into new groups right
    after their own. A group's prefix is final once it is taken.
    """
    n = len(text)
    order = array("i", sorted(range(n), key=text.__getitem__))
    place = array("i", bytes(4 * n))
    group = array("i", bytes(4 * n))  # where the suffix's group starts in order
    size = array("i", bytes(4 * n))
    length = array("i", bytes(4 * n))
    back = array("i", bytes(4 * n))
    start = 0
    for k in range(n):
        i = order[k]
        if text[i] != text[order[start]]:
            start = k
        place[i], group[i], length[start] = k, start, 1
        size[start] += 1
    last = n - 1
    while last >= 0:
        first = group[order[last]]
        members = sorted(order[first : last + 1]) if last > first else (order[first],)
        copies: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= first:
                j = back[j]
            back[i] = j
            if j >= 0:
                copies[j] = copies.get(j, 0) + 1
        if copies:
            by_copies: dict[int, dict[int, list[int]]] = {}
            for j, times in copies.items():
                by_copies.setdefault(times, {}).setdefault(group[j], []).append(j)
            grown = length[first]
            for times in sorted(by_copies, reverse=True):
                for g, moved in by_copies[times].items():
                    if len(moved) == size[g]:
                        # all that is left of the group: it stays where it is
                        length[g] += times * grown
                        continue
                    left = size[g] - len(moved)
                    end = g + size[g] - 1
                    for j in moved:
                        k, other = place[j], order[end]
                        order[k], order[end] = other, j
                        place[other], place[j] = k, end
                        end -= 1
                    new = g + left
                    size[new], length[new], size[g] = len(moved), length[g] + times * grown, left
                    for j in moved:
                        group[j] = new
        last = first - 1
    groups = np.frombuffer(group, np.int32).astype(np.int64)
    return np.frombuffer(length, np.int32).astype(np.int64)[groups], groups


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common prefix, in steps that double."""
    n, at, step = min(len(a), len(b)), 0, 16
    while at < n:
        differ = np.flatnonzero(a[at : at + step][: n - at] != b[at : at + step][: n - at])
        if len(differ):
            return at + int(differ[0])
        at += step
        step *= 2
    return n


def runs_of_part(words: np.ndarray) -> set[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of a part of a text."""
    found = set()
    _, ranks = np.unique(words, return_inverse=True)
    for letters in (ranks, ranks.max() - ranks):
        period, group = group_suffixes(letters.tolist())
        at = np.arange(len(words))
        # three roots in a row lie in every run of four periods; the first of them is taken
        for step in (period, 2 * period):
            at = at[at + step[at] < len(words)]
            at = at[group[at + step[at]] == group[at]]
        before = at - period[at]
        at = at[(before < 0) | (group[np.maximum(before, 0)] != group[at])]
        for i in at.tolist():
            p = int(period[i])
            start = i - _common(words[:i][::-1], words[: i + p][::-1])
            end = i + p + _common(words[i:], words[i + p :])
            if end - start >= max(LEAST_WORDS, LEAST_PERIODS * p):
                found.add((start, end - start, p))
    return found


def periodic_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of a text, by start, then period.

    Of a run of at least six words and four periods, every four words in a row
    occur again in the text. So the text is first cut where four words in a
    row occur once; no run passes such a place.
    """
    n = len(words)
    if n < LEAST_WORDS:
        return []
    pair = np.unique(words[:-1] * n + words[1:], return_inverse=True)[1]
    _, four, times = np.unique(pair[:-2] * n + pair[2:], return_inverse=True, return_counts=True)
    again = np.concatenate(([0], (times[four] > 1).view(np.int8), [0]))
    edge = np.diff(again)
    out: set[tuple[int, int, int]] = set()
    for start, end in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        if end + 3 - start >= LEAST_WORDS:
            out.update((start + s, length, p) for s, length, p in runs_of_part(words[start : end + 3]))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _digests(words: np.ndarray, vocabulary: list[str], runs: list[tuple[int, int, int]]) -> tuple[str, str]:
    """Digests of the runs and of the words that none of them drops."""
    listed, kept = hashlib.sha256(), hashlib.sha256()
    edges = np.zeros(len(words) + 1, np.int64)
    for s, length, p in runs:
        listed.update(f"{s},{length},{p}\n".encode())
        edges[s + p] += 1
        edges[s + length] -= 1
    rest = words[np.cumsum(edges[:-1]) == 0]
    for at in range(0, len(rest), JOINED):
        kept.update(((" " if at else "") + " ".join(map(vocabulary.__getitem__, rest[at : at + JOINED].tolist()))).encode())
    return listed.hexdigest(), kept.hexdigest()


_KINDS = {"n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}


def find_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256`` of every row.

    Words count from 0. The run named is the longest, of equally long ones the
    first, then the one of the smallest period; null without runs. With
    ``planted``, texts of some ids get the periodic end of ``repeat_end``
    first. A null text has no words; repeated rows are rows each, null ids
    too; other columns are left out; no rows give none. A text is one task's;
    of its words, only four bytes each and the parts that hold repeats are
    held as more than the text.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(*batch.columns, strict=True):
                words, vocabulary = word_numbers(text.as_py() or "")
                if planted:
                    words = repeat_end(words, doc_id.as_py())
                runs = periodic_runs(words)
                best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
                named = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                rows.append((len(runs), *named, *_digests(words, vocabulary, runs)))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *_KINDS])

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(go, schema)


def op11_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, periodic ends planted."""
    return find_runs(read(spark, sf_dir, "documents"), planted=True)
