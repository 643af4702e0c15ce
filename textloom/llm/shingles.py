"""Sets of word shingles as sorted 64-bit fingerprints, whole batches at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step takes, about.
CHUNK = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _steps(buf: np.ndarray, blank: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``CHUNK`` bytes that cut no word: a longer word is a range of its own."""
    at = 0
    while at < len(buf):
        end = min(at + CHUNK, len(buf))
        gaps = np.flatnonzero(blank[buf[at:end]])
        if len(gaps):
            end = at + int(gaps[-1]) + 1
        else:
            # nothing but the beginning of a long word
            while end < len(buf) and not len(gaps := np.flatnonzero(blank[buf[end : end + CHUNK]])):
                end = min(end + CHUNK, len(buf))
            end += int(gaps[0]) if len(gaps) else 0
        yield at, end
        at = end


def _long_word(word: np.ndarray) -> np.uint64:
    """What ``_word_values`` gives a word, ``CHUNK`` bytes at a time."""
    total, scale = np.uint64(0), np.uint64(1)
    power = np.full(min(CHUNK, len(word)), _BASE)
    power[0] = 1
    power = np.cumprod(power)
    with np.errstate(over="ignore"):
        for at in range(0, len(word), CHUNK):
            piece = word[at : at + CHUNK].astype(np.uint64) + np.uint64(1)
            total += scale * (piece * power[: len(piece)]).sum()
            scale *= power[-1] * _BASE
    return total


def _word_values(buf: np.ndarray, blank: np.ndarray, beginnings: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Start, size and polynomial of each word, and those of the first bytes of all."""
    solid = ~blank[buf]
    edge = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = end - start
    if not len(start):
        return start, size, [np.zeros(0, np.uint64)] * (1 + len(beginnings))
    if len(buf) > CHUNK:
        head = buf[: max(beginnings, default=0)]
        return start, size, [np.array([_long_word(x)], np.uint64) for x in (buf, *(head[:n] for n in beginnings))]
    at = np.flatnonzero(solid)
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    power = np.ones(int(size.max()), np.uint64)
    power[1:] = _BASE
    power = np.cumprod(power)
    place = np.arange(len(at)) - np.repeat(first, size)
    value = (buf[at].astype(np.uint64) + np.uint64(1)) * power[place]
    return start, size, [np.add.reduceat(value if n is None else np.where(place < n, value, np.uint64(0)), first) for n in (None, *beginnings)]


def word_hashes(texts: list[bytes], blank: np.ndarray = _BLANK, beginnings: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and text number of each word, A-Z lowered, in order.

    ``blank``: which bytes part words. After the words follow, for each length
    in ``beginnings``, the first bytes of the words that are longer. Of a very
    long text only its bytes and its words' fingerprints are held whole.
    """
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    hashes, owners = ([[np.zeros(0, t)] for _ in range(1 + len(beginnings))] for t in (np.uint64, np.int64))
    for low, high in _steps(buf, blank):
        start, size, values = _word_values(_LOWER[buf[low:high]], blank, beginnings)
        owner = np.searchsorted(ends, start + low, side="right")
        for k, (n, value) in enumerate(zip((0, *beginnings), values, strict=True)):
            longer = size > n
            hashes[k].append(scramble(value[longer] + np.uint64(n)))
            owners[k].append(owner[longer])
    return np.concatenate(sum(hashes, [])), np.concatenate(sum(owners, []))


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: fingerprints and text numbers, by text, then by fingerprint.

    A text with fewer words is one shingle; one without words has none.
    """
    hashes, owner = word_hashes(texts)
    if not len(hashes):
        return hashes, owner
    grams, whose = [], []
    if len(hashes) >= words:
        last = len(hashes) - words + 1
        same = owner[:last] == owner[words - 1 :]
        gram = np.zeros(last, np.uint64)
        for k in range(words):
            gram = gram * _BASE + hashes[k : last + k]
        grams.append(gram[same])
        whose.append(owner[:last][same])
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    for i in np.flatnonzero((count > 0) & (count < words)):
        gram = np.uint64(0)
        with np.errstate(over="ignore"):
            for h in hashes[first[i] : first[i] + count[i]]:
                gram = gram * _BASE + h
        grams.append(np.array([gram], np.uint64))
        whose.append(np.array([i]))
    gram, text = scramble(np.concatenate(grams)), np.concatenate(whose)
    order = np.lexsort((gram, text))
    gram, text = gram[order], text[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])
    return gram[new], text[new]


def chunks(batch: pa.RecordBatch, text_column: int) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``CHUNK`` bytes with the number of the first; nulls are empty."""
    start, size, out = 0, 0, []
    for i, text in enumerate(batch.column(text_column).cast(pa.binary())):
        value = text.as_py() or b""
        out.append(value)
        size += len(value)
        if size >= CHUNK:
            yield start, out
            start, size, out = i + 1, 0, []
    if out:
        yield start, out
