"""Text functions as Spark columns."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"([\p{L}\p{N}_]+)"
# The abbreviations that do not end a sentence.
ABBREVIATIONS = ("bkz.", "doç.", "dr.", "hz.", "no.", "örn.", "prof.", "s.", "sf.", "sn.", "vb.", "vd.", "vs.", "yrd.")
# Media types by file extension.
MEDIA_TYPES = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "txt": "text/plain"}
_LETTERS = range(sys.maxunicode + 1)
#: Lower-case characters that full case folding changes further.
FOLDED = {c: f for c in map(chr, _LETTERS) if c == c.lower() and (f := c.casefold()) != c}
_ONE = {c: f for c, f in FOLDED.items() if len(f) == 1}
_MANY = {c: f for c, f in FOLDED.items() if len(f) > 1}


#: No character below U+0300 and none of the common punctuation changes under NFC.
MAYBE_NOT_NFC = r"[\x{300}-\x{200f}\x{2028}-\x{10ffff}]"


def _covering(chars: Iterable[str], gap: int = 64) -> str:
    """A character class of few ranges, which Java tests fast, that covers ``chars``."""
    ranges: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if ranges and c - ranges[-1][1] <= gap:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in ranges) + "]"


_MAYBE_ONE, _MAYBE_MANY = _covering(_ONE), _covering(_MANY.keys() - {"ß"})
#: Covers both, and is tested faster still; no letter of Turkish is among them.
_MAYBE_EITHER = "[µŉ\\x{160}-\\x{10ffff}]"


def nfc(df: DataFrame, column: str) -> DataFrame:
    """Compose ``column`` canonically; only rows that may need it go through Python."""

    def compose(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFC", t))

    maybe = F.coalesce(F.col(column).rlike(MAYBE_NOT_NFC), F.lit(False))
    return df.where(~maybe).unionByName(df.where(maybe).withColumn(column, F.pandas_udf(compose, "string")(column)))


#: Control characters and blanks that ``normalize_text`` changes, and whatever else may be one; common punctuation is left out.
_MAYBE_ODD = r"[\x00-\x09\x0b-\x1f\x7f-\xa0\xad\x{378}-\x{200f}\x{2028}-\x{10ffff}]"


def normalize_text(text: Column) -> Column:
    """One kind of line end and blank, no control characters, stripped lines and text. Expects NFC."""
    # most texts are normal already, and looking is many times cheaper than replacing
    doubled = (F.contains(text, F.lit(s)) for s in ("  ", " \n", "\n "))
    ends = (f(text, F.lit(s)) for f in (F.startswith, F.endswith) for s in (" ", "\n"))
    changes = reduce(Column.__or__, (*doubled, *ends, text.rlike(_MAYBE_ODD)))
    return F.when(changes, _normalized(text)).otherwise(text)


def _normalized(text: Column) -> Column:
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[\p{C}&&[^\n]]", " ")
    # single spaces, nearly all blanks, are left alone
    text = F.regexp_replace(text, r"(?U)[^\S\n ][^\S\n]*+| [^\S\n]++", " ")
    text = F.regexp_replace(text, r" (?:(?<![^\n] )|(?![^\n]))", "")
    return F.regexp_replace(text, r"^\n+|\n+$", "")


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(text: Column) -> Column:
    """Turkish case folding: dotted and dotless i, then full case folding."""
    low = F.lower(F.replace(F.replace(text, F.lit("I"), F.lit("ı")), F.lit("İ"), F.lit("i")))
    # the only frequent letter that becomes two
    low = F.replace(low, F.lit("ß"), F.lit("ss"))
    longer = F.create_map(*(F.lit(x) for pair in _MANY.items() for x in pair))

    def full(t: Column) -> Column:
        return F.array_join(F.transform(F.split(t, ""), lambda c: F.coalesce(longer[c], c)), "")

    def further(t: Column) -> Column:
        one = F.when(t.rlike(_MAYBE_ONE), F.translate(t, "".join(_ONE), "".join(_ONE.values()))).otherwise(t)
        return _once(one, lambda t: F.when(t.rlike(_MAYBE_MANY), full(t)).otherwise(t))

    # few texts hold what lower case leaves to fold; the rest is only looked through
    return _once(low, lambda t: F.when(t.rlike(_MAYBE_EITHER), further(t)).otherwise(t))


def words(text: Column) -> Column:
    """Words of the folded text, in order."""
    return F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(1))


def ngrams(items: Column, low: int, high: int) -> Column:
    """All runs of ``low`` to ``high`` items, joined by U+0001, by size, then place."""
    def runs(w: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - n + 1)
        return F.when(F.size(w) >= n, F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), "\x01"))).otherwise(F.array().cast("array<string>"))

    return _once(items, lambda w: F.concat(*(runs(w, n) for n in range(low, high + 1))))


def char_stream(text: Column) -> Column:
    """The folded text with one space between words."""
    return F.trim(F.regexp_replace(fold(text), r"[^\p{L}\p{N}_]+", " "))


def char_ngrams(stream: Column, low: int, high: int) -> Column:
    """All windows of ``low`` to ``high`` code points, spaces included."""
    def runs(t: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(t) - n + 1)
        return F.when(F.length(t) >= n, F.transform(starts, lambda i: F.substr(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return _once(stream, lambda t: F.concat(*(runs(t, n) for n in range(low, high + 1))))


#: Zero-width place after a sentence end that no abbreviation explains; what few places meet is tested first.
SENTENCE_END = r"(?iU)(?<=[.!?…])(?=\s|$)(?<!(?:^|\s)(?:" + "|".join(re.escape(a[:-1]) for a in ABBREVIATIONS) + r"|[\p{L}&&[^İßẞŉǰΐΰևẖẗẘẙẚ]])\.)"


def sentence_pieces(text: Column) -> Column:
    """The text cut after sentence and line ends; the pieces join to the text again."""
    return F.split(F.regexp_replace(text, SENTENCE_END, "\x01"), r"\x01|(?<=\n)")


#: The characters of Unicode's White_Space property, as the patterns' blanks.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def token_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(1))).cast("long")


def token_runs(text: Column) -> Column:
    """Words and what stands between them, in order."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)"), F.lit(1))


def text_slice(content: Column, chunk_start: Column, start: Column, end: Column) -> Column:
    """Evidence text by offsets of the whole document."""
    return F.substr(content, (start - chunk_start + 1).cast("int"), (end - start).cast("int"))


def score_round(score: Column) -> Column:
    """Four decimals, half to even."""
    return F.bround(score.cast("decimal(38,18)"), 4).cast("decimal(5,4)")


def score_level(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")


def percent_label(score: Column) -> Column:
    """A share as percent with at most one decimal."""
    return F.concat(F.regexp_replace(F.format_string("%.1f", F.round(score.cast("double") * 100, 1)), r"\.0$", ""), F.lit("%"))


def clean_filename(name: Column, longest: int = 255) -> Column:
    """The last path leaf without control characters, at most ``longest`` characters, keeping the suffix. Expects NFC."""
    leaf = F.trim(F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"\p{C}", ""))
    suffix = F.regexp_extract(leaf, r"[^.](\.[^.]+)$", 1)
    kept = F.concat(F.substr(leaf, F.lit(1), F.greatest(F.lit(0), F.lit(longest) - F.length(suffix))), suffix)
    return F.when(F.length(leaf) <= longest, leaf).otherwise(F.substr(kept, F.lit(1), F.lit(longest)))


def media_type(content_type: Column) -> Column:
    """Type before the parameters, lower case."""
    return F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))


def safe_url(url: Column) -> Column:
    """The address if it is http or https, else null."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    return F.when(scheme.isin("http", "https"), url)


def retry_bound(attempt: Column, factor: int = 10, most: int = 120) -> Column:
    """Seconds that a retry waits at most: doubled each time, up to a limit."""
    return F.least(F.lit(float(factor)) * F.pow(F.lit(2.0), attempt - 1), F.lit(float(most)))


def quota_key(salt: str, identity: Column, window: Column) -> Column:
    """Digest of an identity in one quota window."""
    return F.sha2(F.concat_ws(":", F.lit(salt), identity.cast("string"), window.cast("string")), 256)


def local_date(ts: Column, zone: str = "Europe/Istanbul", missing: str = "-") -> Column:
    return F.coalesce(F.date_format(F.from_utc_timestamp(ts, zone), "dd.MM.yyyy HH:mm"), F.lit(missing))
