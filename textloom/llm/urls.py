"""Verdicts on addresses by pattern rules that their rarest literal token indexes.

A rule is a pattern over host, path and query. Of the tokens that every
address it matches must hold, the one that fewest addresses of the corpus
hold is its key. An address looks its own tokens up and only the rules found
there run their regular expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import fresh, read

#: Rules whose index one pass over the addresses holds; more rules take more passes.
RULES_PER_PASS = 100_000
_TOKEN = re.compile("[a-z0-9]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_ADDRESS = re.compile(r"[^/?#]*")
_PATH = re.compile(r"[^?#]*")
_QUERY = re.compile(r"(?:\?[^#]*)?")
#: What ``^`` in a pattern stands for besides the end.
_PARTS = r"[^A-Za-z0-9_.%-]"


@dataclass(frozen=True)
class Rule:
    """One rule.

    ``site`` rules are ``host/path``: they fit that host and its subdomains if
    the path starts with the rule's, case counting in the path. Other rules are
    patterns in which ``*`` is any text, ``^`` a sign that parts words or the
    end, a last ``|`` the end, and a leading ``||`` the start of the host or of
    one of its labels; A-Z and a-z are one.
    """

    pattern: str
    verdict: str
    site: bool = False

    def regex(self, end: str = r"\Z") -> str:
        """The rule as a regular expression; ``end`` is the dialect's sign for the end of the text."""
        if self.site:
            return rf"\A(?:[^/?]*\.)?{re.escape(self.pattern)}"
        body, out = self.pattern, ""
        if body.startswith("||"):
            body, out = body[2:], r"\A(?:[^/?]*\.)?"
        last = body.endswith("|")
        for sign in body.removesuffix("|"):
            out += ".*" if sign == "*" else rf"(?:{_PARTS}|{end})" if sign == "^" else re.escape(sign)
        return out + (end if last else "")

    def tokens(self) -> list[str]:
        """Tokens that any address the rule matches holds, whole."""
        body = self.pattern.translate(_LOWER)
        front = self.site or body.startswith("||")
        body = body.removeprefix("||") if not self.site else body
        found = []
        for m in _TOKEN.finditer(body):
            left = body[m.start() - 1] not in "*" if m.start() else front
            right = body[m.end()] not in "*" if m.end() < len(body) else False
            if left and right:
                found.append(m[0])
        return found


#: Site rules of the registered query.
SITES = (
    Rule("org/", "allow", True),
    Rule("example.org/es/", "block", True),
    Rule("example.org/en/1", "block", True),
    Rule("com/fr/", "allow", True),
    Rule("com/de/", "block", True),
)
#: Pages that hold no article: forms, carts, search results, adverts and files that are no text.
PATTERNS = tuple(
    Rule(p, "block")
    for p in (
        "^login^ ^signin^ ^signup^ ^logout^ ^register^ ^password-reset^ ^wp-login.php^ ^wp-admin^ ^cart^ ^checkout^ ^basket^ ^cgi-bin^ ^feed| ^rss.xml| ^sitemap.xml| "
        "^print.php^ ^adserver^ ||ads.* ||adserver.* ||doubleclick.net^ ^sessionid= ^phpsessid= ^replytocom= "
        ".exe| .zip| .iso| .mp4| .jpg| .png| .gif| .css| .js| ^xxx^ ^porn^ ^casino^"
    ).split()
)


def parts_of(url: str | None) -> tuple[str, str, str]:
    """Host, path and query of an address; all empty for null or without ``://``."""
    begin = url.find("://") if url else -1
    if begin < 0:
        return "", "", ""
    host = _ADDRESS.match(url, begin + 3)
    path = _PATH.match(url, host.end())
    return host[0].translate(_LOWER), path[0], _QUERY.match(url, path.end())[0]


def _held(subject: str) -> set[str]:
    return set(_TOKEN.findall(subject.translate(_LOWER)))


class Index:
    """Rules by their rarest token; ``rest`` are those without one, which every address runs."""

    def __init__(self, rules: list[Rule], times: dict[str, int]):
        self.by_token: dict[str, list[tuple]] = {}
        self.rest: list[tuple] = []
        self.tried = 0
        for rule in rules:
            key = min(rule.tokens(), key=lambda t: (times.get(t, 0), t), default=None)
            # site rules over patterns, longer ones over shorter, block over allow
            entry = (rule.site, len(rule.pattern), rule.verdict == "block", rule.pattern), re.compile(rule.regex(), re.S | (0 if rule.site else re.I | re.A)), rule
            (self.rest if key is None else self.by_token.setdefault(key, [])).append(entry)

    def best(self, subject: str) -> tuple[tuple, Rule] | None:
        """The first of the matching rules in order of precedence, with its place in it."""
        found = None
        candidates = [self.rest] + [self.by_token[t] for t in _held(subject) if t in self.by_token]
        for place, regex, rule in (entry for entries in candidates for entry in entries):
            if found is None or place > found[0]:
                self.tried += 1
                if regex.search(subject):
                    found = place, rule
        return found


def token_times(urls: DataFrame, column: str, rules: list[Rule]) -> dict[str, int]:
    """How many addresses hold each token of the rules: as many numbers as the rules have tokens."""
    wanted = frozenset(t for rule in rules for t in rule.tokens())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = dict.fromkeys(wanted, 0)
        for batch in batches:
            for url in batch.column(0):
                for token in _held("".join(parts_of(url.as_py()))) & wanted:
                    times[token] += 1
        some = {t: n for t, n in times.items() if n}
        yield pa.RecordBatch.from_arrays([pa.array(list(some), pa.string()), pa.array(list(some.values()), pa.int64())], names=["token", "n"])

    counted = urls.select(F.col(column).cast("string")).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in counted.collect()}


def judge(pages: DataFrame, rules: Iterable[Rule], url_column: str = "url", per_pass: int = RULES_PER_PASS) -> DataFrame:
    """All columns of ``pages`` and ``host``, ``path``, ``rule``, ``pattern``, ``verdict``.

    ``rule`` is the longest site rule that fits; without one, ``pattern`` is
    the longest pattern that matches, and without that the page is allowed. Of
    equally long ones block precedes allow, then the later by code points.
    Nothing is shuffled: each pass carries the best rule so far. Null and
    odd addresses have empty parts, which no rule fits, and are allowed;
    repeated rows are judged alike; columns with the added names are replaced;
    no rows give none, no rules allow all.
    """
    added = ["host", "path", "rule", "pattern", "verdict"]
    pages = pages.drop(*added)
    rules = list(dict.fromkeys(rules))
    of_url = fresh("_url", pages.columns + added)
    out = pages.withColumn(of_url, F.col(url_column).cast("string")).withColumns({name: F.lit(None).cast("string") for name in added})
    for at in range(0, max(1, len(rules)), per_pass):
        part = rules[at : at + per_pass]
        index = Index(part, token_times(pages, url_column, part) if part else {})

        def go(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns: list[list] = [[] for _ in added]
                for url, rule, pattern, verdict in zip(*(batch.column(batch.schema.get_field_index(n)) for n in (of_url, "rule", "pattern", "verdict")), strict=True):
                    host, path, query = parts_of(url.as_py())
                    rule, pattern, verdict = rule.as_py(), pattern.as_py(), verdict.as_py()
                    found = index.best(host + path + query) if host or path or query else None
                    name = rule if rule is not None else pattern
                    if found and (name is None or found[0] > (rule is not None, len(name), verdict == "block", name)):
                        best = found[1]
                        rule, pattern, verdict = best.pattern if best.site else None, None if best.site else best.pattern, best.verdict
                    for values, value in zip(columns, (host, path, rule, pattern, verdict or "allow"), strict=True):
                        values.append(value)
                arrays = [pa.array(columns[added.index(f.name)], pa.string()) if f.name in added else batch.column(i) for i, f in enumerate(batch.schema)]
                yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

        out = out.mapInArrow(go, out.schema)
    return out.drop(of_url)


def op12_rare_token_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's address judged by the site rules and patterns."""
    return judge(read(spark, sf_dir, "pages").select("page_id", "url"), SITES + PATTERNS).select("page_id", "host", "path", "rule", "pattern", "verdict")


def _sql() -> str:
    """All rules against all addresses, without an index."""
    rows = ",\n  ".join(f"('{r.pattern}', '{r.verdict}', {str(r.site).lower()}, '{'(?s)' if r.site else '(?si)'}{r.regex(chr(92) + 'z')}')" for r in SITES + PATTERNS)
    return rf"""
WITH x(pattern, verdict, site, regex) AS (VALUES
  {rows}
), u AS (
  SELECT DISTINCT url, translate(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '(?s)\A.*?://[^?#]*(\?[^#]*)', 1) AS query
  FROM pages WHERE contains(url, '://')
), m AS (
  SELECT url, arg_max(x, (site, len(pattern), verdict = 'block', pattern)) AS x FROM u, x
  WHERE host || path || query <> '' AND regexp_matches(host || path || query, regex) GROUP BY url
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, CASE WHEN x.site THEN x.pattern END AS rule,
  CASE WHEN NOT x.site THEN x.pattern END AS pattern, coalesce(x.verdict, 'allow') AS verdict
FROM pages p LEFT JOIN u ON u.url = p.url LEFT JOIN m ON m.url = p.url
"""


OP12_SQL = _sql()
