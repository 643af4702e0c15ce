"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes a row of text blocks. A linear classifier of a block's own
marks gives the costs of calling it content or boilerplate, which are the
capacities to the two terminals; neighbouring blocks and blocks close in the
element tree are tied by smoothness edges. The minimum cut of that graph is
the cheapest labelling.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import read

# Element names of HTML.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
UNSEEN = frozenset("head script style noscript template iframe svg math canvas object audio video textarea select button option title noembed noframes xmp".split())
#: Elements that an opening block of the same kind closes.
SELF_CLOSING = {"p": "p", "li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "td", "th": "td", "option": "option"}
BOILERPLATE = frozenset("nav footer aside fieldset menu dialog".split())
CONTENT = frozenset("article main".split())


def _parts(names: str) -> re.Pattern:
    """Matches class and id names, or hyphenated parts of them; a whole name alone, too."""
    return re.compile(rf"(?:^|[\s_-])(?:{'|'.join(names.split())})(?:$|[\s_-])", re.I)


#: Names that boilerplate has, and those that articles have too. As one part of a hyphenated name the first say less.
STRONG = _parts(
    "ads? adverts? advertisement advertising banner sponsor(?:ed)? promo nav navbar navigation menu breadcrumbs? footer (?:site|page|global|top)-?header masthead topbar sidebar aside "
    "cookies? consent gdpr notice popup modal newsletter subscribe subscription signup share sharing related recommended comments? commentlist disqus replies respond pagination pager toolbar copyright"
)
WEAK = _parts("side rail widget alert overlay login social follow recommendations trending popular reply discussion search legal disclaimer hidden")
READERS = _parts("comments? commentlist disqus replies respond discussion")
GOOD = _parts("article content main post entry story body text")
#: Class names of a page's state or subject, which say nothing of the element: has-sidebar, comments-open, tag-popular.
STATE = re.compile(r"(?<![\w-])(?:(?:has|have|with|without|no|not|is|tag|category|format|type|status)[_-][\w-]*|[\w-]*[_-](?:open|opened|closed|enabled|disabled|on|off))(?![\w-])", re.I)
SEVERITY = ("", "weak", "part", "strong")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())

#: Log-odds of content over boilerplate that each mark of a block adds. What a
#: text says of itself is worth up to 6, so structure decides clear cases and
#: the rest is left to the text and its neighbours.
WEIGHTS = {"bias": 0.2, "article": 3.0, "outside": -3.0, "good": 0.8, "boilerplate": -16.0, "strong": -16.0, "part": -13.0, "weak": -8.0, "page_header": -12.0, "links": -4.0, "words": 0.9, "stops": 0.6, "heading": 1.0, "paragraph": 0.8, "rights": -4.0}
#: Capacity of the edge between neighbours with one parent; it halves with every two steps more in the tree.
SMOOTH = 2.0
#: Blocks up to which a block is tied to later ones of the same parent.
REACH = 3
#: Characters that an article has at least.
LEAST_ARTICLE = 140
_SCALE = 1000

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_BARE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?")
_TELLING = re.compile("class|id|role|style|hidden", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in RAW}
_BLANKS = re.compile(r"\s+")
_STOP = re.compile(r"[.!?…](?:\s|$)")
_RIGHTS = re.compile(r"\s*(?:©|\(c\)\s|copyright\b)|.{0,200}\ball rights reserved\b", re.I | re.S)


class _Element:
    """An open element with all that its ancestors pass on to it.

    ``block`` is its innermost block element, ``up`` the one around that,
    ``depth`` the number of open ones; ``hint`` is the number of the innermost
    element with a name of boilerplate.
    """

    __slots__ = ("article", "bad", "block", "depth", "good", "header", "hint", "link", "name", "readers", "unseen", "up")

    def __init__(self, name: str, above: _Element | None):
        self.name, self.block, self.up, self.depth, self.hint = name, self, None, 0, 0
        self.article, self.bad, self.good, self.header, self.unseen, self.link, self.readers = name in CONTENT, name in BOILERPLATE, False, False, name in UNSEEN, name == "a", False
        if above:
            if name in INLINE:
                self.block, self.up, self.depth = above.block, above.up, above.depth
            else:
                self.up, self.depth = above.block, above.depth + 1
            self.hint = above.hint
            self.header = above.header or (name == "header" and not above.article)
            self.article, self.bad, self.unseen, self.link = above.article or self.article, above.bad or self.bad, above.unseen or self.unseen, above.link or self.link
            self.good, self.readers = above.good, above.readers


def _named(e: _Element, attributes: str) -> tuple[str, str]:
    """Read an element's attributes: the kind of content element it is, and the weight of its names, if any."""
    kind, hint = e.name if e.name in CONTENT else "", "strong" if e.name == "form" else ""
    if _TELLING.search(attributes):
        values = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        names, role = f"{values.get('class', '')} {values.get('id', '')}", values.get("role", "").lower()
        if role in CONTENT:
            kind, e.article = kind or role, True
        if e.name not in ("html", "body"):
            e.bad = e.bad or role in ROLES
            telling = STATE.sub(" ", names)
            e.readers = e.readers or bool(READERS.search(telling))
            if not kind:
                whole = any(STRONG.fullmatch(name) for name in telling.split())
                hint = hint or ("strong" if whole else "part" if STRONG.search(telling) else "weak" if WEAK.search(telling) else "")
        e.good = e.good or bool(GOOD.search(names))
        style = values.get("style", "").replace(" ", "").lower()
        e.unseen = e.unseen or "hidden" in values or "display:none" in style or "visibility:hidden" in style or values.get("aria-hidden", "").lower() == "true"
    return kind, hint


def blocks_of(page: str) -> list[dict]:
    """The text blocks of a page in order: text, link characters, and the marks of their ancestors.

    An element with a name of boilerplate is none if it holds the first main
    element or, without one, the first article; if it holds most of the
    article's text outside links and is not its readers' (on a page without
    either element only if its name is no strong sign); or if nothing like an
    article would be left on such a page. So with a form. An unclosed quote
    ends with its tag; an unclosed tag, comment or script with the page.
    """
    out: list[dict] = []
    stack = [_Element("", None)]
    last = page.rfind(">")
    open_at: dict[str, list[int]] = {}
    # named elements: the weight of the name, the named element around, and whether it is the readers'
    hints: dict[int, tuple[str, int, bool]] = {}
    forms: set[int] = set()
    # named elements around the first main and the first article
    around: dict[str, set[int]] = {}
    text: list[str] = []
    links = serial = at = 0
    tag = _TAG

    def flush() -> None:
        nonlocal links
        joined = _BLANKS.sub(" ", "".join(text)).strip()
        text.clear()
        if joined:
            out.append({"text": joined, "links": links, "at": stack[-1]})
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        if raw and not stack[-1].unseen:
            value = html.unescape(raw) if "&" in raw else raw
            text.append(value)
            if stack[-1].link:
                links += len(value.strip())

    def close(k: int) -> None:
        if stack[-1].depth != stack[k - 1].depth:
            flush()
        for e in stack[k:]:
            open_at[e.name].pop()
        del stack[k:]

    def close_if_innermost(name: str) -> None:
        if open_at.get(name) and stack[open_at[name][-1]].depth == stack[-1].depth:
            close(open_at[name][-1])

    while at < len(page):
        begin = page.find("<", at)
        add(page[at : begin if begin >= 0 else len(page)])
        if begin < 0:
            break
        if page.startswith("<!--", begin):
            at = page.find("-->", begin + 2) + 3
            at = at if at > 2 else len(page)
            continue
        if page[begin + 1 : begin + 2] in ("!", "?"):
            at = page.find(">", begin) + 1
            at = at or len(page)
            continue
        if begin > last and page[begin + 1 : begin + 2].isalpha():
            break
        m = tag.match(page, begin)
        if not m and tag is _TAG and _BARE_TAG.match(page, begin):
            # quotes do not close from here on: tags end at the next bracket
            tag = _BARE_TAG
            m = tag.match(page, begin)
        if not m:
            add("<")
            at = begin + 1
            continue
        at, name = m.end(), m[2].lower()
        if m[1]:
            places = open_at.get(name)
            if places:
                if name not in INLINE or stack[-1].depth == stack[places[-1]].depth:
                    close(places[-1])
            elif name not in INLINE:
                flush()
            continue
        if name in VOID:
            if name == "hr":
                flush()
            else:
                add(" ")
            continue
        if name not in INLINE:
            flush()
            close_if_innermost("p")
            for partner in {name, SELF_CLOSING[name]} if name in SELF_CLOSING else ():
                close_if_innermost(partner)
        if m[3].endswith("/") and name in ("svg", "path", "use"):
            continue
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        serial += 1
        above, e = stack[-1], _Element(name, stack[-1])
        kind, hint = _named(e, m[3])
        if hint:
            hints[serial], e.hint = (hint, above.hint, e.readers), serial
            if name == "form":
                forms.add(serial)
        open_at.setdefault(name, []).append(len(stack))
        stack.append(e)
        if kind and kind not in around and not (e.bad or e.unseen or e.readers):
            around[kind] = set()
            k = e.hint
            while k:
                around[kind].add(k)
                k = hints[k][1]
    flush()

    # text of the article, or of the page, in and outside each named element, and what of it is outside links
    main = "main" in around or "article" in around
    spared = around.get("main", around.get("article", set()))
    inside = [b for b in out if not b["at"].bad and (b["at"].article or not main)]
    held: dict[int, int] = {}
    told: dict[int, int] = {}
    whole = plain = 0
    for block in inside:
        size = len(block["text"])
        own = max(0, size - block["links"])
        whole += own
        k = block["at"].hint
        if k:
            held[k], told[k] = held.get(k, 0) + size, told.get(k, 0) + own
        while k and (k in spared or hints[k][0] == "weak"):
            k = hints[k][1]
        plain += 0 if k else size
    for k in sorted(hints, reverse=True):
        up = hints[k][1]
        if up:
            held[up], told[up] = held.get(up, 0) + held.get(k, 0), told.get(up, 0) + told.get(k, 0)
    spared = spared | {k for k, n in told.items() if 2 * n > whole and not hints[k][2] and (main or hints[k][0] != "strong")}
    if plain < LEAST_ARTICLE:
        most = max((n for k, n in held.items() if not main or k in forms), default=0)
        spared |= {k for k, n in held.items() if n == most > plain and (not main or k in forms)}
    level: dict[int, str] = {0: ""}
    for k in sorted(hints):
        own, up, _ = hints[k]
        level[k] = level[up] if k in spared else max(own, level[up], key=SEVERITY.index)
    for block in out:
        block["hint"] = level[block["at"].hint]
        block["outside"] = main and not block["at"].article
    return out


def log_odds(block: dict) -> float:
    """The classifier's log-odds that a block is content."""
    e, size = block["at"], len(block["text"])
    score = WEIGHTS["bias"] + WEIGHTS["article"] * e.article + WEIGHTS["outside"] * block["outside"] + WEIGHTS["good"] * e.good
    score += WEIGHTS["boilerplate"] * e.bad + WEIGHTS["page_header"] * e.header + (WEIGHTS[block["hint"]] if block["hint"] else 0.0)
    score += WEIGHTS["links"] * min(1.0, block["links"] / size)
    score += WEIGHTS["words"] * min(3.0, math.log1p(size / 40))
    score += WEIGHTS["stops"] * min(3, len(_STOP.findall(block["text"])))
    score += WEIGHTS["heading"] * (e.block.name in ("h1", "h2", "h3", "h4")) + WEIGHTS["paragraph"] * (e.block.name in ("p", "blockquote", "pre"))
    score += WEIGHTS["rights"] * bool(_RIGHTS.match(block["text"]))
    return score


def minimum_cut(gains: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source when the cheapest cut parts it from the sink.

    ``gains``: capacity from the source if positive, to the sink if negative.
    ``edges``: undirected ``(a, b, capacity)``. Shortest augmenting paths by
    levels, each level graph blocked in one sweep.
    """
    n = len(gains)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def tie(a: int, b: int, forth: int, back: int) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((forth, back))

    for i, gain in enumerate(gains):
        if gain > 0:
            tie(source, i, gain, 0)
        elif gain < 0:
            tie(i, sink, -gain, 0)
    for a, b, capacity in edges:
        tie(a, b, capacity, capacity)
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue and sink not in level:
            a = queue.popleft()
            for e in out[a]:
                if room[e] and to[e] not in level:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if sink not in level:
            return [i in level for i in range(n)]
        turn = dict.fromkeys(level, 0)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                k = next(i for i, e in enumerate(path) if not room[e])
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if room[e] and level.get(to[e], -1) == level[a] + 1 and (to[e] == sink or level[to[e]] < level[sink]):
                    break
                turn[a] += 1
            if turn[a] < len(out[a]):
                path.append(out[a][turn[a]])
                a = to[path[-1]]
            elif a == source:
                break
            else:
                a = to[path.pop() ^ 1]
                turn[a] += 1


def _apart(a: _Element, b: _Element) -> int:
    """Steps between two blocks' innermost block elements in the tree."""
    x, y, steps = a.block, b.block, 0
    while x is not y:
        if x.depth >= y.depth:
            x = x.up
        else:
            y = y.up
        steps += 1
    return steps


def smoothness(blocks: list[dict]) -> list[tuple[int, int, int]]:
    """Edges between neighbours by their steps apart in the tree, and between close blocks of one parent.

    The way from a block to the next goes up and down the tree as the page
    itself does, so all ways together are no longer than the page.
    """
    edges = []
    for i in range(len(blocks) - 1):
        a = blocks[i]["at"]
        steps = max(0, _apart(a, blocks[i + 1]["at"]) - 2)
        edges.append((i, i + 1, round(_SCALE * SMOOTH / 2 ** min(10, steps / 2))))
        for j in range(i + 2, min(i + 1 + REACH, len(blocks))):
            if a.up is blocks[j]["at"].up:
                edges.append((i, j, round(_SCALE * SMOOTH / 2 ** (j - i))))
    return edges


def main_text(page: str | None) -> str:
    """The content blocks of a page, one a line; empty for null, empty or content-free pages."""
    blocks = blocks_of(page or "")
    kept = minimum_cut([round(_SCALE * log_odds(b)) for b in blocks], smoothness(blocks))
    return "\n".join(b["text"] for b, keep in zip(blocks, kept, strict=True) if keep)


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``page_id, url, html``.

    The whole page is parsed; a null or empty page has empty text. Broken
    markup is read as ``blocks_of`` says, at any depth in time that grows with
    the page. Repeated rows, null ids and addresses stay as they are; other
    columns, ``text`` and ``n_chars`` among them, are left out; no rows give
    none. Among cheapest labellings the one with the least content is taken.
    """
    kinds = dict(pages.dtypes)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col(html_column).cast("string")).mapInArrow(go, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op1_mincut_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(read(spark, sf_dir, "pages"))
