"""Main text of HTML pages by minimum cut.

A page becomes a list of text blocks, each with the element it stands in. A classifier gives every
block log-odds of being content, from the elements around it, its length and its share of links;
they become the capacity of an edge from the source (content) or to the sink (boilerplate).
Neighbouring blocks, and blocks of one parent, are tied by edges whose capacity falls with their
distance in the tree. The maximum flow separates the blocks at least total cost: a doubtful block
follows its surroundings, a clear one stands against them.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.S)
_PLAIN_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_NAMED = re.compile(r"</?[a-zA-Z]")
_LONG_REFERENCE = re.compile(r"&#(?:[0-9]{10,}|[xX][0-9a-fA-F]{10,});?")
_ATTRIBUTE = re.compile(r"(id|class|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORD = re.compile(r"[a-z]+")
_HIDDEN_STYLE = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)

_RAW = frozenset("script style noscript template textarea title iframe svg math object select option canvas".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol
    p pre search section summary table tbody td tfoot th thead tr ul""".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_PROSE = frozenset("p blockquote pre li dd dt td figcaption".split())
_ONE_AT_A_TIME = frozenset("li dt dd tr td th option".split())
_SHELL = frozenset("nav footer aside form button menu dialog search fieldset".split())
_BODY_TAG = frozenset("article main".split())
_SHELL_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
# words of class and id attributes
_SHELL_WORD = frozenset("""ad ads adv advert advertisement adsense adslot banner breadcrumb breadcrumbs comment comments
    consent cookie cookies copyright disclaimer discussion disqus dropdown feedback footer gdpr legal login menu modal
    nav navbar navigation newsletter notice notification outbrain overlay pager pagination paywall popup privacy promo
    promoted promotion recommended related replies reply respond responses search share sharing shoutbox sidebar signup
    skip social sponsor sponsored subscribe subscription taboola tags teaser toolbar topbar trending widget widgets
    """.split())
_SHELL_PART = ("sidebar", "comment", "footer", "cookie", "advert", "sponsor", "newsletter", "breadcrumb", "navbar",
               "navigation", "subscribe", "pagination", "disclaimer")
_BODY_WORD = frozenset("article content entry post story text body main prose".split())

_SCALE = 10
_SHELL_ODDS = -12.0
_TIE = 1.5


class _Element:
    __slots__ = ("tag", "serial", "depth", "parent", "owner", "shell", "body", "link", "content")

    def __init__(self, tag: str, serial: int, parent: _Element | None, attributes: str):
        self.tag, self.serial, self.parent = tag, serial, parent
        self.depth = parent.depth + 1 if parent else 0
        # the nearest element that makes a block
        self.owner: _Element = self if parent is None or tag in _BLOCK else parent.owner
        self.shell = parent.shell if parent else False
        self.body = parent.body if parent else False
        self.content = parent.content if parent else False
        self.link = (parent.link if parent else False) or tag == "a"
        words: set[str] = set()
        named = ""
        if attributes:
            for name, value in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'").lower()
                if name in ("class", "id"):
                    named += " " + value
                elif name == "role" and value in _SHELL_ROLE:
                    self.shell = True
                elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                    self.shell = True
                elif name == "style" and _HIDDEN_STYLE.search(value):
                    self.shell = True
            words = set(_WORD.findall(named))
        if tag in _SHELL or (tag == "header" and not self.body):
            self.shell = True
        elif tag not in ("html", "body", "article", "main"):
            if words & _SHELL_WORD or any(part in named for part in _SHELL_PART):
                self.shell = True
            elif words & {"header", "masthead"} and not self.body:
                self.shell = True
        if tag in _BODY_TAG:
            self.body = True
        if words & _BODY_WORD:
            self.content = True


class Block:
    """Text between two block borders and where it stands."""

    __slots__ = ("parts", "links", "size", "element")

    def __init__(self, element: _Element):
        self.parts: list[str] = []
        self.links = self.size = 0
        self.element = element

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _short_reference(found: re.Match[str]) -> str:
    body = found[0].rstrip(";")[2:]
    base = "x" if body[0] in "xX" else ""
    digits = body[len(base):].lstrip("0")
    # beyond every code point, and beyond what int() takes
    return "\ufffd" if len(digits) > 7 else html.unescape(f"&#{base}{digits or 0};")


def unescaped(chunk: str) -> str:
    """Character references of one run of text decoded; numbers may have any length."""
    if "&" not in chunk:
        return chunk
    return html.unescape(_LONG_REFERENCE.sub(_short_reference, chunk))


def _next_token(page: str, at: int, last: int, quotes: bool) -> tuple[re.Match[str] | None, bool]:
    """The next tag or comment from ``at`` on, and whether quotation marks still count. ``last`` is the
    place of the last ``>``: a ``<`` behind it begins no tag. Where a tag finds no end because of its
    quotation marks, its ``<`` is text, and marks count for nothing from there on. So the search to
    the end of the page is made once, and the time is linear."""
    while (at := page.find("<", at)) >= 0:
        if at < last or page.startswith("<!--", at):
            token = (_TOKEN if quotes else _PLAIN_TOKEN).match(page, at)
            if token is not None:
                return token, quotes
            quotes = quotes and _NAMED.match(page, at) is None
        at += 1
    return None, quotes


def blocks(page: str) -> list[Block]:
    """Text blocks in page order. Broken markup is taken as it comes: an end tag closes what is open
    inside its element, one without a start tag is ignored, a paragraph ends where a block starts, and
    a tag that never ends is text."""
    root = _Element("html", 0, None, "")
    current, serial = root, 0
    opened: Counter[str] = Counter()  # open elements by tag
    out: list[Block] = []
    block: Block | None = None
    at, size = 0, len(page)
    last, quotes = page.rfind(">"), True
    lower: str | None = None

    def leave(element: _Element) -> _Element:
        """Close all that is open inside an open element, and itself."""
        node = current
        while True:
            opened[node.tag] -= 1
            if node is element:
                return node.parent
            node = node.parent

    while at < size:
        token, quotes = _next_token(page, at, last, quotes)
        chunk = page[at:token.start()] if token else page[at:]
        if chunk:
            if block is None and not chunk.isspace():
                block = Block(current.owner)
                out.append(block)
            if block is not None:
                block.parts.append(unescaped(chunk))
                block.size += len(chunk)
                if current.link:
                    block.links += len(chunk)
        if token is None:
            break
        at = token.end()
        tag = token[2]
        if not tag:
            continue
        tag = tag.lower()
        if token[1]:
            if opened[tag] > 0:
                node = current
                while node.tag != tag:
                    node = node.parent
                current = leave(node)
            if tag in _BLOCK:
                block = None
            continue
        if tag == "br" or tag == "wbr":
            if block is not None and tag == "br":
                block.parts.append(" ")
            continue
        if tag in _BLOCK:
            block = None
            node = current.owner
            if node is not root and (node.tag == "p" or (node.tag == tag and tag in _ONE_AT_A_TIME)):
                current = leave(node)
        if tag in _VOID or token[3].endswith("/"):
            continue
        if tag in _RAW:
            # lower() may change lengths outside ASCII, so the end tag is looked for without it
            lower = lower if lower is not None else page.translate(_ASCII_LOWER)
            stop = lower.find("</" + tag, at)
            at = size if stop < 0 else stop
            continue
        serial += 1
        current = _Element(tag, serial, current, token[3])
        opened[tag] += 1
    return out


_ASCII_LOWER = {k: k + 32 for k in range(65, 91)}


def odds(block: Block, text: str, framed: bool) -> float:
    """Log-odds that a block is content. ``framed``: the page has an article or main element."""
    element = block.element
    if element.shell:
        return _SHELL_ODDS
    score = min(len(text) / 80.0, 3.0) - 1.0
    if element.body:
        score += 2.5
    elif framed:
        score -= 2.0
    if element.content:
        score += 1.5
    if element.tag in _HEADING:
        score += 1.0
    elif element.tag in _PROSE:
        score += 0.5
    if block.size:
        score -= 4.0 * block.links / block.size
    return score


def _distance(a: _Element, b: _Element) -> int:
    """Edges between two elements in the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth and a.parent is not None:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def ties(found: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness edges: neighbours in page order, and the next block of the same parent."""
    out = []
    last: dict[int, int] = {}
    for k, block in enumerate(found):
        parent = (block.element.parent or block.element).serial
        before = last.get(parent)
        if k:
            weight = _TIE / (1 + 0.5 * _distance(found[k - 1].element, block.element))
            out.append((k - 1, k, int(weight * _SCALE) + 1))
        if before is not None and before != k - 1:
            out.append((before, k, int(_TIE * _SCALE / 2)))
        last[parent] = k
    return out


def source_side(gains: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Minimum cut: for each node, whether it stays with the source.

    ``gains``: capacity from the source if positive, to the sink if negative. ``edges``: capacity in
    both directions. Maximum flow by shortest augmenting levels.
    """
    count = len(gains)
    if all(g >= 0 for g in gains) or all(g <= 0 for g in gains):
        return [g > 0 or (g == 0 and any(x > 0 for x in gains)) for g in gains]
    source, sink = count, count + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(count + 2)]

    def add(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for k, gain in enumerate(gains):
        if gain > 0:
            add(source, k, gain, 0)
        elif gain < 0:
            add(k, sink, -gain, 0)
    for a, b, weight in edges:
        add(a, b, weight, weight)
    while True:
        level = [-1] * (count + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            node = queue.popleft()
            for edge in out[node]:
                if room[edge] and level[to[edge]] < 0:
                    level[to[edge]] = level[node] + 1
                    queue.append(to[edge])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(count)]
        following = [0] * (count + 2)
        path: list[int] = []
        node = source
        while True:
            if node == sink:
                pushed = min(room[edge] for edge in path)
                for edge in path:
                    room[edge] -= pushed
                    room[edge ^ 1] += pushed
                cut = next(k for k, edge in enumerate(path) if not room[edge])
                node = to[path[cut] ^ 1]
                del path[cut:]
                continue
            edges_of = out[node]
            while following[node] < len(edges_of):
                edge = edges_of[following[node]]
                if room[edge] and level[to[edge]] == level[node] + 1:
                    break
                following[node] += 1
            else:
                if node == source:
                    break
                level[node] = -1
                node = to[path.pop() ^ 1]
                continue
            path.append(edge)
            node = to[edge]


def labelled_blocks(page: str) -> list[tuple[str, bool]]:
    """Blocks that have text, with whether the cut calls them content."""
    found, texts = [], []
    for block in blocks(page):
        text = block.text()
        if text:
            found.append(block)
            texts.append(text)
    framed = any(b.element.body and not b.element.shell for b in found)
    gains = [round(odds(b, t, framed) * _SCALE) for b, t in zip(found, texts)]
    return list(zip(texts, source_side(gains, ties(found))))


def main_text(page: str | None) -> str:
    """Content blocks in page order with one space between them; empty for null or empty pages."""
    return " ".join(text for text, content in labelled_blocks(page or "") if content)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``. Nulls in id or url are passed on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    picked = pages.select("page_id", "url", "html")
    kind = picked.schema["page_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
