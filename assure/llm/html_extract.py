"""HTML extraction: a minimum cut labels the text blocks of a page as content or boilerplate.

A page becomes blocks of text, each with its place in the element tree. A linear classifier gives each block
log odds of being content; they are the capacities of its terminal edges. Neighbouring blocks are joined by
smoothness edges, stronger the nearer they are in the tree. The maximum flow leaves the cheapest labelling.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: Elements that may stand in a head; any other, or text, ends it.
IN_HEAD = frozenset("title base basefont bgsound link meta style script noscript noframes template".split())
#: Elements of other languages, which a slash closes; in HTML a slash closes nothing.
FOREIGN = frozenset("svg math".split())
#: Elements whose content is no text of the page.
SKIPPED = frozenset("head script style noscript template iframe svg math canvas object select option button textarea audio video dialog".split())
#: Those of which the content is not even markup.
RAW = frozenset("script style textarea title iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements within a line of text; any other begins and ends blocks.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split()
)
#: What elements, roles and names say about the text below them, in log odds of content: no more than the smoothness
#: edges around a block can outweigh together, so that its neighbours decide with it.
BY_ELEMENT = {"article": 0.75, "main": 0.75, "nav": -4.0, "footer": -4.0, "aside": -4.0, "form": -4.0, "header": -4.0, "menu": -4.0, "fieldset": -4.0, "address": -1.5, "h1": 1.5, "h2": 0.5, "h3": 0.5, "blockquote": 0.5, "p": 0.5, "pre": 0.5}
BY_ROLE = {"main": 0.75, "article": 0.75, "navigation": -4.0, "banner": -4.0, "contentinfo": -4.0, "complementary": -4.0, "search": -4.0, "form": -4.0, "dialog": -4.0, "alert": -4.0, "menu": -4.0, "menubar": -4.0}
#: Words of names that speak for or against content, and those that only tell the kind of box.
WORDS_AGAINST = re.compile(
    r"ads?|adv|advert\w*|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|breadcrumbs?|footer|foot|sidebar\w*|side|widgets?|cookies?|consent|gdpr|notices?|notifications?|popup\w*|modals?|overlay\w*|subscri\w*|newsletters?|signup|login|shar(?:e|ing)|social\w*|related|recommend\w*|comments?|respond|repl(?:y|ies)|disqus|discussions?|pagination|pager|toolbar|masthead|copyright|legal|skip|hidden|topbar|header|tags|search|form"
)
WORDS_FOR = frozenset("article articles content contents post posts entry story stories text body main prose".split())
WORDS_OF_BOXES = WORDS_FOR | frozenset(
    "area bar block box bottom buttons button card cards class col column container cta digest global group hd holder icon icons inner item items label left link links list message module outer page panel policy primary reader right row secondary section site slot sub title top unit user users view wrap wrapper js id thread".split()
)
#: Of a name all of whose words are known, of one with other words in it, and of one for content.
AGAINST, DOUBTFUL, FOR = -4.0, -1.0, 1.0
#: Smoothness: of neighbours in one element, and of others over their distance in the tree.
SAME, APART = 2.0, 0.5

#: The classifier's constant, and its weight of the binary logarithm of the number of words, up to a bound.
BIAS, LENGTH, LONGEST = -2.0, 0.6, 2.5

ATTRIBUTE = re.compile(r"""(class|id|role|style|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(\shidden(?=[\s/>=]|$))""", re.I)
NAME = re.compile(r"[a-zA-Z][^\s/>]*")


def name_hint(name: str) -> tuple[float, float]:
    """What a class or id says against and for content; a word that is not known makes it doubtful."""
    words = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
    against = [w for w in words if WORDS_AGAINST.fullmatch(w)]
    if against:
        known = all(w in WORDS_OF_BOXES for w in words if w not in against)
        return (AGAINST if known else DOUBTFUL), 0.0
    return 0.0, FOR if any(w in WORDS_FOR for w in words) else 0.0


class Block:
    __slots__ = ("text", "linked", "node")

    def __init__(self, text: str, linked: int, node: int):
        self.text, self.linked, self.node = text, linked, node


class Page:
    """The blocks of a page in order; parent, depth and prior (summed hints) of each element."""

    def __init__(self, source: str):
        self.parent, self.depth, self.prior = [-1], [0], [0.0]
        self.blocks: list[Block] = []
        self._parts: list[str] = []
        self._linked: list[str] = []
        self._read(source)

    def _flush(self, node: int) -> None:
        if self._parts:
            text = " ".join(html.unescape("".join(self._parts)).split())
            if text:
                linked = len(" ".join(html.unescape("".join(self._linked)).split()))
                self.blocks.append(Block(text, min(linked, len(text)), node))
            self._parts, self._linked = [], []

    def _hint(self, name: str, attributes: str, within: set[str]) -> float:
        hint = BY_ELEMENT.get(name, 0.0)
        if name == "header" and "article" in within:
            hint = 0.0
        if attributes:
            worst, best = 0.0, 0.0
            for key, a, b, c, bare in ATTRIBUTE.findall(attributes):
                key, value = key.lower(), a or b or c
                if bare or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    worst = AGAINST
                elif key == "role":
                    hint += BY_ROLE.get(value.lower(), 0.0)
                elif key in ("class", "id") and name not in ("body", "html"):
                    for one in value.split():
                        against, good = name_hint(one)
                        worst, best = min(worst, against), max(best, good)
            hint += worst or best
        return hint

    def _read(self, s: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]  # open block elements with their nodes
        opened: dict[str, int] = {}
        skip: list[str] = []
        inner: dict[str, int] = {}  # elements open within those skipped
        ended: set[str] = set()  # skipped elements of which no end comes any more
        links = 0
        at, end = 0, len(s)
        missing: set[str] = set()  # quotes that don't come any more

        def close(to: int) -> None:
            while len(stack) > to:
                name, _ = stack.pop()
                opened[name] -= 1

        while at < end:
            lt = s.find("<", at)
            if lt < 0:
                lt = end
            if lt > at and skip == ["head"] and s[at:lt].strip():
                skip.clear()  # text ends a head
            if lt > at and not skip:
                self._parts.append(s[at:lt])
                if links:
                    self._linked.append(s[at:lt])
            if lt >= end:
                break
            if s.startswith("<!--", lt):
                found = s.find("-->", lt + 4)
                at = end if found < 0 else found + 3
                continue
            closing = s.startswith("</", lt)
            m = NAME.match(s, lt + 1 + closing)
            if not m:
                if s[lt + 1 : lt + 2] in ("!", "?", "/"):
                    found = s.find(">", lt)
                    at = end if found < 0 else found + 1
                else:  # a plain less-than sign
                    if not skip:
                        self._parts.append("<")
                    at = lt + 1
                continue
            gt = self._tag_end(s, m.end(), missing)
            if gt < 0:
                break  # a tag that is cut off
            name, attributes, at = m[0].lower(), s[m.end() : gt], gt + 1
            if skip and self._skips(s, name, closing, attributes, skip, inner, opened, ended):
                if skip and skip[-1] in RAW and not closing and name == skip[-1]:
                    at = self._after_raw(s, name, at, skip)
                continue
            node = stack[-1][1]
            if not closing and (name in SKIPPED or name in RAW):
                if name not in INLINE:
                    self._flush(node)
                if not (name in FOREIGN and attributes.endswith("/")):
                    skip.append(name)
                    inner.clear()
                    at = self._after_raw(s, name, at, skip)
                    if name not in RAW and name != "head" and name not in ended:
                        if not re.compile(rf"</{name}(?=[\s/>])", re.I).search(s, at):
                            ended.add(name)
                continue
            if name in INLINE or name in VOID:
                if name == "a":
                    links = 0 if closing else 1
                elif name in ("br", "hr", "wbr") and name != "wbr":
                    self._parts.append(" ")
                    if name == "hr":
                        self._flush(node)
                continue
            self._flush(node)
            if closing:
                if opened.get(name):
                    k = len(stack) - 1
                    while stack[k][0] != name:
                        k -= 1
                    close(k)
                links = 0
                continue
            if stack[-1][0] == "p" or stack[-1][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                close(len(stack) - 1)
            node = stack[-1][1]
            within = {x for x, n in opened.items() if n > 0}
            self.parent.append(node)
            self.depth.append(self.depth[node] + 1)
            self.prior.append(self.prior[node] + self._hint(name, attributes, within))
            stack.append((name, len(self.parent) - 1))
            opened[name] = opened.get(name, 0) + 1
        self._flush(stack[-1][1])

    @staticmethod
    def _skips(s: str, name: str, closing: bool, attributes: str, skip: list[str], inner: dict[str, int], opened: dict[str, int], ended: set[str]) -> bool:
        """Whether a tag within skipped elements is skipped too; if not, they have ended.

        They end with their own end tag; with that of an element around them; a head also with whatever can't be
        in it; and one whose end tag never comes with the next block.
        """
        if closing and name in skip:
            del skip[len(skip) - 1 - skip[::-1].index(name) :]
            return True
        if skip[-1] == "head" and not closing and name not in IN_HEAD and name != "head":
            skip.clear()
            return name in ("body", "html")
        if not closing and (name in SKIPPED or name in RAW):
            if name != skip[-1] and not (name in FOREIGN and attributes.endswith("/")):
                skip.append(name)
            elif name in RAW:
                skip.append(name)
            return True
        if name in INLINE or name in VOID:
            return True
        if skip[-1] in ended:
            skip.clear()
            return False
        if not closing:
            inner[name] = inner.get(name, 0) + (not attributes.endswith("/"))
        elif inner.get(name):
            inner[name] -= 1
        elif opened.get(name) and skip[-1] != "head":
            skip.clear()
            return False
        return True

    @staticmethod
    def _after_raw(s: str, name: str, at: int, skip: list[str]) -> int:
        if name not in RAW:
            return at
        m = re.compile(rf"</{name}(?=[\s/>])", re.I).search(s, at)
        skip.pop()
        if not m:
            return len(s)
        found = s.find(">", m.end())
        return len(s) if found < 0 else found + 1

    @staticmethod
    def _tag_end(s: str, at: int, missing: set[str]) -> int:
        """The place of the > that ends a tag: the first one outside quoted values."""
        first = s.find(">", at)
        gt = first
        while gt >= 0:
            inside = s[at:gt]
            quotes = re.search(r"""=\s*(["'])""", inside)
            while quotes:
                q = quotes[1]
                closed = inside.find(q, quotes.end())
                if closed < 0:
                    break
                quotes = re.compile(r"""=\s*(["'])""").search(inside, closed + 1)
            if not quotes:
                return gt
            start = at + quotes.end()
            closed = -1 if quotes[1] in missing else s.find(quotes[1], start)
            if closed < 0:
                missing.add(quotes[1])
                return first
            gt = s.find(">", closed)
        return first

    def distance(self, x: int, y: int) -> int:
        """Steps between two elements in the tree."""
        n = 0
        while x != y:
            if self.depth[x] < self.depth[y]:
                x, y = y, x
            x = self.parent[x]
            n += 1
        return n

    def container(self, block: Block) -> int:
        return max(self.parent[block.node], 0)


def log_odds(page: Page, block: Block) -> float:
    """The classifier: of content, from hints above the block, length, links and signs of boilerplate."""
    words = block.text.count(" ") + 1
    odds = page.prior[block.node] + BIAS + min(LONGEST, LENGTH * math.log2(1 + words))
    odds -= 4.0 * block.linked / len(block.text)
    if "©" in block.text or re.search(r"all rights reserved|cookies?\b", block.text, re.I) and words < 40:
        odds -= 2.0
    return odds


def max_flow_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut: terminal capacities from odds, edges both ways."""
    n = len(odds)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, c: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(c)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, o in enumerate(odds):
        add(*((s, i) if o > 0 else (i, t)), abs(o), 0.0)
    for a, b, c in edges:
        add(a, b, c, c)
    least = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            x = queue.popleft()
            for e in out[x]:
                if cap[e] > least and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        nxt = [0] * (n + 2)
        path: list[int] = []
        x = s
        while True:  # a blocking flow, depth first
            if x == t:
                push = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                k = next(k for k, e in enumerate(path) if cap[e] <= least)
                x = to[path[k] ^ 1]
                del path[k:]
                continue
            edges_of = out[x]
            while nxt[x] < len(edges_of):
                e = edges_of[nxt[x]]
                if cap[e] > least and level[to[e]] == level[x] + 1:
                    path.append(e)
                    x = to[e]
                    break
                nxt[x] += 1
            else:
                if x == s:
                    break
                x = to[path.pop() ^ 1]
                nxt[x] += 1


def main_blocks(source: str) -> list[str]:
    """The texts of the blocks of a page that the cut labels as content, in page order."""
    page = Page(source)
    blocks = page.blocks
    if not blocks:
        return []
    edges = []
    for step, share in ((1, 1.0), (2, 0.5)):
        for i in range(len(blocks) - step):
            x, y = blocks[i], blocks[i + step]
            if page.prior[x.node] * page.prior[y.node] < 0:
                continue  # what is above them contradicts
            a, b = page.container(x), page.container(y)
            if a == b:
                edges.append((i, i + step, SAME * share))
            elif step == 1:
                edges.append((i, i + 1, APART / max(1, page.distance(a, b))))
    kept = max_flow_cut([log_odds(page, b) for b in blocks], edges)
    return [b.text for b, k in zip(blocks, kept) if k]


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks of each row of pages (page_id, url, html).

    A null or empty page, or one without content, has an empty text. Whole pages of any length are read, tags
    that are cut off or never closed included. Repeated rows give repeated results, an empty table an empty
    one; other columns are ignored.
    """

    def of_batch(batch: pa.RecordBatch) -> dict:
        found = [main_blocks(h.as_py() or "") for h in batch.column("html")]
        texts = ["\n".join(blocks) for blocks in found]
        return {
            "page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts,
            "n_chars": [len(t) for t in texts], "n_blocks": [len(b) for b in found],
        }

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return arrow_map(rows, of_batch, "page_id long, url string, text string, n_chars long, n_blocks long")
