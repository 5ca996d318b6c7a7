"""Main text of web pages by minimum-cut labelling.

A page becomes its text blocks (runs of text between block-level tags) in order.
A classifier over a block's ancestors, classes, links and length gives the odds
that it is main text; the negative log odds become terminal capacities.  Names
count by what an element holds: the classes, roles and form tag of one that holds
most of the page's prose, with its article or heading, are the page's own and are
no evidence (`<body class="no-sidebar">`, a form around the whole page).  Blocks
that follow each other, and blocks of one parent, are joined by smoothness edges
that weaken with their distance in the DOM.  The minimum cut separates content
from boilerplate.

The cut is found exactly: a block whose odds outweigh all its edges is decided at
once and its edges become terminals of its neighbours; what then remains is
solved by augmenting shortest paths.

Text: character references are decoded, white space in a block becomes one space,
ends are trimmed, blocks are joined by a newline.  Scripts, styles, titles,
comments and markup never become blocks.  A null page is empty; a page without
content has the empty text.  Broken markup (unclosed or stray tags, a lone <) is
read as browsers do, as far as blocks need; pages of any length and depth are
parsed in linear time.  Of several least cuts the one with fewest blocks of content
is taken (what the flow can't reach is boilerplate).  Repeated pages are rows of
their own; input columns are kept, but for those named like an output column.  An
empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quire.llm.common import map_texts

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page; markup in those of the first line is text to a browser.
RAW_TEXT = frozenset("script style title textarea iframe noembed noframes xmp".split())
RAW = RAW_TEXT | frozenset("svg template annotation annotation-xml".split())
INLINE = frozenset(
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mspace semantics object video audio canvas picture a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
#: An opening tag closes an open element of these.
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "option": {"option"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
}
#: Elements that an unclosed li, dt, td ... is never closed beyond.
SCOPES = frozenset("html body table ul ol dl div section article main nav aside footer header form select".split())

#: Log odds of main text by an ancestor's tag, role or a word of its class or id.
TAGS = {
    "article": 3.0, "main": 2.0, "nav": -7.0, "footer": -7.0, "aside": -7.0, "form": -7.0, "menu": -7.0, "dialog": -7.0,
    "button": -7.0, "select": -7.0, "fieldset": -6.0, "noscript": -7.0, "header": -5.0, "p": 0.8, "h1": 0.8, "h2": 0.5, "h3": 0.5,
    "blockquote": 0.6, "pre": 0.6, "head": -9.0, "address": -1.5,
}
ROLES = {"navigation": -7.0, "banner": -6.0, "contentinfo": -7.0, "complementary": -7.0, "search": -7.0, "alert": -7.0, "dialog": -7.0, "form": -7.0, "main": 2.0, "article": 3.0}
WORDS = dict.fromkeys(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside widget ad ads advert adverts advertisement advertising sponsor sponsored promo "
    "promotion banner cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe subscription signup login register share sharing social "
    "related recommended recommendations comment comments commentlist reply replies disqus respond pagination pager toolbar copyright legal skip search alert masthead topbar".split(),
    -6.5,
) | dict.fromkeys("article content post entry story maincontent articlebody".split(), 1.2)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

#: Odds that don't come from ancestors, smoothness, and the scale of capacities.
BIAS, LINKS, LONG, SENTENCE, ADJACENT, SIBLING = -0.8, -5.0, 1.2, 0.8, 2.0, 0.8
SCALE = 1000
#: Steps between blocks at which their edge has no weight left.
MOST_STEPS = 2000
#: Characters from which a block that ends as a sentence and is no list of links is prose.
PROSE = 60
#: Tags that can hold a whole page, and so say nothing if they hold its article.
WRAPPERS = frozenset(["form", "fieldset", "header"])


def element_odds(tag: str, attributes: str) -> tuple[float, float, float]:
    """What an element says of its blocks: evidence against them by its tag or by being
    hidden, evidence against by names that a whole page may bear, evidence for them."""
    firm, found = [0.0 if tag in WRAPPERS else TAGS.get(tag, 0.0)], [TAGS.get(tag, 0.0)]
    if "=" in attributes or "hidden" in attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            value, name = "".join(values), name.lower()
            if name in ("class", "id"):
                found += [WORDS[w] for w in {x.lower() for x in WORD.findall(value)} if w in WORDS]
            elif name == "role":
                found.append(ROLES.get(value.strip().lower(), 0.0))
            elif name == "style" and HIDDEN.search(value) or name == "aria-hidden" and value == "true":
                firm.append(-7.0)
        if re.search(r"(?:^|\s)hidden(?:\s|$)", attributes):
            firm.append(-7.0)
    return min(0.0, *firm), min(0.0, *found), max(0.0, *found)


class Block:
    __slots__ = ("text", "element", "inner", "odds", "tag", "links")

    def __init__(self, text: str, element: int, inner: int, tag: str, links: int):
        self.text, self.element, self.inner, self.odds, self.tag, self.links = text, element, inner, 0.0, tag, links

    def prose(self) -> int:
        """Its characters if it reads as prose, else 0."""
        n = len(self.text)
        return n if n >= PROSE and self.text[-1] in ".!?\u2026\u3002\"'\u201d)" and 3 * self.links < n else 0


class Tree:
    """Elements in page order: tag, parent (0 is the page itself), depth, and evidence."""

    def __init__(self):
        self.tags, self.parents, self.depths = [""], [0], [0]
        self.firm, self.named, self.good = [0.0], [0.0], [0.0]

    def add(self, tag: str, parent: int, evidence: tuple[float, float, float]) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1)
        for into, value in zip((self.firm, self.named, self.good), evidence, strict=True):
            into.append(value)
        return len(self.tags) - 1

    def distance(self, a: int, b: int, most: int) -> int:
        """Steps between two elements, or `most` if there are more."""
        steps = 0
        while a != b and steps < most:
            if self.depths[a] >= self.depths[b]:
                a = self.parents[a]
            else:
                b = self.parents[b]
            steps += 1
        return steps if a == b else most

    def judge(self, found: list[Block]) -> None:
        """Sets the blocks' odds.  Names of an element that holds most of the page's
        prose, with its heading or article, are those of the page and say nothing."""
        n = len(self.tags)
        prose, heads = [0] * n, [0] * n
        for b in found:
            prose[b.inner] += b.prose()
        for e in range(n - 1, 0, -1):
            prose[self.parents[e]] += prose[e]
        articles = [e for e in range(n) if self.tags[e] in ("article", "main")]
        anchor = max(articles, key=lambda e: (prose[e], -e), default=0) or next((e for e in range(n) if self.tags[e] == "h1"), 0)
        if anchor:
            heads[anchor] = 1
            for e in range(n - 1, 0, -1):
                heads[self.parents[e]] += heads[e]
        against, good = [0.0] * n, [0.0] * n
        for e in range(1, n):
            whole = self.tags[e] in ("html", "body") or prose[0] and 2 * prose[e] >= prose[0] and (heads[e] or not anchor)
            against[e] = min(against[self.parents[e]], self.firm[e], 0.0 if whole else self.named[e])
            good[e] = max(good[self.parents[e]], self.good[e])
        for b in found:
            b.odds = against[b.inner] + good[b.inner]


def blocks(page: str) -> tuple[list[Block], Tree]:
    """The text blocks of a page, with odds, and its elements."""
    found: list[Block] = []
    tree = Tree()
    # open elements: tag, element, place in the stack of the nearest block element and of the nearest scope
    stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]
    places: dict[str, list[int]] = {}  # of open elements in the stack, by tag
    unclosed: set[str] = set()  # raw elements that no closing tag follows any more
    at = links = linked = 0
    buffer: list[str] = []

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                tag, element, *_ = stack[stack[-1][2]]
                found.append(Block(text, element, stack[-1][1], tag, linked))
            buffer.clear()
        linked = 0

    def put(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            buffer.append(text)
            if links:
                linked += len(text.strip())

    def pop_to(k: int) -> None:
        nonlocal links
        while len(stack) > k:
            tag = stack.pop()[0]
            places[tag].pop()
            links -= tag == "a"

    def last(tag: str) -> int:
        return places[tag][-1] if places.get(tag) else 0

    n = len(page)
    end_of_tags = page.rfind(">")
    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt > end_of_tags:  # no tag can end any more
            comment = page.find("<!--", at)
            put(page[at:] if comment < 0 else page[at:comment])
            break
        put(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = TAG.match(page, lt) or LOOSE_TAG.match(page, lt)
        if not m:
            put("<")
            at = lt + 1
            continue
        at, close, tag = m.end(), m[1], m[2].lower()
        inline = tag in INLINE
        if tag == "br":
            buffer.append(" ")
            continue
        if not inline and tag not in RAW:
            flush()
        if close:
            if k := last(tag):
                pop_to(k)
            continue
        if tag in RAW:
            if tag not in ("annotation", "annotation-xml"):
                flush()
            if m[3].endswith("/") and tag not in RAW_TEXT:
                continue
            end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            if end:
                at = page.find(">", end.end()) + 1 or n
            elif tag in RAW_TEXT:
                at = n
            else:
                unclosed.add(tag)
            continue
        if tag in VOID or m[3].endswith("/") and inline:
            continue
        if not inline:
            k = max(map(last, ("p", *CLOSES.get(tag, ()))))
            if k > stack[-1][3]:
                pop_to(k)
        header = tag == "header" and (places.get("article") or places.get("main"))
        element = tree.add(tag, stack[-1][1], element_odds("" if header else tag, m[3]))
        k = len(stack)
        stack.append((tag, element, stack[-1][2] if inline else k, k if tag in SCOPES else stack[-1][3]))
        places.setdefault(tag, []).append(k)
        links += tag == "a"
    flush()
    tree.judge(found)
    return found, tree


def block_odds(block: Block) -> float:
    n = len(block.text)
    odds = BIAS + block.odds + LONG * min(1.0, n / 200) + (SENTENCE if block.text[-1] in ".!?…。\"'" else 0.0)
    return odds + LINKS * min(1.0, block.links / n)


def edges(found: list[Block], tree: Tree) -> list[tuple[int, int, int]]:
    """Smoothness edges: neighbours in the page, and the next block of the same parent."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            weight = int(SCALE * ADJACENT / (1 + tree.distance(found[i - 1].element, b.element, MOST_STEPS)))
            out.append((i - 1, i, weight))
        parent = tree.parents[b.element]
        if (j := last.get(parent)) is not None and j != i - 1:
            out.append((j, i, int(SCALE * SIBLING)))
        last[parent] = i
    return out


def min_cut(excess: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut.

    excess: capacity from the source less that to the sink; links: undirected.
    """
    n = len(excess)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, w in links:
        if w:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
    excess = list(excess)
    side: list[bool | None] = [None] * n
    weight = [sum(d.values()) for d in near]
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is not None or abs(excess[i]) < weight[i] or not excess[i]:
            continue
        side[i] = excess[i] > 0
        for j, w in near[i].items():
            del near[j][i]
            weight[j] -= w
            excess[j] += w if side[i] else -w
            queue.append(j)
        near[i] = {}
    # what is left: send the positive excess to the negative one along shortest paths
    rest = [i for i in range(n) if side[i] is None]
    sources = [i for i in rest if excess[i] > 0]
    while sources:
        before = dict.fromkeys(sources, -1)
        queue, end = deque(sources), -1
        while queue and end < 0:
            i = queue.popleft()
            for j, w in near[i].items():
                if w > 0 and j not in before:
                    before[j] = i
                    if excess[j] < 0:
                        end = j
                        break
                    queue.append(j)
        if end < 0:
            for i in rest:
                side[i] = i in before
            return [bool(x) for x in side]
        path = [end]
        while before[path[-1]] >= 0:
            path.append(before[path[-1]])
        flow = min(excess[path[-1]], -excess[end], *(near[b][a] for a, b in zip(path, path[1:], strict=False)))
        excess[path[-1]] -= flow
        excess[end] += flow
        for a, b in zip(path, path[1:], strict=False):
            near[b][a] -= flow
            near[a][b] = near[a].get(b, 0) + flow
        sources = [i for i in sources if excess[i] > 0]
    return [bool(x) for x in side]


def main_text(page: str) -> str:
    """The main text of a page."""
    found, tree = blocks(page)
    kept = min_cut([int(SCALE * block_odds(b)) for b in found], edges(found, tree))
    return "\n".join(b.text for b, keep in zip(found, kept, strict=True) if keep)


EXTRACTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(df: DataFrame, html_column: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Adds text and n_chars, the main text of a column of pages and its code points."""

    def make():
        def work(raw: list[bytes], _) -> dict:
            texts = [main_text(x.decode()) for x in raw]
            return {"text": texts, "n_chars": [len(x) for x in texts]}

        return work

    return map_texts(df, make, EXTRACTED, html_column, keep)
