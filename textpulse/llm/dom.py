"""A tolerant document tree of an HTML page, as parallel lists, and features of its nodes.

Nodes are block elements and runs of text between their borders (tag ``#text``). Inline elements belong to the run
around them. Scripts, styles, templates and the head are markup, not text, and leave no nodes.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np

# Element kinds of HTML, and words that sites use in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
MARKUP = frozenset("script style template noscript svg iframe head title textarea select option canvas".split())
HEAD_TAGS = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_TAGS = frozenset("article main".split())
OTHER_TAGS = frozenset("nav header footer aside form button dialog menu fieldset".split())
MAIN_WORDS = frozenset("article content entry main post story text".split())
OTHER_WORDS = frozenset(
    "ad ads advert advertisement alert banner breadcrumb breadcrumbs comment comments cookie consent disclaimer footer form header"
    " login menu nav navbar navigation newsletter notice pagination popup promo promoted related reply search share sidebar"
    " signup social sponsor sponsored subscribe tags toolbar widget".split()
)
_PUNCTUATION = re.compile(r"[.,;:!?]")
_TAG_BEGIN = re.compile(r"<[A-Za-z/]")
_COMMENT_END, _EMPTY_COMMENT = re.compile(r"--!?>"), re.compile(r"<!--(?:-?>)")
#: Characters from which a run counts as long.
LONG_RUN = 80
BUCKETS = 8
FEATURES = 20 + BUCKETS


class Page(HTMLParser):
    """``tags, tokens, parents, texts, links`` by node, parents before children and nodes in page order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.tokens, self.parents = ["#page"], [()], [-1]
        self.texts: list[list[str] | None] = [None]
        self.links = [0]
        self.blocks = [0]  # numbers of the open block elements
        self.open = ["#page"]  # all open elements
        self.run = -1  # text run that goes on
        self.silent = 0  # open markup elements
        self.anchors = 0  # open links
        self.count = Counter()  # open elements by tag
        # A tag that the page's end cuts off is no text; a parser would look for its end once for every "<" in it.
        cut = _TAG_BEGIN.search(html, html.rfind(">") + 1)
        self.feed(html[: cut.start()] if cut else html)
        self.close()

    def _mark_end(self, i: int) -> int:
        end = self.rawdata.find(">", i)
        return len(self.rawdata) if end < 0 else end + 1

    def parse_comment(self, i: int, report: bool = True) -> int:
        """A comment without an end goes on to the end of the page."""
        m = _COMMENT_END.search(self.rawdata, i + 4)
        short = _EMPTY_COMMENT.match(self.rawdata, i)
        return short.end() if short else m.end() if m else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        """Declarations and marked sections of any form are comments up to the next ``>``."""
        return self.parse_comment(i) if self.rawdata.startswith("<!--", i) else self._mark_end(i)

    def parse_pi(self, i: int) -> int:
        return self._mark_end(i)

    def _node(self, tag: str, tokens: tuple, text: list[str] | None) -> int:
        self.tags.append(tag)
        self.tokens.append(tokens)
        self.parents.append(self.blocks[-1])
        self.texts.append(text)
        self.links.append(0)
        return len(self.tags) - 1

    def _pop(self) -> None:
        tag = self.open.pop()
        self.count[tag] -= 1
        if tag in MARKUP:
            self.silent -= 1
        elif tag == "a":
            self.anchors -= 1
        elif tag not in INLINE:
            self.blocks.pop()
            self.run = -1

    def _pop_to(self, tags: set[str]) -> None:
        """Close the innermost open element of ``tags`` and what is open inside it."""
        while self.open[-1] not in tags:
            self._pop()
        self._pop()

    def _end_head(self) -> None:
        while self.count["head"]:
            self._pop_to({"head"})

    def handle_starttag(self, tag: str, attrs) -> None:
        # A page may leave out the end tag of its head; what stands in an open template or noscript does not end it.
        if tag == "body" or (tag not in HEAD_TAGS and not self.count["template"] and not self.count["noscript"]):
            self._end_head()
        if tag in VOID:
            if tag in ("br", "hr") and self.run >= 0:
                self.texts[self.run].append(" ")
            return
        if tag not in INLINE and tag not in MARKUP:
            if self.count["p"]:  # a block ends an open paragraph
                self._pop_to({"p"})
            if tag in CLOSES and any(self.count[t] for t in CLOSES[tag]):
                inner = len(self.open) - 1
                while inner and self.open[inner] not in CLOSES[tag] and self.open[inner] not in ("ul", "ol", "dl", "table"):
                    inner -= 1
                if self.open[inner] in CLOSES[tag]:
                    while len(self.open) > inner:
                        self._pop()
        self.open.append(tag)
        self.count[tag] += 1
        if tag in MARKUP:
            self.silent += 1
        elif tag == "a":
            self.anchors += 1
        elif tag not in INLINE:
            words = " ".join(v for k, v in attrs if v and k in ("class", "id", "role")).lower()
            self.blocks.append(self._node(tag, tuple(re.findall(r"[a-z]+", words)), None))
            self.run = -1

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.count[tag]:
            self._pop_to({tag})

    def handle_data(self, data: str) -> None:
        if self.open[-1] == "head" and data.strip():  # text cannot stand in a head
            self._end_head()
        if self.silent:
            return
        if self.run < 0:
            if not data.strip():
                return
            self.run = self._node("#text", (), [])
        self.texts[self.run].append(data)
        if self.anchors:
            self.links[self.run] += len(data)

    def blocks_of(self, keep) -> list[str]:
        """Text of the kept runs, white space made single spaces, without empty ones."""
        out = [" ".join("".join(t).split()) for t, k in zip(self.texts, keep) if k and t is not None]
        return [t for t in out if t]


def signs(page: Page) -> tuple[list[int], list[int]]:
    """1 for nodes whose own tag or words stand for main text, and for other matter."""
    main = [int(t in MAIN_TAGS or not MAIN_WORDS.isdisjoint(w)) for t, w in zip(page.tags, page.tokens)]
    other = [int(t in OTHER_TAGS or not OTHER_WORDS.isdisjoint(w)) for t, w in zip(page.tags, page.tokens)]
    return [m and not o for m, o in zip(main, other)], other


def by_convention(page: Page) -> list[int] | None:
    """Main (1) or not (0) by the page's own signs, or null if it has none for main text.

    A text run is main if it stands inside an element for main text and in no element for other matter, other than a
    header inside the former. An element is main if a run in it is.
    """
    main, other = signs(page)
    if not any(main):
        return None
    inside, dropped, out = [0] * len(main), [0] * len(main), [0] * len(main)
    for i, parent in enumerate(page.parents):
        above, gone = (inside[parent], dropped[parent]) if parent >= 0 else (0, 0)
        inside[i] = above or main[i]
        dropped[i] = gone or (other[i] and not (page.tags[i] == "header" and above))
        if page.texts[i] is not None and inside[i] and not dropped[i]:
            out[i] = 1
    for i in range(len(out) - 1, 0, -1):
        out[page.parents[i]] |= out[i]
    return out


def by_density(page: Page) -> list[int]:
    """Main (1) or not (0) for a page without signs for main text, by its runs' lengths and shares of link text.

    A run is main if it is long and mostly no link, or such a run's sibling that is mostly no link; without long runs all
    that are mostly no link are. Runs in elements for other matter are not.
    """
    _, other = signs(page)
    dropped, plain, out = [0] * len(other), [0] * len(other), [0] * len(other)
    long = set()  # parents, and theirs, of long runs
    for i, parent in enumerate(page.parents):
        dropped[i] = other[i] or (dropped[parent] if parent >= 0 else 0)
        if page.texts[i] is not None and not dropped[i]:
            chars = len("".join(page.texts[i]))
            plain[i] = int(3 * page.links[i] <= chars)
            if plain[i] and chars >= LONG_RUN:
                long |= {parent, page.parents[parent]}
    for i, parent in enumerate(page.parents):
        out[i] = int(plain[i] and (not long or parent in long or page.parents[parent] in long))
    for i in range(len(out) - 1, 0, -1):
        out[page.parents[i]] |= out[i]
    return out


def features(page: Page) -> np.ndarray:
    """One row per node: densities of its subtree, place, siblings, own and inherited signs, hashed words."""
    n = len(page.tags)
    main, other = signs(page)
    chars, links, marks, tags, children, depth = ([0] * n for _ in range(6))
    above_main, above_other, place = [0] * n, [0] * n, [0] * n
    for i in range(n):
        p = page.parents[i]
        if p >= 0:
            depth[i] = depth[p] + 1
            above_main[i] = above_main[p] or main[p]
            above_other[i] = above_other[p] or other[p]
            place[i] = children[p]
            children[p] += 1
        if page.texts[i] is not None:
            text = "".join(page.texts[i])
            chars[i], links[i], marks[i] = len(text), page.links[i], len(_PUNCTUATION.findall(text))
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        chars[p] += chars[i]
        links[p] += links[i]
        marks[p] += marks[i]
        tags[p] += tags[i] + 1
    most = [0] * n
    for i in range(1, n):
        most[page.parents[i]] = max(most[page.parents[i]], chars[i])
    out = np.zeros((n, FEATURES))
    for i in range(n):
        p = max(0, page.parents[i])
        c, k, tag = chars[i], max(1, children[p]), page.tags[i]
        row = (
            depth[i], math.log1p(c), c / max(1, chars[0]), links[i] / max(1, c), math.log1p(c / (tags[i] + 1)),
            math.log1p(children[i]), place[i] / k, math.log1p(k), math.log1p(chars[p] / k), c / max(1, most[p]),
            100 * marks[i] / max(1, c), main[i], other[i], above_main[i], above_other[i],
            tag in HEADINGS, tag == "p", tag in ("li", "ul", "ol"), tag == "#text", above_main[i] and tag == "header",
        )
        out[i, :20] = row
        for word in page.tokens[i]:
            out[i, 20 + zlib.crc32(word.encode()) % BUCKETS] += 1
    return out
