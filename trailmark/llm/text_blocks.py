"""Main text of web pages: flat text blocks classified by a decision tree.

A page is read once by a tokenizer for tags, comments and text. Block-level tags cut its text
into flat blocks. Each block is described by its own word count and link density, those of the
blocks before and after it, and what encloses it: how near the closest container is that is meant
for content, and whether a container is meant for something else (by tag name, role or a word of
its class or id), or only named by a word that may as well be its topic. A decision tree, grown at
start from the small labelled table ``LABELLED``, keeps or drops each block. Scripts, styles, forms,
comments and markup never become blocks.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.shared import map_text

# Names of HTML elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INVISIBLE = frozenset(
    "script style noscript template svg math iframe object canvas audio video head title select textarea button form "
    "datalist option map".split()
)
RAW = frozenset("script style textarea title noscript iframe xmp template".split())  # read up to their own end tag
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span "
    "strike strong sub sup time tt u var wbr img".split()
)
CONTENT_TAGS = frozenset("article main".split())
OTHER_TAGS = frozenset("nav header footer aside menu dialog fieldset".split())
# Whole words of class, id and role attributes.
CONTENT_WORDS = frozenset(
    "article articles articlebody articlecontent articletext main maincontent mainbody content contents contentbody post posts postbody "
    "postcontent posttext story stories storybody storycontent entry entries entrycontent body bodytext bodycontent text textbody prose "
    "pagecontent blogpost".split()
)
OTHER_WORDS = frozenset(
    "nav navs navbar navigation topnav subnav sidenav sitenav mainnav menu menus submenu mainmenu header headers siteheader pageheader masthead "
    "footer footers sitefooter pagefooter sidebar sidebars leftsidebar rightsidebar aside widget widgets advert adverts advertisement "
    "advertisements advertising advertorial adsense sponsor sponsors sponsored promo promos promotion promotions promoted banner banners notice "
    "notices cookie cookies cookiebar cookiebanner consent gdpr popup popups modal modals overlay overlays newsletter newsletters subscribe "
    "subscription signup login comment comments commentlist commentform disqus reply replies respond response responses discussion discussions "
    "feedback share shares sharebar sharing sharebuttons social socials socialmedia related relatedposts recommend recommended recommendation "
    "recommendations trending popular breadcrumb breadcrumbs crumb crumbs pagination pager tagcloud copyright legal disclaimer disclaimers "
    "toolbar toolbars skip skiplink search searchbox searchform searchbar complementary contentinfo alert alerts toc outbrain taboola ad ads adv "
    "meta tags rail side foot head topbar bar tools links".split()
)
OTHER_NAMES = frozenset("sign-up author-bio byline-box".split())  # words that count only together
ASIDE_WORDS = frozenset("comment comments reply replies promo promos teaser teasers related".split())  # of an article that is not the page's
# Of OTHER_WORDS those that may name a topic: as the id of a section or heading, or beside a class for content.
TOPIC_WORDS = frozenset(
    "discussion discussions tools links related response responses respond legal feedback search popular trending recommended "
    "recommendation recommendations share shares sharing social meta tags rail side foot head bar alert alerts".split()
)
TITLED = frozenset("section h1 h2 h3 h4 h5 h6".split())
TEASER_WORDS = frozenset("promo promos teaser teasers related".split())  # a page's only article is its own all the same
LAYOUT = frozenset("has with no without".split())  # begin names that tell what else the page holds

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
PART = re.compile(r"[_\W]+|(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")

NONE, CONTENT, OTHER, GONE, TOPIC, TEASER = range(6)
PLACES = (CONTENT, OTHER, TOPIC, TEASER)  # roles that hold for what is inside, the nearest one first


@dataclass
class Block:
    text: str
    words: int
    linked: int
    content: bool  # inside a container for content
    other: float  # the nearest container is for something else: 1, may be: 0.5, is not: 0
    heading: bool
    item: bool  # of a list
    teaser: bool  # the nearest container is an article that seems to point to another page


def _role(tag: str, attributes: str) -> int:
    """What an element is for: nothing special, content, other matter (surely or perhaps), a teaser, or not shown."""
    if tag in INVISIBLE:
        return GONE
    names: list[list[str]] = []
    ids: list[list[str]] = []
    if attributes and ("=" in attributes or "hidden" in attributes.lower()):
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return GONE
            if name == "style":
                if "display:none" in value.lower().replace(" ", ""):
                    return GONE
            elif name in ("class", "id", "role"):
                (ids if name == "id" else names).extend([p.lower() for p in PART.split(one) if p] for one in value.split())
    if tag in ("html", "body", "pre"):
        return NONE
    names = [parts for parts in names if parts and parts[0] not in LAYOUT]
    ids = [parts for parts in ids if parts and parts[0] not in LAYOUT]
    classes = {p for parts in names for p in parts}
    words = classes | {p for parts in ids for p in parts}
    if tag in OTHER_TAGS:
        return OTHER
    if tag in CONTENT_TAGS:
        aside = words & ASIDE_WORDS
        return (TEASER if aside <= TEASER_WORDS else OTHER) if aside else CONTENT
    other = words & OTHER_WORDS
    if any("-".join(pair) in OTHER_NAMES for parts in names + ids for pair in zip(parts, parts[1:])):
        return OTHER
    if other:
        named = tag in TITLED and not classes & OTHER_WORDS
        beside = any(CONTENT_WORDS.issuperset(parts) for parts in names)
        return TOPIC if other <= TOPIC_WORDS and (named or beside) else OTHER
    return CONTENT if words & CONTENT_WORDS else NONE


class _Open:
    """Open elements, innermost last; what a block needs to know of them takes no walk."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, int, int]] = []  # name ("" once closed early), role, nearest place, content containers
        self.at: dict[str, list[int]] = {}  # name -> its places in the stack
        self.outer: list[int] = []  # places of elements that are not inline
        self.gone = self.links = 0

    def place(self) -> int:
        return self.stack[-1][2] if self.stack else NONE

    def content(self) -> bool:
        return bool(self.stack and self.stack[-1][3])

    def add(self, tag: str, role: int) -> None:
        if tag in ("p", "li"):
            self._close_open(tag)
        place = role if role in PLACES else self.place()
        held = (self.stack[-1][3] if self.stack else 0) + (role == CONTENT)
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.outer.append(len(self.stack))
        self.stack.append((tag, role, place, held))
        self.gone += role == GONE
        self.links += tag == "a"

    def end(self, tag: str) -> None:
        """Close the innermost ``tag`` and all inside of it; an inline one only if nothing else is inside."""
        if not self.at.get(tag):
            return
        depth = self.at[tag][-1]
        if tag in INLINE and self.outer and self.outer[-1] > depth:
            return
        while len(self.stack) > depth:
            name, role, _, _ = self.stack.pop()
            if name:
                self.at[name].pop()
                if name not in INLINE:
                    self.outer.pop()
                self.gone -= role == GONE
                self.links -= name == "a"

    def _close_open(self, tag: str) -> None:
        """Forget an open ``tag``, which never holds itself, if only inline elements lie above it."""
        if self.at.get(tag) and self.outer[-1] == self.at[tag][-1] and self.stack[self.outer[-1]][1] == NONE:
            self.at[tag].pop()
            depth = self.outer.pop()
            self.stack[depth] = ("", *self.stack[depth][1:])


def blocks(page: str) -> list[Block]:
    """Flat text blocks in page order; white space inside a block is one space."""
    found: list[Block] = []
    opened = _Open()
    held: list[str] = []
    linked: list[str] = []
    heading = False
    teasers = 0

    def flush() -> None:
        if held:
            text = SPACE.sub(" ", html.unescape("".join(held))).strip()
            if text:
                inner = SPACE.sub(" ", html.unescape(" ".join(linked))).split()
                place, words = opened.place(), text.count(" ") + 1
                other = {OTHER: 1.0, TEASER: 1.0, TOPIC: 0.5}.get(place, 0.0)
                listed = bool(opened.at.get("li"))
                found.append(Block(text, words, min(len(inner), words), opened.content(), other, heading, listed, place == TEASER))
            held.clear()
            linked.clear()

    at, size = 0, len(page)
    while at < size:
        cut = page.find("<", at)
        cut = size if cut < 0 else cut
        if cut > at and not opened.gone:
            held.append(page[at:cut])
            if opened.links:
                linked.append(page[at:cut])
        if cut == size:
            break
        token = TOKEN.match(page, cut)
        if token is None:  # a bare "<" is text
            if not opened.gone:
                held.append("<")
            at = cut + 1
            continue
        at, tag = token.end(), (token[2] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            flush()
            heading = not token[1] and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        if token[1]:
            opened.end(tag)
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
        elif tag not in VOID and not token[3].endswith("/"):
            role = _role(tag, token[3])
            teasers += role == TEASER
            opened.add(tag, role)
    flush()
    if teasers == 1 and not any(b.content and not b.other for b in found):  # the page's only article
        for block in found:
            if block.teaser:
                block.content, block.other = True, 0.0
    return found


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "content", "other", "page_has_content", "heading")

# Small labelled table: one block per row, FEATURES in order but for the last, then 1 for main text.
PLAIN = np.array(
    [
        # paragraphs of an article, long, short, first, last, with links
        (60, 0.0, 12, 0.0, 45, 0.0, 1, 0, 1, 1), (35, 0.1, 60, 0.0, 50, 0.0, 1, 0, 1, 1), (8, 0.0, 40, 0.0, 33, 0.0, 1, 0, 1, 1),
        (2, 0.0, 30, 0.0, 28, 0.0, 1, 0, 1, 1), (1, 0.0, 50, 0.0, 4, 0.0, 1, 0, 1, 1), (9, 0.0, 5, 0.0, 80, 0.0, 1, 0, 1, 1),
        (3, 0.0, 1, 1.0, 60, 0.0, 1, 0, 1, 1), (80, 0.05, 9, 0.0, 6, 0.2, 1, 0, 1, 1), (5, 0.0, 70, 0.0, 7, 0.1, 1, 0, 1, 1),
        (20, 0.4, 35, 0.0, 40, 0.0, 1, 0, 1, 1), (4, 0.5, 20, 0.0, 30, 0.0, 1, 0, 1, 1), (200, 0.0, 2, 0.0, 1, 0.0, 1, 0, 1, 1),
        (1, 0.0, 1, 0.0, 1, 0.0, 1, 0, 1, 1), (12, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1, 1), (3, 1.0, 30, 0.0, 40, 0.0, 1, 0, 1, 1),
        # links among links inside of an article; a single one between or above paragraphs is text of it
        (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 1, 0), (2, 1.0, 3, 1.0, 2, 1.0, 1, 0, 1, 0), (7, 1.0, 6, 1.0, 8, 1.0, 1, 0, 1, 0),
        (12, 1.0, 10, 1.0, 14, 0.9, 1, 0, 1, 0), (4, 0.9, 60, 0.0, 5, 1.0, 1, 0, 1, 0), (3, 1.0, 25, 0.1, 2, 1.0, 1, 0, 1, 0),
        (5, 1.0, 4, 1.0, 0, 0.0, 1, 0, 1, 0), (3, 1.0, 4, 1.0, 50, 0.0, 1, 0, 1, 0), (2, 1.0, 2, 1.0, 9, 0.0, 1, 0, 1, 0),
        (1, 1.0, 45, 0.0, 35, 0.0, 1, 0, 1, 1), (6, 1.0, 20, 0.1, 25, 0.0, 1, 0, 1, 1), (7, 1.0, 0, 0.0, 60, 0.0, 1, 0, 1, 1),
        (2, 1.0, 40, 0.0, 0, 0.0, 1, 0, 1, 1), (30, 0.6, 2, 1.0, 2, 1.0, 1, 0, 1, 1), (50, 0.2, 3, 1.0, 4, 1.0, 1, 0, 1, 1),
        (20, 0.0, 2, 1.0, 3, 1.0, 1, 0, 1, 1), (3, 0.0, 2, 1.0, 2, 1.0, 1, 0, 1, 1),
        # menus, headers, footers, sidebars, notices, adverts and comments, inside an article or not
        (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 1, 0), (2, 1.0, 1, 1.0, 2, 1.0, 0, 1, 1, 0), (7, 0.0, 1, 1.0, 9, 0.0, 0, 1, 1, 0),
        (40, 0.0, 2, 1.0, 10, 0.0, 0, 1, 1, 0), (25, 0.0, 50, 0.0, 30, 0.0, 1, 1, 1, 0), (60, 0.0, 45, 0.0, 50, 0.0, 1, 1, 1, 0),
        (6, 0.5, 50, 0.0, 3, 1.0, 1, 1, 1, 0), (4, 0.0, 40, 0.0, 0, 0.0, 0, 1, 1, 0), (90, 0.0, 4, 0.0, 70, 0.0, 0, 1, 0, 0),
        (50, 0.1, 6, 0.2, 20, 0.0, 0, 1, 0, 0), (1, 0.0, 3, 1.0, 40, 0.0, 0, 1, 0, 0), (15, 0.0, 1, 0.0, 12, 0.0, 1, 1, 1, 0),
        # in the article, under a name that may be its topic: paragraphs are text, links and notes beside links are not
        (40, 0.0, 30, 0.0, 35, 0.0, 1, 0.5, 1, 1), (2, 0.0, 30, 0.0, 40, 0.0, 1, 0.5, 1, 1), (12, 0.1, 3, 0.0, 0, 0.0, 1, 0.5, 1, 1),
        (25, 0.2, 2, 0.0, 60, 0.0, 1, 0.5, 1, 1), (60, 0.0, 1, 0.0, 2, 1.0, 1, 0.5, 1, 1), (1, 0.0, 40, 0.0, 15, 0.0, 1, 0.5, 1, 1),
        (3, 1.0, 2, 1.0, 4, 1.0, 1, 0.5, 1, 0), (2, 1.0, 40, 0.0, 3, 1.0, 1, 0.5, 1, 0), (2, 0.0, 40, 0.0, 3, 1.0, 1, 0.5, 1, 0),
        (4, 0.9, 3, 1.0, 0, 0.0, 1, 0.5, 1, 0), (9, 0.7, 20, 0.0, 8, 0.8, 1, 0.5, 1, 0), (30, 0.0, 4, 1.0, 3, 0.0, 0, 0.5, 1, 0),
        (40, 0.0, 30, 0.0, 20, 0.0, 0, 0.5, 0, 0), (3, 0.0, 25, 0.0, 40, 0.0, 0, 0.5, 0, 0), (15, 0.1, 9, 0.0, 9, 0.0, 0, 0.5, 1, 0),
        # outside of the article of a page that has one
        (30, 0.0, 4, 1.0, 30, 0.0, 0, 0, 1, 0), (8, 0.0, 1, 1.0, 6, 0.0, 0, 0, 1, 0), (3, 0.0, 60, 0.0, 0, 0.0, 0, 0, 1, 0),
        (45, 0.0, 3, 0.0, 60, 0.0, 0, 0, 1, 0), (25, 0.1, 35, 0.0, 30, 0.0, 0, 0, 1, 0), (90, 0.0, 70, 0.0, 80, 0.0, 0, 0, 1, 0),
        (14, 0.0, 5, 0.0, 40, 0.0, 0, 0, 1, 0), (22, 0.0, 8, 0.0, 3, 0.0, 0, 0, 1, 0), (33, 0.0, 2, 0.0, 9, 0.0, 0, 0, 1, 0),
        (5, 1.0, 20, 0.0, 3, 1.0, 0, 0, 1, 0), (70, 0.0, 40, 0.0, 2, 1.0, 0, 0, 1, 0), (1, 0.0, 1, 1.0, 2, 0.0, 0, 0, 1, 0),
        # pages that mark no article: long blocks, and short ones beside long ones, are main text
        (50, 0.0, 5, 0.0, 40, 0.0, 0, 0, 0, 1), (25, 0.1, 40, 0.0, 30, 0.0, 0, 0, 0, 1), (15, 0.0, 30, 0.0, 25, 0.0, 0, 0, 0, 1),
        (6, 0.0, 40, 0.0, 35, 0.0, 0, 0, 0, 1), (3, 0.0, 25, 0.0, 60, 0.0, 0, 0, 0, 1), (100, 0.2, 2, 1.0, 3, 1.0, 0, 0, 0, 1),
        (9, 0.0, 2, 0.5, 60, 0.0, 0, 0, 0, 1), (14, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (20, 0.0, 3, 1.0, 4, 0.0, 0, 0, 0, 1),
        (50, 0.0, 60, 0.0, 4, 0.0, 0, 0, 0, 1), (30, 0.0, 45, 0.0, 0, 0.0, 0, 0, 0, 1), (80, 0.0, 100, 0.1, 12, 0.0, 0, 0, 0, 1),
        (18, 0.0, 25, 0.0, 2, 1.0, 0, 0, 0, 1), (40, 0.1, 15, 0.0, 8, 0.0, 0, 0, 0, 1), (16, 0.0, 90, 0.0, 6, 0.5, 0, 0, 0, 1),
        (2, 1.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0), (5, 0.8, 60, 0.0, 4, 1.0, 0, 0, 0, 0),
        (4, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0), (3, 0.0, 4, 0.0, 2, 0.0, 0, 0, 0, 0), (30, 0.9, 20, 0.0, 15, 0.5, 0, 0, 0, 0),
        (1, 1.0, 1, 1.0, 30, 0.0, 0, 0, 0, 0), (3, 1.0, 2, 1.0, 60, 0.0, 0, 0, 0, 0), (2, 1.0, 50, 0.0, 1, 1.0, 0, 0, 0, 0),
        (8, 1.0, 70, 0.0, 40, 0.0, 0, 0, 0, 0), (15, 0.9, 3, 0.0, 25, 0.1, 0, 0, 0, 0), (4, 0.8, 12, 0.0, 12, 0.0, 0, 0, 0, 0),
        (12, 0.7, 12, 0.8, 12, 0.9, 0, 0, 0, 0), (2, 0.0, 3, 1.0, 1, 0.0, 0, 0, 0, 0), (6, 0.0, 1, 0.0, 3, 0.6, 0, 0, 0, 0),
    ]
)
HEADINGS = np.array(
    [
        # of an article, above text, lists or other headings; above links only
        (3, 0.0, 20, 0.0, 50, 0.0, 1, 0, 1, 1), (2, 0.0, 1, 0.0, 3, 0.0, 1, 0, 1, 1), (6, 0.0, 0, 0.0, 30, 0.1, 1, 0, 1, 1),
        (4, 0.0, 60, 0.0, 8, 0.2, 1, 0, 1, 1), (1, 0.0, 2, 1.0, 40, 0.0, 1, 0, 1, 1), (8, 0.5, 3, 1.0, 60, 0.0, 1, 0, 1, 1),
        (5, 1.0, 4, 1.0, 70, 0.0, 1, 0, 1, 1), (2, 0.0, 30, 0.0, 0, 0.0, 1, 0, 1, 1), (7, 0.1, 45, 0.0, 20, 0.0, 1, 0, 1, 1),
        (3, 0.0, 30, 0.0, 40, 0.0, 1, 0.5, 1, 1), (2, 0.0, 40, 0.0, 6, 0.0, 1, 0.5, 1, 1), (1, 0.0, 20, 0.0, 25, 0.1, 1, 0.5, 1, 1),
        (1, 0.0, 40, 0.0, 2, 1.0, 1, 0.5, 1, 0), (2, 0.0, 30, 0.0, 3, 1.0, 1, 0.5, 1, 0), (2, 0.0, 15, 0.0, 7, 0.9, 1, 0.5, 1, 0),
        # of other matter, with and without an article on the page
        (2, 0.0, 1, 1.0, 30, 0.0, 0, 1, 1, 0), (2, 0.0, 30, 0.0, 30, 0.0, 0, 1, 0, 0), (1, 0.0, 60, 0.0, 20, 0.0, 1, 1, 1, 0),
        (3, 0.0, 40, 0.0, 50, 0.0, 1, 1, 1, 0), (4, 1.0, 2, 1.0, 3, 1.0, 0, 1, 0, 0), (2, 0.0, 0, 0.0, 60, 0.0, 0, 1, 0, 0),
        (2, 0.0, 30, 0.0, 30, 0.0, 0, 0.5, 1, 0), (3, 0.0, 30, 0.0, 40, 0.0, 0, 0, 1, 0), (5, 0.0, 1, 1.0, 60, 0.0, 0, 0, 1, 0),
        (4, 0.0, 2, 0.0, 20, 0.0, 0, 0, 1, 0), (1, 0.0, 30, 0.0, 0, 0.0, 0, 0, 1, 0), (6, 1.0, 20, 0.0, 30, 0.0, 0, 0, 1, 0),
        # of pages that mark no article: above text they belong to it, above links or a few words they do not
        (2, 0.0, 1, 1.0, 40, 0.0, 0, 0, 0, 1), (2, 0.0, 0, 0.0, 40, 0.0, 0, 0, 0, 1), (5, 0.0, 2, 1.0, 70, 0.1, 0, 0, 0, 1),
        (9, 0.0, 3, 0.0, 25, 0.0, 0, 0, 0, 1), (1, 0.0, 3, 0.8, 28, 0.0, 0, 0, 0, 1), (4, 0.0, 30, 0.0, 90, 0.2, 0, 0, 0, 1),
        (1, 0.0, 40, 0.0, 2, 1.0, 0, 0, 0, 0), (2, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0), (2, 1.0, 4, 0.0, 8, 0.0, 0, 0, 0, 0),
        (3, 0.0, 4, 0.0, 2, 0.0, 0, 0, 0, 0), (4, 0.0, 50, 0.0, 0, 0.0, 0, 0, 0, 0), (2, 0.0, 30, 0.0, 30, 0.0, 0, 0.5, 0, 0),
    ]
)
LABELLED = np.vstack([np.insert(PLAIN, -1, 0, axis=1), np.insert(HEADINGS, -1, 1, axis=1)])


def grow(table: np.ndarray, depth: int = 6):
    """Binary tree by Gini impurity: a leaf is the share of ones, a node (feature, threshold, left, right).

    Headings, which are short, are set apart before the greedy splits, as these would part them from other
    blocks by chance.
    """
    kind = len(FEATURES) - 1
    headings = table[:, kind] > 0.5
    if headings.any() and not headings.all():
        return kind, 0.5, grow(table[~headings], depth), grow(table[headings], depth)
    x, y = table[:, :-1], table[:, -1]
    if depth == 0 or y.min() == y.max():
        return float(y.mean())
    best = (np.inf, 0, 0.0)
    for feature in range(x.shape[1]):
        values = np.unique(x[:, feature])
        for threshold in (values[:-1] + values[1:]) / 2:
            left = x[:, feature] <= threshold
            impurity = sum(p.mean() * (1 - p.mean()) * len(p) for p in (y[left], y[~left]))
            best = min(best, (impurity, feature, float(threshold)))
    if np.isinf(best[0]):
        return float(y.mean())
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(table[left], depth - 1), grow(table[~left], depth - 1)


def is_main(tree, row: tuple) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


def features(found: list[Block]) -> list[tuple]:
    """One row per block. A heading's next block is the first that is none; the neighbours of a list's plain items are the list's."""
    marked = any(b.content and not b.other for b in found)
    sizes = [(b.words, b.linked / b.words) for b in found]
    plain = [b.item and density < 0.5 for b, (_, density) in zip(found, sizes)]

    def neighbours(order: range) -> list[tuple[int, float]]:
        """The block met before each one in this order."""
        met: list[tuple[int, float]] = [(0, 0.0)] * len(found)
        last = None
        for i in order:
            if last is not None:
                passed = plain[i] and plain[last] or order.step < 0 and found[i].heading and found[last].heading
                met[i] = met[last] if passed else sizes[last]
            last = i
        return met

    before, after = neighbours(range(len(found))), neighbours(range(len(found) - 1, -1, -1))
    places = [(int(b.content), b.other, int(marked), int(b.heading)) for b in found]
    return [(*size, *b, *a, *place) for size, b, a, place in zip(sizes, before, after, places)]


def main_text(page: str, tree) -> tuple[str, int, int]:
    """The main text, its number of blocks and the number of all blocks of one page."""
    found = blocks(page)
    kept = [b.text for b, row in zip(found, features(found)) if is_main(tree, row)]
    return " ".join(kept), len(kept), len(found)


def extract(pages: DataFrame, labelled: np.ndarray = LABELLED) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points), n_kept, n_blocks.

    A null, empty or blank page gives an empty text. Pages of any length are read whole, in time linear
    in their length. Repeated rows give repeated results; other columns are left out.
    """
    tree = grow(labelled)

    def work(found: list[str]) -> dict[str, object]:
        done = [main_text(page, tree) for page in found]
        return {
            "text": [t for t, _, _ in done], "n_chars": [len(t) for t, _, _ in done],
            "n_kept": [k for _, k, _ in done], "n_blocks": [n for _, _, n in done],
        }

    fields = [("text", T.StringType()), ("n_chars", T.LongType()), ("n_kept", T.LongType()), ("n_blocks", T.LongType())]
    return map_text(pages.select("page_id", "url", "html"), fields, work, text="html")
