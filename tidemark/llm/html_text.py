"""HTML extraction: flat text blocks classified by a decision tree on word counts and link density.

A page becomes a flat list of blocks, none cut beforehand: the text between block-level tags, from menus and footers as well.  Each has its
number of words, its link density (share of words inside links), the same two of the blocks before and after it, where it stands
(outside what the page marks as its article, on a page that marks none, inside) and whether an element or a name sets it
apart (menu, form, advert, reader comments).  One tree grown from the labelled table below says from these eight figures which
blocks are main text; scripts, styles, hidden elements and the like are no text at all.

The page is read forwards once: what a search for a tag's or an element's end has found to be missing is remembered, so unclosed tags,
quotes and elements cost no more than closed ones.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import map_batches

# Element names by their role.
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr td th "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle mspace semantics".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = "script style noscript template textarea title svg iframe object select button canvas audio video head annotation".split()
APART = set("nav footer aside form dialog menu fieldset".split())
ARTICLE = set("article main".split())
# Words of class, id and role attributes.  These set apart wherever they stand, alone, as the last part of a name (post-comments),
# or as its first part before one of PARTS (comments-area).
APART_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies gdpr paywall menu nav navbar navigation sidebar aside comment "
    "comments commentlist disqus newsletter breadcrumb breadcrumbs pagination pager footer login signup popup modal contentinfo complementary".split()
)
# Of these, the ones that are a topic as often as a part of the page, when they stand inside an article.
TOPICS = set("menu nav login signup aside footer comment popup modal pager".split())
PARTS = set(
    "area bar block body bottom box container content count form frame head header inner item items left link links list main menu nav notice overlay panel right section slot "
    "text thread top unit widget widgets wrap wrapper banner consent message message-box modal popup".split()
)
# These set apart only as a whole name outside an article, where they may be a topic.
OUTER_WORDS = set("alert banner consent disclaimer header masthead notice notices overlay promotion rail related recommended replies respond search share sharing side social subscribe subscription toolbar topbar widget".split())
ARTICLE_WORDS = set("article post entry story content main body text".split())

NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
STOPS = re.compile("[>\"']")
ATTRIBUTES = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NONE_SHOWN = re.compile(r"display\s*:\s*none", re.I)
CUT = re.compile(r"[-_]+")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "place", "apart")
OUTSIDE, NOWHERE, INSIDE = 0, 1, 2
#: The labelled table: the first six FEATURES, then 1 for main text.  Blocks inside a marked article (16 of ``pages``, the others of laid-out articles with
#: links and lists of links); blocks of laid-out pages that mark nothing, with menus, notices and footers in plain ``div``; blocks outside a marked
#: article, and blocks that an element or a name sets apart, of ``pages`` and of laid-out pages.
MARKED = (
    (198, 0.00, 57, 0.00, 30, 0.00, 1), (113, 0.00, 117, 0.00, 30, 0.00, 1), (72, 0.00, 61, 0.00, 120, 0.00, 1), (3, 0.00, 11, 0.00, 23, 0.00, 1), (59, 0.00, 50, 0.00, 15, 0.00, 1),
    (1, 0.00, 1, 0.00, 37, 0.00, 1), (22, 0.00, 51, 0.00, 0, 0.00, 1), (30, 0.00, 33, 0.00, 45, 0.00, 1), (38, 0.00, 3, 0.00, 36, 0.00, 1), (11, 0.00, 38, 0.00, 3, 0.00, 1),
    (15, 0.00, 27, 0.00, 46, 0.00, 1), (7, 0.00, 7, 0.00, 3, 0.00, 1), (1, 0.00, 45, 0.00, 30, 0.00, 1), (1, 0.00, 2, 0.00, 15, 0.00, 1), (1, 0.00, 41, 0.00, 91, 0.00, 1),
    (1, 0.00, 46, 0.00, 76, 0.00, 1), (4, 0.75, 7, 0.00, 3, 0.67, 1), (43, 0.07, 33, 0.00, 5, 0.80, 1), (2, 1.00, 43, 0.07, 45, 0.00, 1), (1, 1.00, 25, 0.04, 41, 0.00, 1),
    (34, 0.09, 34, 0.03, 35, 0.03, 1), (45, 0.11, 5, 0.00, 20, 0.25, 1), (50, 0.06, 2, 0.00, 91, 0.00, 1), (22, 0.09, 29, 0.00, 34, 0.03, 1), (3, 0.67, 4, 0.75, 98, 0.00, 1),
    (5, 0.40, 9, 0.00, 27, 0.00, 1), (35, 0.03, 3, 0.00, 1, 1.00, 1), (31, 0.13, 7, 0.00, 3, 0.67, 1), (1, 1.00, 25, 0.16, 31, 0.00, 1), (37, 0.08, 2, 0.00, 25, 0.16, 1),
    (28, 0.07, 6, 0.00, 3, 0.00, 1), (1, 1.00, 35, 0.03, 21, 0.00, 1), (25, 0.20, 94, 0.00, 17, 0.12, 1), (25, 0.08, 37, 0.03, 0, 0.00, 1), (5, 0.60, 4, 0.00, 4, 0.75, 1),
    (37, 0.03, 25, 0.12, 25, 0.08, 1), (3, 0.33, 95, 0.00, 30, 0.00, 1), (21, 0.10, 2, 0.00, 13, 0.23, 1), (30, 0.13, 32, 0.00, 4, 0.00, 1), (34, 0.03, 22, 0.09, 11, 0.18, 1),
    (3, 0.67, 71, 0.00, 1, 1.00, 1), (45, 0.00, 2, 1.00, 0, 0.00, 1), (88, 0.00, 43, 0.00, 1, 1.00, 1), (92, 0.00, 85, 0.00, 2, 1.00, 1), (88, 0.00, 102, 0.00, 2, 1.00, 1),
    (24, 0.04, 12, 0.17, 1, 1.00, 1), (5, 0.00, 24, 0.04, 1, 1.00, 1), (34, 0.00, 6, 0.83, 0, 0.00, 1), (3, 0.00, 2, 1.00, 0, 0.00, 1), (24, 0.00, 1, 1.00, 28, 0.04, 1),
    (41, 0.00, 1, 1.00, 0, 0.00, 1), (48, 0.02, 92, 0.00, 1, 1.00, 1), (50, 0.00, 2, 1.00, 119, 0.00, 1), (64, 0.00, 21, 0.00, 2, 1.00, 1), (27, 0.00, 5, 0.40, 2, 1.00, 1),
    (33, 0.09, 11, 0.18, 2, 1.00, 1), (35, 0.00, 1, 1.00, 0, 0.00, 1), (35, 0.03, 3, 0.00, 1, 1.00, 1), (26, 0.00, 2, 1.00, 78, 0.00, 1), (17, 0.12, 13, 0.23, 3, 1.00, 1),
    (1, 1.00, 25, 0.04, 41, 0.00, 1), (1, 1.00, 5, 0.00, 16, 0.00, 1), (1, 1.00, 35, 0.03, 21, 0.00, 1), (2, 1.00, 88, 0.00, 50, 0.00, 1), (3, 1.00, 40, 0.00, 1, 1.00, 1),
    (1, 1.00, 22, 0.00, 1, 1.00, 1), (1, 1.00, 1, 1.00, 1, 1.00, 1), (1, 1.00, 1, 1.00, 18, 0.00, 1), (2, 1.00, 3, 1.00, 0, 0.00, 1), (2, 1.00, 1, 0.00, 30, 0.00, 1),
    (2, 1.00, 2, 1.00, 2, 1.00, 1),
)
UNMARKED = (
    (3, 1.00, 0, 0.00, 2, 1.00, 0), (3, 1.00, 0, 0.00, 1, 1.00, 0), (1, 1.00, 6, 0.83, 5, 0.20, 0), (8, 0.50, 7, 0.71, 0, 0.00, 0), (2, 1.00, 3, 0.00, 15, 0.07, 0),
    (1, 1.00, 3, 1.00, 4, 0.75, 0), (4, 0.00, 2, 1.00, 3, 0.67, 0), (2, 1.00, 1, 1.00, 3, 0.00, 0), (4, 0.75, 6, 0.83, 7, 0.43, 0), (1, 1.00, 3, 1.00, 1, 1.00, 0),
    (9, 0.33, 8, 0.75, 2, 1.00, 0), (2, 1.00, 1, 1.00, 1, 1.00, 0), (1, 1.00, 2, 1.00, 2, 1.00, 0), (5, 0.80, 5, 0.80, 10, 0.60, 0), (1, 1.00, 0, 0.00, 2, 1.00, 0),
    (1, 1.00, 0, 0.00, 2, 1.00, 0), (2, 1.00, 4, 0.75, 7, 0.14, 0), (1, 1.00, 2, 1.00, 3, 1.00, 0), (5, 0.00, 1, 1.00, 3, 0.00, 0), (2, 0.00, 3, 1.00, 4, 0.75, 0),
    (4, 0.00, 3, 1.00, 3, 0.67, 0), (8, 0.75, 3, 1.00, 4, 0.75, 0), (1, 1.00, 11, 0.18, 7, 0.00, 0), (7, 0.71, 1, 1.00, 7, 0.43, 0), (3, 1.00, 0, 0.00, 3, 1.00, 0),
    (3, 1.00, 2, 1.00, 3, 1.00, 0), (3, 1.00, 3, 1.00, 2, 0.00, 0), (5, 0.80, 6, 0.83, 3, 0.67, 0), (1, 1.00, 3, 1.00, 12, 0.08, 0), (3, 1.00, 3, 1.00, 4, 0.50, 0),
    (7, 0.71, 45, 0.00, 5, 0.60, 0), (2, 1.00, 1, 1.00, 3, 1.00, 0), (3, 1.00, 1, 1.00, 5, 0.60, 0), (3, 0.00, 3, 1.00, 8, 0.75, 0), (2, 1.00, 1, 1.00, 3, 1.00, 0),
    (7, 0.71, 4, 0.75, 2, 0.50, 0), (6, 0.67, 1, 1.00, 7, 0.00, 0), (1, 1.00, 9, 0.22, 9, 0.00, 0), (5, 0.80, 4, 0.75, 4, 0.00, 0), (5, 0.80, 8, 0.75, 5, 0.80, 0),
    (2, 1.00, 0, 0.00, 3, 1.00, 0), (15, 0.07, 2, 1.00, 2, 1.00, 0), (5, 0.80, 4, 0.75, 5, 0.80, 0), (4, 0.75, 4, 0.00, 4, 0.75, 0), (5, 0.60, 54, 0.00, 6, 0.67, 0),
    (1, 1.00, 1, 1.00, 1, 1.00, 0), (2, 1.00, 1, 1.00, 1, 1.00, 0), (7, 0.43, 3, 0.67, 0, 0.00, 0), (2, 1.00, 1, 1.00, 2, 1.00, 0), (4, 0.00, 3, 0.67, 2, 0.50, 0),
    (2, 1.00, 1, 1.00, 6, 0.67, 0), (3, 0.00, 2, 1.00, 4, 0.75, 0), (1, 1.00, 3, 1.00, 3, 1.00, 0), (1, 1.00, 2, 1.00, 5, 0.00, 0), (2, 1.00, 2, 1.00, 1, 1.00, 0),
    (3, 1.00, 1, 1.00, 1, 1.00, 0), (15, 0.00, 3, 0.00, 8, 0.75, 1), (4, 0.00, 93, 0.00, 60, 0.00, 1), (20, 0.00, 36, 0.03, 54, 0.00, 1), (64, 0.00, 113, 0.00, 45, 0.00, 1),
    (107, 0.00, 112, 0.00, 40, 0.03, 1), (1, 0.00, 32, 0.09, 45, 0.00, 1), (45, 0.00, 78, 0.00, 4, 0.75, 1), (16, 0.00, 2, 0.00, 4, 0.75, 1), (42, 0.07, 56, 0.00, 101, 0.00, 1),
    (6, 0.00, 3, 0.67, 2, 0.00, 1), (16, 0.00, 2, 0.00, 4, 0.75, 1), (46, 0.02, 5, 0.00, 4, 0.00, 1), (35, 0.03, 4, 0.00, 2, 1.00, 1), (49, 0.00, 116, 0.00, 102, 0.00, 1),
    (52, 0.02, 2, 0.00, 96, 0.00, 1), (56, 0.00, 42, 0.00, 1, 1.00, 1), (21, 0.00, 1, 0.00, 4, 0.75, 1), (9, 0.00, 2, 1.00, 95, 0.00, 1), (33, 0.09, 6, 0.00, 28, 0.07, 1),
    (65, 0.00, 18, 0.00, 54, 0.00, 1), (5, 0.00, 66, 0.00, 71, 0.00, 1), (22, 0.00, 26, 0.04, 39, 0.05, 1), (18, 0.00, 37, 0.00, 1, 1.00, 1), (2, 1.00, 35, 0.03, 26, 0.04, 1),
    (24, 0.00, 102, 0.00, 7, 0.71, 1), (71, 0.00, 116, 0.00, 50, 0.00, 1), (2, 0.00, 3, 0.00, 41, 0.07, 1), (30, 0.10, 52, 0.00, 5, 0.00, 1), (6, 0.00, 2, 1.00, 4, 0.00, 1),
    (2, 0.00, 5, 0.00, 51, 0.02, 1), (4, 0.00, 5, 0.00, 35, 0.00, 1), (78, 0.00, 1, 1.00, 45, 0.00, 1), (19, 0.00, 87, 0.00, 6, 0.67, 1), (101, 0.00, 47, 0.02, 3, 0.00, 1),
    (5, 0.00, 45, 0.00, 108, 0.00, 1), (4, 0.00, 46, 0.02, 3, 0.00, 1), (5, 0.00, 107, 0.00, 100, 0.00, 1), (107, 0.00, 8, 0.00, 5, 0.00, 1), (42, 0.00, 43, 0.00, 56, 0.00, 1),
    (113, 0.00, 108, 0.00, 85, 0.00, 1), (2, 0.00, 9, 0.00, 45, 0.00, 1), (15, 0.00, 1, 0.00, 6, 0.67, 1), (3, 0.00, 2, 1.00, 4, 0.00, 1), (104, 0.00, 23, 0.00, 63, 0.00, 1),
    (19, 0.00, 1, 0.00, 1, 1.00, 1), (4, 0.00, 46, 0.07, 102, 0.00, 1), (52, 0.00, 28, 0.07, 30, 0.10, 1), (39, 0.00, 1, 0.00, 33, 0.00, 1), (40, 0.00, 25, 0.12, 4, 0.75, 1),
    (56, 0.00, 32, 0.09, 40, 0.00, 1), (45, 0.00, 64, 0.00, 5, 0.00, 1), (111, 0.00, 51, 0.02, 108, 0.00, 1), (45, 0.00, 71, 0.00, 5, 0.00, 1), (48, 0.00, 76, 0.00, 1, 0.00, 1),
    (72, 0.00, 5, 0.00, 1, 0.00, 1), (96, 0.00, 52, 0.02, 3, 0.00, 1),
    (9, 0.89, 0, 0.00, 0, 0.00, 1), (3, 1.00, 0, 0.00, 0, 0.00, 1), (40, 0.30, 0, 0.00, 0, 0.00, 1), (1, 0.00, 0, 0.00, 0, 0.00, 1), (120, 0.02, 0, 0.00, 0, 0.00, 1), (6, 0.50, 0, 0.00, 0, 0.00, 1),
)
BESIDE = (
    (1, 1.00, 0, 0.00, 1, 1.00, 0), (1, 1.00, 1, 1.00, 1, 1.00, 0), (1, 1.00, 1, 1.00, 9, 0.00, 0), (2, 1.00, 2, 1.00, 14, 0.00, 0), (9, 0.00, 1, 1.00, 8, 0.00, 0),
    (12, 0.00, 2, 1.00, 3, 0.00, 0), (7, 0.00, 44, 0.00, 0, 0.00, 0), (22, 0.00, 60, 0.00, 10, 0.00, 0), (11, 0.00, 20, 0.00, 0, 0.00, 0), (5, 0.40, 90, 0.00, 2, 1.00, 0),
    (2, 0.00, 1, 1.00, 17, 0.00, 0), (17, 0.00, 2, 0.00, 13, 0.00, 0), (35, 0.06, 17, 0.00, 0, 0.00, 0), (3, 1.00, 31, 0.00, 3, 1.00, 0), (60, 0.00, 2, 0.00, 45, 0.00, 0),
    (4, 0.75, 6, 0.00, 40, 0.00, 0), (110, 0.00, 3, 0.00, 2, 0.00, 0), (8, 0.00, 0, 0.00, 1, 1.00, 0), (1, 0.00, 0, 0.00, 0, 0.00, 0), (15, 0.00, 0, 0.00, 0, 0.00, 0),
)
TABLE = (
    *((*r[:6], INSIDE, 0, r[6]) for r in MARKED), *((*r[:6], NOWHERE, 0, r[6]) for r in UNMARKED), *((*r[:6], OUTSIDE, 0, r[6]) for r in BESIDE),
    *((*r[:6], place, 1, r[6]) for r in BESIDE for place in (OUTSIDE, NOWHERE, INSIDE)),
)


def grow(rows: tuple, used: tuple[int, ...] = tuple(range(len(FEATURES))), depth: int = 6):
    """A classification tree by Gini impurity on the features ``used``: (feature, limit, tree up to the limit, tree above it), or a label."""
    ones = sum(r[-1] for r in rows)
    label = int(2 * ones >= len(rows))
    if depth == 0 or ones in (0, len(rows)):
        return label
    best = None
    for f in used:
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:], strict=False):
            limit = (low + high) / 2
            left = [r[-1] for r in rows if r[f] <= limit]
            right = [r[-1] for r in rows if r[f] > limit]
            cost = sum(sum(x) * (len(x) - sum(x)) / len(x) for x in (left, right))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, limit)
    if best is None:
        return label
    _, f, limit = best
    left, right = (grow(tuple(r for r in rows if (r[f] <= limit) == side), used, depth - 1) for side in (True, False))
    return left if left == right else (f, limit, left, right)


@lru_cache(maxsize=1)
def tree():
    return grow(TABLE)


def is_main(features: tuple, node) -> int:
    """The label of the leaf of a tree that ``features`` lead to."""
    while type(node) is tuple:
        node = node[2] if features[node[0]] <= node[1] else node[3]
    return node


@lru_cache(maxsize=64)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])", re.I)


def _attributes(text: str) -> dict[str, str]:
    """Attributes by lower-cased name; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTES.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _hidden(found: dict[str, str]) -> bool:
    return "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(NONE_SHOWN.search(found.get("style", "")))


def _place(name: str, attributes: str, in_article: bool) -> tuple[int, bool]:
    """(2 for an element that holds the article, 1 for one whose names say so, else 0; is apart) of an element that opens."""
    apart, article = name in APART or (name == "header" and not in_article), 2 * (name in ARTICLE)
    if attributes and not attributes.isspace():
        found = _attributes(attributes)
        for token in " ".join(found.get(k, "") for k in ("class", "id", "role")).lower().split():
            parts = [x for x in CUT.split(token) if x]
            if not parts:
                continue
            words = APART_WORDS - TOPICS if in_article else APART_WORDS
            named = (parts[-1] in words and (len(parts) == 1 or parts[-1] != "comment")) or (parts[0] in words and set(parts[1:]) <= PARTS)
            named = named or token == "comment"
            apart = apart or named or (not in_article and (token in OUTER_WORDS or (parts[0] in ("site", "page", "top") and parts[-1] in OUTER_WORDS)))
            article = max(article, int(name not in ("body", "html") and set(parts) <= ARTICLE_WORDS))
        article = 2 if found.get("role", "").lower() in ARTICLE else article
        apart = apart or _hidden(found)
    apart = apart and name not in ("body", "html", "article", "main")
    return 0 if apart else article, apart


class Tags:
    """The tags of a page, forwards; what is known to be missing from a place on is not sought again."""

    def __init__(self, html: str):
        self.html, self.last = html, {c: html.rfind(c) for c in ">\"'"}
        self.no_end: set[str] = set()
        self.no_close: set[int] = set()  # quotes from which no tag ends outside quotes

    def end_of(self, name: str, at: int) -> int | None:
        """Where the next closing tag of ``name`` stands."""
        if name in self.no_end:
            return None
        found = _end_of(name).search(self.html, at)
        if found is None:
            self.no_end.add(name)
        return None if found is None else found.start()

    def _close(self, at: int) -> int:
        """The ``>`` that ends a tag: the first outside quotes, or where quotes do not close the first of all."""
        pos, passed = at, []
        while (m := STOPS.search(self.html, pos)) is not None:
            if m[0] == ">":
                return m.start()
            passed.append(m.start())
            pos = 0 if m.start() in self.no_close or m.start() >= self.last[m[0]] else self.html.find(m[0], m.end()) + 1
            if not pos:
                break
        self.no_close.update(passed)
        return self.html.find(">", at)

    def after(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, lower-cased name, closes, attributes) of the next tag, comment or declaration (no name) from ``at`` on."""
        html = self.html
        while (start := html.find("<", at)) >= 0 and (start < self.last[">"] or html.startswith("<!--", start)):
            if html.startswith("<!--", start):
                end = -1 if "-->" in self.no_end else html.find("-->", start + 4)
                if end < 0:
                    self.no_end.add("-->")
                return start, len(html) if end < 0 else end + 3, "", False, ""
            m = NAME.match(html, start + 1)
            if m is not None:
                end = self._close(m.end())
                return start, end + 1, m[1].lower(), html[start + 1] == "/", html[m.end() : end]
            if html[start + 1 : start + 2] in ("!", "?", "/"):
                return start, html.find(">", start) + 1, "", False, ""
            at = start + 1
        return None


def blocks(html: str) -> list[tuple[str, int, float, int, bool]]:
    """(text, words, link density, article level, apart) of each block of a page, in page order."""
    out: list[tuple] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # name, article level, apart
    in_link = False
    at, end = 0, len(html)

    def close() -> None:
        nonlocal text, linked
        if text:
            words = "".join(text).split()
            if words:
                inside = len("".join(linked).split()) if linked else 0
                out.append((" ".join(words), len(words), min(1.0, inside / len(words)), stack[-1][1], stack[-1][2]))
            text, linked = [], []

    def add(piece: str) -> None:
        if "&" in piece:
            piece = unescape(piece)
        text.append(piece)
        if in_link:
            linked.append(piece)

    tags = Tags(html)
    while at < end:
        found = tags.after(at)
        if found is None:
            add(html[at:])
            break
        start, at_next, name, closing, attributes = found
        if start > at:
            add(html[at:start])
        at = at_next
        if not name:
            continue
        if name in UNREAD and not closing and not attributes.endswith("/"):
            stop = tags.end_of(name, at)
            if stop is not None or name in ("script", "style", "textarea"):
                at = end if stop is None else stop
            continue
        if name in UNREAD and name != "head":
            continue
        if name in INLINE:
            if name in ("br", "td", "th"):
                text.append(" ")
                if in_link:
                    linked.append(" ")
            elif name == "a":
                in_link = not closing
            elif not closing and name == "span" and attributes and _hidden(_attributes(attributes)):
                stop = tags.end_of("span", at)
                at = at if stop is None else stop
            continue
        close()
        in_link = in_link and name not in ("p", "div", "li", "article", "section")
        if name in VOID or (name[0] == "h" and len(name) == 2 and name[1] in "123456" and (closing or not attributes)):
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if stack[i][0] not in ("p", "li", "dd", "dt", "tr") and name in ("p", "li", "dd", "dt", "tr"):
                    break
        else:
            if stack[-1][0] == "p" or (stack[-1][0] == name and name in ("li", "dd", "dt", "tr", "option")):
                stack.pop()
            if not attributes.endswith("/"):
                article, apart = _place(name, attributes, stack[-1][1] > 0)
                stack.append((name, max(stack[-1][1], article), stack[-1][2] or apart))
    close()
    return out


def places(found: list[tuple]) -> list[int]:
    """Where each block stands: OUTSIDE or INSIDE what the page marks as its article, NOWHERE on a page that marks none."""
    level = max((b[3] for b in found if not b[4]), default=0)
    if level == 1 and 2 * sum(b[1] for b in found if b[3] and not b[4]) < sum(b[1] for b in found if not b[4]):
        level = 0  # only names say so, and most text is elsewhere
    return [NOWHERE if not level else INSIDE if b[3] >= level else OUTSIDE for b in found]


def features_of(found: list[tuple]) -> list[tuple]:
    """FEATURES of each block."""
    sides = [(0, 0.0), *(b[1:3] for b in found), (0, 0.0)]
    return [(*sides[i + 1], *sides[i], *sides[i + 2], place, int(b[4])) for i, (b, place) in enumerate(zip(found, places(found), strict=True))]


def main_text(html: str | None) -> str:
    """The main text of a page: its main blocks joined by two line feeds; empty for null."""
    found, node = blocks(html or ""), tree()
    return "\n\n".join(b[0] for b, f in zip(found, features_of(found), strict=True) if is_main(f, node))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    A null or empty page has empty text.  Unclosed tags, comments and quotes end where HTML ends them or at the end of the
    page; a page of any length is read whole.  Repeated rows are extracted each; null ids and urls are carried; an empty table gives no
    rows.  Other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = list(map(main_text, batch["html"].to_pylist()))
        return pa.record_batch(
            [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
        )

    return map_batches(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
