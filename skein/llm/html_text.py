"""Main text of web pages by the maximum-scoring contiguous subsequence.

A page is a sequence of tags and words. A word scores by the elements that it stands in: their names, the words of their
classes, ids and roles, whether it is a link, the length of its block. These weights come from labelled pages (pages whose
markup names their article) by logistic regression, with that markup hidden; a list of common names gives the weights that
they start from, and that names which no labelled page has keep. Tags score negative, by their odds. One linear scan finds
the contiguous region with the highest score.

What an element says counts only for a part of the page: an element that names itself the article, and what stands around
one, is not beside the text, whatever its name; on pages without such an element, nor is one that holds most of the words, unless its very
name (``nav``, ``footer`` and the like) says what it is.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from math import log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_batches, share_of

#: The fit reads at most so many pages, those with the smallest hash of their url or id.
FIT_PAGES = 400

#: Each part of a tag has characters of its own and gives none back, so a broken tag costs its length once.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|select)\b(?:"[^"]*+"|'[^']*+'|[^'"<>])*+>.*?(?:</\1\s*+>|\Z)|<![^<>]*+>|<\?[^<>]*+>|<(/?)([a-zA-Z][^\s/<>"']*+)((?:"[^"]*+"|'[^']*+'|[^'"<>])*+)>""", re.S | re.I)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_GAP = re.compile(r"\s+")

BLOCKS = frozenset("p div section article main h1 h2 h3 h4 h5 h6 ul ol li table tr thead tbody tfoot caption blockquote pre figure figcaption dl dt dd hr address header footer nav aside form fieldset body html title head details summary center".split())
_VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: Elements that end where the next one of their kind starts.
_ENDED = frozenset("p li tr dt dd".split())
#: Elements whose content is never text of the page.
_HIDDEN = frozenset("head title button".split())
#: Weights to start from (fixed values, in log-odds): names of elements; whole words of class, id and role values; parts
#: of such words between hyphens or underscores; words that mean little on an element of some length.
ELEMENTS = {"nav": -4.0, "footer": -4.0, "aside": -4.0, "form": -4.0, "menu": -4.0, "dialog": -4.0, "header": -2.5}
ASIDE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promos promotion cookie cookies consent notice notices comment comments disqus respond sidebar sidebars widget widgets nav navbar "
    "navigation menu menus breadcrumb breadcrumbs footer masthead social share sharing related recommended recommendations newsletter subscribe popup modal pagination pager complementary contentinfo".split()
)
PARTS = ASIDE - {"notice", "notices", "respond"}
DOUBTFUL = frozenset("header side alert search login signup copyright legal disclaimer tag tags meta byline".split())
MAIN = frozenset("article post entry content main story body-text".split())
#: A doubtful element of so many words, fewer than a third of them links, is text.
LONG = 60
#: An element with a name of those above is around the text if it has so much of the page's words; others with half.
WRAPS = 0.8
#: Below this sum of what its elements say, a text inside the region is beside it.
BESIDE = -1.5


class Page:
    """A page as rows ``(kind, text, block, element)``: ``kind`` is ``"<name"``, ``"</name"`` or ``""`` for text, ``block``
    tells if a block starts there; elements have a parent, a name, words, and the words of text and of links in them."""

    def __init__(self, page: str) -> None:
        self.rows: list[tuple[str, str, bool, int]] = []
        self.parent, self.name, self.words, self.size, self.links = [-1], [""], [()], [0], [0]
        stack, opened = [0], Counter()
        at, link = 0, 0

        def text_row(raw: str) -> None:
            if raw:
                self.rows.append(("", raw, False, stack[-1]))
                if not hidden and (n := len(raw.split())):
                    self.size[stack[-1]] += n
                    self.links[stack[-1]] += n * (link > 0)

        hidden = 0

        def close(name: str) -> None:
            nonlocal link, hidden
            while True:
                top = self.name[stack.pop()]
                opened[top] -= 1
                link -= top == "a"
                hidden -= top in _HIDDEN
                if top == name:
                    return

        for m in _TOKEN.finditer(page):
            text_row(page[at : m.start()])
            at = m.end()
            if not (name := m[3]):
                continue
            name = name.lower()
            if m[2]:
                self.rows.append((f"</{name}", "", name in BLOCKS, stack[-1]))
                if opened[name]:
                    close(name)
                continue
            named = " ".join(x for g in _NAMED.findall(m[4]) for x in g if x).lower() if m[4] else ""
            if name in _ENDED and opened[name]:
                k = len(stack) - 1
                while k > 0 and self.name[stack[k]] not in BLOCKS:
                    k -= 1
                if self.name[stack[k]] == name:
                    close(name)
            self.rows.append((f"<{name}", "", name in BLOCKS, stack[-1]))
            if name not in _VOID and not m[4].endswith("/") and (name in BLOCKS or name in _HIDDEN or name == "a" or name in ELEMENTS or named):
                self.parent.append(stack[-1])
                self.name.append(name)
                self.words.append(tuple(named.split()))
                self.size.append(0)
                self.links.append(0)
                stack.append(len(self.name) - 1)
                opened[name] += 1
                link += name == "a"
                hidden += name in _HIDDEN
        text_row(page[at:])
        for k in range(len(self.name) - 1, 0, -1):  # an element comes after its parent
            self.size[self.parent[k]] += self.size[k]
            self.links[self.parent[k]] += self.links[k]
        # comments are articles inside one, or say so
        self.article, within = [False] * len(self.name), [False] * len(self.name)
        for k in range(1, len(self.name)):
            within[k] = within[self.parent[k]] or self.name[k] == "article"
            self.article[k] = self.name[k] == "article" and not within[self.parent[k]] and not ASIDE.intersection(self.words[k])
        if not any(self.article):
            self.article = [n == "main" or "main" in w and n in ("div", "section") for n, w in zip(self.name, self.words, strict=True)]
        self.around = self.article[:]
        if not any(self.article):
            for k in range(1, len(self.name)):
                marked = self.name[k] == "form" or ASIDE.intersection(self.words[k])
                self.around[k] = self.size[k] >= self.size[0] * (WRAPS if marked else 0.5) and (self.name[k] not in ELEMENTS or self.name[k] == "form")
        for k in range(len(self.name) - 1, 0, -1):
            self.around[self.parent[k]] |= self.around[k]
        self.inside = self.article[:]
        for k in range(1, len(self.name)):
            self.inside[k] |= self.inside[self.parent[k]]

    def said(self, k: int) -> list[str]:
        """What one element says: its name and its words, unless it is around the text."""
        name = self.name[k]
        if name in ("", "html", "body"):
            return []
        if self.around[k]:
            return []
        out = [] if name == "header" and self.inside[k] else [f"t:{name}"]
        doubt = self.size[k] >= LONG and 3 * self.links[k] < self.size[k]
        for word in self.words[k]:
            if not (doubt and word in DOUBTFUL):
                out.append(f"c:{word}")
            if "-" in word or "_" in word:
                out += [f"p:{part}" for part in re.split("[-_]+", word) if part]
        return out


def start_weight(feature: str) -> float:
    """The weight of a feature before any page is read."""
    kind, _, word = feature.partition(":")
    if kind == "t":
        return ELEMENTS.get(word, 0.0)
    if kind == "c":
        return -4.0 if word in ASIDE else -2.0 if word in DOUBTFUL else 0.5 if word in MAIN else 0.0
    if kind == "p":
        return -2.0 if word in PARTS else 0.0
    return {"link": -0.5, "bias": 0.5}.get(kind, 0.0)


class Weights:
    """Log-odds of features, and scores of tags by name; features without a learned weight have that of the start."""

    def __init__(self, word: dict[str, float] | None = None, tag: dict[str, float] | None = None) -> None:
        self.word, self.tag = word or {}, tag or {}

    def of(self, features: list[str]) -> float:
        return sum(w if (w := self.word.get(f)) is not None else start_weight(f) for f in features)

    def of_tag(self, kind: str) -> float:
        return min(-0.05, self.tag.get(kind, -0.5))


def _plain(page: Page) -> list[list[str]]:
    """Of each text row the features that are not of its elements: nearest block, link, words of its block."""
    size: list[int] = []
    block, n = [0] * len(page.rows), 0
    for k, (kind, text, starts, _) in enumerate(page.rows):
        if starts:
            size.append(n)
            n = 0
        block[k] = len(size)
        n += len(text.split()) if not kind else 0
    size.append(n)
    out = []
    for k, (kind, _, _, e) in enumerate(page.rows):
        if kind:
            out.append([])
            continue
        linked = False
        while e > 0 and page.name[e] not in BLOCKS:
            linked |= page.name[e] == "a"
            e = page.parent[e]
        name = page.name[e]
        out.append(["bias", f"b:{'div' if name in ('article', 'main', 'body', 'html', '') else name}", f"n:{min(6, size[block[k]].bit_length())}", *(["link"] if linked else [])])
    return out


def learn(pages: list[str], rounds: int = 150, pull: float = 2.0) -> Weights:
    """Weights from pages that name an article: logistic regression of "inside it" on the features of each text, by words.

    The article's own markup is no feature. ``pull`` is the strength by which weights stay where they start.
    """
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    index: dict[str, int] = {}
    rows, cols, label, mass = [], [], [], []
    for text in pages:
        page = Page(text or "")
        if "article" not in page.name:
            continue
        said = [page.said(k) for k in range(len(page.name))]
        for (kind, raw, _, e), plain in zip(page.rows, _plain(page), strict=True):
            if kind:
                (inside if page.inside[e] else outside)[kind] += 1
            elif (n := len(raw.split())) and not any(page.name[x] in _HIDDEN for x in _up(page, e)):
                for f in [*plain, *(f for x in _up(page, e) for f in said[x])]:
                    rows.append(len(label))
                    cols.append(index.setdefault(f, len(index)))
                label.append(float(page.inside[e]))
                mass.append(n**0.5)
    start = np.array([start_weight(f) for f in index])
    w = start.copy()
    if label:
        r, c, y, m = np.array(rows), np.array(cols), np.array(label), np.array(mass)
        # a page's words count alike whatever their number: as many inside as outside
        m = m * np.where(y > 0, 0.5 / max(m[y > 0].sum(), 1), 0.5 / max(m[y == 0].sum(), 1)) * len(y)
        curve = np.bincount(c, m[r], len(index)) / 4 + pull
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(r, w[c], len(y)), -30, 30)))
            grad = np.bincount(c, ((p - y) * m)[r], len(index)) + pull * (w - start)
            w = w - 0.3 * grad / curve
    tag = {k: max(-6.0, min(-0.05, log((inside[k] + 1) / (outside[k] + 1)) / 4 - 0.5)) for k in inside | outside}
    return Weights({f: float(x) for f, x in zip(index, w, strict=True)}, tag)


def _up(page: Page, e: int):
    while e > 0:
        yield e
        e = page.parent[e]


def best_region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous part with the highest sum, the first of several; (0, 0) if no sum is positive."""
    best, total, start, span = 0.0, 0.0, 0, (0, 0)
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, span = total, (start, i + 1)
    return span


def row_scores(page: Page, weights: Weights) -> tuple[list[float], list[bool]]:
    """Score of each row, and whether it is beside the text."""
    own, shut = [0.0] * len(page.name), [False] * len(page.name)
    for k in range(1, len(page.name)):
        own[k] = own[page.parent[k]] + weights.of(page.said(k))
        shut[k] = shut[page.parent[k]] or page.name[k] in _HIDDEN
    scores, beside = [], []
    for (kind, text, _, e), plain in zip(page.rows, _plain(page), strict=True):
        beside.append(shut[e] or own[e] < BESIDE)
        if kind:
            scores.append(weights.of_tag(kind))
        else:
            n = len(text.split())
            scores.append(n * (-1.0 if beside[-1] else max(-3.0, min(2.0, own[e] + weights.of(plain)))))
    return scores, beside


def _region(page: Page, weights: Weights) -> tuple[int, int, list[bool]]:
    """Bounds of the region among the rows, and for each row whether it is beside the text."""
    scores, beside = row_scores(page, weights)
    a, b = best_region(scores)
    if a == b:
        return 0, 0, beside
    # the smallest element around the region, if it is the article or a part of the page below its body
    over = list(_up(page, page.rows[a][3]))
    ends = set(_up(page, page.rows[b - 1][3]))
    common = next((e for e in over if e in ends and page.name[e] in BLOCKS), 0)
    article = next((e for e in dict.fromkeys([*over, *ends]) if page.article[e]), 0)
    whole = article or (common if page.name[common] not in ("", "html", "body") else 0)
    if whole:
        within = [False] * len(page.name)
        within[whole] = True
        for k in range(whole + 1, len(page.name)):
            within[k] = within[page.parent[k]]
        places = [k for k, row in enumerate(page.rows) if within[row[3]]]
        a, b = min(a, places[0]), max(b, places[-1] + 1)
    while a > 0 and not page.rows[a][2]:  # the block that the region starts in, as a whole
        a -= 1
    while b < len(page.rows) and not page.rows[b][2]:
        b += 1
    return a, b, beside


def extract(page: str | None, weights: Weights) -> str:
    """Text of the best region: blocks in page order, one line each; empty if there is none.

    A region that touches an element which names itself the article (``article``, else ``main``) takes that element as a
    whole; else it takes the smallest block element around it, unless that is the page's body. Parts of it that their
    elements' weights mark as beside the text are left out. Of regions with the same score the first counts. Broken
    markup is text; the time grows with the page's length.
    """
    found = Page(page or "")
    a, b, beside = _region(found, weights)
    blocks, now = [], []
    for (kind, text, block, _), out in zip(found.rows[a:b], beside[a:b], strict=True):
        if block:
            blocks.append(now)
            now = []
        elif kind:
            if kind in ("<br", "<td", "<th", "<img"):
                now.append(" ")
        elif not out:
            now.append(text)
    blocks.append(now)
    lines = (_GAP.sub(" ", html.unescape("".join(x))).strip() for x in blocks)
    return "\n".join(x for x in lines if x)


def fit_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", rows: int = FIT_PAGES) -> Weights:
    """Weights from about ``rows`` pages at most, picked by a hash of their id; what is collected has that bound."""
    usable = pages.where(F.col(html_col).contains("<article"))
    n = usable.count()
    if not n:
        return Weights()
    picked = usable.where(share_of(F.col(id_col), rows, n)).select(id_col, html_col)
    return learn([r[1] for r in sorted(picked.collect(), key=lambda r: (str(r[0]), r[1]))])


def extract_pages(pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of ``pages``: id, url, ``text`` (empty if none), ``n_chars`` (its code points).

    Map only. Null and empty html give the empty text; repeated rows give repeated results; an empty table gives no
    rows; further columns are not read.
    """
    shipped = pages.sparkSession.sparkContext.broadcast(weights)

    def make():
        weights = shipped.value

        def one(key, url, page):
            text = extract(page, weights)
            return key, url, text, len(text)

        return one

    kinds = dict(pages.dtypes)
    return map_batches(pages.select(id_col, url_col, html_col), make, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
