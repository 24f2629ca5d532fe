"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded down the tree.

Each page becomes a tree of block elements. Trees score each node from its tag, attribute words, depth, siblings and
the density of text and links in its subtree. Decoding keeps the best-scoring set of nodes in which no node is kept
without its ancestors. The kept nodes' text is joined in page order.

The trees learn from a bounded sample of the pages themselves: nodes under an article or main element are main text, those
under elements or attribute words that tell of something else are not. So that the trees don't depend on tags alone,
each page is also shown with its parts re-dressed in other tags and classes, and with the parts of pages (notices, forms,
sidebars, comments) that it may lack.
"""

from __future__ import annotations

import html as entities
import math
import pickle
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonority.llm.common import portions, table

#: Pages that the trees are fitted on at most; trees, their depth, step and bins.
MAX_PAGES, TREES, DEPTH, STEP, BINS = 250, 50, 4, 0.2, 24

#: Bytes of html whose nodes a task scores at once, about.
CHARS = 2_000_000

# How HTML's elements behave.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd map mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("noscript template svg math object head canvas audio video".split())
#: Elements whose content is no markup: it goes on to the next end tag of the same name, whatever it holds.
_VERBATIM = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.I) for t in ("script", "style", "iframe", "noembed", "noframes", "textarea", "title")}
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

#: Comments, declarations and tags. Loops are possessive, so a tag is read once; one whose quotes are not closed ends at the next >.
_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+|[^>]*+))>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Groups of tags and of attribute words that the trees see; fixed lists.
_TAGS = ({"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"div"}, {"article", "main"}, {"section"}, {"nav", "menu"}, {"header", "hgroup"}, {"footer"}, {"aside"}, {"form", "button", "select", "option", "textarea", "label", "fieldset", "input"}, {"ul", "ol", "dl"}, {"li", "dd", "dt"}, {"table", "tr", "td", "th", "tbody", "thead"}, {"blockquote", "pre", "figure", "figcaption"})
_WORDS = (
    {"content", "article", "post", "entry", "story", "main", "body", "text", "prose"},
    {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "tabs", "toc"},
    {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "adsense"},
    {"footer", "foot", "copyright", "legal", "colophon"},
    {"header", "masthead", "topbar", "logo", "branding", "contentinfo"},
    {"sidebar", "side", "aside", "widget", "widgets", "rail", "related", "recommended", "trending", "popular", "complementary", "more"},
    {"comment", "comments", "reply", "replies", "respond", "disqus", "discussion", "reader", "reviews"},
    {"cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "gdpr", "newsletter", "subscribe", "paywall", "overlay", "warning", "notification"},
    {"form", "search", "login", "signup", "signin", "register", "contact", "share", "social", "sharing", "tags", "meta", "byline"},
)
_NEGATIVE_TAGS = (5, 6, 7, 8, 9)


class Page:
    """A page's block elements, in page order: parents stand before children."""

    def __init__(self, source: str) -> None:
        self.tag, self.attrs, self.parent, self.blocks = ["html"], [""], [-1], []
        self.chars, self.linked, self.words, self.marks = [0], [0], [0], [0]
        #: nodes that stand for text directly in the body
        self.loose: set[int] = set()
        self._read(source)

    def _read(self, source: str) -> None:
        stack, buffer, now, links, linked, at, skip = [0], [], 0, 0, 0, 0, ""
        #: places in the stack of each tag that is open
        places: dict[str, list[int]] = {}

        def last(tags: Iterable[str]) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        def cut(i: int) -> None:
            for k in stack[i:]:
                places[self.tag[k]].pop()
            del stack[i:]

        def add(tag: str, attrs: str, parent: int) -> int:
            self.tag.append(tag)
            self.attrs.append(attrs)
            self.parent.append(parent)
            for x in (self.chars, self.linked, self.words, self.marks):
                x.append(0)
            return len(self.tag) - 1

        def flush() -> None:
            nonlocal linked
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                of = now or add("p", "", 0)
                if not now:
                    self.loose.add(of)
                self.blocks.append((of, text))
                self.chars[of] += len(text)
                self.linked[of] += min(linked, len(text))
                self.words[of] += text.count(" ") + 1
                self.marks[of] += text.count(".") + text.count(",") + text.count("?")
            linked = 0

        # what follows the last > has no more tags
        limit = source.rfind(">") + 1
        while m := _TOKEN.search(source, at, limit):
            start, end, tag = m.start(), m.end(), m[2]
            if start > at and not skip:
                piece = source[at:start]
                if "&" in piece:
                    piece = entities.unescape(piece)
                buffer.append(piece)
                if links:
                    linked += len(piece.strip())
            at = end
            if tag is None:
                if end == limit and m[0].startswith("<!--") and not m[0].endswith(("-->", "--!>")):
                    at = len(source)
                continue
            tag, closing = tag.lower(), bool(m[1])
            if not closing and tag in _VERBATIM:
                close = _VERBATIM[tag].search(source, end, limit)
                at = close.end() if close else len(source)
                continue
            if skip:
                if closing and tag == skip or skip == "head" and tag == "body":
                    skip = ""
                if tag != "body" or closing:
                    continue
            if tag in _INLINE:
                if tag == "a":
                    links = max(0, links - 1) if closing else links + 1
                elif tag == "br":
                    buffer.append(" ")
                continue
            if tag in _RAW:
                if not closing and not m[3].endswith("/"):
                    skip = tag
                continue
            if tag in ("html", "body"):
                if tag == "body" and not closing and m[3]:
                    self.attrs[0] = m[3]
                continue
            if closing:
                if i := last((tag,)):
                    flush()
                    links = 0
                    cut(i)
                    now = stack[-1]
                continue
            flush()
            links = 0
            if tag in _ENDS_P and (i := last(("p",))):
                cut(i)
            if tag in _SAME:
                ends, within = _SAME[tag]
                if (i := last(ends)) > last(within):
                    cut(i)
            now = stack[-1]
            if tag in _VOID:
                continue
            now = add(tag, m[3], now)
            places.setdefault(tag, []).append(len(stack))
            stack.append(now)
        if at < len(source) and not skip:
            # a comment that never ends
            buffer.append(entities.unescape(source[at:].partition("<!--")[0]))
        flush()


_TAG_OF = {t: i for i, group in enumerate(_TAGS) for t in group}
_WORD_OF = {w: i for i, group in enumerate(_WORDS) for w in group}
_COLUMNS = len(_TAGS) + len(_WORDS) + 2 + 18


def _attribute_groups(attrs: str) -> set[int]:
    if not attrs or "=" not in attrs:
        return set()
    words = (w.lower() for m in _ATTRIBUTE.finditer(attrs) for w in _PARTS.findall(m[1] or m[2] or m[3] or ""))
    return {_WORD_OF[w] for w in words if w in _WORD_OF}


def node_features(page: Page) -> np.ndarray:
    """A row for each node but the root, whose row is zeros."""
    n = len(page.tag)
    parent = page.parent
    chars, linked, words, marks = list(page.chars), list(page.linked), list(page.words), list(page.marks)
    nodes, paragraphs, children = [1] * n, [t == "p" for t in page.tag], [0] * n
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        words[p] += words[i]
        marks[p] += marks[i]
        nodes[p] += nodes[i]
        paragraphs[p] += paragraphs[i]
        children[p] += 1
    total = max(chars[0], 1)
    out = np.zeros((n, _COLUMNS), np.float32)
    depth, order, seen, largest, good, bad = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(1, n):
        largest[parent[i]] = max(largest[parent[i]], chars[i])
    first = len(_TAGS)
    log = math.log1p
    before = 0
    for i in range(1, n):
        p = parent[i]
        depth[i], order[i] = depth[p] + 1, seen[p]
        seen[p] += 1
        row = out[i]
        g = _TAG_OF.get(page.tag[i])
        if g is not None:
            row[g] = 1
        own = _attribute_groups(page.attrs[i])
        for k in own:
            row[first + k] = 1
        good[i] = good[p] + (g == 3 or 0 in own)
        bad[i] = bad[p] + (g in _NEGATIVE_TAGS or any(k > 0 for k in own))
        c = chars[i]
        row[first + len(_WORDS) :] = (
            good[p], bad[p], depth[i], order[i] / max(children[p], 1), children[p], children[i], log(c), log(page.chars[i]), c / total, linked[i] / max(c, 1), nodes[i] / max(c / 100, 1),
            words[i] / nodes[i], marks[i] / max(words[i], 1), paragraphs[i], c / max(largest[p], 1), c / max(chars[p], 1), log(chars[p]), linked[p] / max(chars[p], 1), before / total, i / n,
        )
        before += page.chars[i]
    return out


class Trees:
    """Gradient-boosted regression trees for the logistic loss, over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> None:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        mean = float(np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 0.01, 0.99)) if len(x) else 0.5
        self.base, self.trees, self.depth = math.log(mean / (1 - mean)), [], depth
        if not len(x) or len(set(y.tolist())) < 2:
            return
        b = self._bin(x)
        score = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            grad, curve = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
            feature, cut, value = self._grow(b, grad, curve)
            self.trees.append((feature, cut, value))
            score += value[self._leaf(b, feature, cut)]

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(self.edges)], 1).astype(np.uint8)

    def _grow(self, b: np.ndarray, grad: np.ndarray, curve: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A full tree by levels: node k has children 2k+1 and 2k+2; a node that is not split sends all rows left."""
        inner, n, m = (1 << self.depth) - 1, len(b), b.shape[1]
        feature, cut = np.zeros(inner, np.int64), np.full(inner, 255, np.int64)
        at = np.zeros(n, np.int64)
        for level in range(self.depth):
            first, wide = (1 << level) - 1, 1 << level
            best = np.full(wide, 1e-6)
            for j in range(m):
                key = (at - first) * BINS + b[:, j]
                g = np.bincount(key, grad, wide * BINS).reshape(wide, BINS)
                h = np.bincount(key, curve, wide * BINS).reshape(wide, BINS)
                gl, hl = g.cumsum(1), h.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < 1) | (ht - hl < 1)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(wide), k]
                better = top > best
                best[better], feature[first : first + wide][better], cut[first : first + wide][better] = top[better], j, k[better]
            at = 2 * at + 1 + (b[np.arange(n), feature[at]] > cut[at])
        leaf = at - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, curve, inner + 1)
        return feature, cut, STEP * g / (h + 1)

    def _leaf(self, b: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for _ in range(self.depth):
            at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
        return at - len(feature)

    def logit(self, x: np.ndarray) -> np.ndarray:
        b, out = self._bin(x), np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            out += value[self._leaf(b, feature, cut)]
        return out


def decode(page: Page, logit: np.ndarray) -> list[bool]:
    """The set of nodes with the greatest sum of log-odds in which no node stands without its parent; the root is in."""
    n = len(page.tag)
    best = np.clip(logit, -8, 8).tolist()
    for i in range(n - 1, 0, -1):
        if best[i] > 0:
            best[page.parent[i]] += best[i]
    kept = [True] + [False] * (n - 1)
    for i in range(1, n):
        kept[i] = kept[page.parent[i]] and best[i] > 0
    return kept


def weak_labels(page: Page) -> list[int | None]:
    """1 for nodes under an article or main element, 0 for those outside or under something else; None without either."""
    n = len(page.tag)
    inside, against = [False] * n, [False] * n
    for i in range(1, n):
        p, g, own = page.parent[i], _TAG_OF.get(page.tag[i]), _attribute_groups(page.attrs[i])
        inside[i] = inside[p] or g == 3 or (0 in own and not own - {0})
        against[i] = against[p] or g in (5, 7, 8, 9) or g == 6 and not inside[p] or any(k > 0 for k in own) and g != 3
    if not any(inside):
        return [None] * n
    holds = [i and inside[i] and not against[i] for i in range(n)]
    for i in range(n - 1, 0, -1):
        holds[page.parent[i]] = holds[page.parent[i]] or holds[i]
    return [int(h) for h in holds]


_MAIN = ("article", "main", 'div class="article-body"', 'div class="post-content"', 'div id="content"', 'section class="entry"', 'div class="story text"', "div", "section", 'div role="main"')
_ASIDE = (
    ("nav", 'div class="menu"', 'ul class="nav"', 'div id="navigation"', 'div class="breadcrumbs"'), ('div class="ad"', 'div class="advert"', 'aside class="sponsored"', 'div id="banner"', 'section class="promo"'),
    ("footer", 'div class="footer"', 'div id="foot"', 'div class="copyright"'), ("aside", 'div class="sidebar"', 'div class="widget"', 'section class="related"'),
    ('section class="comments"', 'div id="comments"', 'ol class="comment-list"', 'div class="reader-comments"'), ('div class="cookie-notice"', 'div class="consent"', 'div class="newsletter popup"', 'div role="alert"', 'div class="notice"'),
    ("form", 'form class="search"', 'div class="login-form"'), ("header", 'div class="header"', 'div id="masthead"'),
)


def _dress(parts: list[str], opening: str, rng: random.Random) -> str:
    tag = opening.split()[0]
    inner = "ul" if tag != "ul" and rng.random() < 0.3 else ""
    body = "".join(f"<li>{x}</li>" if inner or tag in ("ul", "ol") else f"<p>{x}</p>" for x in parts)
    return f"<{opening}>" + (f"<{inner}>{body}</{inner}>" if inner else body) + f"</{tag}>"


def redressed(page: Page, pool: list[str], rng: random.Random) -> str:
    """The page's main text in another dress, among parts of other pages."""
    labels = weak_labels(page)
    main = [(page.tag[i], t) for i, t in page.blocks if labels[i] == 1]
    around = [t for i, t in page.blocks if labels[i] == 0] or ["-"]
    opening = rng.choice(_MAIN)
    body = "".join(f"<{t if t[0] == 'h' else 'p'}>{entities.escape(x)}</{t if t[0] == 'h' else 'p'}>" for t, x in main)
    comments = "" if rng.random() < 0.6 else _dress([entities.escape(rng.choice(pool)) for _ in range(rng.randint(1, 3))], rng.choice(_ASIDE[4]), rng)
    inside = rng.random() < 0.4
    lead, bare = "", rng.random()
    if bare < 0.1 and len(main) > 2:
        # the first sentence stands before the article, in no element
        lead, _, body = body.partition("</p>")
        lead = re.sub("<[^>]*>", " ", lead)
    core = f"{lead}<{opening}>{body}{comments if inside else ''}</{opening.split()[0]}>"
    if bare > 0.85:
        # no element around the article, or none in it either
        inside, core = False, body if bare > 0.92 else re.sub("</?p>", "<br>", body).replace("<br><br>", "<hr>")
    for _ in range(rng.randint(0, 2) if bare <= 0.85 else 0):
        core = f"<div class=\"{rng.choice(['wrapper', 'page', 'container', 'row', 'col'])}\">{core}</div>"

    def other(kind: int) -> str:
        short = [entities.escape(rng.choice(around)) for _ in range(rng.randint(1, 6))]
        if kind == 0 or kind == 3 and rng.random() < 0.5:
            short = [f'<a href="/x">{x}</a>' for x in short]
        elif kind in (3, 5) and rng.random() < 0.5:
            short = [entities.escape(rng.choice(pool))]
        elif kind == 6:
            short = [f"<label>{x}</label><button>{x[:9]}</button>" for x in short[:2]]
        return _dress(short, rng.choice(_ASIDE[kind]), rng)

    head = "".join(other(k) for k in rng.sample([7, 0, 1, 5, 6], rng.randint(1, 4)))
    tail = ("" if inside else comments) + "".join(other(k) for k in rng.sample([3, 1, 5, 6, 2, 2], rng.randint(1, 4)))
    return f"<html><body>{head}{core}{tail}</body></html>"


def learn(sources: list[str], variants: int = 4, seed: int = 3) -> Trees:
    """Fit the trees on pages with weak labels, as they are and re-dressed."""
    rng, pages = random.Random(seed), [Page(s) for s in sources]
    pool = [t for p in pages for _, t in p.blocks if len(t) > 40] or ["-"]
    rows, labels = [], []
    for page in pages:
        own = weak_labels(page)
        if own[0] is None:
            continue
        shown = [(page, own)]
        for _ in range(variants):
            page2 = Page(redressed(page, pool, rng))
            # the dress itself tells which part is main; its blocks are found again by their text
            main = {t for i, t in page.blocks if own[i] == 1}
            keep = [False] * len(page2.tag)
            for i, t in page2.blocks:
                keep[i] = keep[i] or t in main
            outside = weak_labels_against(page2)
            keep = [k and not o for k, o in zip(keep, outside)]
            for i in range(len(keep) - 1, 0, -1):
                keep[page2.parent[i]] = keep[page2.parent[i]] or keep[i]
            shown.append((page2, [int(k) for k in keep]))
        for p, y in shown:
            rows.append(node_features(p)[1:])
            labels += y[1:]
    if not rows:
        return Trees(np.zeros((0, _COLUMNS)), np.zeros(0), np.zeros(0))
    x, y = np.concatenate(rows), np.array(labels, float)
    return Trees(x, y, np.ones(len(y)))


def weak_labels_against(page: Page) -> list[bool]:
    """Nodes under a tag or attribute word that tells of something other than main text."""
    out = [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        g, own = _TAG_OF.get(page.tag[i]), _attribute_groups(page.attrs[i])
        out[i] = out[page.parent[i]] or g in _NEGATIVE_TAGS or any(k > 0 for k in own)
    return out


def main_texts(sources: list[str], trees: Trees) -> list[str]:
    """Main text of each page; all nodes of all pages are scored at once."""
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    rows = [node_features(p) for p in pages]
    logits = np.split(trees.logit(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
    out = []
    for page, z in zip(pages, logits):
        kept = decode(page, z)
        if not any(kept[1:]):  # nothing but loose text, if anything
            out.append("\n".join(t for i, t in page.blocks if i in page.loose))
        else:
            out.append("\n".join(t for i, t in page.blocks if kept[i]))
    return out


def fit(pages: DataFrame, max_pages: int = MAX_PAGES) -> Trees:
    """Fit in one task, on the pages with the least hashes of ``page_id``, ``max_pages`` at most."""
    chosen = pages.where(F.length("html") > 0).select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(max_pages)
    sample = pages.select("page_id", "html").join(F.broadcast(chosen), "page_id")

    def one(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if held := list(parts):
            pdf = pd.concat(held).sort_values(["page_id", "html"]).drop_duplicates("page_id")
            yield pd.DataFrame({"model": [pickle.dumps(learn(pdf["html"].tolist()))]})

    got = sample.repartition(1).mapInPandas(one, "model binary").collect()
    return pickle.loads(bytes(got[0]["model"])) if got else learn([])


def extract(pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """Extract the main text of every page from the whole html.

    :param pages: ``page_id, url, html`` and any other columns, which are ignored. A null or empty html has an empty
        text; where no element is kept, as in html without markup, the loose text of the body is the page's text.
        Repeated rows and null ids are all returned.
    :return: ``page_id, url, text, n_chars``; none for an empty table.
    """
    shared = pages.sparkSession.sparkContext.broadcast(fit(pages, max_pages))
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for b in batches:
            for part in portions(b, "html", CHARS):
                texts = main_texts([h or "" for h in part.column("html").to_pylist()], trees)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(each, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
