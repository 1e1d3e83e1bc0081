"""Operator 7, main text of web pages by a tree-structured graphical model.

A page is read into its tree of block elements; every run of inline text is a
leaf of its element. Each node is content or not. Its own evidence (tag, words
of class / id / role, text length, share of linked text, sentence marks) and a
potential between parent and child make a tree-structured model; one upward and
one downward pass of sum-product messages give every node's marginal. The text
leaves that are content with a marginal over one half are the main text.

The potentials are frequencies from labelled pages: the hand-labelled pages in
``LABELLED`` and a bounded sample of the table (``TRAIN_PAGES``), labelled where
the page itself says so (article or main element, less the navigation, forms and
notices inside it). Every page is extracted whole.

Messages of a whole batch of pages run together, a depth of the trees at a time.

Edge cases: null, empty and tagless pages: no tags means one text leaf, judged
like any other; broken markup is read as browsers do (implied end tags, stray
end tags ignored, open tags closed at the end, a head ended by the first tag or
text that can't stand in it, quotes in a tag only right after '='); the text of
formulas (math) stays, that of drawings (svg) doesn't; character references are decoded
once; white space inside a block (no-break spaces too) is one space, a line
break element is white space; a page without content nodes gives the empty text;
repeated pages are each extracted; an empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, prepare

TRAIN_PAGES = 300          # pages of the table that the potentials are fitted on, about: the bound of the fit
TRAIN_CHARS = 200_000      # of a training page, at most
PAGE_WEIGHT = 40           # nodes that a training page counts as, at most
_PAGES = 200               # pages whose messages run together

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[\s/]++|[^\s/>][^\s/>=]*+"
    r"(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)?+)*+)(?:>|\Z)"
    r"|(?P<text>[^<]++|<)", re.S)
# A whole attribute: name, and value in quotes or without. A quote stands for itself but right after '='.
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>"'][^\s>]*+))?+)?+""")
_BUTTON = re.compile(r"<(?P<end>/?)button[\s/>]", re.I)
_WORD = re.compile(r"[a-z]+")
_MARK = re.compile(r"[.!?…。](?:\s|$)")
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption"
                  " figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table"
                  " caption tbody td tfoot th thead tr ul noscript object label legend".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())  # no markup inside
HIDDEN = frozenset("script style textarea title xmp iframe noembed noframes head template svg select option"
                   " datalist button canvas audio video map".split())               # no text for readers
# What may stand in the head; any other tag, and text, ends it.
_IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
# Elements of an svg that hold HTML, and tags that end an svg left open.
_SVG_HTML = frozenset("foreignobject desc title".split())
_NOT_SVG = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing"
                     " menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
           "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tbody thead tfoot tr td th", "table"),
           "thead": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table")}
_CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _CLOSES.items()}
# Words of class, id or role, and tags, that mark parts of an article as no part of its text.
_NOT_TEXT = frozenset("nav navigation menu aside sidebar footer form comment comments reply respond ad ads advert sponsor"
                      " promo cookie consent notice banner share social related newsletter subscribe breadcrumb"
                      " breadcrumbs pagination widget popup modal".split())


_FLOW = frozenset("p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 hgroup blockquote pre table caption tbody thead tfoot tr td th"
                  " figure figcaption center".split())
KINDS = 3  # of nodes, each with its own parent-child potential


class Page:
    """Nodes of a page in document order: tag, parent, words, and for leaves their text."""

    def __init__(self):
        self.tag, self.parent, self.words, self.text, self.linked, self.label = [], [], [], [], [], []

    def add(self, tag: str, parent: int, words: frozenset = frozenset(), text: str | None = None, linked: int = 0,
            label: str | None = None) -> int:
        for column, x in ((self.tag, tag), (self.parent, parent), (self.words, words), (self.text, text),
                          (self.linked, linked), (self.label, label)):
            column.append(x)
        return len(self.tag) - 1


def parse(html: str, marks: bool = True) -> Page:
    """The nodes of a page. ``marks``: whether a ``label`` attribute is the training mark of
    ``LABELLED``; in pages of a table it is the page's own and says nothing."""
    page = Page()
    stack = [page.add("html", -1)]
    parts: list[str] = []
    linked, links, hidden = 0, 0, []

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                page.add("#text", stack[-1], text=text, linked=min(linked, len(text)))
            parts.clear()
            linked = 0

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.match(html, at)
        at = m.end()
        if m["text"] is not None:
            if hidden == ["head"] and not m["text"].isspace():
                hidden.clear()
            if not hidden:
                t = _html.unescape(m["text"])
                parts.append(t)
                linked += len(t) if links else 0
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if tag in hidden:
                while hidden.pop() != tag:
                    pass
            elif hidden:
                pass
            elif tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK and any(page.tag[k] == tag for k in stack[1:]):
                flush()
                while page.tag[stack.pop()] != tag:
                    pass
            continue
        if hidden == ["head"] and tag not in _IN_HEAD:
            hidden.clear()
        while hidden and hidden[-1] == "svg" and tag in _NOT_SVG:
            hidden.pop()
        in_svg = bool(hidden) and hidden[-1] == "svg"
        if (in_svg or tag == "svg") and _ATTR.sub("", m["attrs"]).endswith("/"):
            continue  # an element without content; elsewhere '/>' is '>'
        if in_svg:
            if tag == "svg" or tag in _SVG_HTML:
                hidden.append(tag)
            continue
        if tag == "head" and tag in hidden:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
            at = end.start() if end else n
            hidden.append(tag)
            continue
        if tag == "button":
            # One that is never closed, or not before the next, hides nothing: its label is lost in the text.
            after = _BUTTON.search(html, at)
            if after is None or not after["end"]:
                continue
        if hidden or tag in HIDDEN:
            if tag in HIDDEN or tag in hidden:
                hidden.append(tag)
            continue
        if tag == "a":
            links += 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK:
            flush()
            links = 0
            if tag in ("html", "body") and tag in (page.tag[k] for k in stack):
                continue
            if page.tag[stack[-1]] == "p":
                stack.pop()
            close, scope = _CLOSES.get(tag, (frozenset(), frozenset()))
            while close and any(page.tag[k] in close for k in _inside(page, stack, scope)):
                stack.pop()
            found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(m["attrs"])}
            words = frozenset(_WORD.findall(" ".join(found.get(k, "") for k in ("class", "id", "role")).lower()))
            node = page.add(tag, stack[-1], words, label=found.get("label") if marks else None)
            if tag not in VOID:
                stack.append(node)
    flush()
    return page


def _inside(page: Page, stack: list[int], scope: frozenset) -> list[int]:
    """Open elements down from the top up to (without) the nearest of ``scope``."""
    out = []
    for k in reversed(stack[1:]):
        if page.tag[k] in scope:
            break
        out.append(k)
    return out


def _bucket(x: float, steps: tuple) -> int:
    return sum(x >= s for s in steps)


def evidence(page: Page) -> list[list[str]]:
    """What is observed at each node."""
    n = len(page.tag)
    chars, linked, marks = [0] * n, [0] * n, [0] * n
    for k in range(n - 1, -1, -1):
        if page.text[k] is not None:
            chars[k], linked[k] = len(page.text[k]), page.linked[k]
            marks[k] = len(_MARK.findall(page.text[k]))
        if page.parent[k] >= 0:
            up = page.parent[k]
            chars[up] += chars[k]
            linked[up] += linked[k]
            marks[up] += marks[k]
    out = []
    for k in range(n):
        kind = "t" if page.text[k] is not None else "e"
        # The tag and the share of linked text say something together: a list of links is a menu.
        links = _bucket(linked[k] / max(1, chars[k]), (0.01, 0.3, 0.7))
        if kind == "e" and page.tag[k] in _FLOW and not page.words[k]:
            # Its leaves speak for it; only a list or table as a whole adds something.
            out.append([f"tag:{page.tag[k]}:{links}"] if page.tag[k] in ("ul", "ol", "dl", "table") else [])
            continue
        tag = f"tag:{page.tag[k]}" if kind == "e" else f"under:{page.tag[page.parent[k]]}"
        size, stops = _bucket(chars[k], (1, 25, 80, 200, 600)), _bucket(marks[k], (1, 3, 8))
        # Jointly: a short text is a menu entry if it is linked, a line of prose if it ends in a stop.
        out.append([f"{tag}:{links}", f"{kind}shape:{links}:{size}:{stops}", *(f"word:{w}" for w in sorted(page.words[k]))])
    return out


def kinds(page: Page) -> list[int]:
    """0: text leaf, 1: plain element of running text, 2: element that may open a region of its own."""
    return [0 if page.text[k] is not None else 1 if page.tag[k] in _FLOW and not page.words[k] else 2
            for k in range(len(page.tag))]


def labels_of(page: Page) -> list[int] | None:
    """Whether each node is content, by ``label`` marks if the page has any, else by
    its article or main elements; None if the page has neither."""
    n = len(page.tag)
    marked = any(x is not None for x in page.label)
    main = [t in ("article", "main") for t in page.tag]
    if not marked and not any(main):
        return None
    y = [0] * n
    for k in range(n):
        up = y[page.parent[k]] if page.parent[k] >= 0 else 0
        if marked:
            y[k] = int(page.label[k]) if page.label[k] is not None else up
        elif main[k]:
            y[k] = 1
        else:
            y[k] = int(up and page.tag[k] not in _NOT_TEXT and not page.words[k] & _NOT_TEXT)
    # An element above the content is content if most of its text is.
    inside, whole = [0] * n, [0] * n
    for k in range(n - 1, -1, -1):
        if page.text[k] is not None:
            whole[k], inside[k] = len(page.text[k]), len(page.text[k]) * y[k]
        elif page.label[k] is None and not y[k] and 2 * inside[k] > whole[k]:
            y[k] = 1
        if page.parent[k] >= 0:
            whole[page.parent[k]] += whole[k]
            inside[page.parent[k]] += inside[k]
    return y


class Model:
    """Log potentials: of evidence given the state, and of the child's state given the
    parent's, by the kind of the child."""

    def __init__(self, pages: list[Page]):
        seen: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        total = {"#": [0.0, 0.0], "root": [1.0, 1.0]}
        pair = np.ones((KINDS, 2, 2))
        for page in pages:
            y = labels_of(page)
            if y is None:
                continue
            kind = kinds(page)
            weight = min(1.0, PAGE_WEIGHT / len(y))  # a page of thousands of nodes counts no more than a plain one
            for k, features in enumerate(evidence(page)):
                for f in features:
                    seen[f][y[k]] += weight
                total["#"][y[k]] += weight
                if page.parent[k] >= 0:
                    pair[kind[k], y[page.parent[k]], y[k]] += weight
                else:
                    total["root"][y[k]] += weight
        n = np.array(total["#"]) + 1
        self.feature = {f: tuple(np.log((np.array(c) + 0.2) / (n + 0.4)).tolist()) for f, c in seen.items()}
        self.pair = np.log(pair / pair.sum(axis=2, keepdims=True))
        root = np.array(total["root"])
        self.root = np.log(root / root.sum())

    def marginals(self, pages: list[Page]) -> list[np.ndarray]:
        """P(content) of every node of each page, by sum-product messages."""
        size = [len(p.tag) for p in pages]
        first = np.cumsum([0, *size])
        none = (0.0, 0.0)
        own = np.array([[sum(x) for x in zip(none, *[self.feature.get(f, none) for f in fs], strict=True)]
                        for p in pages for fs in evidence(p)])
        parent = np.array([k + a if k >= 0 else -1 for p, a in zip(pages, first, strict=False) for k in p.parent])
        pair = self.pair[np.array([x for p in pages for x in kinds(p)], np.int64)]
        depth = np.zeros(len(parent), np.int64)
        for k, up in enumerate(parent.tolist()):  # parents come before their children
            depth[k] = depth[up] + 1 if up >= 0 else 0
        levels = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=0)) + 1)]
        up_sum, message = own.copy(), np.zeros((len(parent), 2))
        for at in reversed(levels[1:]):
            # Upward: over the child's states, for each state of the parent.
            message[at] = np.logaddexp(pair[at, :, 0] + up_sum[at, :1], pair[at, :, 1] + up_sum[at, 1:])
            np.add.at(up_sum, parent[at], message[at])
        down = np.tile(self.root, (len(parent), 1))
        for at in levels[1:]:
            # Downward: all the parent knows but what this child told it.
            rest = down[parent[at]] + up_sum[parent[at]] - message[at]
            down[at] = np.logaddexp(rest[:, :1] + pair[at, 0], rest[:, 1:] + pair[at, 1])
            down[at] -= down[at].max(axis=1, keepdims=True)
        belief = down + up_sum
        p = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
        return [p[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]

    def main_text(self, pages: list[Page]) -> list[str]:
        return ["\n\n".join(t for t, x in zip(p.text, m.tolist(), strict=True) if t is not None and x > 0.5)
                for p, m in zip(pages, self.marginals(pages), strict=True)]


# Hand-labelled pages: the parts that a page may have, label="1" where the main text is.
_PARTS = {
    "nav": '<nav label="0" class="main-nav"><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li>'
           '<li><a href="/c">Contact</a></li></ul></nav>',
    "menu": '<div label="0" class="menu" id="menu"><a href="/x">Products</a> <a href="/y">Prices</a> <a href="/z">Help</a></div>',
    "header": '<header label="0" class="site-header"><div class="logo">The Daily Page</div><a href="/">Start</a></header>',
    "footer": '<footer label="0" class="footer">&copy; 2020 The Daily Page &middot; All rights reserved. Imprint.</footer>',
    "foot": '<div label="0" id="footer" class="site-footer"><p>Copyright by the owners. Terms of use.</p></div>',
    "aside": '<aside label="0" class="sidebar"><h3>Most read</h3><ul><li><a href="/1">A first story</a></li>'
             '<li><a href="/2">A second story</a></li></ul></aside>',
    "side": '<div label="0" class="sidebar widget related"><h4>Related</h4><p><a href="/q">More about this. Read it now.</a></p></div>',
    "ad": '<div label="0" class="ad">Buy one of these today, and get another. It is worth it.</div>',
    "promo": '<section label="0" class="promo advert banner"><p>Try our offer for a month. You can leave at any time.</p></section>',
    "cookie": '<div label="0" class="cookie-notice consent" role="dialog"><p>We use cookies to make this site better. '
              'By going on you agree.</p></div>',
    "notice": '<div label="0" class="notice alert"><p>This page has moved. Please update your links.</p></div>',
    "form": '<form label="0" class="search newsletter"><label>Your mail</label><input name="q"><p>Subscribe to our letter. '
            'No spam.</p></form>',
    "comments": '<section label="0" class="comments" id="comments"><h3>Comments</h3><div class="comment"><p>I think this is '
                'wrong. Not by much, though.</p></div><div class="comment reply"><p>It is right. See above.</p></div></section>',
    "comment": '<div label="0" id="respond" class="comment-list"><ul><li class="comment"><p>Thanks for writing this up. It helped '
               'me a lot.</p></li><li class="comment"><p>First!</p></li></ul></div>',
    "share": '<div label="0" class="share social"><a href="/f">Share</a> <a href="/t">Post</a></div>',
    "crumbs": '<div label="0" class="breadcrumb"><a href="/">Home</a> &gt; <a href="/n">News</a></div>',
}
_LONG = ("It was late in the year when the work began, and no one had thought that it would take so long. The first days "
         "went well. Then the rain came, and with it the mud; the carts stood still for weeks.")
_SHORT = ("The old bridge was closed.", "A short one.", "Nobody knew why, but everyone had something to say about it. So it went on.")


def _body(k: int) -> str:
    some = "".join(f"<p>{_LONG if i % 2 == k % 2 else _SHORT[(i + k) % 3]}</p>" for i in range(2 + k % 4))
    extra = ("", "<h2>What came after</h2><p>Things changed.</p>", "<ul><li>One point of it.</li><li>Another.</li></ul>",
             "<blockquote><p>We had no choice, said the keeper.</p></blockquote><pre>a = 1</pre>",
             "<table><tr><td>Year</td><td>1900</td></tr></table>")[(k + k // 5) % 5]
    return f"<h1>A bridge and its keeper</h1>{some}{extra}"


def _labelled() -> list[str]:
    wraps = ('<article label="1">{}</article>', '<main label="1" class="content">{}</main>',
             '<div label="1" id="content" class="post entry">{}</div>', '<div class="page"><div label="1" class="article-body text">{}</div></div>',
             '<main><article label="1" class="story">{}</article></main>')
    parts = list(_PARTS)
    out = []
    for k in range(60):
        pick = [parts[(k * 5 + j * 3) % len(parts)] for j in range(4)]
        before, after = "".join(_PARTS[p] for p in pick[:2]), "".join(_PARTS[p] for p in pick[2:])
        body = _body(k)
        if k % 4 == 3:  # a part inside the article
            body += _PARTS[("comments", "share", "promo", "aside", "form")[k // 4 % 5]]
        out.append(f"<html><head><title>A</title></head><body>{before}{wraps[k % 5].format(body)}{after}</body></html>")
    return out


# Hand-labelled pages of other kinds: no class names, prose full of links, lines cut by br, tables, lists, short pages.
_LINKS = ('The <a href="/m">mayor of the old town</a> said that the <a href="/b">bridge over the river</a> would be closed.',
          'Said <a href="/x">the keeper of the northern gate</a>.', 'It is <a href="/l">the longest of its kind</a>, and the oldest too.',
          'See also <a href="/r">the report of the council</a>, which came out in the spring of that year, and what was said of it.')
_TOP = ('<ul label="0"><li><a href="/">Start</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul>',
        '<div label="0"><a href="/">Start</a> <a href="/w">Weather</a> <a href="/j">Jobs</a></div>',
        '<table label="0"><tr><td><a href="/1">One</a></td><td><a href="/2">Two</a></td></tr></table>',
        '<p label="0"><a href="/">Back to the list</a> | <a href="/next">Next</a></p>', "")
_END = ('<div label="0">&copy; 1999 The Town Paper</div>', '<p label="0"><a href="/i">Imprint</a> <a href="/p">Privacy</a></p>',
        '<ul label="0"><li><a href="/a">Another story of that week</a></li><li><a href="/b">What the others wrote</a></li></ul>', "")
_OTHER = (
    '<div label="1"><h1>The bridge</h1><p>{0}</p><p>{1}</p><p>{l}</p></div>',
    '<div label="1" class="story-text"><p>{l}</p><p>{1}</p><p>{0}</p></div>',
    '<div label="1">{l}<br>{s}<br><br>{0}<br>{1}</div>',
    '<div label="1">{l}<br><br>{l}</div>',
    '<div label="1">{s}<br>{l}<br><i>{s}</i></div>',
    '<div label="1"><h2>Figures</h2><p>{s}</p><table><tr><th>Year</th><th>Carts</th></tr><tr><td>1900</td><td>17</td></tr>'
    '<tr><td>1901</td><td>23 a day, as far as is known.</td></tr></table><p>{l}</p></div>',
    '<article label="1"><p>{s}</p></article>',
    '<main label="1"><p>{s}</p><p>{1}</p></main>',
    '<section label="1"><h1>Bread</h1><ul><li>500 g of flour</li><li>a spoon of salt</li></ul><ol><li>Mix it all.</li><li>{s}</li></ol></section>',
    '<div label="1" id="post-7" class="entry-content"><p>{0} {2}</p><blockquote>{s}</blockquote><p>{3}</p></div>',
    '<td label="1"><font>{l}</font><p>{0}</p><p>{l}</p></td>',
    '<div label="1" class="blog-post"><h1>{s}</h1><p>{2}</p><p>{l}</p><pre>x = 1</pre></div>',
    '<div label="1" class="article-content"><p>{1}</p><div><p>{3}</p></div><div><div><p>{s}</p></div></div></div>',
    '<center label="1"><h1>Welcome</h1><p>{l}</p></center>',
)


def _others() -> list[str]:
    out = []
    for k in range(6 * len(_OTHER)):
        body = _OTHER[k % len(_OTHER)].format(*_LINKS, l=_LONG, s=_SHORT[k % 3])
        if body.startswith("<td"):
            body = f'<table><tr><td label="0"><a href="/c">Contents</a><br><a href="/k">Links</a></td>{body}</tr></table>'
        out.append(f"<html><body>{_TOP[k % 5]}{body}{_END[k // 3 % 4]}</body></html>")
    return out


LABELLED = [*_labelled(), *_others()]


def fit(pages: DataFrame, html: str = "html", train_pages: int = TRAIN_PAGES) -> Model:
    """Potentials from ``LABELLED`` (hand-labelled pages of many kinds) and about ``train_pages`` pages of the table, by content hash."""
    col = F.col(f"`{html}`")
    n = pages.count()
    some = pages.where(F.length(col) <= TRAIN_CHARS) \
                .where(F.pmod(F.xxhash64(F.lit(7), col), F.lit(1 << 30)) < F.lit(train_pages / max(1, n) * (1 << 30))) \
                .select(col.alias("html")).distinct()
    return Model([parse(x) for x in LABELLED] + [parse(x, marks=False) for x in sorted(r["html"] for r in some.collect())])


def extract(pages: DataFrame, keep: list[str], html: str = "html", model: Model | None = None) -> DataFrame:
    """``_row`` with the ``keep`` columns and the main text in ``_out.text``."""
    prepare(pages.sparkSession)
    state = vars(model or fit(pages, html))

    def run(batches: Iterator[pa.RecordBatch]):
        m = Model([])
        vars(m).update(state)
        for rb in batches:
            raw = rb.column(1).to_pylist()
            out: list[str] = []
            for a in range(0, len(raw), _PAGES):
                out += m.main_text([parse((x or b"").decode("utf-8", "replace"), marks=False) for x in raw[a:a + _PAGES]])
            yield rb, pa.StructArray.from_arrays([pa.array(out, pa.string())], names=["text"])

    return map_texts(pages, run, "struct<text:string>", keep, html)


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    out = extract(pages, ["page_id", "url"])
    return out.select("_row.*", F.col("_out.text").alias("text"), F.char_length("_out.text").cast("long").alias("n_chars"))
