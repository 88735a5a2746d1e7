"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into flat blocks at block-level tags.  Each block has its word count and link density
(share of its words inside links), those of the block before and after it, and whether it lies in
page furniture (by tag, role, class or id) or inside an article element.  A small decision tree
(Gini splits) trained on the labelled blocks of ``SAMPLES`` says which blocks are main text.

An article or main element clears what a wrapper's class or id, or a form around it, says about
furniture, and so does a wrapper or form that holds most of the page's words while next to none lie free
elsewhere.  An inline element that is furniture is a block of its own; the block around it stays one.

Tags are read in one pass over the page.  A quote counts only as the start of an attribute's value.  A tag that never
ends by that rule ends at the next ``>``, and so do all after it; without any ``>`` the rest is text.

Rules.  Scripts, styles, templates, drawings (svg), the document head and comments hold no blocks.  Character
references are decoded once; white space inside a block becomes one space; blocks are trimmed and
joined in page order by one newline.  A null or empty page has empty text; nothing is capped, and a
page without any kept block has empty text too.  Repeated rows are extracted alike; a null page_id or
url stays null; extra columns are ignored.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxima.llm.layouts import LAYOUTS

# ----------------------------------------------------------------- fixed values: HTML names
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea title iframe noframes xmp svg".split())
BLOCK = frozenset((
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav "
    "ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul").split())
FURNITURE_TAGS = frozenset("nav footer aside form dialog menu select button label head".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu".split())
#: A class or id token that is one of these words marks furniture, and so does a hyphenated one that ends
#: with such a word (``site-footer``) or begins with one and ends with a PLAIN_WORDS (``ad-slot``), unless it
#: tells how a page is laid out (``has-sidebar``, ``page-with-header``).
FURNITURE_WORDS = frozenset((
    "ad ads advert adverts advertisement adverting advertising banner breadcrumb breadcrumbs comment comments "
    "cookie cookies consent disqus footer form gdpr header login masthead menu modal nav navbar navigation "
    "newsletter notice notices notification pager pagination popup promo promotion reader-comments related "
    "replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar "
    "topbar widget").split())
PLAIN_WORDS = frozenset("area bar block box container form group inner item items link links list panel section slot unit widget widgets wrap wrapper".split())
#: Furniture only as a whole token: page builders end the names of every wrapper with them.
WHOLE_WORDS = frozenset("form notice widget".split())
LAYOUT_WORDS = frozenset("has have is no not with without".split())
#: Wrappers of these hold articles that are not the page's own: only a main element clears them.
HOLDER_WORDS = frozenset((
    "ad ads advert adverts advertisement comment comments disqus promo promotion reader-comments related replies reply "
    "respond sidebar sponsor sponsored widget").split())
DEPTH = 6                        # nested pieces of furniture that are told apart
SOFT, HOLDER, FIRM = 1, 2, 3     # furniture that an article clears, that a main element clears, that stays
MAIN_WORDS = frozenset("article articlebody content entry main post story".split())

_TAG = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*)|(!--)|(!\[CDATA\[)|[!?])")
#: The next attribute of a tag, or its end; a value in quotes, or up to white space.
_ATTR = re.compile(r"[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:(?P<q>[\"'])|([^\s>]*)))?)")
_SLASH = re.compile(r"/\s*>\Z")
MOST = 0.5                       # share of a page's words that makes a wrapper the page itself
FREE = 0.2                       # of the wrapper's words, that may lie outside of all furniture
_WORDS = re.compile(r"[a-z]+")


def _named(token: str, in_main: bool) -> int:
    """SOFT or HOLDER for a class or id token that marks furniture, else 0."""
    parts = [token] if token in FURNITURE_WORDS else _WORDS.findall(token)
    if not parts or not LAYOUT_WORDS.isdisjoint(parts):
        return 0
    last = parts[-1] if parts[-1] in FURNITURE_WORDS and (len(parts) == 1 or parts[-1] not in WHOLE_WORDS) else ""
    word = last or (parts[0] if parts[-1] in PLAIN_WORDS and parts[0] not in WHOLE_WORDS else "")
    if word not in FURNITURE_WORDS or in_main and word == "header":     # an article may have a header of its own
        return 0
    return HOLDER if word in HOLDER_WORDS else SOFT


def _kind(tag: str, attrs: dict[str, str], in_main: bool) -> tuple[int, str]:
    """Furniture (0, SOFT, HOLDER, FIRM) and main (``main``, ``article``, another or no word) for an
    element by its tag and its class, id, role and hidden attributes."""
    furniture = (SOFT if tag == "form" else FIRM) if tag in FURNITURE_TAGS or (tag == "header" and not in_main) else 0
    main = tag if tag in ("article", "main") else ""
    named = 0
    if "hidden" in attrs:
        furniture = FIRM
    role = attrs.get("role", "").strip()
    if role in FURNITURE_ROLES:
        furniture = FIRM
    elif role in ("main", "article"):
        main = role
    if tag not in ("body", "html", "article", "main"):
        for value in (attrs.get("class", ""), attrs.get("id", "")):
            named = max([named, *(_named(t, in_main) for t in value.split())])
            if not main and not MAIN_WORDS.isdisjoint(_WORDS.findall(value)):
                main = "named"
    if main not in ("article", "main"):             # these are not furniture by class or id
        furniture = max(furniture, named)
    return furniture, "" if furniture else main


class _Tags:
    """The tags of a page, in one pass."""

    def __init__(self, page: str):
        self.page, self.broken = page, False
        self.last = {c: page.rfind(c) for c in ">\"'"}

    def next(self, pos: int):
        """``(start, end, tag, closing, attributes)`` of the next piece of markup from ``pos``; None at the end of the
        markup.  The tag is None for comments and the like."""
        page, n = self.page, len(self.page)
        m = _TAG.search(page, pos)
        if not m:
            return None
        start = m.start()
        if m[3] or m[4]:
            end = page.find("-->" if m[3] else "]]>", m.end() - (2 if m[3] else 0))
            return start, n if end < 0 else end + 3, None, False, {}
        if m[2] is None:
            end = page.find(">", m.end())
            return start, n if end < 0 else end + 1, None, False, {}
        if start > self.last[">"]:
            return None                             # it never ends, and nor does any after it
        end, attrs = (None, {}) if self.broken else self.attributes(m.end())
        if end is None:
            self.broken = True
            end, attrs = page.find(">", m.end()) + 1, {}
        if _SLASH.search(page, max(m.end(), end - 80), end):
            attrs["/"] = ""
        return start, end, m[2].lower(), bool(m[1]), attrs

    def attributes(self, pos: int) -> tuple[int | None, dict[str, str]]:
        """The end of a tag whose name ends at ``pos``, None if it never ends; and its attributes, the first of each name."""
        page, attrs = self.page, {}
        while m := _ATTR.match(page, pos):
            if m[1]:
                return m.end(), attrs
            pos, value = m.end(), m[4] or ""
            if m["q"]:
                end = page.find(m["q"], pos) if pos <= self.last[m["q"]] else -1
                if end < 0:
                    break
                value, pos = page[pos:end], end + 1
            attrs.setdefault(m[2].lower(), html.unescape(value).lower() if value else "")
        return None, attrs


def blocks(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """``(text, words, words in links, furniture, main)`` of every non-empty flat block."""
    out: list[tuple[str, int, int, tuple, bool]] = []
    parts: list[str] = []
    # tag, furniture marks (element, level) and main: of the element and all around it; what an inline piece of
    # furniture interrupts
    stack: list[tuple[str, tuple, bool, tuple | None]] = []
    open_tags: dict[str, int] = {}                  # how many of each are open
    open_blocks: list[int] = []                     # places of block elements in the stack
    linked = links = element = 0
    place: int | None = None                       # of the interrupted block among the blocks

    def flush():
        nonlocal parts, linked, place
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                marks, main = stack[-1][1:3] if stack else ((), False)
                out.insert(len(out) if place is None else place, (text, text.count(" ") + 1, linked, marks, main))
            parts, linked = [], 0
        place = None

    def close(at: int):
        nonlocal links, parts, linked, place
        while len(stack) > at:
            tag, _, _, held = stack[-1]
            if held or tag in BLOCK:
                flush()
            stack.pop()
            open_tags[tag] -= 1
            if tag in BLOCK:
                open_blocks.pop()
            links -= tag == "a"
            if held:
                parts, linked, place = held
                if parts:
                    parts.append(" ")

    pos, n, tags = 0, len(page), _Tags(page)
    while pos < n:
        found = tags.next(pos)
        end = found[0] if found else n
        if end > pos:
            t = html.unescape(page[pos:end])
            parts.append(t)
            if links:
                linked += len(t.split())
        if not found:
            break
        _, pos, tag, closing, attrs = found
        if tag is None:
            continue
        if closing:
            if tag in BLOCK:
                flush()
            if open_tags.get(tag):
                at = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
                if open_blocks and open_blocks[-1] >= at:
                    flush()
                close(at)
            continue
        if tag in ("svg", "math") and "/" in attrs:
            continue
        if tag in RAW:
            m = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, pos)
            if tag == "xmp":                        # its text is shown as it stands
                flush()
                t = page[pos: m.start() if m else n]
                parts.append(t)
                linked = len(t.split()) if links else 0
                flush()
            pos = m.end() if m else (pos if "/" in attrs and tag != "xmp" else n)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            inner = stack[open_blocks[-1]][0] if open_blocks else ""
            if inner == "p" or inner == tag and tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
                close(open_blocks[-1])
        if tag in VOID:
            continue
        marks, main = stack[-1][1:3] if stack else ((), False)
        f, a = _kind(tag, attrs, main)
        if a in ("main", "article"):                # a wrapper was not furniture after all
            clears = HOLDER if a == "main" else SOFT
            if all(level <= clears for _, level in marks):
                marks = ()
        held = None
        if f and not marks and tag not in BLOCK:
            # an inline element that is furniture is a block of its own, and the block around it goes on after it
            held = (parts, linked, len(out) if place is None and "".join(parts).strip() else place)
            parts, linked, place = [], 0, None
        element += 1
        if tag in BLOCK:
            open_blocks.append(len(stack))
        stack.append((tag, (*marks, (element, f)) if f and len(marks) < DEPTH else marks, main or bool(a), held))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        links += tag == "a"
    flush()
    close(0)
    flush()
    cleared = _pages_themselves(out)
    return [(text, w, k, any(e not in cleared for e, _ in marks), main) for text, w, k, marks, main in out]


def _pages_themselves(found: list[tuple[str, int, int, tuple, bool]]) -> set[int]:
    """Furniture by form, class or id that holds most words of the page while next to none lie free elsewhere."""
    cleared: set[int] = set()
    total = sum(b[1] for b in found)
    for _ in range(DEPTH):
        held, free = {}, 0
        for _, w, _, marks, _ in found:
            marks = [m for m in marks if m[0] not in cleared]
            free += w if not marks else 0
            if marks:
                held[marks[0]] = held.get(marks[0], 0) + w
        big = [e for (e, level), w in held.items() if level == SOFT and w > MOST * total and free <= FREE * w]
        if not big:
            break
        cleared.update(big)
    return cleared


def features(found: list[tuple[str, int, int, bool, bool]]) -> np.ndarray:
    """Words and link density of the block before, the block, the block after; furniture; main."""
    x = np.zeros((len(found), 8))
    if found:
        own = np.array([(w, min(1.0, k / w)) for _, w, k, _, _ in found], float)
        x[1:, 0:2], x[:, 2:4], x[:-1, 4:6] = own[:-1], own, own[1:]
        x[:, 6:8] = [(f, m) for _, _, _, f, m in found]
    return x


# ----------------------------------------------------------------- the labelled table
_LONG = ("the river rose after two days of rain and the old bridge had to be closed to all traffic until engineers "
         "could look at the pillars, which had been repaired only last spring at great cost to the town")
_MID = "most of the shops near the market opened again on friday morning"

#: Labelled pages: blocks whose text holds a tick are main text.
SAMPLES = [
    f"<nav><ul><li><a href=/>home</a></li><li><a href=/n>news</a></li></ul></nav><div class=ad>buy two lamps and get one free today</div><article><h1>the flood✓</h1><p>{_LONG}✓</p><p>so✓.</p><p>{_MID}✓</p></article><footer>copyright 2020 all rights reserved by the town paper</footer>",
    f"<header><h1>town paper</h1><p>daily since long ago</p></header><main><h2>bridge closed✓</h2><p>{_MID}✓</p><p>{_LONG}✓ <a href=/b>bridge✓</a></p><ul><li>first point✓</li><li>second point✓</li></ul></main><aside><h3>more</h3><p>{_MID}</p></aside><footer><a href=/c>contact</a></footer>",
    f"<div id=menu><a href=/>home</a> | <a href=/a>about us</a></div><div class='post content'><h1>rain✓</h1><p>{_LONG}✓</p><blockquote>{_MID}✓</blockquote></div><div id=comments><p>{_MID}</p><p>{_LONG}</p></div>",
    f"<div><a href=/>home</a> <a href=/x>sports</a> <a href=/y>weather</a></div><div><p>{_LONG}✓</p><p>{_LONG}✓</p><p>{_MID}✓</p></div><div><a href=/1>terms of use</a> <a href=/2>privacy</a></div>",
    f"<p><a href=/>front page</a></p><h1>town news today✓</h1><p>{_LONG}✓</p><p>{_MID}✓ <a href=/more>more✓</a></p><p>{_LONG}✓</p><p><a href=/next>next page</a> <a href=/prev>previous page</a></p>",
    f"<div class=cookie-notice>we use cookies to make this site better for all readers</div><article><p>{_MID}✓</p></article><form action=/s>your name and mail<input><button>send</button></form>",
    f"<article><header><h1>a title✓</h1></header><p>{_LONG}✓</p><div class='ad banner'>{_MID}</div><p>{_LONG}✓</p><footer>share this with friends</footer><section class=comments><p>{_MID}</p></section></article>",
    f"<table><tr><td><a href=/>home</a></td><td><a href=/m>map</a></td></tr></table><p>{_LONG}✓</p><p>{_LONG}✓</p>",
    "<article><h1>short✓</h1><p>yes✓</p><p>no✓ more✓</p></article><footer>the town paper</footer>",
    "<article><h1>a short title✓</h1><p>a few words✓</p></article>",
    "<main><p>one✓</p><p>two words✓</p></main><div>town paper</div>",
    "<div>town paper</div><article><h2>what we saw✓</h2><p>not much✓</p></article><div>since long ago</div>",
    "<div>town paper</div><div>daily</div><main><p>nothing new today✓</p></main><div>all rights reserved</div>",
    f"<div class=sidebar><p>{_LONG}</p><p>{_MID}</p></div><div class=article><p>{_MID}✓</p><pre>one two✓</pre><p>{_LONG}✓</p></div><div class=related><a href=/1>{_MID}</a></div>",
    f"{_LONG}✓",
    f"<p>{_LONG}✓</p>",
    f"<p>{_MID}✓</p><p>{_LONG}✓</p>",
    f"<div>{_MID}✓ {_MID}✓</div><div><a href=/>home</a> <a href=/n>news</a></div>",
    f"<h1>the flood✓</h1><p>{_LONG}✓</p><p>{_MID}✓</p><p>so✓.</p>",
    f"<table><tr><td>{_MID}✓</td></tr><tr><td>{_LONG}✓</td></tr></table>",
    f"<article><p><a href=/whole>{_MID}✓</a></p><p>{_LONG}✓</p></article><nav><a href=/>{_MID}</a></nav>",
    f"<div><a href=/1>{_MID}</a></div><div><a href=/2>{_MID}</a></div><p>{_MID}✓</p><p>{_LONG}✓</p><div><a href=/3>{_MID}</a></div>",
    f"<div class=has-sidebar><div class=sidebar><p>{_MID}</p></div><article><h1>the flood✓</h1><p>{_LONG}✓</p><p>{_MID}✓ <span class=ad>{_MID}</span> so✓</p></article></div>",
    f"<div id=page-with-header class='social-share-enabled form-page'><div class=site-footer><p>{_MID}</p></div><main><p>{_LONG}✓</p><p>ok✓</p></main></div>",
    f"<section class=newsletter><p>{_MID}</p></section><main><p>{_LONG}✓</p><nav><a href=/s>skip</a></nav><p>ok✓</p></main><div role=contentinfo>{_MID}</div>",
]


def labelled_blocks(pages: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The training table: features and label of every block of ``SAMPLES`` and every other page of ``LAYOUTS``."""
    found = [blocks(s) for s in (SAMPLES + LAYOUTS[::2] if pages is None else pages)]
    return (np.concatenate([features(f) for f in found]),
            np.array(["✓" in b[0] for f in found for b in f], float))


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2):
    """A binary tree of ``(feature, threshold, low branch, high branch)``; leaves are probabilities."""
    p = float(y.mean())
    if depth == 0 or p in (0.0, 1.0) or len(y) < 2 * least:
        return p
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, c = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        a, b = c[:-1], c[-1] - c[:-1]
        m = len(y) - n
        impurity = a * (n - a) / n + b * (m - b) / m
        ok = (v[1:] > v[:-1]) & (n >= least) & (m >= least)
        if ok.any():
            k = int(np.argmin(np.where(ok, impurity, np.inf)))
            if best is None or impurity[k] < best[0] - 1e-12:
                best = (impurity[k], f, (v[k] + v[k + 1]) / 2)
    if best is None:
        return p
    _, f, t = best
    low = x[:, f] <= t
    return (f, t, fit_tree(x[low], y[low], depth - 1, least), fit_tree(x[~low], y[~low], depth - 1, least))


def predict(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, t, a, b = tree
    low = x[:, f] <= t
    out = np.empty(len(x))
    out[low], out[~low] = predict(a, x[low]), predict(b, x[~low])
    return out


def main_text(page: str | None, tree) -> str:
    found = blocks(page or "")
    keep = predict(tree, features(found)) >= 0.5
    return "\n".join(b[0] for b, k in zip(found, keep) if k)


def extract_main_text(pages: DataFrame, tree=None) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``."""
    tree = fit_tree(*labelled_blocks()) if tree is None else tree

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py(), tree) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        run, "page_id bigint, url string, text string, n_chars bigint")
