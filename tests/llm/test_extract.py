"""Main text of hand-made pages and of the generated ones."""

from __future__ import annotations

import html
import re
import time

import numpy as np
import pytest

from proxima.llm import extract as X

SF = "/root/testdata/sf0.001"
TREE = X.fit_tree(*X.labelled_blocks())
PARA = "a long paragraph about the harbour and the boats that left it early in the morning when the fog was thick"


def text(page):
    return X.main_text(page, TREE)


def test_training_table_is_learned():
    x, y = X.labelled_blocks()
    assert ((X.predict(TREE, x) >= 0.5) == y).mean() > 0.95


def test_furniture_goes_and_text_stays():
    page = f"""<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>if (a</b>) "</p>"</script></head><body>
    <header><h1>Site</h1></header><nav><a href="/">home</a></nav><!-- note <p>x</p> --><div class="notice">{PARA}</div>
    <article><header><h1>Title &amp; more</h1></header><p>{PARA}<br>second&nbsp;line</p><aside>{PARA}</aside><p>Of.</p>
    <div class="advert">{PARA}</div><form><label>Mail</label><input></form><ul><li>first</li><li>second</ul>
    <section id="comments"><p>{PARA}</p></section></article><div class="sidebar"><p>{PARA}</p></div>
    <footer>&copy; all</footer></body></html>"""
    assert text(page) == f"Title & more\n{PARA} second line\nOf.\nfirst\nsecond"


def test_broken_and_empty_pages():
    assert text(None) == text("") == text("<p></p>") == text("<script>var a;") == ""
    assert text(f"<article><p><b>{PARA}<p>{PARA} a < b &lt;i&gt; &amp;amp; &#228;") == f"{PARA}\n{PARA} a < b <i> &amp; ä"
    assert text(f"{PARA}") == PARA
    assert text("<article>" + "<div>" * 3000 + PARA) == PARA


def test_pages_of_the_generator(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in X.extract_main_text(pages).collect()}
    for p in pages.collect():
        m = re.search(r"<article>(.*?)</article>", p.html, re.S)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", q.replace("<br>", " "))).split()) for q in re.split(r"</?(?:p|h1)>", m[1])]
        r = got[p.page_id]
        assert r.text == "\n".join(q for q in parts if q) and r.n_chars == len(r.text) and r.url == p.url


def test_null_columns_repeats_and_no_rows(spark):
    rows = [(None, None, None, "c"), (1, "u", "<p>", "c"), (1, "u", "<p>", "c")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    assert sorted(X.extract_main_text(pages).collect(), key=str) == sorted([(None, None, "", 0), (1, "u", "", 0), (1, "u", "", 0)], key=str)
    assert X.extract_main_text(pages.limit(0)).collect() == []


def test_wrappers_do_not_hide_the_article():
    article = f"<h1>Title</h1><p>{PARA}</p><p>Of.</p>"
    for outer in ("class='has-sidebar'", "class='no-sidebar'", "class='social-share-enabled'", "class='form-page'",
                  "id='page-with-header'", "class='header'", "class='modal x'"):
        for inner in ("article", "main", "div role=main"):
            page = f"<div {outer}><{inner}>{article}<div class=ad>{PARA}</div></{inner[:7].split()[0]}><div class='site-footer'><p>{PARA}</p></div></div>"
            assert text(page) == f"Title\n{PARA}\nOf.", (outer, inner)
    assert text(f"<form action=/><main>{article}</main></form>") == f"Title\n{PARA}\nOf."
    # what is not the page's own stays out
    assert text(f"<main>{article}</main><div id=comments><article><p>{PARA}</p></article></div>") == f"Title\n{PARA}\nOf."
    assert text(f"<main>{article}</main><aside><article><p>{PARA}</p></article></aside><div class=ad-slot><p>{PARA}</p></div>") == f"Title\n{PARA}\nOf."


def test_inline_furniture_leaves_its_paragraph_whole():
    flags = [(b[0], b[3]) for b in X.blocks("<article><p>text <span class=ad>buy now</span> more</p><p>next</p></article>")]
    assert flags == [("text more", False), ("buy now", True), ("next", False)]
    assert text(f"<article><p>{PARA} <span class=ad>buy <b>now</b></span> more</p><p>{PARA}</p></article>") == f"{PARA} more\n{PARA}"
    for end in ("</p><p>next", "<p>next", "</article>next"):       # an inline element that is never closed
        got = [(b[0], b[3]) for b in X.blocks(f"<article><p>text <i class=ad>buy{end}")]
        assert got == [("text", False), ("buy", True), ("next", False)], end


def test_drawings_formulas_and_plain_text():
    page = f"<article><p>{PARA} <svg width='1'/> one</p><p>{PARA} <math/> two</p><svg><text>no</text></svg><p>{PARA} <math><mi>x</mi></math></p></article>"
    assert text(page) == f"{PARA} one\n{PARA} two\n{PARA} x"
    assert text(f"<article><p>{PARA}</p><xmp>a &lt; <b>c</b></xmp><object data=x><p>{PARA}</p></object></article>") == f"{PARA}\na &lt; <b>c</b>\n{PARA}"


_FLOOD = "the river rose after two days of rain and the bridge was closed to all traffic until friday"
_ARTICLE = f"<article><h1>the flood</h1><p>{_FLOOD}</p><p>so it was.</p></article>"
_BODY = f"<h1>the flood</h1><p>{_FLOOD}</p><p>{_FLOOD} and after it most shops opened again</p>"


@pytest.mark.parametrize("wrap", [
    '<div style="overflow:hidden">{}</div>', '<div aria-hidden="false">{}</div>', '<div data-role="dialog">{}</div>',
    "<div title='the hidden town'>{}</div>", "<div data-class=sidebar data-x='id=footer'>{}</div>", "<form action=/x>{}</form>",
    "<div class='page form-wrapper'>{}</div>", "<div class='elementor-widget'>{}</div>"])
def test_wrappers_do_not_hide_the_article(wrap):
    page = "<nav><a href=/>home</a></nav>" + wrap.format(_ARTICLE) + "<footer>bye now</footer>"
    assert X.main_text(page, TREE) == f"the flood\n{_FLOOD}\nso it was."


@pytest.mark.parametrize("wrap", [
    "<form id=aspnetForm>{}</form>", "<form><div class=form-body>{}</div></form>", "<div class=site-form>{}</div>",
    "<div class='elementor-widget elementor-widget-text-editor'><div class=elementor-widget-container>{}</div></div>"])
def test_a_wrapper_of_the_whole_page_is_the_page(wrap):
    page = "<nav><a href=/>home</a></nav>" + wrap.format(_BODY) + "<footer>bye now</footer>"
    assert X.main_text(page, TREE).split("\n")[1] == _FLOOD and "home" not in X.main_text(page, TREE)


def test_a_form_beside_the_text_stays_furniture():
    page = f"<div>{_BODY}</div><form><p>{_FLOOD} please tell us your name</p></form><div hidden><p>{_FLOOD} unseen</p></div>"
    assert "your name" not in X.main_text(page, TREE) and "unseen" not in X.main_text(page, TREE)
    comments = f"<p>{_FLOOD}</p><div class=comments>" + f"<p>{_FLOOD} said one</p>" * 9 + "</div>"
    assert "said one" not in X.main_text(comments, TREE)


@pytest.mark.parametrize("piece", ["<a ", '<a "', '<a x="', '<a x="><a " ', "<a x='>", "<!-- ", "<![CDATA[", "<p", "</p", "<div>",
                                   '<a href=">" ', "<b>", "<b><hr>", "</i>", "<li>", "<svg>", "&", "<textarea"])
def test_broken_pages_take_linear_time(piece):
    """A mebibyte of tags that never end."""
    page = piece * ((1 << 20) // len(piece))
    start = time.perf_counter()
    X.main_text(page, TREE)
    assert time.perf_counter() - start < 8          # under a second on a quiet machine; quadratic time is minutes


def test_attributes():
    tags = X._Tags('<P CLASS="a&amp;B" id = x hidden data-role=\'main\' id=y a"b=1/>t<br/><a href=/x/>')
    assert tags.next(0)[2:] == ("p", False, {"class": "a&b", "id": "x", "hidden": "", "data-role": "main", 'a"b': "1/"} | {"/": ""})
    start, end, tag, _, attrs = tags.next(tags.next(0)[1])
    assert (tag, attrs) == ("br", {"/": ""})


def quality(tree, pages, blank):
    right = kept = main = 0
    for page in pages:
        found = X.blocks(page)
        x = X.features(found)
        if blank:
            x[:, 6:] = 0
        keep = X.predict(tree, x) >= 0.5
        truth = np.array(["✓" in b[0] for b in found])
        right, kept, main = right + (keep & truth).sum(), kept + keep.sum(), main + truth.sum()
    return right / kept, right / main


def test_held_out_layouts():
    """Precision and recall of blocks on layouts that were not trained on, with all features and with those of words and
    link density alone."""
    held = X.LAYOUTS[1::2]
    precision, recall = quality(TREE, held, False)
    assert precision >= 0.95 and recall >= 0.95
    x, y = X.labelled_blocks()
    x[:, 6:] = 0
    precision, recall = quality(X.fit_tree(x, y), held, True)
    assert precision >= 0.85 and recall >= 0.9
