import os
import re
from html import unescape
from itertools import combinations

import numpy as np
import pytest

from terrastack.llm import html_extract, queries
from terrastack.llm.html_extract import best_region, main_text

DATA = "/root/testdata/sf0.01"
PAGES = "page_id long, url string, html string, text int, n_chars string"
BODY = [f"Sentence {i} of the report tells what was seen at the river on that day, and by whom it was told." for i in range(6)]
PROSE = "".join(f"<p>{p}</p>" for p in BODY)
WANT = "Title of it\n" + "\n".join(BODY)
MENU = "<ul>" + "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(12)) + "</ul>"
ARTICLE = f"<h1>Title of it</h1>{PROSE}"
REMARKS = "<p>I was there and saw it all, every word of this is true, and more could be told of it by those who stayed.</p>" * 4

LAYOUTS = {
    "article": f"<nav>{MENU}</nav><article>{ARTICLE}</article><footer>&copy; someone, all rights reserved</footer>",
    "main": f"<div>{MENU}</div><main>{ARTICLE}</main><aside>{MENU}</aside>",
    "role": f"<div role=navigation>{MENU}</div><div role='main'>{ARTICLE}</div><div role=contentinfo>Imprint and contact of the site</div>",
    "divisions": f'<div id="top-nav">{MENU}</div><div class="content">{ARTICLE}</div><div class="sidebar">{MENU}{REMARKS}</div><div class="site-footer">{REMARKS}</div>',
    "no names": f"<div>{MENU}</div><div>{ARTICLE}</div><div>{MENU}</div>",
    "table": f"<table><tr><td>{MENU}</td><td>{ARTICLE}</td><td>{MENU}</td></tr></table>",
    "comments after": f'<article>{ARTICLE}</article><section id="comments"><article class="comment">{REMARKS}</article><article>{REMARKS}</article></section>',
    "comments within": f'<article>{ARTICLE}<div class="comment-list">{REMARKS}</div></article>',
    "advert within": f'<article><h1>Title of it</h1>{"".join(f"<p>{p}</p>" for p in BODY[:3])}<div class="ad-slot"><p>Buy now and save, {REMARKS}</p></div>{"".join(f"<p>{p}</p>" for p in BODY[3:])}</article>',
    "aside and form within": f"<main><h1>Title of it</h1><p>{BODY[0]}</p><aside>{REMARKS}</aside><form><p>Your name and address, please</p><input></form>{''.join(f'<p>{p}</p>' for p in BODY[1:])}</main>",
    "header of the article": f"<header><h1>The Paper</h1>{MENU}</header><article><header><h1>Title of it</h1><span>by someone</span></header>{PROSE}</article>",
    "entry header": f'<div class="masthead"><h1>The Paper</h1></div><div><div class="entry-header"><h1>Title of it</h1><p>12 May</p></div>{PROSE}</div><div>{MENU}</div>',
    "header that holds all": f'<div class="header-wide"><article>{ARTICLE}</article></div>',
    "notices": f'<div class="cookie-notice">{REMARKS}</div><article>{ARTICLE}</article><div class="newsletter_signup">{REMARKS}</div><div hidden>{REMARKS}</div><p style="display: none">{REMARKS}</p>',
    "names in other languages": f'<div class="werbung">{REMARKS}</div><article>{ARTICLE}<div id="leser-kommentare">{REMARKS}</div><ol class="commentlist"><li>{REMARKS}</li></ol></article><div id="cookiebanner">{REMARKS}</div>',
    "commentary": f'<div><article class="commentary">{ARTICLE}</article></div>',
    "no sidebar": f'<div class="no-sidebar"><div class="has-comments">{ARTICLE}</div></div>',
    "scripts": f"<script>if (a<b) document.write('<article></p>{REMARKS}')</script><style>p>a{{}}</style><noscript>{REMARKS}</noscript><article>{ARTICLE}</article><!-- <p>{REMARKS}</p> --><template>{REMARKS}</template>",
    "upper case": f"<NAV>{MENU}</NAV><ARTICLE>{ARTICLE.replace('p>', 'P>')}</ARTICLE><FOOTER>{REMARKS}</FOOTER>",
    "unclosed": f"<nav>{MENU}</nav><article><h1>Title of it</h1>{''.join(f'<p>{p}' for p in BODY)}</article><footer>{REMARKS}",
    "cut off": f"<nav>{MENU}</nav><article>{ARTICLE}<p",
    "attributes": f"<nav title='a > b'>{MENU}</nav><article data-x=\"</article>\">{ARTICLE}</article>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    assert main_text(f"<!DOCTYPE html><html><head><title>Title</title></head><body class='sidebar-right'>{LAYOUTS[name]}</body></html>") == WANT


def test_blocks_white_space_and_references():
    html = "<article><h1>A&nbsp;&lt;b&gt;\n &amp;amp; c</h1><p>one<b>two</b>\t three <br>four <a href='#'>five</a>.</p><div>x &euro; y &#x263A;<p>z &am</p>tail</div><ul><li>i</li><li>j<ul><li>k</li></ul></ul></article>"
    assert main_text(html) == "A <b> &amp; c\nonetwo three four five.\nx € y ☺\nz &am\ntail\ni\nj\nk"


def test_program_text_keeps_its_comments():
    assert main_text('<article><p>Use it so:</p><pre><span class="comment"># note</span> f(a &lt; b)</pre></article>') == "Use it so:\n# note f(a < b)"


@pytest.mark.parametrize("html", [None, "", " ", "<p></p>", "<", "<!--", "</", "<script>x", "<a href='", "<div class=\"x", "\x00", "<nav>menu</nav>"])
def test_pages_without_text(html):
    assert main_text(html) in ("", "<", "\x00")


def test_text_without_markup_and_long_pages():
    assert main_text("plain words of a file\n\nwithout any tag") == "plain words of a file without any tag"
    long = "<article>" + "".join(f"<p>word {i}</p>" for i in range(100_000)) + "</article>"
    assert main_text(long) == "\n".join(f"word {i}" for i in range(100_000))
    assert main_text("<div>" * 20_000 + "<p>deep words here</p>") == "deep words here"
    assert main_text("<a \"" * 20_000 + ">") == ""


def test_region_equals_trying_all():
    rng = np.random.default_rng(4)
    for _ in range(300):
        scores = rng.integers(-3, 4, rng.integers(0, 9)).astype(float).tolist()
        start, end = best_region(scores)
        best = max((sum(scores[i:j]) for i, j in combinations(range(len(scores) + 1), 2)), default=0)
        assert sum(scores[start:end]) == max(best, 0)


def test_weights_are_words_for_and_tags_against():
    learned = html_extract.weights()
    assert all(w <= 0 for w in learned.tag.values()) and learned.tag["p", False] > learned.tag["div", False]
    word = lambda **on: learned.word[tuple(int(f == "bias" or f in on) for f in html_extract.FEATURES)]
    assert word() > 0 and word(inside=1) > 0 > word(outside=1) and word(link=1, item=1) < 0
    assert all(learned._agreement(html_extract.read_items(p), learned.cost) > 0.95 for p in html_extract.PAGES)


def test_odd_rows(spark):
    page = f"<article>{ARTICLE}</article>"
    rows = [(1, "u", page, 1, "x"), (1, "u", page, 1, "x"), (None, None, page, None, None), (2, "v", None, 1, "x"), (3, None, "", 1, "x")]
    found = sorted((tuple(r) for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()), key=str)
    assert found == sorted([(1, "u", WANT, len(WANT))] * 2 + [(None, None, WANT, len(WANT)), (2, "v", "", 0), (3, None, "", 0)], key=str)
    assert html_extract.extract(spark.createDataFrame([], PAGES)).collect() == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query_equals_the_article_elements(spark):
    """The given pages have one article each, of headings and paragraphs; some are cut off."""

    def plain(html):
        text = re.sub(r"<[^>]*\Z", "", re.search(r"<article>(.*?)(</article>|\Z)", html, re.S)[1])
        parts = re.split(r"</?(?:p|h1)\b[^>]*>", text)
        return "\n".join(t for t in (" ".join(unescape(re.sub(r"</?b>", "", p).replace("<br>", " ")).split()) for p in parts) if t)

    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    found = queries.op12_html_extraction(spark, DATA).collect()
    assert len(found) == len(pages)
    for r in found:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain(pages[r.page_id].html), len(r.text))
