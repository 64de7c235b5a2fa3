"""Web page operators: main text and url filter."""

import html
import re
from collections import Counter

import pytest

from conftest import SF_CHECK
from helpers import rows_of
from quarry.llm import html_extraction, url_filter
from quarry.llm.html_extraction import Weights, main_text
from quarry.llm.queries import URL_RULES

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="main">
<header class="site-header"><a href="/">Site name</a></header><nav><ul><li><a href=/a>Menu</a></ul></nav>
<div class="cookie-notice">We use cookies, many cookies.</div>
<{tag}><header><h1>Head &amp; line</h1></header><p>First   <b>bold</b>text<br>next &lt;b&gt; line.
<p>Second paragraph<script>var x = "<p>no</p>";</script> goes on.</p>
<div class="ad-slot">Buy this now.</div><aside>Side note</aside><ul><li>item one<li>item two</ul>
<form><label>Name</label><input><button>Send</button></form><p hidden>secret</p>
<p>Last one.</p><div id="comments"><p>A reader's long comment that must go away.</p></div></{tag}>
<!-- <p>commented</p> --><footer>&copy; Site</footer></body></html>"""
TEXT = "Head & line\n\nFirst boldtext next <b> line.\n\nSecond paragraph goes on.\n\nitem one\n\nitem two\n\nLast one."


@pytest.mark.parametrize("tag", ["article", "main", "div", "section"])
def test_main_text_without_furniture(tag):
    # outside of an article a header element is the page's
    want = TEXT if tag in ("article", "main") else TEXT.removeprefix("Head & line\n\n")
    assert main_text(PAGE.format(tag=tag), Weights()) == want


def test_cut_off_and_odd_markup():
    w = Weights()
    assert main_text("", w) == "" and main_text("<p", w) == "" and main_text("<!-- x", w) == ""
    assert main_text("plain text only", w) == "plain text only"
    assert main_text("<article><p>One two three</p><p>cut &am", w) == "One two three\n\ncut &am"
    assert main_text("<article><p>a < b and c > d</p><p class='x", w) == "a < b and c > d"
    assert main_text("<script>only()</script><style>x", w) == ""
    assert main_text("</div></p><p>text here", w) == "text here"
    assert main_text("<p>" * 3000 + "deep" + "</p>" * 3000, w) == "deep"
    assert main_text("<a title='" * 2000, w) == ""


def test_template_pages_exactly(spark):
    pages = spark.read.parquet(f"{SF_CHECK}/pages.parquet")
    got = {r["page_id"]: r for r in html_extraction.extract_main_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split())
                  for b in re.split(r"</?(?:p|h1)>", body)]
        want = "\n\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == want
        assert got[r["page_id"]]["n_chars"] == len(want)


def test_page_cases(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x y z</p>"), (3, "u", "<p>x y z</p>"),
            (3, "u", "<p>x y z</p>"), (4, "u", PAGE.format(tag="article"))]
    df = spark.createDataFrame([(*r, "id", 1) for r in rows],
                               "page_id bigint, url string, html string, text string, id int")
    got = rows_of(html_extraction.extract_main_text(df))
    assert Counter((r["page_id"], r["text"]) for r in got) == Counter(
        {(1, ""): 1, (2, ""): 1, (None, "x y z"): 1, (3, "x y z"): 2, (4, TEXT): 1})
    assert html_extraction.extract_main_text(df.limit(0)).count() == 0


LIST = """<body><nav><ul><li>Home page<li>All our topics</ul></nav><div>Some plain words of the site</div>
<article><p>{}</p>{}</article><footer><section>The site's own foot</section></footer></body>"""


def test_containers_of_furniture_are_kept_inside_an_article(spark):
    inner = "<ul><li>first item</li><li>second item</li></ul><div>a plain box of many words</div><p>The end.</p><ul><li>last</ul>"
    rows = [(i, "u", LIST.format("word " * 40, "")) for i in range(30)] + [(30, "u", LIST.format("An intro.", inner))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    want = "An intro.\n\nfirst item\n\nsecond item\n\na plain box of many words\n\nThe end.\n\nlast"
    weights = html_extraction.learn(pages.limit(30), "page_id", "html")
    assert "ul" not in weights.words and weights.words["div"] < html_extraction.DROP
    assert main_text(rows[30][2], weights) == want
    got = {r["page_id"]: r["text"] for r in html_extraction.extract_main_text(pages).collect()}
    assert got[30] == want and got[0] == " ".join(["word"] * 40)


def test_names_of_article_parts_are_not_furniture():
    keep = ('<h2 id="related-work">Related work</h2>', '<h2 id="legal-basis">Legal basis</h2>',
            '<section class="search-methods"><p>How we searched</p></section>',
            '<section id="search"><p>Search</p></section>', '<p id="notice">A notice</p>',
            '<span class="social-science">Social</span>', '<div id="hidden-variables"><p>Variables</p></div>',
            '<h3 class="comment-on-method">On method</h3>', '<div id="login-theory">Theory</div>')
    drop = ('<div class="ad-300x250">Buy</div>', '<div class="related-posts">More</div>', '<div class="related">More</div>',
            '<div id="comments">Talk</div>', '<div class="site shareButtons">Share</div>', '<p class="md cookie-notice">Ok</p>',
            '<div role="search">Find</div>', '<section role="note complementary">Aside</section>', '<nav id="toc">Menu</nav>')
    for tag in ("article", "main"):
        page = f"<{tag}><p>Begin here.</p>{''.join(k + d for k, d in zip(keep, drop))}<p>The end.</p></{tag}>"
        want = ["Begin here.", *(re.sub("<[^>]*>", "", k) for k in keep), "The end."]
        assert main_text(page, Weights()).split("\n\n") == want
    # outside of content one word is enough, as before
    assert main_text('<div class="search-methods">Find</div><article><p>Text.</p></article>', Weights()) == "Text."


ARTICLE = "<article><p>The article of the page is long enough to be read.</p></article>"
SAID = "The article of the page is long enough to be read."


@pytest.mark.parametrize("name", ["overflow-hidden", "has-sidebar", "no-sidebar", "search-results", "comments-open"])
def test_a_wrapper_s_name_does_not_lose_the_article(name):
    w = Weights()
    for page in (f'<body><div class="{name}">{ARTICLE}</div></body>', f'<div id="{name}"><div>{ARTICLE}</div></div>',
                 f'<form class="{name}">{ARTICLE}</form>', f'<div class="{name}">{ARTICLE.replace("<article", "<main").replace("</article", "</main")}</div>',
                 f'<div class="{name}"><p>{SAID}</p></div>'):
        assert main_text(page, w) == SAID, page
    # furniture inside stays out, and cards in a named box do not come back beside the article
    page = f'<div class="{name}"><article><p>{SAID}</p><div class="ad-slot">Buy</div><nav>Menu</nav></article></div>'
    assert main_text(page, w) == SAID
    page = f'{ARTICLE}<div class="related"><article><p>Another story, a card only</p></article></div>'
    assert main_text(page, w) == SAID
    assert main_text(f"<nav>{ARTICLE}</nav><aside>{ARTICLE}</aside><div hidden>{ARTICLE}</div>", w) == ""


def test_attributes_are_read_as_such():
    w = Weights()
    for attrs in ('title="a hidden gem"', "data-hidden='false'", 'data-class="ad"', 'alt="class=ad"', "x=hidden",
                  'title="id=comments role=search"', 'aria-hidden="false"', "data-id=comments", 'title = "style=display:none"'):
        assert main_text(f"<article><p>One.</p><div {attrs}>Kept here.</div></article>", w) == "One.\n\nKept here.", attrs
    for attrs in ("hidden", "HIDDEN=''", 'class=ad-slot', "CLASS='x ad'", "id = comments", 'style="a:b;display: none"',
                  "data-x='>' hidden", "aria-hidden=true"):
        assert main_text(f"<article><p>One.</p><div {attrs}>Gone here.</div></article>", w) == "One.", attrs


def test_letters_that_change_length_in_lower_case():
    page = "<p>İİİİ İstanbul" + "İ" * 50 + "</p><SCRIPT>var x = 1</Script><article><p>Behind the script.</p></article>"
    assert main_text(page, Weights()).endswith("Behind the script.") and "var" not in main_text(page, Weights())


def test_text_of_labels_outputs_and_formulas_in_an_article():
    page = ("<article><p>The sum <label>called</label> is <output>5</output> and <math><mi>x</mi><mo>=</mo><mn>2</mn>"
            "<annotation>x=2</annotation></math> holds.</p><form><label>Name</label></form></article>"
            "<label>Outside</label>")
    assert main_text(page, Weights()) == "The sum called is 5 and x=2 holds."


def test_many_open_elements_and_stray_end_tags_take_linear_time():
    import time
    took = []
    for n in (10_000, 40_000):
        page = "<div>" * n + "text of the page" + "</span>" * n + "</section>" * n
        t = time.perf_counter()
        assert main_text(page, Weights()) == "text of the page"
        took.append(time.perf_counter() - t)
    assert took[1] < 12 * took[0] + 1


def test_scan_finds_the_best_of_all_intervals():
    import random
    rng = random.Random(2)
    for _ in range(500):
        values = [rng.choice([-3, -1, -1, 0, 1, 2]) / 1 for _ in range(rng.randint(0, 14))]
        start, end = html_extraction.best_region(values)
        best = max((sum(values[i:j]) for i in range(len(values)) for j in range(i + 1, len(values) + 1)), default=0)
        assert sum(values[start:end]) == max(best, 0)


def test_every_container_of_the_sample_is_learnt(spark):
    rows = [(i, f'<body>{"".join(f"<div class=c{i}x{k}>some words</div>" for k in range(300))}{ARTICLE}</body>')
            for i in range(30)]
    weights = html_extraction.learn(spark.createDataFrame(rows, "page_id bigint, html string"), "page_id", "html")
    assert sum(k.startswith("div.c") for k in weights.words) == 9000 and {"div", "p", "article"} <= set(weights.tags)


# ------------------------------------------------------------- url filter

URLS = [("http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/"),
        ("http://example.net", "example.net", "", None),
        ("http://myexample.net/en/", "myexample.net", "/en/", "net/"),
        ("https://b.org/fr/x", "b.org", "/fr/x", "org/fr/"),
        ("https://b.org/fr", "b.org", "/fr", None),
        ("ftp://example.com/de/#a", "example.com", "/de/", "example.com/de/"),
        ("no scheme", "", "", None), (None, "", "", None), ("://", "", "", None),
        ("http://x://y/fr/", "x:", "//y/fr/", None), ("http://h?q=/en/", "h", "", None),
        ("http://É.net/A", "É.net", "/A", "net/")]


def test_rules_hosts_and_paths(spark):
    df = spark.createDataFrame([(i, u[0], "x", "y") for i, u in enumerate(URLS)],
                               "page_id bigint, url string, host string, verdict string")
    got = {r["page_id"]: r for r in url_filter.url_filter(df, URL_RULES).collect()}
    assert {i: (r["host"], r["path"], r["rule"]) for i, r in got.items()} == \
        {i: u[1:] for i, u in enumerate(URLS)}
    assert all(r["verdict"] == URL_RULES[r["rule"]] for r in got.values() if r["rule"])
    assert all(r["verdict"] in ("allow", "block") for r in got.values())
    assert url_filter.url_filter(df.limit(0), URL_RULES).count() == 0


def test_hosts_are_shrunk_towards_their_domain(spark):
    rows = [(f"h{i}.bad.com", 20, 19) for i in range(10)] + [(f"h{i}.good.com", 20, 1) for i in range(10)]
    rows += [("new.bad.com", 0, 0), ("new.good.com", 0, 0), ("odd.good.com", 30, 29),
             ("one.good.com", 1, 1)]
    df = spark.createDataFrame(rows, "host string, n int, bad int")
    got = {r["host"]: r for r in url_filter.reputation(df).collect()}
    assert got["new.bad.com"]["blocked"] and not got["new.good.com"]["blocked"]
    assert got["odd.good.com"]["blocked"]           # its own evidence outweighs the domain
    assert not got["one.good.com"]["blocked"]       # one bad page does not
    assert got["one.good.com"]["mean"] > got["new.good.com"]["mean"]
