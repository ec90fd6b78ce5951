import html as lib
import re
import time

import pytest

from sparkpanel.llm import html


def test_articles_of_given_pages(spark):
    for r in html.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        assert r.text == " ".join(lib.unescape(re.sub(r"<[^>]+>", " ", body)).split())
        assert r.n_chars == len(r.text)


LONG = "This is the first sentence of a text that goes on for quite a while, as texts do."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<p></p>", ""), ("just text", "just text"), ("<p>a &amp; b <b>x</b>y</p>", "a & b xy"),
        (f"<div class='menu'><a href=x>Home</a></div><p>{LONG}</p><p>short</p><p>{LONG}</p><div id=comments><p>Great!</p></div>", f"{LONG} short {LONG}"),
        (f"<nav>never closed <article><p>{LONG}</p></article><footer>f</footer>", LONG),
        (f"<script>var t='</p>';</script><style>p{{}}</style><form><p>Mail</p></form><p>{LONG}</p>", LONG),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"), ('<a href="x">only a link</a>', ""),
        (f"<div class=sidebar><div><p>{LONG}</p></div></div><main><p>tiny</p></main><aside>{LONG}</aside>", "tiny"),
        (f"<article><header><h1>T</h1></header><p>{LONG}</p><section class='comments'><p>{LONG}</p></section></article>", f"T {LONG}"),
    ],
)
def test_pages(page, text):
    assert html.main_text(page) == text


def test_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", None, 5, 7)], "page_id long, url string, html string, n_chars long, text int")
    assert [tuple(r) for r in html.extract(df).collect()] == [(1, "u", "", 0)]
    assert html.extract(df.limit(0)).count() == 0


LINK = '<a href="x">{}</a>'


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><h1>{LINK.format('Title')}</h1><p>{LONG}</p><ul>{''.join(f'<li>{LINK.format(i)}</li>' for i in range(5))}</ul><p>{LONG}</p><p>{LINK.format('last')}</p></article>", f"Title {LONG} 0 1 2 3 4 {LONG} last"),
        (f"<main><p>{LINK.format('only a link')}</p></main>", "only a link"),
        (f"<div>{''.join(f'<p>{LINK.format(i)}</p>' for i in range(4))}</div><h2>{LINK.format('Title')}</h2><p>{LONG}</p><p>{LINK.format('more')}</p>", f"Title {LONG} more"),
        (f"<p>Short text.</p><p>Some more.</p>{''.join(f'<p>{LINK.format(i)}</p>' for i in range(4))}<p>{LONG}</p>", f"Short text. Some more. {LONG}"),
    ],
)
def test_linked_lines_and_short_runs(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><h2 id='side-effects'>Side</h2><section id='social-history'><p>{LONG}</p></section><div id=search-methods>S</div><p class=legal>law</p></article>", f"Side {LONG} S law"),
        ("<article><p>a</p><figure><img src=x><figcaption>A caption</figcaption></figure><label>b</label><p>c</article>", "a A caption b c"),
        (f"<article><p>{LONG}</p><div class='box related-posts'><p>ad</p></div><div role=navigation>n</div><span class=ad>x <span>y</span> z</span></article>", LONG),
        (f"<p class='notice'>x<p>{LONG}<p>more", f"{LONG} more"),
        (f"<ul><li class='menu-item'>x<li>{LONG}</ul><p>more</p>", f"{LONG} more"),
        (f"<div><p class='notice'>x</div><p>{LONG}</p>", LONG),
        (f"<dl><dt class=ad>x<dd>{LONG}</dl><table><tr><td class=sidebar>s<td>t</table><p>{LONG}</p>", f"{LONG} t {LONG}"),
        (f"<div class=menu><ul><li>a<li>b<ul><li>c</ul></ul><p>d</div><p>{LONG}</p>", LONG),
        (f"<article><div class=share>x</article><p>out</p><article><p>{LONG}</div></p><p>in</p></article>", f"{LONG} in"),
    ],
)
def test_furniture_takes_no_article_text(page, text):
    assert html.main_text(page) == text


def test_unclosed_elements_take_linear_time():
    n = 100_000
    assert html.main_text("<p><table><td>" + "<div>" * n + "</p>" * n + "text") == "text"


def plain(page):
    """The given pages without what stands around their article, by plain expressions."""
    page = re.sub(r"(?s)<head>.*?</head>|<nav>.*?</nav>|<footer>.*?</footer>|<div class=\"ad\">.*?</div>|<!--.*?-->", " ", page)
    return " ".join(lib.unescape(re.sub(r"<[^>]+>", " ", page)).split())


def test_one_rule_for_pages_with_and_without_marks(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        bare = re.sub(r"</?article>", "", r.html)
        assert html.main_text(r.html) == html.main_text(bare) == plain(r.html)
        # the article's mark alone is enough too
        unnamed = re.sub(r"<(/?)(?:nav|footer)>", r"<\1div>", r.html).replace(' class="ad"', "")
        assert html.main_text(unnamed) == plain(r.html)


def test_text_outside_an_article_is_kept_where_it_weighs_as_much():
    long = f"<p>{LONG * 20}</p>"
    assert html.main_text(f"<article>{long}</article>{long}<p>{LONG}</p>") == f"{LONG * 20} {LONG * 20}"


@pytest.mark.parametrize("name", ["layout has-sidebar", "social-science article-body", "legal-news", "overlay", "page sidebar", "mainContent"])
def test_wrappers_named_like_furniture(name):
    assert html.main_text(f"<body><div class='{name}'><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div></body>") == f"Title {LONG} {LONG}"


@pytest.mark.parametrize("name", ["main-nav", "sidebar-left", "comment-list", "siteHeader", "related_posts", "ad-slot-3", "cookie-notice"])
def test_names_of_furniture(name):
    assert html.main_text(f"<div class='{name}'><p>{LONG}</p></div><h1>Title</h1><p>{LONG} More.</p>") == f"Title {LONG} More."


def test_distribution_by_its_definition():
    """Stretches without an empty window in them, kept where one of their windows holds a part of the typical weight."""
    import random

    rng = random.Random(7)
    for _ in range(300):
        lines = [html.Line("x", rng.choice([0, 0, 0, 3, 50, 200]), html.TEXT) if rng.random() < 0.7 else html.Line("", 0, html.TEXT) for _ in range(rng.randrange(1, 40))]
        weights = [float(x.plain) for x in lines]
        if not any(weights):
            continue
        heavy = sorted(weights, reverse=True)
        typical = next(w for i, w in enumerate(heavy) if sum(heavy[: i + 1]) >= sum(heavy) / 2)
        surge, want, at = min(typical * html.SHARE, html.SURGE), [False] * len(lines), 0
        while at < len(lines):
            if not weights[at]:
                at += 1
                continue
            end = at
            while any(weights[end + 1 : end + 1 + html.LINES]):
                end += 1
            while not weights[end]:
                end -= 1
            if max(sum(weights[i : i + html.LINES]) for i in range(at, end + 1)) >= surge:
                for i in range(at, end + 1):
                    want[i] = weights[i] > 0 or lines[i].text == "x"
            at = end + 1
        import numpy as np

        got = html.between_surge_and_dive(lines, np.array(weights))
        # linked lines beside a stretch are another rule's
        assert [g for g, x in zip(got, lines, strict=True) if x.plain] == [w for w, x in zip(want, lines, strict=True) if x.plain]
        assert all(g or not w for g, w in zip(got, want, strict=True))


def unmarked(page):
    """The page with nothing left that names its article or its furniture."""
    page = re.sub(r"<(/?)(?:nav|footer|aside|header)>", r"<\1div>", page).replace(' class="ad"', "")
    return re.sub(r"</?article>", "", page)


def test_distribution_alone_finds_the_text_of_unmarked_pages(spark):
    from collections import Counter

    shares, dropped, lines = [], 0, 0
    for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect():
        page = unmarked(r.html)
        got, want = Counter(html.main_text(page).split()), Counter(plain(r.html).split())
        shares.append(2 * sum((got & want).values()) / sum((got + want).values()))
        found = html.lines_of(page)
        keep = html.between_surge_and_dive(found, html.weights_of(found))
        dropped, lines = dropped + sum(not k and bool(x.text) for k, x in zip(keep, found, strict=True)), lines + sum(bool(x.text) for x in found)
        assert not html.taken_out(found, keep).any()
    print(f"the distribution drops {dropped} of {lines} lines, {sum(s == 1 for s in shares)} of {len(shares)} pages exact, least {min(shares):.3f}")
    # one page in 2,500 has an article of a single word, twice
    assert sum(shares) / len(shares) >= 0.999 and sum(s < 0.95 for s in shares) <= len(shares) / 1000 and dropped > lines / 4


def test_short_closing_lines_responses_and_teasers():
    closing = "".join(f"<div>Line {i} said.</div>" for i in range(12))
    text = " ".join([LONG * 6, *(f"Line {i} said." for i in range(12))])
    assert html.main_text(f"<body><div>{LONG * 6}</div>{closing}</body>") == text
    assert html.main_text(f"<body><h1>Title</h1><div>{LONG * 6}</div>{closing}</body>") == "Title " + text
    article, responses = "word " * 50, "".join(f"<p>{'reply ' * 100}</p>" for _ in range(30))
    assert html.main_text(f"<article><p>{article}</p></article><section>{responses}</section>") == article.strip()
    assert html.main_text(f"<div><article><h1>T</h1><p>{LONG * 8}</p></article><article><h2>Next</h2><p>{LONG}</p></article></div>") == f"T {LONG * 8}"
    assert html.main_text(f"<article><p>{LONG * 4}</p></article><article><p>{LONG * 3}</p></article>") == f"{LONG * 4} {LONG * 3}"
    assert html.main_text(f"<article><p>{LONG * 4}</p><div class=ad>{LONG}</div><p>ab</p><p>cd</p></article>") == f"{LONG * 4} ab cd"


@pytest.mark.parametrize("bad", ["<a ", '<a b="', "<a '", "<!", "<?", "<!--", "<div class=x", "<script>"])
def test_broken_pages_take_linear_time(bad):
    start = time.perf_counter()
    html.main_text(bad * (1_000_000 // len(bad)))
    assert time.perf_counter() - start < 2
