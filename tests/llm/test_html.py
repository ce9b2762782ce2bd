"""Main text: the parser on hand-made pages, the templates against brute force."""

import re
from html import unescape

import pytest

from roadspeed.llm import html, queries


def texts(page):
    """Text blocks of a page of its own, without templates."""
    found, n = html.main_text(page, set())
    assert n == 0
    return found.split("\n\n") if found else []


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a<p>b  \n c<br>d</p>", ["a", "b c d"]),
        ('<head><title>T</title><script>var t="</p>";</script></head><body><p>x</p>', ["x"]),
        ("<nav><ul><li>menu<article><h1>H</h1>text<p>more</article><footer>f", ["H", "text", "more"]),
        ("<article><header><h1>Head</h1></header><p>One <b>two<br><p>three</article><footer>&copy;</footer>", ["Head", "One two", "three"]),
        ("<div class='ad'>buy</div><div id=sidebar>s</div><div class=gadget>ok</div>", ["ok"]),
        ("<article>text<section class='comments'><article class=comment>no</article></section></article>", ["text"]),
        ("<article>a</article><p>outside</p>", ["a"]),
        ("<body class='has-sidebar'><main class='with-sidebar'><p>in</p><aside>out</aside><form>f</form></main>", ["in"]),
        ("<p>1 < 2 &lt;b&gt; &#65;&nbsp;x</p><!-- no --><p hidden>no</p>", ["1 < 2 <b> A x"]),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", ["a", "b", "c", "d"]),
        ('<p title="a>b">q</p><p>un<i>der</i>line</p>', ["q", "underline"]),
        ("<style>p{}</style><noscript>n</noscript><p>k</p><script>unclosed <p>x", ["k"]),
        ("<div role=navigation>n</div><div>a<div>b</div>c</div>", ["a", "b", "c"]),
        ("<p title='the hidden truth' data-x='display:none'>seen</p><p style='color:red;display: none'>no</p><p aria-hidden=true>no</p><p HIDDEN>no</p>", ["seen"]),
        ("<div class='post-header'><h1>Title</h1></div><div class='page-header'>no</div><p class='share-price'>up</p>", ["Title", "up"]),
        ("<article><div class=header>T</div><div class='related-work'>w</div><div class='relatedPosts'>no</div><p class='intro'>p<span class=share-buttons>no</span>q</p></article>", ["T", "w", "pq"]),
        (f"<div><p>{'A long story. ' * 20}</p></div><article>Next</article>", [("A long story. " * 20).strip(), "Next"]),
        ("<div id=cookie-banner-2>no</div><div class='ad-slot'>no</div><div class='UserComments'>no</div><div class=has-comments>ok</div>", ["ok"]),
    ],
)
def test_parse(page, expected):
    assert texts(page) == expected


def test_long_and_broken_pages():
    assert texts("<p>x</p>" * 20_000) == ["x"] * 20_000
    assert texts("<div>" * 5_000 + "deep") == ["deep"]
    assert texts('<a "' * 20_000 + "x") is not None
    assert texts("<" * 50_000 + "x") == ["<" * 50_000 + "x"]


STRIP = re.compile(r"<[^>]+>")


def test_templates(spark):
    """Pages of known parts: what a person would keep is known without the parser."""
    pages, expected = [], {}

    def add(i, url, parts, kept):
        pages.append((i, url, "<body>" + "".join(parts) + "</body>", "x", "h", "b"))
        expected[i] = "\n\n".join(STRIP.sub("", x) for x in kept)

    welcome, legal, small = "<div><p>Welcome here</p></div>", "<div><p>All rights are ours.</p></div>", "<div><p>Small print.</p></div>"
    for i in range(30):  # on all pages of the host
        story = [f"<p>Story {i} and more</p>", f"<p>Same day {i % 29}</p>"]
        add(i, f"https://big.example/{i}", [welcome, "<div>", *story, "</div>", legal], story)
    for i in range(100, 109):  # a host of nine pages has no template
        add(i, f"https://small.example/{i}", [small, f"<p>Tale {i}</p>"], [small, f"<p>Tale {i}</p>"])
    for i in range(200, 260):  # three layouts of a third each, no sign in the path
        box = f"<div><p>Layout {i % 3}</p></div>"
        add(i, f"https://three.example/{i}/x", [box, f"<p>Tale {i}</p>"], [f"<p>Tale {i}</p>"])
    for i in range(300, 400):  # a section of fifteen pages among a hundred; half of its pages in an article
        box, own = "<div><p>Only in this section</p></div>", i < 315
        add(i, f"https://parts.example:80/{'rare' if own else 'often'}/{i}", [box * own, f"<article><p>Tale {i}</p>", "<p>A line that recurs</p>" * (i % 3 == 0), "</article>"], [f"<p>Tale {i}</p>", *["<p>A line that recurs</p>"] * (i % 3 == 0)])
    for i in range(500, 530):
        add(i, "http://copy.example/", ["<article><p>One article, many copies</p></article>"], ["One article, many copies"])
    deep = "<div>" * 60 + "<p>Far below</p>" + "</div>" * 60
    for i in range(600, 620):  # sixty elements deep
        add(i, "http://deep.example/a", [f"<section>{deep}</section>", f"<p>Tale {i}</p>"], [f"<p>Tale {i}</p>"])
    for i in range(700, 703):
        pages.append((i, [None, "no host", "http://big.example"][i - 700], [None, "", welcome][i - 700], "x", "h", "b"))
        expected[i] = ""
    pages += [pages[0], pages[-1]]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string, host string, hashes string")
    rows = html.extract(df).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == expected[r.page_id], r.page_id
        assert r.n_chars == len(r.text)
    by = {r.page_id: r for r in rows}
    assert (by[1].n_templates, by[100].n_templates, by[200].n_templates, by[300].n_templates, by[600].n_templates) == (2, 0, 1, 1, 1)
    assert {r.page_id: r.url for r in rows} == {p[0]: p[1] for p in pages}


def test_template_list_joined_beyond_the_broadcast_limit(spark, monkeypatch):
    pages = [(i, "http://a.example/", f"<div>Top</div><p>Tale {i}</p>") for i in range(20)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    monkeypatch.setattr(html, "BROADCAST_HASHES", 0)
    assert sorted(r.text for r in html.extract(df).collect()) == sorted(f"Tale {i}" for i in range(20))


def test_no_pages(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


ARTICLE = "<h1>Title</h1><p>First part of the story.</p><p>Second part.</p>"
STORY = "Title\n\nFirst part of the story.\n\nSecond part."


@pytest.mark.parametrize(
    "page",
    [
        f'<article class="post has-comments">{ARTICLE}</article>',
        f'<main class="content comments-open">{ARTICLE}</main>',
        f'<article id="post-no-comments">{ARTICLE}</article>',
        f'<article class="post comment">{ARTICLE}</article>',  # holds the only h1
        '<article><div class="hero-banner"><h1>Title</h1></div><p>First part of the story.</p><p>Second part.</p></article>',
        '<main><div class="promo"><div class="related"><h1>Title</h1></div></div><div class="related">Others</div><p>First part of the story.</p><p>Second part.</p></main>',
        f'<article>{ARTICLE}<ol class="comment-list"><li><article class="post">Nice</article></li></ol></article>',
        f'<article>{ARTICLE}</article><article class="comment even depth-1"><p>Nice</p></article><article class="comment-body">Bad</article>',
        f'<article>{ARTICLE}<div class="cookie-notice">We use cookies</div><div class="ad-banner">Buy</div><div id="nav-menu">Home</div></article>',
        f'<div class="banner">Buy</div><div class="notice">Closed</div><ul class="menu"><li>Home</li></ul><article>{ARTICLE}</article>',
    ],
)
def test_articles_stay_whole(page):
    assert html.main_text(page, set())[0] == STORY


def test_parts_of_an_article_keep_their_names():
    page = '<article><h1>Title</h1><section class="restaurant-menu">Soup</section><div class="notice">Closed on Monday</div><div class="page-header">By us</div></article>'
    assert html.main_text(page, set())[0] == "Title\n\nSoup\n\nClosed on Monday\n\nBy us"
    two = '<article><h1>Title</h1><div class="promo"><h1>Buy</h1></div><p>Text</p></article>'
    assert html.main_text(two, set())[0] == "Title\n\nText"


def brute_text(page):
    """The article of a page as the given tables have it: tags without names, adverts between or inside blocks."""
    body = re.search(r"<article>(.*)</article>", page, re.S)
    if not body:
        return None
    body = re.sub(r"<(script|style|form|aside|nav|footer|header)\b.*?</\1>|<!--.*?-->", "", body[1], flags=re.S)
    body = re.sub(r'<div class="ad">.*?</div>', "", body, flags=re.S)
    blocks = re.split(r"</?(?:p|h[1-6]|div|ul|ol|li|blockquote|section|table|tr|td|th|pre|figure|figcaption|hr)\b[^>]*>", body)
    texts = [" ".join(unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br\s*/?>", " ", b))).split()) for b in blocks]
    return "\n\n".join(t for t in texts if t)


def test_query_against_plain_expressions(spark):
    """Every page of the given table whose article is marked up without names, through the query."""
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    found = {r.page_id: r.text for r in queries.op5_main_text(spark, "/root/testdata/sf0.001").collect()}
    assert found.keys() == pages.keys()
    plain = {i: brute_text(h or "") for i, h in pages.items()}
    known = [i for i, t in plain.items() if t is not None]
    assert len(known) >= 20
    assert [i for i in known if found[i] != plain[i]] == []


def test_a_very_long_page_and_repeated_ids(spark):
    long = "<article>" + "<p>word other third</p>" * 60_000 + "</article>"
    rows = [(1, "http://a/", long), (1, "http://a/", "<article>Short</article>"), (1, "http://a/", "<article>Short</article>"), (None, None, "<article>No id</article>"), (2, "http://b/", None)]
    found = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in found) == sorted([("1", 60_000 * 18 - 2), ("1", 5), ("1", 5), ("None", 5), ("2", 0)])
