import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import html as hx

SHELL = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/x">menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy {0}</div>{1}<div id="sidebar">side</div><footer>&copy; foot</footer></body></html>"""


def one(page):
    return hx.blocks_text(hx.main_nodes(hx.parsed(page)))


def test_furniture_goes_and_text_stays():
    page = SHELL.format(1, '<article><h1>Head &amp; line</h1><!-- ad --><p><b>First<br> part&nbsp;one.<p>Two  <i>three</i>\n four &#233; &lt;x&gt;</p><form>mail <input></form><ul><li>a<li>b</ul><section class="comments"><p>reader</p></section></article>')
    assert one(page) == "Head & line\n\nFirst part one.\n\nTwo three four é <x>\n\na\n\nb"


def test_without_article_and_broken_pages():
    assert one("<body><nav>m</nav><div>One</div><div>Two") == "One\n\nTwo"
    assert one("plain words") == "plain words" and one("") == "" and one("<script>x") == ""
    assert one("<article><p>cut off &am</p><p>then <b") == "cut off &am\n\nthen"
    assert one("<article><nav>never closed<p>text</p></article>") == "never closed\n\ntext"
    long = "<article>" + "<p>" + "word " * 20000 + "</p></article>"
    assert len(one(long)) == 5 * 20000 - 1


def test_template_of_a_host(spark):
    """Without telling tags, text that stands on the host's pages alike is furniture."""
    rows = [(i, f"http://h.example/{i}", f"<body><div>Welcome to our site</div><div>Story {i} about thing {i * 7}</div><div>All rights kept</div></body>", "x") for i in range(12)]
    rows += [(50, "http://other.example/1", "<p>Welcome to our site</p>", "x"), (51, None, None, "x"), (52, "no url", "", "x"), (0, "http://h.example/0", rows[0][2], "x")]
    got = sorted((r.page_id, r.url, r.text, r.n_chars) for r in hx.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect() if r.url)
    want = [(i, f"http://h.example/{i}", f"Story {i} about thing {i * 7}") for i in [0, *range(12)]] + [(50, "http://other.example/1", "Welcome to our site"), (52, "no url", "")]
    assert got == sorted((*w, len(w[2])) for w in want)
    assert hx.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def texts_of(spark, pages):
    rows = [(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)]
    return {r.page_id: r.text for r in hx.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_classes_decide(spark):
    """Text that comes and goes by itself is content; with tags of its own, at its place among them, it is furniture."""
    page = lambda i: "<body><div>Top line</div>" + f"<div>Story {i}</div>" + ("<div>Rain again</div>" if i % 10 < 7 else "") + ("<section>Offer</section>" if i % 10 > 2 else "") + "</body>"
    got = texts_of(spark, [page(i) for i in range(20)])
    assert got == {i: f"Story {i}" + ("\n\nRain again" if i % 10 < 7 else "") for i in range(20)}
    got = texts_of(spark, [f"<body><h2>A</h2>Wares<h3>B</h3><p>Story {i}</p></body>" for i in range(9)] + ["<body><h2>A</h2><h3>B</h3>Wares<p>Story 9</p></body>"])
    assert got == {i: f"Story {i}" for i in range(9)} | {9: "Wares\n\nStory 9"}


def test_copies_of_one_story(spark):
    story = "<body><div>Our site</div><{0}><p>The one story</p></{0}></body>"
    assert set(texts_of(spark, [story.format("article")] * 8 + [f"<body><div>Our site</div><article><p>Other {i}</p></article></body>" for i in range(2)]).values()) == {"The one story", "Other 0", "Other 1"}
    other = [f"<body><div>Our site</div><section><p>Other {i}</p></section></body>" for i in range(4)]
    got = texts_of(spark, [story.format("section")] * 12 + other)
    assert got == {i: "The one story" for i in range(12)} | {12 + i: f"Other {i}" for i in range(4)}
    shared = [f"<body><article><p>Said by all</p><p>Other {i}</p></article></body>" for i in range(10)]
    assert texts_of(spark, shared) == {i: f"Said by all\n\nOther {i}" for i in range(10)}


def test_names_alone_empty_no_page(spark):
    """Names that tell a state, or stand on the page's larger part or around its article, drop nothing."""
    text = "<p>" + "The whole story. " * 9 + "</p>"
    want = ("The whole story. " * 9).strip()
    for around in (
        '<div id="page" class="has-sidebar"><div class="content">{}</div></div>', '<div class="article-body with-comments">{}</div>', '<main><div class="entry-content tags-enabled">{}</div></main>',
        '<article><div class="post social-story">{}</div></article>', '<div class="widget">{}</div>', '<div class="promo"><article>{}</article></div>',
    ):
        assert one("<body>" + around.format(text) + "</body>") == want
        got = texts_of(spark, ["<body>" + around.format(text.replace("whole", f"whole {i}")) + "</body>" for i in range(6)])
        assert got == {i: want.replace("whole", f"whole {i}") for i in range(6)}
    assert one(f'<body><div class="postComments">reader</div><div id="cookie_notice">ok</div><div class="main-menu">a</div><div class="site-header">b</div>{text}</body>') == want


def test_named_slots_need_the_template(spark):
    """A name makes furniture of what recurs on the host; a tag of one page alone is content there."""
    long = "Words of the story. " * 5
    got = texts_of(spark, [f'<body><div class="ad">Buy {i}</div><p>{long}{i}</p>' + ('<div class="notice">Found once</div>' if i == 3 else "") + "</body>" for i in range(8)])
    assert got == {i: f"{long}{i}" + ("\n\nFound once" if i == 3 else "") for i in range(8)}


def full_classes(pages):
    """By brute force: token -> (kind, count on every page), and the tokens of each class that holds on the host."""
    read = [hx.parsed(p) for p in pages]
    vectors, texts = defaultdict(lambda: [0] * len(pages)), set()
    for i, page in enumerate(read):
        texts |= {n.token for n in page.nodes if n.token}
        for token, n in Counter(page.tokens).items():
            vectors[token][i] = n
    often = {t: tuple(v) for t, v in vectors.items() if 2 * sum(x > 0 for x in v) >= len(pages)}
    template = set()
    for t, v in often.items():
        tags = [u for u, w in often.items() if u not in texts and [x > 0 for x in w] == [x > 0 for x in v]]
        if t in texts and tags:
            template.add(t)
    named = {e[0] for p in read for e in p.named if sum(x > 0 for x in vectors[e[0]]) >= 2}
    return template, named


def test_classes_agree_with_full_vectors(spark):
    """The sums stand for the occurrence vectors: hosts of the test data and made ones have the classes of brute force."""
    hosts = defaultdict(list)
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        hosts[re.sub(r"^\w+://([^/?#]*).*", r"\1", r.url.lower())].append(r.html)
    hosts["made"] = [f"<div>Top</div><p>Story {i}</p>" + ("<div>Rain</div>" if i % 3 else "") + ("<section class='ad'>Offer</section>" if i % 2 else "") for i in range(12)]
    rows = [(h, hash((h, p)), p) for h, ps in hosts.items() for p in dict.fromkeys(ps)]
    known = {r.host: hx.Template(np.frombuffer(r.known, np.int64).reshape(-1, 4)) for r in hx.templates(spark.createDataFrame(rows, "host string, page_hash long, html string")).collect()}
    for host, pages in hosts.items():
        pages = list(dict.fromkeys(pages))
        if len(pages) >= hx.MIN_PAGES:
            assert (set(known[host].texts), known[host].named) == full_classes(pages), host
        else:
            assert host not in known


def test_classes_change_the_result(spark):
    """Pages of one host without their article tags: with its classes their texts are the articles', without them adverts stay."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("url like '%blog.tionsh.example.com%'").limit(40).collect()]
    bare = [re.sub(r"</?article>", "", p) for p in pages]
    assert texts_of(spark, bare) == {i: one(p) for i, p in enumerate(pages)}
    without = [hx.blocks_text(hx.main_nodes(hx.parsed(p), hx.Template(np.zeros((0, 4), np.int64)))) for p in bare]
    assert all(one(p) != t for p, t in zip(pages, without, strict=True))


def test_quotes_open_values_only_after_their_sign():
    assert one("<article><p>One</p><p><a href=/x title=Bob's>link</a> goes on</p><p>Two is long</p></article>") == "One\n\nlink goes on\n\nTwo is long"
    assert one("<article><p>One</p><p><img alt=5\"screen> goes on</p><p>Two</p></article>") == "One\n\ngoes on\n\nTwo"
    assert one("<article><p>One</p><a href=/p?q=\"x>t</a> <a href=\"a>b\" class='c>d'>u</a> <b x = \"y>z\" =\"q>v</b><p>Two</p></article>") == "One\n\nt u v\n\nTwo"
    assert one("<p>a<br/>b</p><p title='never closed>c</p>") == "a b"


STORY, REMARKS = "<p>" + "story text " * 20 + "</p>", "<section id='comments'>" + ("<div class='comment'><p>" + "remark words " * 20 + "</p></div>") * 9 + "</section>"


@pytest.mark.parametrize("page", ["<article>{s}</article>{c}", "<article>{s}{c}</article>", "<body><h1>Title</h1>{s}{c}</body>", "<main>{s}</main>{c}", "{c}<article>{s}</article>"])
@pytest.mark.parametrize("times", [0, 1, 5])
def test_comments_go_whatever_their_length(page, times):
    got = one(page.format(s=STORY, c=REMARKS * times))
    assert "story text" in got and "remark" not in got and got == one(page.format(s=STORY, c=""))


def test_what_stands_beside_the_main_part_goes_whatever_its_length():
    assert one(f"<main>{STORY}</main><div class='related'>{'other story ' * 400}</div>") == one(f"<main>{STORY}</main>")
    assert one(f"<div class='widget'>{STORY}</div>") == one(STORY)  # nothing else that could be the main part


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://h/1", f"<p>{i}</p>", "x", 3, "y") for i in range(1)], "page_id long, url string, html string, host string, salt int, known string")
    assert [(r.page_id, r.text) for r in hx.main_text(pages).collect()] == [(1, "0")]
