from __future__ import annotations

import random
import re

import pytest

from apptledger.llm import html, queries

FURNITURE_INSIDE = re.compile(r"(?s)^(?:(?!</article>).)*<(?:aside|nav|form|footer|section|div|figure)")

PAGE = "page_id long, url string, html string"


def text_of(page, template=()):
    tokens = html.Reader().tokens(page)
    return html.main_text(tokens, html.valid_places([t[0] for t in tokens], list(template)))


@pytest.mark.parametrize(("page", "expected"), [
    ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("a<br>b", "a b"), ("a<b>c</b>d <i>e</i>", "acd e"),
    ("<article><h1>T</h1><p>x &amp; y&nbsp;z &lt;q&gt;</article><footer>f</footer>", "T\n\nx & y z <q>"),
    ("<nav>n</nav><div>body</div><aside>s</aside>", "body"),
    ("<header><h1>site</h1></header><article><header><h1>T</h1></header>x</article>", "T\n\nx"),
    ("<main>m</main><div>other</div>", "m"), ("<div role=main>m</div><p>other", "m"),
    ("<article>a<div class='ad box'>buy</div><form><p>f</form>b</article>", "a\n\nb"),
    ("<article>a</article><article class=comment>c</article><section id='comments'><article>d</article></section>", "a"),
    ("<div class='cookie-notice'>n</div><p>t", "t"), ("<script>var x='</p>';</script><style>p{}</style>t", "t"),
    ("<!-- <p>no</p> -->t<!-- open", "t"), ("<article><p>cut off <a href='/x", "cut off"), ("<p>1 < 2 and &am", "1 < 2 and &am"),
    ("<title>no</title><textarea>no</textarea><svg><text>no</text></svg>t", "t"),
    ("<ul class=menu><li>a<li>b</ul><ul><li>c<li class=ad>d<li>e</ul>", "c\n\ne"),
    ("<a title=\"x > y\" href='<p>'>link</a>", "link"), ("<P CLASS=X>Up</P>", "Up"), ("<body class='has-sidebar'>t", "t"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"), ("<article> \n </article>x", ""),
    ("<p>a</p><svg/><p>b</p>", "a\n\nb"), ("<p>a</p><svg viewBox='0 0' /><p>b</p><svg><text>x/</text></svg>c", "a\n\nb\n\nc"),
    ("<article>a<section id=discussion>d</section><div class='reply-letter'>r</div><div class='search-results-analysis'>s</div></article>",
     "a\n\nd\n\nr\n\ns"),
    ("<article>a<div class='share-bar'>x</div><div class='share-price-report'>s</div><div id=comments>c</div></article>", "a\n\ns"),
    ("<article><p>a<p class=advert>Buy now</p><p>b</p><h2 class=menu>m</h2>c<span class=ad>x<b>y</b></span>d</article>", "a\n\nb\n\ncd"),
    ("<p class=ad>x<p>t<span class='ad'>y<p>u", "t\n\nu"), ("<p class=notice>n</p><p class='related'>r</p>t", "n\n\nt"),
    ("<div><p class=ad>x</div>t<a class=comment-link>c</a> u", "t u"), ("<p class=ad>x<a href=y>z</a> w</p>t", "t"),
    ("<p>a</nav></div></p>b", "a\n\nb"), ("<header class=x><p>h</header><h1 class=header>T</h1>", "T"),
])
def test_by_element(page, expected):
    assert text_of(page) == expected


def site(number: int, article: str, head: str = "Daily News") -> str:
    """A page whose furniture no element or class gives away."""
    return (f"<html><body><div class=a1><div>{head}</div><div>Home World Sport</div></div><div class=b2><h2>Story {number}</h2>"
            f"{article}</div><div class=c3>All content belongs to its owners</div></body></html>")


def rows(spark, pages):
    return {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, PAGE)).collect()}


def test_template_text_goes_and_slots_stay(spark):
    rng = random.Random(1)
    words = ["ran", "sun", "tree", "hill", "lake", "bird"]
    articles = {i: [" ".join(rng.choices(words, k=9)) for _ in range(rng.randint(1, 4))] for i in range(12)}
    pages = [(i, f"http://News.example/{i}", site(i, "".join(f"<p>{p}" for p in a))) for i, a in articles.items()]
    got = rows(spark, pages + [(100, "http://other.example/", pages[0][2]), (101, None, pages[0][2])])
    for i, paragraphs in articles.items():
        assert got[i] == "\n\n".join([f"Story {i}", *paragraphs])
    # A host with a single page has no template.
    assert got[100].startswith("Daily News\n\nHome") and got[101] == got[100]


def test_copies_count_once(spark):
    """Many copies of one page do not make its article a template's."""
    pages = [(i, "http://h.example/", site(1, "<p>the same story")) for i in range(30)]
    pages += [(100 + i, "http://h.example/x", site(i + 2, f"<p>story of {i}")) for i in range(8)]
    got = rows(spark, pages)
    assert got[0] == "Story 1\n\nthe same story" and got[29] == got[0]
    assert got[103] == "Story 5\n\nstory of 3"


def test_near_copies_count_once(spark):
    """One story under many addresses, each with its own mark, keeps its text; so does a sentence that all articles share."""
    rng = random.Random(7)
    words = [f"word{i}" for i in range(300)]
    story = "".join(f"<p>{' '.join(rng.choices(words, k=30))}" for _ in range(4))
    pages = [(i, f"http://copies.example/{i}", f"<html><body><div class=x>{story}<p>Ref tok{i}</div></body></html>") for i in range(10)]
    pages += [(100 + i, "http://shared.example/", f"<body><div>Home</div><article><p>{' '.join(rng.choices(words, k=30))}<p>We asked for a comment."
               "</article><div>All rights reserved</div></body>") for i in range(8)]
    got = rows(spark, pages)
    for i in range(10):
        assert got[i] == text_of(pages[i][2]) and f"Ref tok{i}" in got[i] and len(got[i]) > 400
    for i in range(8):
        assert got[100 + i] == text_of(pages[10 + i][2]) and got[100 + i].endswith("We asked for a comment.")


def test_templates_too_large_to_broadcast(shuffled_joins, spark):
    pages = [(i, f"http://h{i % 2}.example/", site(i, f"<p>this is the story of {i} and {i * i}")) for i in range(24)]
    got = rows(spark, pages)
    assert all(got[i] == f"Story {i}\n\nthis is the story of {i} and {i * i}" for i in range(24))


def article_text(page):
    """The text of a test page's article by a plain parser: what was built into it."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        blocks, parts, depth, raw = None, None, 0, 0

        def handle_starttag(self, tag, attrs):
            if tag == "article":
                self.depth += 1
            if tag in ("script", "style"):
                self.raw += 1
            if tag == "br":
                self.parts.append(" ")
            elif tag not in html.INLINE:
                self.close_block()

        def handle_endtag(self, tag):
            if tag in ("script", "style"):
                self.raw -= 1
            if tag not in html.INLINE:
                self.close_block()
            if tag == "article":
                self.depth -= 1

        def handle_data(self, data):
            if self.depth and not self.raw:
                self.parts.append(data)

        def close_block(self):
            self.blocks.append(" ".join("".join(self.parts).split()))
            self.parts = []

    parser = Plain(convert_charrefs=True)
    parser.blocks, parser.parts = [], []
    parser.feed(page or "")
    parser.close()
    parser.close_block()
    return "\n\n".join(b for b in parser.blocks if b)


def test_the_query_keeps_every_article(spark):
    """Articles of the given pages hold no furniture, so a plain parser that knows nothing of templates must agree."""
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = {r.page_id: r.text for r in queries.op8_main_text(spark, "/root/testdata/sf0.001").collect()}
    plain = {i: article_text(p) for i, p in pages.items() if "<article" in (p or "") and not FURNITURE_INSIDE.search(p.split("<article", 1)[1])}
    assert len(plain) > len(pages) / 2
    assert {i: got[i] for i in plain} == plain


def test_classes_must_nest_and_keep_order():
    a, b = [1, 2], [3, 4]
    assert html.valid_places([1, 3, 4, 2], [a, b]) == {0, 1, 2, 3}
    assert html.valid_places([1, 3, 2, 4], [a, b]) == {0, 2}  # the one that began later goes
    assert html.valid_places([1, 2, 1, 2, 9], [a]) == {0, 1, 2, 3}
    assert html.valid_places([1, 2, 2, 1], [a]) == set()
    assert html.valid_places([7, 8], [a, b]) == set()


def test_odd_rows(spark):
    long = "<article>" + "<p>long text &amp; more " * 30_000
    nested = "<div>" * 3000 + "deep"
    pages = [(1, None, None), (2, "http://h/", ""), (None, "http://h/", "<p>x"), (None, "http://h/", "<p>x"), (3, "x", long), (4, "http://h/", nested)]
    df = spark.createDataFrame(pages, PAGE).withColumn("text", html.F.lit("old")).withColumn("host", html.F.lit(1))
    got = html.extract(df)
    assert set(got.columns) == set(df.columns)
    texts = {(r.page_id, r.text[:20], len(r.text)) for r in got.collect()}
    assert got.count() == len(pages)
    assert (1, "", 0) in texts and (None, "x", 1) in texts and (4, "deep", 4) in texts
    assert (3, "long text & more\n\nlo", 30_000 * 18 - 2) in texts
    assert html.extract(df.limit(0)).collect() == []
