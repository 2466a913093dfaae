import random
import re

import pytest

from quern.llm.html_extract import MIN_PAGES, MIN_SHARE, MIN_TOKENS, ROOT, Template, deduce_templates, extract, main_text, page_tokens, parse

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{x}</style><script>var t="</p>";</script></head><body class="page">
<header class="site"><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><div class="menu"><a>x</a></div><nav><ul><li>n</ul></nav>
<main><article class="post"><header><h1>Title &amp; more</h1><p class="byline">By me</p></header><p>Hello <b>bold</b>text&nbsp;here
 and 1 < 2.</p><!-- ad --><span class="ad">BUY</span><aside>side</aside><div class="share-buttons">share</div><ul><li>one<li>two</ul>
<form><p>Name <input></p></form><section class="comments"><article><p>reader says</p></article></section><p>Last<p></article></main>
<footer>&copy; foot</footer></body></html>"""


def test_article_and_nothing_else():
    assert main_text(PAGE) == "Title & more\nHello boldtext here and 1 < 2.\none\ntwo\nLast"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain &lt;text", "plain <text"),
        ("<article><h1>A<p><b>B<br><p>C &am", "A\nB\nC &am"),
        ("<article><p>cut <a hre", "cut"),
        ("<div class='content'><p>A<p>B</div><div class=sidebar>no</div> tail", "A\nB\ntail"),
        ("<p>x</p><script>a<b", "x"),
        ("<p hidden>no</p><p style='display: none'>no</p><p>yes</p>", "yes"),
        ("</div></p><p>a</nav>b", "a\nb"),
        ("<p>a <span class='ad'>BUY <span>now</span> today</span> b</p>", "a b"),
        ("<p>Hello <span class=ad>BUY</span> world</p>", "Hello world"),
        ("<p>Hello <span class=ad>BUY<p>world</p>", "Hello\nworld"),
        ("<div class='has-sidebar content'><p>x</p></div>", "x"),
        ("<main><h1>The title</h1><article><p>A story of some length</p></article></main>", "The title\nA story of some length"),
        ("<main><p>An opening that is long enough to count</p><article><p>A card</p></article></main>", "An opening that is long enough to count\nA card"),
        ("<p>a <button>press</button> b <label>c <input></label>", "a b"),
    ],
)
def test_pages(html, text):
    assert main_text(html) == text


def test_template_text_of_a_host_is_left_out(spark):
    page = lambda i: f"<html><body><div class='top'>Welcome to our place</div><div class='x'><div>Story number {i} begins</div></div><div class='end'>All rights reserved</div></body></html>"
    rows = [(i, f"http://a.example/{i}", page(i), "t") for i in range(8)] + [(100, None, None, "t"), (101, "http://b.example/", page(101), "t"), (0, "http://a.example/0", page(0), "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    classes = deduce_templates(df).collect()
    assert {r.host for r in classes} == {"a.example"}
    assert max(r.share for r in classes) == 1.0
    found = {r.page_id: r for r in extract(df).collect()}
    assert all(found[i].text == f"Story number {i} begins" for i in range(8))
    assert found[100].text == "" and found[100].n_chars == 0
    assert found[101].text == "Welcome to our place\nStory number 101 begins\nAll rights reserved"
    assert extract(df).count() == len(rows)
    assert any(r.page_id == 0 for r in extract(df).collect())


def test_long_and_empty(spark):
    schema = "page_id long, url string, html string"
    long = "<article>" + "<p>word &amp; more</p>" * 20_000
    r = extract(spark.createDataFrame([(1, "http://c/", long)], schema)).first()
    assert r.text == "\n".join(["word & more"] * 20_000) and r.n_chars == len(r.text)
    assert extract(spark.createDataFrame([], schema)).collect() == []


def test_copies_of_an_article_are_no_template(spark):
    page = lambda *paragraphs: f"<html><body><div class='top'><p>Welcome here</p></div><div class='x'>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div><div class='end'><p>All rights reserved</p></div></body></html>"
    rows = [(i, f"http://a.example/{i}", page(f"Story {i} begins", f"Story {i} ends")) for i in range(8)]
    rows += [(i, f"http://a.example/{i}", page("The copied story", "goes on and on")) for i in range(8, 12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = {r.page_id: r.text for r in extract(df).collect()}
    assert all(found[i] == f"Story {i} begins\nStory {i} ends" for i in range(8))
    assert all(found[i] == "The copied story\ngoes on and on" for i in range(8, 12))


def test_a_repeated_notice_inside_an_article_is_left_out(spark):
    page = lambda *paragraphs: f"<html><body><article>{''.join(f'<p>{p}</p>' for p in paragraphs)}<ul><li>This post may contain links</li></ul></article></body></html>"
    rows = [(i, f"http://a.example/{i}", page(f"Story {i} begins with these words of its own", f"Story {i} ends with some others")) for i in range(8)]
    rows += [(8 + i, f"http://a.example/c{i}", page("The copied story begins here and there", "goes on and on until it ends", f"Copy {i}")) for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = {r.page_id: r.text for r in extract(df).collect()}
    assert all(found[i] == f"Story {i} begins with these words of its own\nStory {i} ends with some others" for i in range(8))
    assert all(found[8 + i].startswith(f"The copied story begins here and there\ngoes on and on until it ends\nCopy {i}") for i in range(4))


def site(i, paragraphs=3):
    """A page without a telling tag or name: only the host's other pages show what is the article."""
    story = "".join(f"<div class='b'>Paragraph {k} of story {i} has words {i * 7 + k} and more of its own {i}{k}</div>" for k in range(paragraphs + i % 3))
    offers = f"<div class='z'><div>Buy the thing number {i % 2} now and save a lot of money today</div></div>"
    links = "".join(f"<a href='/{k}'>Place {k + i}</a> " for k in range(3 + i % 2))
    return f"<html><body><div class='q'><div>{links}</div></div><div class='w'><h1>Story {i}</h1><div class='u'>{story}</div>{offers}</div><div class='y'><div>Words below everything</div></div></body></html>"


def test_the_template_decides(spark):
    df = spark.createDataFrame([(i, f"http://a.example/{i}", site(i)) for i in range(12)], "page_id long, url string, html string").repartition(4)
    for r in extract(df).collect():
        story = [f"Paragraph {k} of story {r.page_id} has words {r.page_id * 7 + k} and more of its own {r.page_id}{k}" for k in range(3 + r.page_id % 3)]
        assert r.text == "\n".join([f"Story {r.page_id}", *story])
        alone = main_text(site(r.page_id))
        assert "Buy the thing" in alone and "Words below" in alone and "Place" in alone


def test_slots_of_classes_and_bare_templates():
    token = lambda token, around, kind, chars, fills, n=10, links=0: {"token": token, "around": around, "kind": kind, "pages": 10, "n": n, "chars": chars, "links": links, "fills": fills}
    t = Template([token(1, ROOT, 1, 1000, 10), token(2, 1, 1, 100, 10), token(3, 1, 1, 900, 10), token(4, 3, 1, 100, 3), token(5, 3, 1, 100, 10, links=90), token(6, 2, 2, 50, 10), token(7, 3, 0, 0, 1)])
    assert (t.way, t.main, t.dropped, t.titles, t.texts) == ([ROOT, 1, 3], 3, {4, 5}, {6}, {7})
    assert Template([]).main is None
    tied = Template([token(1, ROOT, 1, 1000, 10), token(2, 1, 1, 500, 10), token(3, 1, 1, 500, 10)])
    assert tied.main == 1


def test_classes_are_those_of_plain_occurrence_vectors(spark):
    rows = [(i, f"http://{'ab'[i % 2]}.example/{i}", site(i // 2, 2)) for i in range(20)] + [(50, "http://c.example/", site(1))]
    rows += [(60, "http://a.example/copy", site(1, 2))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    want = set()
    for host in ("a.example", "b.example", "c.example"):
        contents = {"\n".join(x for x, _ in parse(html)[1]): page_tokens(html) for _, url, html in rows if f"//{host}/" in url}
        pages = list(contents.values())
        vectors = {k: tuple(p.get(k, [0, 0])[1] for p in pages) for p in pages for k in p}
        around = {k: x[2] for p in pages for k, x in p.items()}
        often = {k for k, v in vectors.items() if sum(map(bool, v)) >= max(MIN_PAGES, MIN_SHARE * len(pages))}
        nested = {k for k in often if around[k] == ROOT or around[k] in often}
        classes = {}
        for k in nested:
            classes.setdefault(vectors[k], set()).add(k)
        want |= {(host, frozenset(c)) for c in classes.values() if len(c) >= MIN_TOKENS}
    assert want and {(r.host, frozenset(t.token for t in r.tokens)) for r in deduce_templates(df).collect()} == want


def test_null_url_repeated_rows_and_clashing_columns(spark):
    rows = [(1, None, site(1), "h", "p"), (1, None, site(1), "h", "p"), (None, "", "<p>x", "h", "p"), (2, "http://a/", None, "h", "p")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, page string")
    found = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in extract(df).collect()), key=str)
    assert [x[0] for x in found] == [0, 1, 1, 2] and found[1] == found[2] and found[1][3] == len(found[1][2]) > 0
    assert found[0][2] == "x" and found[3][2:] == ("", 0)
    assert deduce_templates(df).collect() == []


def test_pages_without_a_telling_tag_or_name(spark):
    """The pages of sf0.01 with all elements but h1 and p made plain divisions: hosts with a template give the same text."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    plain = lambda h: re.sub(r"</(article|nav|footer|ul|li)>", "</div>", re.sub(r'<(article|nav|footer|ul|li)>|<div class="ad">', lambda m: f"<div class='k{len(m[0])}'>", h))
    rows = [(r.page_id, r.url, plain(r.html)) for r in pages.collect()]
    bare = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    told = {r.host for r in deduce_templates(bare).collect()}
    want = {r.page_id: r.text for r in extract(pages).collect()}
    found = {r.page_id: r for r in extract(bare).collect()}
    hosts = {i: re.match(r"\w+://([^/?#]*)", url)[1] for i, url, _ in rows}
    here = [i for i in want if hosts[i] in told]
    assert len(here) > 200 and sum(found[i].text == want[i] for i in here) >= 0.97 * len(here)
    alone = {i: main_text(html) for i, _, html in rows}
    assert sum(alone[i] == want[i] for i in here) == 0


def _words(seed, n):
    return " ".join(random.Random(seed).choices("ka lo mi nu pe ra si to vu wa xe yo".split(), k=n))


def _pages(spark, make, n=12):
    rows = [(i, f"https://h.org/{i}", make(i)) for i in range(n)]
    return {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


_FRAME = "<html><body><nav><a href=/>Home</a></nav>{}<footer>All rights reserved</footer></body></html>"


def _comments(i, by="section id=comments"):
    return f"<{by}><h3>Comments</h3>" + "".join(f"<div class=entry><b>u{j}</b><p>{_words((i, j).__hash__(), 30)}</p></div>" for j in range(8)) + f"</{by.split()[0]}>"


def _article(i):
    return f"T{i}", _words(f"a{i}", 40), _words(f"b{i}", 40)


@pytest.mark.parametrize("n", [12, 2])
@pytest.mark.parametrize("around", ["<div class=post><h1>{}</h1><p>{}</p><p>{}</p></div>", "<main><article><h1>{}</h1><p>{}</p><p>{}</p></article>", "<div class=wrap><div class=post><h1>{}</h1><p>{}</p><p>{}</p></div>"])
def test_more_comments_than_article(spark, around, n):
    close = {"<main": "</main>", "<div class=wrap": "</div>"}.get(around.split(">")[0], "")
    got = _pages(spark, lambda i: _FRAME.format(around.format(*_article(i)) + _comments(i) + close), n)
    assert got == {i: "\n".join(_article(i)) for i in range(n)}


def test_headings_that_recur_in_articles_stay(spark):
    def make(i):
        t, a, b = _article(i)
        return _FRAME.format(f"<div class=post><h1>{t}</h1><h2>Ingredients</h2><p>{a}</p><h2>Method</h2><p>{b}</p><h2>Share this</h2><ul class=x><li><a href=/>Mail</a><li><a href=/>Print</a></ul></div>")

    assert _pages(spark, make) == {i: "{}\nIngredients\n{}\nMethod\n{}".format(*_article(i)) for i in range(12)}


def test_two_layouts_of_a_host(spark):
    def make(i):
        t, a, b = _article(i)
        return _FRAME.format(f"<div class={'story' if i % 3 == 0 else 'post'}><h1>{t}</h1><p>{a}</p><p>{b}</p></div><div class=box><p>Read our {_words(i, 6)}</p></div>")

    assert _pages(spark, make) == {i: "\n".join(_article(i)) for i in range(12)}


def test_names_that_only_hold_a_telling_word_stay(spark):
    def make(i):
        t, a, b = _article(i)
        return _FRAME.format(f"<div class=post><h1>{t}</h1><p>{a}</p><div class=social-history><p>{b}</p></div><div class=social-share><p>Like {_words(i, 5)}</p></div></div>")

    assert _pages(spark, make) == {i: "\n".join(_article(i)) for i in range(12)}
