"""HTML extraction: the given pages against their known template, and hand-made pages."""

import html
import re
import time

from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from strandwork.llm import html_extraction as H


def template(page):
    """What the article of a given page holds: its blocks by the template's own tags."""
    body = re.search(r"(?s)<article>(.*?)(?:</article>|<footer>|$)", page)[1]
    blocks = (" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1|article)>", body))
    return "\n\n".join(b for b in blocks if b)


def test_given_pages(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = rows(H.op9_html_extraction(spark, sf))
    assert len(found) == len(pages)
    for r in found:
        assert r["url"] == pages[r["page_id"]].url and r["n_chars"] == len(r["text"])
        assert r["text"] == template(pages[r["page_id"]].html), r["page_id"]


PROSE = "A long and winding sentence, with commas, that goes on for a while, as prose does, until it ends. " * 3


def page(article, before="", after=""):
    return f"<html><head><title>T</title><script>if (a < b) '</p>'</script></head><body>{before}<div id=main><div class='story'>{article}</div></div>{after}</body></html>"


def test_boilerplate_goes():
    around = "<nav><ul><li><a href=/>Home</a></ul></nav><header><p>Site, name, slogan, and more text</p></header><div class='cookie notice'><p>We use cookies, you know, and such things.</p></div>"
    below = f"<aside class=sidebar><p>{PROSE}</p></aside><form><p>Join, now</p></form><section id='comments'><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></section><footer>&copy; me</footer>"
    got = H.extract(page(f"<h1>Title &amp; more</h1><p>{PROSE}<p>Second\n\n  para <b>bold</b>&nbsp;x<ul><li>one<li>two, <a href=x>linked</a></ul><pre>a  b</pre>", around, below))
    assert got.split("\n\n") == ["Title & more", PROSE.strip(), "Second para bold x", "one", "two, linked", "a b"]


def test_comments_inside_article():
    got = H.extract(page(f"<p>{PROSE}</p><p>{PROSE}</p><div class=comments><p>First!</p></div><div class='ad'>Buy</div>"))
    assert got == f"{PROSE.strip()}\n\n{PROSE.strip()}"


def test_class_words_around_article():
    """Words that say what a page has, or that stand on what holds the article, take nothing away; a long comment section still goes."""
    text = f"{PROSE.strip()}\n\n{PROSE.strip()}"
    inner = f"<p>{PROSE}</p><p>{PROSE}</p>"
    for around in ("<body class='single no-sidebar'><div>{}</div>", "<body class=sidebar><div>{}</div>", "<main class='has-footer'>{}</main>", "<div class='content with-sidebar'>{}</div>", "<article class='related'>{}</article>", "<div class='page sidebar'><div>{}</div></div>"):
        assert H.extract(around.format(inner)) == text, around
        assert H.extract(around.format(inner + "<div class='sidebar'><p>Aside, short</p></div>")) == text, around
    assert H.extract(f"<article><div>{inner}</div></article><section id=comments>{inner * 9}</section>") == text


def test_short_parts_of_article():
    """A short section beside long ones, and headings, lists, tables and figures beside paragraphs, stay."""
    long = f"<p>{PROSE}</p>" * 9
    short = "<h2>Short</h2><p>One, two.</p>"
    want = ["Short", "One, two."] + [PROSE.strip()] * 9
    for tag in ("section", "div"):
        parts = f"<{tag}>{short}</{tag}><{tag}>{long}</{tag}>"
        for page_ in (f"<article>{parts}</article>", f"<main>{parts}</main>", f"<body><div id=x>{parts}</div>"):
            assert H.extract(page_).split("\n\n") == want, page_[:40]
    got = H.extract(f"<div id=x><h2>A</h2><ul><li>b</ul><table><tr><td>c</table><figure><figcaption>d</figcaption></figure><div>{long}</div><h3>e</h3></div>")
    assert got.split("\n\n") == ["A", "b", "c", "d"] + [PROSE.strip()] * 9 + ["e"]


def test_odd(spark):
    assert [H.extract(x) for x in (None, "", "   ", "<p></p>", "<script>x</script>", "<nav><a href=x>a</a></nav>")] == [""] * 6
    assert H.extract("just text &lt;here&gt;") == "just text <here>"
    assert H.extract("<p>caf&eacute; &#128512; &amp;amp; &bogus;") == "café \U0001f600 &amp; &bogus;"
    assert H.extract("</p></div><p>a</b><b>c") == "a c" or H.extract("</p></div><p>a</b><b>c") == "ac"
    deep = "<div>" * 3000 + "<p>deep, text</p>"
    assert H.extract(deep) == "deep, text"
    assert len(H.extract("<p>" + "word, " * 200_000)) == 1_199_999
    df = spark.createDataFrame([(1, None, None, "x"), (1, "u", "<p>a", "x"), (None, "u", "<p>a", "x")], "page_id long, url string, html string, text string")
    assert sorted(r["text"] for r in rows(H.extract_pages(df))) == ["", "a", "a"]


def test_empty(spark, empty_dir):
    assert H.op9_html_extraction(spark, empty_dir).count() == 0


def test_layouts():
    """One article, two long paragraphs and what belongs to them, in many shapes of page; what is around it goes."""
    a, b = PROSE.strip(), PROSE.strip().replace("long", "short")
    body = f"<p>{a}</p><p>{b}</p>"
    around = "<nav><a href=/>Home</a> <a href=/x>News</a></nav><header><h1>Site</h1><p>Its slogan, here</p></header>{}<aside><p>Read also, this, and that</p></aside><footer>Imprint</footer>"
    shapes = {
        "<article>{}</article>": [a, b],
        "<main><section><h2>Summary</h2><p>Short.</p></section><section>{}</section></main>": ["Summary", "Short.", a, b],
        "<article><header><h1>Title</h1><p class=byline>By A. Writer</p></header>{}</article>": ["Title", "By A. Writer", a, b],
        "<h2>Title</h2><div>{}</div><ul><li>First point<li>Second point</ul>": ["Title", a, b, "First point", "Second point"],
        "<main class='no-sidebar'>{}</main>": [a, b],
        "<form action=/><div>{}</div><input name=q></form>": [a, b],
        "<div id=content><div>{}<div class='share price'><p>" + a + "</p></div></div></div>": [a, b, a],
        "<div><div><div><p>Lead, in</p>{}</div></div></div>": ["Lead, in", a, b],
        "<table><tr><td><a href=1>One</a><td>{}</td></tr></table>": [a, b],
        "<section role=main><h1>T</h1>{}<blockquote>Quoted</blockquote><pre>x  = 1</pre></section>": ["T", a, b, "Quoted", "x = 1"],
        "<article>{}<div class='social share'><a href=1>Tweet</a> <a href=2>Post</a></div><div class=related><a href=1>Other</a></div><footer><p>Filed under x</p></footer></article>": [a, b],
        "<div class=post>{}<form><p>Subscribe, now</p></form><div id=comments><p>First, really</p></div></div>": [a, b],
    }
    for shape, want in shapes.items():
        for page_ in (around.format(shape.format(body)), f"<html><body>{around.format(f'<div class=wrap>{shape.format(body)}</div>')}</body></html>"):
            assert H.extract(page_).split("\n\n") == want, shape


def test_time_is_linear_in_nesting():
    import time

    for hostile in ("<div>" * 100_000, "<div><p>x, y" * 30_000, "<li><ul>" + "<div>" * 30_000 + "<li>a</li>" * 30_000, "<b>" * 60_000 + "x" + "</i>" * 60_000):
        start = time.process_time()
        H.extract(hostile)
        assert time.process_time() - start < 10


def test_plain_and_vague_words():
    """Long adverts, notices and forms go; a long block of a vague word stays, a short one or one of links goes."""
    a = PROSE.strip()
    inner = f"<p>{a}</p>" * 4
    for word in ("ad", "advert-box", "site-notice", "comments-header", "cookie-consent widget"):
        assert H.extract(f"<div class=x>{inner}<div class='{word}'><p>{a}</p></div></div>") == "\n\n".join([a] * 4), word
    assert H.extract(f"<div class=x>{inner}<form><p>{a}</p></form></div>") == "\n\n".join([a] * 4)
    for word in ("share price", "social history", "widget-maker", "article-header"):
        assert H.extract(f"<div class=x>{inner}<div class='{word}'><p>{a}</p></div></div>") == "\n\n".join([a] * 5), word
        assert H.extract(f"<div class=x>{inner}<div class='{word}'><p>Short.</p></div></div>") == "\n\n".join([a] * 4), word
        assert H.extract(f"<div class=x>{inner}<div class='{word}'><p><a href=1>{a}</a></p></div></div>") == "\n\n".join([a] * 4), word
    assert H.extract(f"<div class='loading breadth'>{inner}</div>") == "\n\n".join([a] * 4)


MARKUP = ["<", ">", "</", "<!", "<!--", "-->", "<![", "<![CDATA[", "]]>", "<?", "/>", "=", "'", '"', " ", "\n", "a", "p", "div", "<p>", "<a href=x>", "<a>", "</a>", "<svg>", "<script>", "</script>", "<title>", "&", "&#", ";", "&amp;", "\x00", "é", "text, "]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.lists(st.sampled_from(MARKUP), max_size=40).map("".join)))
def test_any_string_gives_a_text(text):
    assert isinstance(H.extract(text), str)


def test_marked_sections(spark):
    assert H.extract("<p>abc</p><![foo[bar]]><p>def</p>") == "abc\n\ndef"
    assert H.extract("<p>x<![<p>y").split() in (["x", "y"], ["xy"])
    assert H.extract("<p>a</p><![ foo") == "a"
    df = spark.createDataFrame([(1, "u", "<p>abc</p><![foo[bar]]><p>def</p>"), (2, "u", "<p>x<![<p>y")], "page_id long, url string, html string")
    assert H.extract_pages(df).count() == 2


def test_links_that_are_none():
    """An anchor without href, an unclosed link, an article within a link; and menus of linked blocks still go."""
    a = PROSE.strip()
    body = f"<h1>T</h1><p>{a}</p><p>{a}</p>"
    want = ["T", a, a]
    for shape in ("<body><a name='top'>{}", "<body><a name=top><article>{}</article>", "<body><div><a href=/x>{}</a></div>", "<body><a href=/x><article>{}</article></a>", "<article><a href=/x>{}</article>", "<div><svg>{}</div>", "<head><title>x</title>{}", "<div><p><svg><path></p>{}</div>"):
        assert H.extract(shape.format(body)).split("\n\n") == want, shape
    menu = "".join(f"<a href=/{i}><div>Topic {i}</div></a>" for i in range(30))
    assert H.extract(f"<div class=top>{menu}</div><div>{body}</div>").split("\n\n") == want


def test_words_within_words():
    """navajo is no nav, a recipe's cookies are no notice, a post's header with its title is none of the site."""
    a = PROSE.strip()
    body = f"<p>{a}</p>" * 3
    for part in (f"<section class=navajo-history><h2>Then</h2><p>{a}</p></section>", f"<section id=cookies><h2>Cookies</h2><p>{a}</p></section>"):
        got = H.extract(f"<article>{body}{part}</article>").split("\n\n")
        assert len(got) == 5 and got[-1] == a, part
    got = H.extract(f"<div class=post><div class='post-header'><h1>Title</h1></div><div class=body>{body}</div></div>")
    assert got.split("\n\n") == ["Title", a, a, a]
    assert H.extract(f"<article>{body}<div class=cookie-notice><p>{a}</p></div></article>") == "\n\n".join([a] * 3)


def test_time_is_linear_in_what_is_unfinished():
    for hostile in ("<a ", "<!--", "<![", "<a x='", "<a x=\"", "</a ", "<p><!--", "<title>", "<textarea><p>", "<script ", "& ", "&#", "<", "<a href=x><p>t", "<svg><p>", "<p>x<a href=1>y"):
        start = time.process_time()
        H.extract("<p>first</p>" + hostile * (1_000_000 // len(hostile)))
        assert time.process_time() - start < 20, hostile
