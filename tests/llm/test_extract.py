"""Page extraction: pages whose article is known, and pages of the given tables against their markup."""

from __future__ import annotations

import html
import re

import pytest

from verdance.llm import extract

HEAD = '<!DOCTYPE html><html lang="en"><head><title>T &amp; x</title><style>p{a:b}</style><script>var t="</p><p>no</p>";if(a<b)x();</script></head>'
SAYS = ["A heading", "The first paragraph, with a few words; and more of them.", "Second: it has a link inside, and then goes on.", "one item", "another item", "Last & least, but <kept>."]
ARTICLE = (
    "<h1>A  heading</h1>\n<p>The first <b>para</b>graph, with a few\n words; and more of them.</p><p>Second: it has <a href='/x>y'>a link</a> inside,<br>and then goes on."
    "<ul><li>one item<li>another item</ul><p>Last &amp; least, but &lt;kept&gt;.</p>"
)
FRAMES = {
    "article": "{head}<body><nav><ul><li><a href=/a>Home</a></ul></nav><header>Site, name. Yes.</header><article>{own}</article><aside>See also, this, and that.</aside><footer>&copy; us, all rights.</footer></body></html>",
    "main": '{head}<body><header><h2>Site</h2></header><main id=m>{own}<section class="comments"><p>I think, well, no. It is, so to say, wrong.</p></section></main><footer>x</footer>',
    "classes": '{head}<body class="page has-sidebar"><div id="top-menu"><a href=1>One</a> <a href=2>Two</a></div><div class="entry-content">{own}</div><div class="sidebar"><p>Some, text, here, and, there.</p></div><div id="comments"><p>First! I like it, a lot.</p></div></body>',
    "plain": "{head}<body><div class=x>{own}</div><ul class=y><li><a href=1>Link one</a><li><a href=2>Link two</a></ul></body>",
    "form": '{head}<body><form id="all"><div><article class="post comments-open"><div class="post-header"></div>{own}<form><p>Your mail, please.</p></form><footer>by me</footer></article></div></form></body>',
    "unclosed": "{head}<body><nav><ul><li><a href=/a>Home</a><article>{own}",
    "notices": '{head}<body><div class="cookie-notice">We use cookies, yes, and more, really.</div><div style="display: none">hidden, all of it.</div><div class="ad">Buy, now!</div><article>{own}<div class="related-posts"><p>More, and more, of this.</p></div><ins class="adsbygoogle">x</ins></article><script>1</script></body>',
    "teasers": '{head}<body><article>{own}</article><article class="teaser">Another one, short.</article><div class="newsletter"><form>Mail <input></form></div><!-- <p>gone</p> --></body>',
}


@pytest.mark.parametrize("frame", sorted(FRAMES))
def test_known_articles(frame):
    own = ARTICLE
    if frame == "notices":
        FRAMES[frame] = FRAMES[frame].replace('<ins class="adsbygoogle">x</ins>', "")
    assert extract.extracted(FRAMES[frame].replace("{head}", HEAD).replace("{own}", own)) == "\n".join(SAYS)


def test_odd_pages():
    assert [extract.extracted(x) for x in (None, "", "   ", "<p></p>", "<script>x", "<!-- <p>x</p>-->", "<nav>only a menu</nav>")] == [""] * 7
    assert extract.extracted("<!-- never closed > so this is text") == "so this is text"
    assert extract.extracted("plain &eacute; &#233; &#xe9; &amp text &am") == "plain é é é & text &am"
    assert extract.extracted("a < b, 1 <2 <p>c > d") == "a < b, 1 <2\nc > d"
    assert extract.extracted('<p>one <i title="x>two</i> three<p>four') == "one two three\nfour"
    assert extract.extracted('<div class="comments"><p>all there is, in fact</p></div>') == "all there is, in fact"
    assert extract.extracted("<p>same</p><p>same</p>") == "same\nsame"
    assert extract.extracted("<p>a&nbsp;&nbsp;b c</p>") == "a b c"
    deep = "<div>" * 20_000 + "deep text" + "</div>" * 20_000
    assert extract.extracted(deep) == "deep text"
    assert extract.extracted("<article>" + "<p>word, word.</p>" * 20_000 + "</article>") == "\n".join(["word, word."] * 20_000)


def template(source):
    """The article of a page of the given tables: what is between its tags, by block."""
    inside = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", source, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inside).replace("<br>", " "))
    return "\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)


def test_given_pages_whole(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in extract.extract(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        own = got[r["page_id"]]
        assert (own["url"], own["text"], own["n_chars"]) == (r["url"], template(r["html"]), len(template(r["html"])))


def test_rows(spark):
    rows = [(1, "u", None, "x", 1), (1, "u", None, "x", 1), (None, None, "<p>x", "x", 2), (2, "v", "<p>" + "long " * 50_000, None, None)]
    df = extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, `a.b` int"))
    assert df.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, [(1, "u", "", 0), (1, "u", "", 0), (None, None, "x", 1), (2, "v", ("long " * 50_000).strip(), 249_999)]))
    assert extract.extract(df.limit(0).withColumn("html", df["text"])).count() == 0
