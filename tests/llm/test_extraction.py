"""op13: blocks of awkward markup, and template removal against plain counts."""

import html
import random
import re

import pytest

from slidegrid.llm import extraction as X
from slidegrid.llm.markup import Page
from slidegrid.session import table

SF = "/root/testdata/sf0.01"


def text(markup):
    page = Page(markup)
    return page.text(page.kept())


@pytest.mark.parametrize("markup, wanted", [
    ("", ""), ("plain  words\n here", "plain words here"), ("a &lt;b&gt; &amp;amp; &eacute;&#x1F600;&nbsp;c", "a <b> &amp; é\U0001F600 c"),
    ("<p>one<p>two<b>bold<p>three", "one\n\ntwobold\n\nthree"), ("<p>a<br>b</p>c", "a b\n\nc"), ("<p>a<b>b</b><i>c</i> d</p>", "abc d"),
    ("x<script>var t='</p><p>no';</script>y<style>p{}</style>z<!-- <p>no</p> -->!", "xyz!"), ("<script>never closed <p>no", ""), ("a<!-- never closed", "a"),
    ("1 < 2 <3 <", "1 < 2 <3 <"), ("a<b", "a"), ('<p title="a>b">c</p>', "c"), ("<p title='x>c</p>d", "cd".replace("cd", "c\n\nd")), ("</p></div>a", "a"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "a\n\nb\n\nc"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\n\nc"),
    ("<nav>menu</nav><header>site</header><div class='ad'>buy</div><p>text</p><aside>side</aside><footer>foot</footer>", "text"),
    ("<div class=x><p>out</p></div><article><header><p>by me</p><h1>Head</h1></header><p>in</p><form>f</form></article><p>out</p>", "Head\n\nin"),
    ("<main><h1>T</h1><article><p>a</p></article><article><p>b</p></article></main><p>o</p>", "T\n\na\n\nb"), ("<main><p>m</p><div id='Comments'>c</div></main>o", "m"),
    ("<div class='site-wrap has-sidebar'><p>long enough main text of it</p></div><div class='sidebar'>s</div>", "long enough main text of it"),
    ("<section id=comments><article class=comment>c</article></section><div><p>body text</p></div>", "body text"), ("<p hidden>h</p><p style='display: none'>n</p><p>v</p>", "v"),
    ("<form><p>the whole page lies in a form</p></form>", "the whole page lies in a form"), ("<div class='cookie-notice'><h1>x</h1></div><article>a</article>", "a"),
    ("<article><p>t</p><div class='reader comments'>c</div></article>", "t"), ("<title>t</title><body><p>b", "b"), ("\ud800<p>lone", "\ud800\n\nlone"),
])
def test_blocks(markup, wanted):
    assert text(markup) == wanted


def test_depth_and_length_do_not_matter():
    assert text("<div>" * 100_000 + "deep") == "deep"
    assert len(text("<p>" + "word " * 300_000)) == 5 * 300_000 - 1
    assert text('<a "' * 2_000 + ">x") == "x"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "mine", "theirs") for i, u, h in rows], "page_id long, url string, html string, host string, text string")


def site(n, host, block, at=lambda i: True):
    return [(i, f"http://{host}/p{i}", f"<div><p>story {host} {i}</p><p>and more {i}</p></div>" + (block if at(i) else "")) for i in range(n)]


def test_templates_go(spark):
    block = "<div><p>Join <b>us</b> now</p><p>every day</p></div>"
    rows = site(40, "A.net", block) + site(40, "b.net", block, lambda i: i % 2) + site(4, "c.net", block) + site(40, "d.net", "")
    rows += [(90, None, block), (91, "http://a.net/x", None), (92, "http://a.net/y", ""), (0, "http://a.net/p0", rows[0][2])]
    frame = pages(spark, rows)
    for bytes_ in (X.BROADCAST_BYTES, 0):
        got = {}
        for r in X.extract(frame, broadcast_bytes=bytes_).collect():
            assert r["n_chars"] == len(r["text"])
            got.setdefault((r["page_id"], r["url"]), []).append(r["text"])
        told = "Join us now\n\nevery day"
        for i, u, h in rows:
            if h and u and "story" in h:
                host = u.split("/")[2]
                body = re.findall(r"<p>((?:story|and)[^<]*)</p>", h)
                wanted = "\n\n".join(body + ([told] if told.split("\n")[0].split()[0] in h and host.lower() in ("b.net", "c.net") else []))
                assert got[(i, u)][0] == wanted, (i, u)
        assert got[(90, None)] == [told] and got[(91, "http://a.net/x")] == got[(92, "http://a.net/y")] == [""] and len(got[(0, "http://a.net/p0")]) == 1


def test_copies_of_a_page_are_one_page(spark, hot):
    """A story on most pages of a host is no template when those pages are copies; a block on many different pages is."""
    rng = random.Random(2)
    rows = [(i, f"http://e.net/{i}", "<p>the same story</p><p>with two blocks</p>") for i in range(70)]
    rows += [(100 + i, f"http://e.net/q{i}", f"<p>other {rng.random()}</p><p>shared tail</p>") for i in range(30)]
    got = {r["page_id"]: r["text"] for r in X.extract(pages(spark, rows)).collect()}
    assert all(got[i] == "the same story\n\nwith two blocks" for i in range(70))
    assert all(got[100 + i].startswith("other") and "tail" not in got[100 + i] for i in range(30))


def test_counts_equal_a_plain_loop(spark):
    frame = pages(spark, site(25, "a.net", "<ul><li>x</li><li>y</li></ul>") + site(9, "b.net", "<p>z</p>", lambda i: i < 6))
    seen = {}
    for r in frame.collect():
        page = Page(r["html"])
        keep = page.kept()
        for tree in page.subtrees(keep):
            seen.setdefault((r["url"].split("/")[2], tree), set()).add(page.text(keep))
    want = {}
    for (host, tree), texts in seen.items():
        if len(texts) >= 5 and len(texts) >= 0.6 * (25 if host == "a.net" else 9):
            want.setdefault(host, set()).add(tree)
    assert {r["host"]: {bytes(t) for t in r["recurring"]} for r in X.templates(frame).collect()} == want and len(want["a.net"]) == 3


def test_empty_table(spark):
    assert X.extract(pages(spark, [])).count() == 0


def test_given_pages(spark):
    """The given pages name their article; its blocks are lines and headings."""
    frame = table(spark, SF, "pages")
    got = {r["page_id"]: r["text"] for r in X.extract(frame).collect()}
    for r in frame.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S).group(1)
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?p>|</?h1>", article))
        assert got[r["page_id"]] == "\n\n".join(b for b in blocks if b)
