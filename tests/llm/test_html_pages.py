"""Main texts of pages where the host's vote, tags and words must not lose the article; and of all pages of a test table
against a plain reading of their one template."""

import html
import os
import re

import pytest

from stratagraph.llm import html_text, warc

FOLDER = "/root/testdata/sf0.001"


def texts(spark, rows):
    got = html_text.main_texts(spark.createDataFrame([(i, f"http://{h}/{i}", x) for i, (h, x) in enumerate(rows)], "page_id long, url string, html string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    return {r.page_id: r.text for r in got.collect()}


def test_an_article_beside_the_hosts_path(spark):
    """A page whose article lies elsewhere keeps it; a block that other pages passed over doesn't become one."""
    long, side = "words of an article and more of it " * 18, "a long block beside each article of this host " * 12
    usual = [("h", f"<div class='main'><p>{k} {long}</p></div><div class='rail'>{side}</div>") for k in range(4)]
    odd = [("h", f"<div class='main'><p>tiny</p></div><article><p>{long}</p></article>"), ("h", f"<div class='main'><p>A short article.</p></div><div class='rail'>{side}</div>")]
    got = texts(spark, usual + odd)
    assert got[0] == f"0 {long}".strip() and got[4] == long.strip() and got[5] == "A short article."


def test_tags_that_belong_to_an_article(spark):
    rows = [
        ("a", "<article><p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi></math> holds <svg><text>here</text></svg> <object>too</object></p></article>"),
        ("b", "<header>Site name</header><article><header class='post-header'><h1>Title</h1></header><p>Body of it.</p><footer>Tags</footer></article>"),
        ("c", "<article><p>What was written.</p></article><div class='user-comments'><p>What readers said about it.</p></div>"),
        ("d", "<main><div class='user-guide'><p>How to use it.</p></div></main>"),
    ]
    assert texts(spark, rows) == {0: "Energy E=m holds here too", 1: "Title\nBody of it.", 2: "What was written.", 3: "How to use it."}


def test_no_pages(spark):
    assert texts(spark, []) == {}
    assert texts(spark, [("x", None), ("x", ""), (None, "<p>one")]) == {0: "", 1: "", 2: "one"}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_all_pages_of_a_table(spark):
    """Their template: a menu, an advert, one article of h1 and p, a footer."""
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    got = {r.page_id: r.text for r in html_text.main_texts(spark.read.parquet(f"{FOLDER}/pages.parquet")).collect()}
    for r in pages:
        article = "".join(re.findall(r"<article>(.*?)</article>", r.html or "", re.S))
        blocks = [html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br[^>]*>", " ", b))) for b in re.split(r"</?(?:h1|p|div|ul|li|article)\b[^>]*>", re.sub(r"(?s)<!--.*?-->|<script.*?</script>", "", article))]
        want = "\n".join(t for t in (re.sub(r"\s+", " ", b).strip() for b in blocks) if t)
        assert got[r.page_id] == want, r.page_id


def test_warc_header_in_another_encoding():
    body = b"payload"
    raw = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nWARC-Target-URI: http://x/\xe9\r\nContent-Length: 7\r\n\r\n" + body + b"\r\n\r\n"
    got = warc.parse(raw)
    assert (got["page_id"], got["payload"], got["url"]) == (7, body, "http://x/é")
