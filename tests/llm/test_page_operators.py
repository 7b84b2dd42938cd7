"""URL filter, archives and page extraction."""

import base64
import gzip
import hashlib
import os
from collections import Counter

import pytest

from paymend.llm import html_extract, url_filter, warc

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def plain_verdict(url):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail.split("?")[0].split("#")[0]
    fit = [(r, v) for r, v in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    rule, verdict = max(fit, key=lambda f: len(f[0]), default=(None, "allow"))
    return host, path, rule, verdict


def test_url_filter_matches_a_plain_scan(pages, no_pages):
    got = url_filter.filter_urls(pages).collect()
    want = Counter((r.page_id, *plain_verdict(r.url)) for r in pages.select("page_id", "url").collect())
    assert Counter(tuple(r) for r in got) == want
    assert url_filter.filter_urls(no_pages).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, [], "block").collect()} == {"block"}


@pytest.mark.parametrize("url", ["https://a.example.net/en/1", "http://x.net/fr", "https://aexample.com/de/1", "https://org/fr/", "https://x.net", "a://b.net?q=/", "http:///net/", "https://u@x.net:8/"])
def test_single_urls(url, tmp_path):
    index = url_filter.RuleIndex(url_filter.write_index(RULES, str(tmp_path)))
    host, path = url_filter.split_url(url)
    got = index.match([index.candidates(host, path)])[0]
    assert (host, path, got and got[0], got[1] if got else "allow") == plain_verdict(url)


def test_equal_digests_are_told_apart_by_their_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda data: len(data))
    index = url_filter.RuleIndex(url_filter.write_index([("abc/", "block"), ("xyz/", "allow")], str(tmp_path)))
    found = index.match([index.candidates(h, "/") for h in ("abc", "xyz", "qqq")])
    assert found == [("abc/", "block"), ("xyz/", "allow"), None]
    assert os.path.getsize(next(tmp_path.iterdir())) < 300


def test_archives_round_trip(pages, no_pages):
    got = warc.round_trip(pages).collect()
    rows = pages.select("page_id", "url", "html").collect()
    first = {}
    for r in rows:
        first[r.html or ""] = max([x for x in (first.get(r.html or ""), r.page_id) if x is not None], default=None)
    want = Counter()
    for r in rows:
        body = (r.html or "").encode()
        top = first[r.html or ""]
        kind = "response" if top is None or r.page_id == top else "revisit"
        name = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want[r.page_id, r.url, kind, top if kind == "revisit" else None, len(body), name, body if kind == "response" else None] += 1
    assert Counter((r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload and bytes(r.payload) if r.payload != b"" else b"") for r in got) == want
    assert all(r.intact for r in got)
    assert warc.round_trip(no_pages).count() == 0
    large = warc.round_trip(pages, smallest=10).collect()
    assert {r.record_type for r in large if r.payload_bytes < 10} == {"response"}


def test_index_finds_single_records_in_the_files(pages, tmp_path):
    folder = f"file://{tmp_path}/w"
    index = warc.write_archives(pages, folder)
    for r in index.collect():
        with open(r.file, "rb") as f:
            f.seek(r.offset)
            data = f.read(r.length)
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")
        assert warc.parse(data)["page_id"] == r.page_id and warc.parse(data)["payload_digest"] == r.digest
    some = index.where("page_id in (4, 9)")
    assert sorted(r.page_id for r in warc.read_records(some, folder).collect()) == sorted(r.page_id for r in some.collect())


def test_damage_is_noticed():
    data, _ = warc.record(1, "u", b"payload", None, False)
    content = gzip.decompress(data)
    assert warc.parse(data)["intact"] and not warc.parse(gzip.compress(content.replace(b"payload", b"pAyload")))["intact"]


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x="</p><p>no";</script></head><body>
<header><p>Site head</p></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>hidden</p> -->
<div class="ad">Buy</div><div id="cookie-notice"><p>We use cookies</p></div>
<main><article><header><h1>Main &amp; title</h1></header><p><b>First  line<br>goes on<p>Second &eacute;&#33; a < b</p>
<ul><li>one<li>two</ul><pre>kept   text</pre><table><tr><td>c1<td>c2</table>tail</article></main>
<section class="comments"><p>I agree</p></section><form><input value="x">Search</form><aside>More</aside><footer>&copy; foot</footer></body></html>"""
TEXT = "Main & title\nFirst line goes on\nSecond é! a < b\none\ntwo\nkept text\nc1\nc2\ntail"


def test_extraction_of_one_page(spark):
    rows = [(1, "http://h/x", PAGE), (2, None, None), (3, "", ""), (4, "http://h/y", "<p>open <b>text <p>cut off <a href='"), (5, "http://h/z", "only words")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: TEXT, 2: "", 3: "", 4: "open text\ncut off", 5: "only words"}


@pytest.mark.parametrize(
    "page, text",
    [
        ('<html><body class="has-sidebar"><p>Whole text</p></body></html>', "Whole text"),
        ('<html class="no-comments"><body id="search"><p>Whole text</p>', "Whole text"),
        ('<body><div class="content no-comments"><p>Whole text</p></div></body>', "Whole text"),
        ('<body><main id="search-content"><p>Whole text</p></main></body>', "Whole text"),
        ('<body><article class="promo"><div class="article-header"><h1>Title</h1></div><div class="header">Sub</div><p>Text</p></article>', "Title\nSub\nText"),
        ('<body><div class="widget"><main><p>In main</p></main></div><div class="widget">Weather</div>', "In main"),
        ('<body><form id="f"><div class="related"><div role="main">In a form</div></div></form><form>Search</form>', "In a form"),
        ('<body><nav><ul><li>Menu<main><p>After an open menu</p></main>', "After an open menu"),
        ('<body><article><p>Text</p><section class="comments"><article class="comment-12">I agree</article></section></article>', "Text"),
        ('<html><head><title>t</title><meta charset="utf-8"><body><p>No end of head</p></body></html>', "No end of head"),
        ("<html><head><title>t</title><p>No body tag</p>", "No body tag"),
        ("<head><title>t</title> <b>Bold</b> text", "Bold text"),
        ("<head><style>p{}</style> bare words", "bare words"),
        ('<body><div class="sidebar2">x</div><div class="big ad">y</div><div role="complementary">z</div><p>Text</p>', "Text"),
        ("<p title=it's>Hello world</p><p>It's fine</p><p>Third</p>", "Hello world\nIt's fine\nThird"),
        ("<p title = 'a > b' alt=\"c > d\" x=y\"z>Hello</p><p data-x=\" class=ad \">More</p>", "Hello\nMore"),
        ("<form id=aspnetForm><div id=content><h1>Title</h1><p>Text</p></div></form>", "Title\nText"),
        ("<div id=search><div class=post><p>One line</p><p>Two lines</p></div></div><form>Search</form>", "One line\nTwo lines"),
        ('<div class="post related"><h1>Title</h1><p>Text of it</p></div><div class=nav-links>Next</div>', "Title\nText of it"),
        ("<h1>T</h1><p>Short</p><div class=comments><p>I agree with all of this</p><p>So do I</p></div>", "T\nShort"),
        ("<article><p>Text</p></article>" + "".join(f"<div class={c}><p>x</p><p>y</p></div>" for c in ("comments-section", "post-comments", "nav-links", "ad-box", "site-nav", "cookie-bar", "site__nav", "ad_slot3")), "Text"),
        ('<div class="has-sidebar"><div class="comments-open search-content"><p>Text</p></div></div>', "Text"),
        ("<form><p>Name</p><input></form>", ""),
    ],
)
def test_articles_are_not_lost_by_a_name(page, text):
    assert "\n".join(t for _, furniture, _, t in html_extract.blocks(page) if not furniture) == text


def test_entropy_removes_what_a_host_repeats(spark):
    rows = []
    for i in range(40):
        same = i if i % 2 else 0  # half of the pages are copies of one article
        rows.append((i, f"http://H{i % 2}.org/{i}", f"<div class='x{i}y'><div class=box><span>Call us today</span></div><p>Article {same} tells of {same * 7}.</p><p>And more {same}.</p></div>"))
    rows.append((99, "http://single.org/", "<div><div class=box>Call us today</div><p>Alone</p></div>"))
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Article {i} tells of {i * 7}.\nAnd more {i}." for i in range(1, 40, 2))
    assert got[0] == got[2] and "Article 0" in got[0]  # copies are one page: nothing is called noise there
    assert got[99] == "Call us today\nAlone"


def test_tree_removes_repeated_contents_of_a_shared_path(spark):
    def page(i, n):
        items = "".join(f"<li class={'on' if k == i % 4 else 'off'}>Item {k}</li>" for k in range(4))
        return f"<body><div class=box><ul>{items}</ul></div><article><p>Please mind our new terms.</p><p>Text {i} of {n}.</p><p>{'Half' if i % 8 else 'Other'} {i % 8}</p></article></body>"

    rows = [(i, f"http://h/{i}", page(i, 40)) for i in range(40)] + [(100 + i, f"http://few/{i}", page(i, 3)) for i in range(3)]
    got = {r.page_id: r.text.split("\n") for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == [f"Text {i} of 40.", f"{'Half' if i % 8 else 'Other'} {i % 8}"] for i in range(40))
    assert all("Please mind our new terms." in got[100 + i] and len(got[100 + i]) == 7 for i in range(3))  # too few pages to tell


def test_extraction_keeps_rows(pages, no_pages):
    got = html_extract.extract(pages).collect()
    assert Counter((r.page_id, r.url) for r in got) == Counter((r.page_id, r.url) for r in pages.select("page_id", "url").collect())
    assert html_extract.extract(no_pages).count() == 0
