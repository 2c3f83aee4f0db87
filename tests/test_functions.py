import html
import re
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pagetide.functions import feeds, text, urls
from pagetide.functions import html as H


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in rows.select("i", make(F.col("v"))).orderBy("i").collect()]


def test_normalize_whitespace(spark):
    got = column(spark, ["  a\t b \r\n\r\n\x0bc\f \n", "", " \n ", None, " x \n\x1cy"], text.normalize_whitespace)
    assert got == ["a b\nc\n", "", "", None, "x\ny\n"]


def test_line_count_matches_splitlines(spark):
    values = ["", "a", "a\n", "a\r\nb", "\n\n", "a\x0bb\x0cc\x1cd\x85e f", "a\r"]
    assert column(spark, values, text.line_count) == [len(v.splitlines()) for v in values]


def test_utf8_prefix_never_cuts_a_character(spark):
    assert column(spark, ["abc", "aéz", "a€", "🙂🙂", None], lambda c: text.utf8_prefix(c, 2)) == ["ab", "a", "a", "", None]


def test_stamps_are_strict(spark):
    got = column(spark, ["20240229T235959Z", "20240230T000000Z", "x", "20240101T000000Zx"], lambda c: text.parse_stamp(c).cast("string"))
    assert got == ["2024-02-29 23:59:59", None, None, None]


def test_content_types(spark):
    bodies = ["%PDF-1", " <?xml version='1'?><!DOCTYPE html>", "<?xml version='1'?><a/>", "<rdf:RDF>", "<P>x", "plain < text"]
    assert column(spark, bodies, text.sniff_content_type) == ["application/pdf", "text/html", "application/xml", "application/rss+xml", "text/html", "text/plain"]
    assert column(spark, ["a.PDF", "b.htm", "c"], text.guess_content_type) == ["application/pdf", "text/html", "text/plain"]
    assert column(spark, ["text/html; Charset='UTF-8'", "text/html"], text.charset) == ["utf-8", None]


@pytest.mark.parametrize("base", ["https://h.example/a/b/c?q=1#f", "http://h.example"])
def test_resolve_matches_the_standard_library(spark, base):
    refs = ["x", "./x", "../x", "../../../x", "/x/../y", "?n=2", "#g", "//other/z", "https://o.example/q", "", " x ", "g/./h", "..", "x?y/../z"]
    got = column(spark, refs, lambda c: urls.resolve(F.lit(base), c))
    assert got == [urljoin(base, r.strip()) for r in refs]


def test_credential_urls(spark):
    bad = ["https://u:p@h/", "https://h/?token=1", "https://h/?a=1;api_key=2", "https://h/#access_token=3", "https://h/?next=token%3Dx", "https://h/?u=https%3A%2F%2Fa%3Ab%40c%2F", "https://hooks.slack.com/services/T/B", "https://discord.com/api/webhooks/1", "https://h/?X-Amz-Signature=1", "https://h/?x%2525252525252525=1", "https://h/?API.KEY=1"]
    good = ["https://h/", "https://h/?q=1#top", "https://h/token/key?page=2", "https://h/a%20b"]
    assert column(spark, bad + good, urls.has_credentials) == [True] * len(bad) + [False] * len(good)


def test_watchable_urls_and_ids(spark):
    assert column(spark, ["ftp://h/", "https://", "https://h/#x", "https://h/?sig=1", "https://h/#", None], urls.url_problem) == [
        "no web address", "no web address", "fragment", "credentials", None, "no web address",
    ]
    (got,) = column(spark, ["https://u@WWW.Ex-ample.org:80/a"], urls.target_id)
    assert re.fullmatch(r"www-ex-ample-org-[0-9a-f]{12}", got)
    assert column(spark, ["10.0.0.1", "8.8.8.8", "300.1.1.1", "x"], urls.ipv4_number) == [167772161, 134744072, None, None]


def test_references_decode(spark):
    values = ["a &amp; b &lt;&#65;&#x20AC;&eacute;", "&amp x", "&unknown; &", "plain"]
    assert column(spark, values, H.decode_references) == [html.unescape(v) if "unknown" not in v else v for v in values]
    values = ["&ampfoo &notit; &NotEqualTilde; &CounterClockwiseContourIntegral; &copy &copycat", "&Ntilde&eacute;"]
    assert column(spark, values, H.decode_references) == [html.unescape(v) for v in values]


def test_odd_pages_neither_recurse_nor_hang(spark):
    """A stray bracket before a megabyte, a hundred thousand lines, a megabyte of broken quotes."""
    import time

    for page in ("<p>1 < 2 " + "x" * 1_000_000, '<a b="' * 150_000, "<" * 100_000):
        began = time.time()
        (got,) = column(spark, [page], lambda c: F.length(H.to_lines(c, F.lit("https://h/"))))
        assert int(got) > 0 and time.time() - began < 60
    marker = "[a:href:sha256:" + "0" * 64 + "]\n"
    assert column(spark, ["line\n" * 100_000 + marker, marker + "x\n", "x\n", marker, "x\n" + marker + marker], H.markers_trail, "string") == [True, False, False, True, True]
    assert column(spark, ["1 < 2 <b>x</b>"], lambda c: H.to_lines(c, F.lit("https://h/"))) == ["1 < 2 x\n"]


def test_addresses(spark):
    import ipaddress

    six = ["2001:4860:4860::8888", "::1", "::", "fe80::1", "2001:DB8::1", "::ffff:8.8.8.8", "64:ff9b::1.2.3.4", "1:2:3:4:5:6:7:8", "1::8", "ff02::1", "2606:4700::"]
    assert column(spark, six, urls.address_hex) == [ipaddress.ip_address(a).packed.hex() for a in six]
    assert column(spark, ["1::2::3", "12345::", ":1", "1:2:3", "1:2:3:4:5:6:7:8:9", "[::1]", "x", None], urls.address_hex) == [None] * 8
    from pagetide.operators.addresses import public_addresses

    rows = spark.createDataFrame([(a,) for a in [*six, "8.8.8.8", "10.1.2.3", "192.0.0.9"]], "a string")
    assert {r["a"] for r in public_addresses(rows, "a").where("public").collect()} == {"2001:4860:4860::8888", "1:2:3:4:5:6:7:8", "1::8", "2606:4700::", "8.8.8.8", "192.0.0.9"}


PAGE = """<html><head><base href="/dir/"><style>p{}</style><script>if(a<b)x("</p>")</script></head><body><!-- <p>no</p> -->
<p>One <b>bold</b> text<br>next&nbsp;line</p><a href="x?a=1&amp;b=2#f">go</a><form action="/post"><input formaction="i"></form>"""


def test_pages_become_lines_and_links(spark):
    rows = spark.createDataFrame([(1, "https://h.example/p", PAGE)], "page_id int, url string, html string")
    r = rows.select(H.to_lines(F.col("html"), F.col("url")).alias("t"), H.links(F.col("html"), F.col("url")).alias("l")).first()
    assert [x["destination"] for x in r["l"]] == ["https://h.example/dir/x?a=1&b=2#f", "https://h.example/post", "https://h.example/dir/i"]
    lines = r["t"].splitlines()
    assert lines[:2] == ["One bold text", "next\xa0line".replace("\xa0", "\xa0")] and lines[3] == "go"
    assert [re.sub("[0-9a-f]{64}", "H", x) for x in lines if x.startswith("[")] == ["[a:href:sha256:H]", "[form:action:sha256:H]", "[input:formaction:sha256:H]"]


def test_links_past_the_limit_share_one_marker(spark):
    page = "".join(f'<a href="/{i}">t</a>' for i in range(503))
    (got,) = column(spark, [page], lambda c: H.to_lines(c, F.lit("https://h/")))
    assert got.count("[a:href:") == 500 and "[omitted-destinations:3:sha256:" in got


RSS = "<rss><channel><item><guid>b</guid><link>https://x/1</link><title>T</title></item><item><guid>https://a/</guid><title>U</title></item></channel></rss>"
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>i</id><link rel="self" href="https://s"/><link href="https://y/2"/><title>A</title><content>c</content></entry></feed>'


def test_feeds(spark):
    rows = spark.createDataFrame([("r", RSS), ("a", ATOM), ("d", "<!DOCTYPE x>" + RSS)], "feed string, xml string")
    got = {(r.feed, r.pos): (r.identity, r.title, r.link) for r in feeds.feed_entries(rows, "feed").collect()}
    assert got == {("r", 0): ("b", "T", "https://x/1"), ("r", 1): ("https://a/", "U", None), ("a", 0): ("i", "A", "https://y/2")}
    swapped = RSS.replace("<item><guid>b</guid><link>https://x/1</link><title>T</title></item>", "").replace("</channel>", "<item><guid>b</guid><link>https://x/1</link><title>T</title></item></channel>")
    text = lambda *xml: [r["text"] for r in feeds.feed_text(spark.createDataFrame(list(enumerate(xml)), "k int, xml string"), "k").orderBy("k").collect()]
    one, two = text(RSS, swapped)
    assert one == two and "[guid:sha256:" in one and "https://a/" not in one
    # Any field that changes shows: date, author, enclosure, a link behind the first.
    base = "<rss><channel><item><guid>b</guid><pubDate>{}</pubDate><author>{}</author><enclosure url='{}'/><link>1</link><link>{}</link></item></channel></rss>"
    same = ["d", "a", "/m", "2"]
    seen = text(*[base.format(*[x + ("!" if i == k else "") for i, x in enumerate(same)]) for k in range(-1, 4)])
    assert len(set(seen)) == 5


def test_feed_bases_and_links(spark):
    rss = """<feed xml:base="https://b.example/x/"><entry xml:base="y/"><id>1</id><link href="p"/><link rel="enclosure" href="q"/><content type="html"><![CDATA[<a href="/z">k</a>]]></content><a href="r">t</a></entry></feed>"""
    rows = spark.createDataFrame([("f", rss)], "feed string, xml string")
    assert [(r["nth"], r["link"]) for r in feeds.feed_links(rows, "feed").orderBy("nth").collect()] == [(0, "https://b.example/x/y/p"), (1, "https://b.example/z"), (2, "https://b.example/x/y/r")]


def test_feed_bases_are_inherited_by_depth(spark):
    rss = """<rss><channel><item xml:base="https://a.example/i/"><content xml:base="https://b.example/c/"><a href="x">t</a><div xml:base="d/"><a href="y">t</a></div></content><a href="z">t</a></item></channel></rss>"""
    rows = spark.createDataFrame([("f", rss)], "feed string, xml string")
    assert [r["link"] for r in feeds.feed_links(rows, "feed").orderBy("nth").collect()] == ["https://b.example/c/x", "https://b.example/c/d/y", "https://a.example/i/z"]
    # The entry's own link is its alternate one, wherever HTML in a field stands.
    early = """<feed><entry><id>1</id><content><![CDATA[<a href="https://in.example/">k</a>]]></content><link href="https://own.example/"/></entry></feed>"""
    (got,) = feeds.feed_entries(spark.createDataFrame([("f", early)], "feed string, xml string"), "feed").collect()
    assert got["link"] == "https://own.example/"


def test_markup_is_read_from_left_to_right(spark):
    """Comments begin outside of raw text only, a > in quotes ends no tag, an attribute's text is no attribute, the last of equal names counts."""
    pages = {
        '<p>A</p><script>var s="<!--";</script><p>B</p>': ("A\nB\n", []),
        '<p>A</p><style>a<b</style><p>B</p>': ("A\nB\n", []),
        '<textarea><p>x</textarea><title>t &amp; <b></title>': ("<p>xt & <b>\n", []),
        '<a title="x > y" href="/z">k</a>': (None, ["https://h.example/z"]),
        "<a data-x=\" href='/evil'\" href=\"/good\">k</a>": (None, ["https://h.example/good"]),
        "<a href='/one' HREF=/two>k</a>": (None, ["https://h.example/two"]),
        "<!-- > <a href='/no'> --><a href=/yes>k</a><!--><a href=/too>k</a>": (None, ["https://h.example/yes", "https://h.example/too"]),
        "<p>A</p><a href='/open": ("A\n<a href='/open\n", []),
    }
    rows = spark.createDataFrame([(k, "https://h.example/p", page) for k, page in enumerate(pages)], "k int, url string, html string")
    got = rows.select("k", H.to_lines(F.col("html"), F.col("url")).alias("t"), H.links(F.col("html"), F.col("url")).alias("l")).orderBy("k").collect()
    for row, (text, links) in zip(got, pages.values(), strict=True):
        assert [x["destination"] for x in row["l"]] == links
        assert text is None or row["t"] == text
